"""A vector collection: dense ids, exact top-k search, evidence."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.functions import wording as w
from foliospark.sources.staging import arrow_filesystem, stage_table

#: Bytes of the collection's vectors that meet all questions at once, questions of a block, scores held at once.
ROW_BYTES, QUERY_ROWS, SCORES = 32 << 20, 4_096, 1 << 22


def dense_ids(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with id, 0 and up without gaps in the given order.

    A range sort, staged with each row's partition and place in it; the rows of each partition are
    counted, and the sums before it joined back. Only one number a partition is sent to all tasks, and
    no window takes all rows into one task.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the generated number is the partition's, shifted by 33 bits, plus the place
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    staged = stage_table(placed.select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")).drop("__at"), "ids")
    counts = sorted((r[0], r[1]) for r in staged.groupBy("__part").count().collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame([(p, before[k]) for k, (p, _) in enumerate(counts)], "__part long, __before long")
    return staged.join(F.broadcast(offsets), "__part").withColumn("id", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def _best(keys: np.ndarray, m: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of the rows (keys, m) for each of a block of queries."""
    lengths, norms = np.linalg.norm(m, axis=1)[None, :], np.linalg.norm(queries, axis=1)[:, None]
    step = max(1, SCORES // len(keys))
    for q in range(0, len(asked), step):
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (queries[q : q + step] @ m.T) / (norms[q : q + step] * lengths)
        score[~np.isfinite(score)] = -2.0
        # all that tie with the k-th at six places stay, so that ties are cut by id later
        cut = np.partition(score, -k, axis=1)[:, -k, None] - 1e-6 if score.shape[1] > k else -2.0
        at, row = np.nonzero((score >= cut) & (score > -2.0))
        yield pa.RecordBatch.from_arrays([pa.array(asked[q + at]), pa.array(keys[row]), pa.array(score[at, row])], ["query_id", "id", "score"])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _search(questions: str, k: int):
    """Arrow batches of (id, vector) -> the best k of each ROW_BYTES of them for every question of a staged table."""

    def blocks() -> Iterator[pa.RecordBatch]:
        fs, root = arrow_filesystem(questions)
        yield from dataset.dataset(root, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_ROWS, columns=["query_id", "vector"], batch_readahead=1, fragment_readahead=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            keys, m = (np.concatenate([h[n] for h in held]) for n in range(2))
            held.clear()
            for q in blocks():
                if len(q):
                    yield from _best(keys, m, q.column("query_id").to_numpy(), _matrix(q.column("vector"), len(q)), k)

        for b in batches:
            b = b.filter(b.column("vector").is_valid())
            if len(b):
                held.append((b.column("id").to_numpy(), _matrix(b.column("vector"), len(b))))
                if sum(h[1].nbytes for h in held) >= ROW_BYTES:
                    yield from close()
        if held:
            yield from close()

    return run


def top_k(collection: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, id, score): the exact k nearest by cosine, rounded to 6 places, ties by id.

    ``collection`` has id and vector, ``queries`` has query_id and vector. The questions are staged in the
    shared folder; one job goes over the collection once, each task holds ROW_BYTES of it at a time and
    streams all questions past them in blocks of QUERY_ROWS. A task keeps k rows for each question and
    ROW_BYTES, so neither the driver nor the shuffle sees a vector. Vectors without length are skipped.
    """
    asked = stage_table(queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "questions")
    rows = collection.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    found = rows.mapInArrow(_search(asked._staged_path, k), "query_id long, id long, score double").select("query_id", "id", F.round("score", 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def evidence(hits: DataFrame) -> DataFrame:
    """(query_id, evidence) from hits (query_id, rank, source, text): labelled texts by rank."""
    block = F.concat(t.fill(w.EVIDENCE_LABEL, F.coalesce("source", F.lit(w.EVIDENCE_SOURCE))), F.lit("\n"), F.coalesce("text", F.lit("")))
    return hits.groupBy("query_id").agg(t.join_in_order(block, F.col("rank"), "\n\n").alias("evidence"))


def assemble(outside, found):
    """Both kinds of evidence under their labels, each left out where it is empty."""
    part = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label + "\n"), x, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(part(w.OUTSIDE_LABEL, outside), part(w.CLOUD_LABEL, found))
