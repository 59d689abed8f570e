"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.support import SPACES, ascii_lower, columns, private, stage_table, text_of


def _key(line):
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _text_hashes():
    """Two 64-bit hashes that stand for a text."""
    return F.xxhash64(text_of()), F.xxhash64(F.lit(1), text_of())


def dropped_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Rows (doc, t1, t2, gone): the 0-based positions of the lines that each text loses.

    Texts are read once: the hashes of their long lines are staged, two 64-bit hashes with different
    seeds for a key, and both the counts and the join back read those. Documents per key are counted in
    two steps with partial aggregates, so a line that stands in a third of all documents costs one row
    per map task. The common keys are staged before the join back, so that their size decides how to
    join: sent to every task while they are few, else by sort-merge, of whose hot keys adaptive
    execution splits the lines.
    """
    t1, t2 = _text_hashes()
    lines = (
        docs.select(F.col("doc_id").alias("doc"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(text_of(), "\n")).alias("at", "line"))
        .select("doc", "t1", "t2", "at", _key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "t1", "t2", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = stage_table(lines, "line-hashes")
    common = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("holder")).where(F.col("n") >= min_docs)
    common = stage_table(common.select("h1", "h2", "holder"), "lines")
    gone = lines.join(common, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc", "t1", "t2").agg(F.collect_set("at").alias("gone"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, prefix: str = "__l_") -> DataFrame:
    """``docs`` with the columns {prefix}n_lines, {prefix}n_dropped and {prefix}text, the text that stays.

    A null or empty text is one empty line. Lines whose key has fewer than ``min_chars`` code points
    stay. A null doc_id is no document: it is never counted and never the holder, so it loses common
    lines. Rows that repeat a doc_id count as one document; the holder keeps its lines in all of them.
    Other columns may have any name that does not begin with ``prefix``. The texts are shuffled once, by
    document, for the join with the positions; those are hashed there, so no texts are sorted.
    """
    p = prefix
    gone = dropped_positions(docs, min_chars, min_docs).select(*(F.col(x).alias(p + y) for x, y in (("doc", "doc"), ("t1", "t1_too"), ("t2", "t2_too"), ("gone", "gone"))))
    t1, t2 = _text_hashes()
    left = docs.withColumns({p + "t1": t1, p + "t2": t2})
    same = left["doc_id"].eqNullSafe(gone[p + "doc"]) & (left[p + "t1"] == gone[p + "t1_too"]) & (left[p + "t2"] == gone[p + "t2_too"])
    joined = left.join(gone.hint("shuffle_hash"), same, "left")
    joined = joined.withColumn(p + "lines", F.split(text_of(), "\n"))
    n = F.size(p + "lines").cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size(p + "lines") - 1), F.col(p + "gone"))
    some = F.col(p + "gone").isNotNull()
    text = F.when(some, F.array_join(F.transform(stay, lambda i: F.col(p + "lines")[i]), "\n")).otherwise(text_of())
    dropped = F.when(some, F.size(F.col(p + "gone"))).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumns({p + "n_lines": n, p + "n_dropped": dropped, p + "text": text})
    return joined.select(*columns(joined)[: len(docs.columns)], p + "n_lines", p + "n_dropped", p + "text")


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__l_n_lines").alias("n_lines"), F.col("__l_n_dropped").alias("n_dropped"), F.sha2(F.encode("__l_text", "utf-8"), 256).alias("kept_sha256"))


def drop_common_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with common lines taken out of text; n_chars, where there, follows the new text.

    Columns of any other name stay as they are.
    """
    p = private(docs)
    out = line_dedup(docs, prefix=p)
    changed = F.col(p + "n_dropped") > 0
    new = {"text": F.when(changed, F.col(p + "text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(p + "text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else col for c, col in zip(docs.columns, columns(out)[: len(docs.columns)], strict=True)))
