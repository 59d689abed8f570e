"""What several operators share: staged tables, text columns, connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.staging import discard, new_path, remove, shared_dir, stage_table

__all__ = ["discard", "new_path", "remove", "shared_dir", "stage_table"]

#: ASCII white space as the contracts name it.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def private(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with, whatever the case."""
    names = [c.lower() for f in frames for c in f.columns]
    k = 0
    while any(c.startswith(f"__{k}_") for c in names):
        k += 1
    return f"__{k}_"


def columns(df: DataFrame) -> list:
    """All columns of ``df`` by their exact names."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def text_of(name: str = "text"):
    """The column's text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def split_words(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column without nulls, as an array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def count_words(text):
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node, for every linked node.

    Alternates large-star and small-star contraction; each round is two shuffles with a map-side
    minimum per node, staged in the shared folder, until no edge changes. Hubs are joined by
    sort-merge, which adaptive execution splits. Nulls and loops are dropped; repeated edges count once.
    """
    now = stage_table(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    # the edge count and a sum of edge hashes: unchanged at the fixed point
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stage_table(small, "edges")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def digits_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """Hex digits of a hash that leave about ``per_bucket`` of ``rows`` rows in a bucket."""
    return max(least, math.ceil(math.log(max(rows, 1) / per_bucket, 16))) if rows > per_bucket else least
