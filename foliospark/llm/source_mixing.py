"""Mixing sources to target weights: a time-varying curriculum over cumulative token demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.support import SPACES, columns, count_words, digits_for, private, stage_table, text_of

#: Weights of the sources in code-point order, repeating, and the slope of each one's schedule: at
#: time t of the training (0 to 1) a source weighs weight * (1 + slope * (2 t - 1)).
WEIGHTS, SLOPES = (5, 2, 1), (-0.5, 0.0, 0.5)
#: Percent of all words that the mix takes; how often a source may be repeated; rows in a bucket of the prefix sums.
SHARE_PERCENT, MOST_TIMES, BUCKET_ROWS = 150, 2, 20_000


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size), one row a source.

    Water filling in closed form: in order of size over weight, a source is capped while its share
    of what is left exceeds its cap. Integer arithmetic in decimals, one division at the end.
    The windows run over one row per source.
    """
    big = lambda x: x.cast("decimal(25,0)")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    ranked = ranked.withColumns({"w": pick(WEIGHTS).cast("long"), "slope": pick(SLOPES)})
    by_ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = ranked.withColumns({
        "all_size": F.sum("source_size").over(everything),
        "before": F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    # (share of all - cap of those before) * w / w_left > cap, both sides times 100
    over = big(SHARE_PERCENT * F.col("all_size") - 100 * MOST_TIMES * F.col("before")) * F.col("w").cast("decimal(9,0)") > big(100 * MOST_TIMES * F.col("source_size")) * F.col("w_left").cast("decimal(12,0)")
    ranked = ranked.withColumn("capped", over)
    ranked = ranked.withColumns({
        "capped_size": F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0)),
        "free_w": F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything),
    })
    fair = ((SHARE_PERCENT * F.col("all_size") - 100 * MOST_TIMES * F.col("capped_size")) * F.col("w")).cast("double") / (100 * F.col("free_w")).cast("double")
    target = F.when(F.col("capped"), (MOST_TIMES * F.col("source_size")).cast("double")).otherwise(fair)
    return ranked.select("source", "source_size", target.alias("target"), "slope")


def _key(text):
    """A hash of doc_id and text, by which a source's documents are ordered and dealt to tasks, with ids or without."""
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))


def _placed(rows: DataFrame, sized: DataFrame, p: str) -> DataFrame:
    """``rows`` (source, {p}size, {p}key and more) with {p}source_size, target, start, quota, slope.

    ``sized`` holds source, size and key of the same rows; prefix sums come from it, so
    that wide rows are shuffled once, by hash bucket of their source, and a source with a third of all
    rows is spread over many tasks.
    """
    c = lambda name: F.col(p + name)
    digits = digits_for(sized.count(), BUCKET_ROWS, 2)
    keyed = lambda df: df.withColumn(p + "bucket", F.substring(c("key"), 1, digits))
    buckets = keyed(sized).groupBy("source", p + "bucket").agg(F.sum(c("size")).alias("bucket_size"))
    goals = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))).withColumnRenamed("source", "goal_source")
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy(p + "bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = buckets.select("source", p + "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    named = {"source": "source", p + "bucket": "bucket_too", "offset": "offset", "source_size": "source_size", "target": "target", "slope": "slope"}
    offsets = offsets.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).select(*(F.col(x).alias(p + ("goal_" if x == "source" else "") + y) for x, y in named.items()))
    placed = keyed(rows).join(offsets, F.col("source").eqNullSafe(c("goal_source")) & (c("bucket") == c("bucket_too")))
    inside = Window.partitionBy("source", p + "bucket").orderBy(p + "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn(p + "start", c("offset") + F.sum(c("size")).over(inside) - c("size"))
    return placed.withColumn(p + "quota", F.floor(c("target") + 0.5).cast("long"))


def _part(start, p: str):
    """Words that a pass takes of a document which begins at ``start``."""
    return F.greatest(F.lit(0), F.least(F.col(p + "size"), F.col(p + "quota") - start)).cast("long")


def _position(start, p: str):
    """The time t at which the source's schedule, slope*t^2 + (1-slope)*t, has met the demand before ``start``."""
    a, g = F.col(p + "slope"), start / F.col(p + "quota")
    return F.when(_part(start, p) > 0, 2 * g / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * g)))


def _sized(docs: DataFrame, p: str) -> DataFrame:
    text = text_of()
    return docs.withColumns({p + "size": count_words(text), p + "key": _key(text)})


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, position, repeat_position.

    Each source's documents stand in the order of a hash of doc_id and text; a document covers the words from its
    start to its end in each pass over the source, and the mix takes a source's words up to its
    rounded target. A pass beyond the first repeats documents; the document at the target is taken in
    part. Rows come range-sorted by position, the training time from 0 to 1; those not taken come last.

    Null texts have size 0 and take nothing, null sources are one source, null doc_ids hash as empty. The order has no other ties than rows with equal doc_id and
    text, which are interchangeable, so reruns agree. An empty table gives no rows; extra columns are
    ignored. Texts are read once, for their sizes and hashes.
    """
    p = "__m_"
    sized = stage_table(_sized(docs.select("doc_id", "source", "text"), p).drop("text"), "mix")
    start = F.col(p + "start")
    again = start + F.col(p + "source_size")
    out = _placed(sized, sized, p).select(
        "doc_id", "source", F.col(p + "size").alias("size"), F.col(p + "source_size").alias("source_size"), F.col(p + "target").alias("target"),
        (_part(start, p) + _part(again, p)).alias("taken"), _position(start, p).alias("position"), _position(again, p).alias("repeat_position"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")


def _first_words(text, n):
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.btrim(F.get(pieces, F.lit(0)), F.lit(SPACES)) == "", 1).otherwise(0)
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), n.cast("int") + lead), ""), F.lit(SPACES))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position.

    A document taken whole keeps its row; one taken in part, of which a source has one a pass, gives
    its text up to the last word taken, and n_chars, where there, follows. Rows without words are not
    taken. Other columns stay, whatever their names; ties and nulls are as in ``mix``. Wide rows are
    shuffled twice: by bucket of the source, and for the sort.
    """
    p = private(docs)
    wide = _sized(docs, p)
    sized = stage_table(wide.select("source", p + "size", p + "key"), "mix")
    start = F.col(p + "start")
    again = start + F.col(p + "source_size")
    passes = F.filter(F.array(*(F.struct(_part(s, p).alias("n"), _position(s, p).alias("at")) for s in (start, again))), lambda x: x["n"] > 0)
    rows = _placed(wide, sized, p).withColumn(p + "pass", F.explode(passes))
    whole = F.col(p + "pass.n") >= F.col(p + "size")
    rows = rows.withColumn(p + "text", F.when(whole, F.col("text")).otherwise(_first_words(text_of(), F.col(p + "pass.n"))))
    rows = rows.orderBy(p + "pass.at", p + "key")
    new = {"text": F.col(p + "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(p + "text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*((new[x] if x in new else col).alias(x) for x, col in zip(docs.columns, columns(rows)[: len(docs.columns)], strict=True)))
