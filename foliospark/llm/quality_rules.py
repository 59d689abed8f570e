"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.support import SPACES, columns, private, split_words, text_of

#: Frequent function words of English, French, German and Spanish, as plain text.
STOP_WORDS = """the of and to in is that for with as it on by at are this was be from or an
le la les de des du et en un une que qui dans pour pas sur est au aux par il elle ce ne se plus avec
der die das und zu den von mit nicht ein eine im auf dem ist sich auch als für es an so aus
el los las y del una con por se no su lo como más al para su al""".split()

SYMBOLS = "#*$%&|<>"

#: Bytes that a text's UTF-8 has beyond one a character, in shares of its characters, from which on it is not written
#: in Latin letters; the stop words are those of four languages that are, so their rule leaves such texts alone.
OTHER_SCRIPT = 0.4

#: Metric, lowest and highest value that a kept text may have (None: no bound). Ratios of an empty text are 0.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("shout_ratio", None, 0.30),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.30),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _pin(value: Column) -> Column:
    """The value, in a column that the optimizer takes for not deterministic.

    It then neither repeats the expression in every use nor moves a filter on it below the projection;
    inside a lambda, such repeats would be computed for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def quality_columns(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """Adds the measures of each row's text under ``prefix``; every other column stays.

    A few chained projections, no shuffle and no Python. Null texts count as empty; empty texts
    have no words and one line without a word. Repeated 3-word windows are found by sorting 64-bit
    window hashes within the row, only in texts in which a hash recurs, so a text costs n log n.
    """
    p = prefix
    c = lambda name: F.col(p + name)
    stop = [*dict.fromkeys(x for w in STOP_WORDS for x in (w, w.capitalize(), w.upper()))]
    step = docs.withColumn(p + "text", text_of(text))
    step = step.withColumns({p + "words": _pin(split_words(c("text"))), p + "lines": F.filter(F.split(c("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    step = step.withColumns({
        p + "n_words": F.size(c("words")).cast("long"),
        p + "word_chars": F.length(F.translate(c("text"), SPACES, "")).cast("long"),
        p + "n_symbols": (F.length(c("text")) - F.length(F.translate(c("text"), SYMBOLS, ""))).cast("long"),
        p + "n_shouts": (F.length(c("text")) - F.length(F.translate(c("text"), "!?", ""))).cast("long"),
        p + "n_chars": F.length(c("text")).cast("long"),
        p + "n_extra": (F.octet_length(c("text")) - F.length(c("text"))).cast("long"),
        p + "n_lines": F.size(c("lines")).cast("long"),
        p + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        p + "n_bullets": F.size(F.filter(c("lines"), lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long"),
        p + "n_ellipses": F.size(F.filter(c("lines"), lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
        p + "n_stop": F.size(F.filter(c("words"), lambda x: x.isin(stop))).cast("long"),
        p + "hashes": _pin(F.when(F.size(c("words")) >= 3, F.transform(F.sequence(F.lit(0), F.size(c("words")) - 3), lambda i: F.xxhash64(c("words")[i], c("words")[i + 1], c("words")[i + 2])))),
    })
    step = step.withColumn(p + "sorted", _pin(F.when(F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes")), F.sort_array(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    twice = F.filter(c("sorted"), lambda x, k: ((k > 0) & (F.get(c("sorted"), k - 1)["h"] == x["h"])) | ((k < F.size(c("sorted")) - 1) & (F.get(c("sorted"), k + 1)["h"] == x["h"])))
    step = step.withColumn(p + "places", _pin(F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        c("places"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    step = step.withColumn(p + "n_repeat_words", _pin(F.coalesce(covered, F.lit(0)).cast("long")))
    return step.drop(*(p + x for x in ("text", "words", "lines", "hashes", "sorted", "places")))


def verdict(prefix: str = "__q_", thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """(base_failed, kept) from the measures: the threshold table as one boolean expression."""
    c = lambda name: F.col(prefix + name)
    metric = {
        "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": _ratio(c("n_symbols"), c("n_words")),
        "shout_ratio": _ratio(c("n_shouts"), c("n_words")),
        "stop_ratio": F.when(c("n_extra") > OTHER_SCRIPT * c("n_chars"), F.lit(1.0)).otherwise(_ratio(c("n_stop"), c("n_words"))),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "bullet_line_ratio": _ratio(c("n_bullets"), c("n_lines")),
        "ellipsis_line_ratio": _ratio(c("n_ellipses"), c("n_lines")),
    }
    base_failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    kept = ~base_failed
    for name, low, high in thresholds:
        kept = kept & (metric[name] >= low if low is not None else F.lit(True)) & (metric[name] <= high if high is not None else F.lit(True))
    return base_failed, kept


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, the base measures, base_failed and kept.

    Null text: no words, so base_failed. Null doc_ids, repeated rows and extra columns of any name
    pass through as rows of their own; an empty table gives none.
    """
    measured = quality_columns(docs.select("doc_id", "text"))
    failed, kept = verdict()
    return measured.select("doc_id", *(F.col(f"__q_{x}").alias(x) for x in BASE), _pin(failed).alias("base_failed"), _pin(kept).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names."""
    p = private(docs)
    measured = quality_columns(docs, prefix=p)
    judged = measured.select(*columns(measured)[: len(docs.columns)], _pin(verdict(p)[1]).alias(p + "kept"))
    kept = judged.where(F.col(p + "kept"))
    return kept.select(*columns(kept)[: len(docs.columns)])
