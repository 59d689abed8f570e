"""Knowledge layers: JSON documents of four layers routed to Markdown, and chunks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.functions import text as t
from foliospark.functions import wording as w


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the JSON files in a folder; files that can't be parsed are dropped later."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def split_documents(sources: DataFrame) -> DataFrame:
    """(file, pos, doc): the elements of a top-level list, or the one object; other files give no rows."""
    value = F.try_parse_json("content")
    docs = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.from_json("content", "array<string>")).when(jsonx.is_object(value), F.array("content"))
    return sources.select("file", F.posexplode(docs).alias("pos", "doc"))


def _blocks(heading, body):
    return F.concat(heading, F.lit("\n\n"), body, F.lit(f"\n\n{w.RULE}\n\n"))


def route_documents(docs: DataFrame) -> DataFrame:
    """(file, pos, block, markdown): one row per section, by layer; empty bodies give none.

    One pass: each document's layer chooses the list of its blocks, which is exploded. Sections keep their
    place in chapters and pages.
    """
    v = docs.select("file", "pos", F.try_parse_json("doc").alias("v"), "doc")
    layer = jsonx.get(F.col("v"), "$.layer", default=F.lit(w.UNKNOWN_LAYER))
    v = v.withColumn("layer", layer)

    def piece(path):
        """The JSON text as it stands, keys in their own order; a string keeps its quotes."""
        value = F.try_variant_get("v", path, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.to_json(value)).otherwise(F.get_json_object("doc", path))

    is_ = lambda name: F.col("layer") == name
    path = {"syllabus": "$.data.knowledge_points", "hotspot": "$.data.hotspot_item"}
    loose = F.when(is_("syllabus"), piece(path["syllabus"])).when(is_("hotspot"), piece(path["hotspot"])).when(~F.coalesce(F.col("layer").isin("textbook", "resource"), F.lit(False)), piece("$.data"))
    v = v.withColumn("leaves", jsonx.leaf_text(loose))
    block = lambda at, heading, body, always=False: F.struct(F.lit(at).cast("long").alias("block") if isinstance(at, int) else at.cast("long").alias("block"), heading.alias("heading"), t.clean_text(body).alias("body"), (F.lit(always) if isinstance(always, bool) else always).alias("always"))
    value = lambda path, default: jsonx.get(F.col("v"), path, default=F.lit(default))

    def section(chapter, c):
        return lambda x, s: block(c * 1_000_000 + s, t.fill(w.BOOK_HEADING, value("$.data.textbook_info.book_title", w.UNNAMED_BOOK), jsonx.get(chapter, "$.chapter_title"), jsonx.get(x, "$.section_title")), jsonx.get(x, "$.raw_text"))

    chapters = jsonx.get(F.col("v"), "$.data.chapters", "array<variant>")
    book = F.flatten(F.filter(F.transform(chapters, lambda x, c: F.transform(jsonx.get(x, "$.sections", "array<variant>"), section(x, c))), lambda x: x.isNotNull()))
    page = lambda x, k: block(k, t.fill(w.RESOURCE_HEADING, value("$.data.resource_info.title", w.UNNAMED_RESOURCE), jsonx.get(x, "$.page_no")), jsonx.get(x, "$.page_text"))
    pages = F.transform(jsonx.get(F.col("v"), "$.data.pages", "array<variant>"), page)
    goals = jsonx.get(F.col("v"), "$.data.teaching_goals", "array<string>")
    goal = F.when(F.size(goals) > 0, block(0, F.lit(w.GOALS_HEADING), F.array_join(goals, " "), True))
    syllabus = F.array_compact(F.array(goal, block(1, F.lit(w.POINTS_HEADING), F.col("leaves"))))
    hot = F.array(block(0, t.fill(w.HOTSPOT_HEADING, value("$.data.hotspot_info.title", w.UNNAMED_HOTSPOT)), F.col("leaves")))
    other = F.array(block(0, t.fill(w.OTHER_HEADING, F.col("layer")), F.col("leaves")))
    chosen = F.when(is_("textbook"), book).when(is_("resource"), pages).when(is_("syllabus"), syllabus).when(is_("hotspot"), hot).when(F.col("layer").isNotNull(), other)
    rows = v.select("file", "pos", F.explode(F.filter(chosen, lambda x: x["always"] | (x["body"] != ""))).alias("x"))
    return rows.select("file", "pos", "x.block", _blocks(F.col("x.heading"), F.col("x.body")).alias("markdown"))


def export_markdown(blocks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(file, markdown): each source's blocks in order, under its export name.

    With ``sources(file, content)``, readable files without a block give an empty export; broken JSON gives none.
    """
    if sources is not None:
        empty = sources.where(F.try_parse_json("content").isNotNull()).select("file", F.lit(0).alias("pos"), F.lit(-1).cast("long").alias("block"), F.lit("").alias("markdown"))
        blocks = blocks.select("file", "pos", "block", "markdown").unionByName(empty)
    out = blocks.groupBy("file").agg(t.join_in_order(F.col("markdown"), [F.col("pos"), F.col("block")], "").alias("markdown"))
    return out.select(F.replace("file", F.lit(".json"), F.lit("_clean.md")).alias("file"), "markdown")


def chunk(files: DataFrame) -> DataFrame:
    """(source, pos, text) from (source, markdown): pieces between rules that are long enough."""
    return files.select("source", F.posexplode(t.chunks(F.col("markdown"))).alias("pos", "text"))
