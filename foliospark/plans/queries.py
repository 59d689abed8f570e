"""Queries over the driver's tables, one or more for each operator of the engine."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.functions import text as t
from foliospark.functions import wording as w
from foliospark.operators import accounts, enrich, games, ingest, kb, layout, lesson, outline, retention, retrieval, vectors
from foliospark.sources import office, office_write
from foliospark.sources.staging import discard, new_path, remove, stage_table

#: Five CJK characters that stand for vowels where a query needs text beyond Latin-1.
CJK = "教学目标课"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _md5(x):
    return F.md5(F.encode(x, "utf-8"))


# -- vectors ------------------------------------------------------------------------------------


def _top(spark, d, k=3):
    """Every row whose id is divisible by 100 asks, and all rows may answer."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, k)


def vector_topk(spark, d):
    return _top(spark, d)


def _hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return _top(spark, d).join(docs, "id", "left")


def evidence_concat(spark, d):
    out = vectors.evidence(_hits(spark, d))
    return out.select("query_id", _md5(F.col("evidence")).alias("evidence_md5"), F.length("evidence").cast("long").alias("n_chars"))


def hit_projection(spark, d):
    return _hits(spark, d).select("query_id", "rank", F.coalesce("source", F.lit(w.EVIDENCE_SOURCE)).alias("source"), F.coalesce("text", F.lit("")).alias("text"))


def evidence_assemble(spark, d):
    docs = table(spark, d, "documents")
    outside = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit(""))
    found = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    return docs.select("doc_id", _md5(vectors.assemble(outside, found)).alias("evidence_md5"))


# -- text ---------------------------------------------------------------------------------------


def clean_text_latin(spark, d):
    return table(spark, d, "documents").select("doc_id", _md5(t.clean_text(F.col("text"))).alias("clean_md5"))


def clean_text_cjk(spark, d):
    text = F.translate("text", "aeiou", CJK)
    clean = table(spark, d, "documents").select("doc_id", t.clean_text(text).alias("clean"))
    return clean.select("doc_id", _md5(F.col("clean")).alias("clean_md5"), F.length("clean").cast("long").alias("n_chars"))


def clean_text_spaces(spark, d):
    text = F.concat(F.lit("　 "), F.replace(F.translate("text", "aeiou", CJK), F.lit(" "), F.lit("　 ")), F.lit("\u001c "))
    return table(spark, d, "documents").select("doc_id", _md5(t.clean_text(text)).alias("clean_md5"))


def _markdown(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(t.join_in_order(F.col("text"), F.col("turn"), "\n\n---\n\n").alias("markdown")).select(F.col("conv_id").alias("source"), "markdown")


def chunk_split(spark, d):
    rows = _markdown(spark, d).select("source", F.posexplode(F.split("markdown", "---", -1)).alias("pos", "piece"))
    return rows.select("source", "pos", _md5(t.strip(F.col("piece"))).alias("piece_md5"))


def chunk_min_len(spark, d):
    return kb.chunk(_markdown(spark, d)).select("source", "pos", _md5(F.col("text")).alias("chunk_md5"))


def chunk_short(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(t.join_in_order(F.concat("props", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise("")), F.col("event_id"), "---").alias("markdown"))
    return kb.chunk(e.select(F.col("user_id").alias("source"), "markdown")).select("source", "pos", "text")


def chunk_ids(spark, d):
    rows = kb.chunk(_markdown(spark, d))
    return vectors.dense_ids(rows, "source", "pos").select("id", "source", "pos", _md5(F.col("text")).alias("chunk_md5"))


def stage_title(spark, d):
    o = table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace("o_orderpriority", "-", " ")).otherwise(F.concat("o_orderpriority", F.lit(" ")))
    return o.select("o_orderkey", t.stage_title(name).alias("title"))


def _file_name():
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "DOCX", "pptx", "xlsx", "XLS", "png", "Jpg", "jpeg", "bmp", "webp", "mp4", "avi", "MOV", "mkv", "txt", "tar.gz"))), (F.col("p_partkey") % 17).cast("int") + 1)
    return F.when(F.col("p_partkey") % 17 == 16, F.col("p_name")).otherwise(F.concat("p_name", F.lit("."), ext))


def ext_filter(spark, d):
    return ingest.accept(table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 17 == 16, F.col("p_name")).otherwise(_file_name()).alias("name"))).select("p_partkey", "ext")


def ext_route(spark, d):
    return table(spark, d, "part").select("p_partkey", F.coalesce(t.route(_file_name()), F.lit("refused")).alias("route"))


def px_to_inch(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(t.inches(F.col("p_size") * 20), 6).alias("inch"))


def _color():
    return F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 3))).otherwise(F.concat(F.lit("##"), F.substring(F.md5("p_name"), 1, 6)))


def hex_rgb(spark, d):
    return table(spark, d, "part").select("p_partkey", t.rgb(_color()).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


# -- JSON ---------------------------------------------------------------------------------------


def _reply():
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    prose = F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))
    two = F.concat(F.lit("{bad} then "), "props")
    return F.when(F.col("event_id") % 5 == 0, fenced).when(F.col("event_id") % 5 == 1, prose).when(F.col("event_id") % 5 == 2, two).when(F.col("event_id") % 5 == 3, F.lit("null")).otherwise(F.concat(F.lit(" "), "props", F.lit(" ")))


def json_tolerant(spark, d):
    e = table(spark, d, "events").select("event_id", jsonx.tolerant(_reply()).alias("x"))
    return e.select("event_id", F.get_json_object("x.json", "$.k").cast("long").alias("k"), F.when(F.col("x.error") == jsonx.NOT_OBJECT, 1).when(F.col("x.error") == jsonx.NOT_JSON, 2).otherwise(0).alias("error"))


def _described():
    flat = F.concat(F.lit('Play {"game_type": "quiz", "n": '), F.col("event_id").cast("string"), F.lit("} now"))
    nested_first = F.concat(F.lit('Play {"pairs": [{"left": 1}], "game_type": "memory_match"} and '), F.lit('{"pairs": [{"left": 1}], "game_type": "memory_match"} again'))
    key_first = F.lit('Play {"game_type": "memory_match", "pairs": [{"left": 1}]} now')
    stray = F.lit('See {x} and {"game_type": "quiz"}')
    k = F.col("event_id") % 5
    return F.when(k == 0, flat).when(k == 1, nested_first).when(k == 2, key_first).when(k == 3, stray).otherwise(F.lit("no game"))


def game_mine(spark, d):
    own = F.when(F.col("event_id") % 7 == 0, F.parse_json(F.lit('{"game_type": "own"}')))
    game, text = jsonx.mine_game(_described(), own)
    e = table(spark, d, "events").select("event_id", game.alias("game"), text.alias("description"))
    return e.select("event_id", F.try_variant_get("game", "$.game_type", "string").alias("game_type"), "description")


def string_or_object(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"')))
    return e.select("event_id", F.try_variant_get(jsonx.string_or_object(raw), "$.k", "long").alias("k"))


def unwrap(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"outline_data": '), "props", F.lit("}"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit('{"outline_data": "{}", "k": -1}'))
    return e.select("event_id", F.try_variant_get(jsonx.unwrap(F.parse_json(raw)), "$.k", "long").alias("k"))


def precedence(spark, d):
    e = table(spark, d, "events")
    queue = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.lit("[]"))
    plan = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"n": '), F.col("event_id").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit("{}"))
    return e.select("event_id", outline.choose_queue(queue, plan).alias("chosen"))


def _quote(c):
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def leaf_text(spark, d):
    c = table(spark, d, "conversations")
    doc = F.concat(F.lit('{"z": {"body": '), _quote(F.col("text")), F.lit(', "metadata": {"deep": "never to be seen"}}, "id": "identifier", "list": ["short", "long enough", '), F.col("turn").cast("string"), F.lit(', ["  nested leaf  "]], "a": "last by place"}'))
    return c.select("conv_id", "turn", _md5(jsonx.leaf_text(doc)).alias("leaves_md5"))


# -- knowledge layers ---------------------------------------------------------------------------


def _kb_docs(spark, d):
    """One JSON document a turn; its role chooses the layer."""
    c = table(spark, d, "conversations")
    text = _quote(F.col("text"))
    body = (
        F.when(F.col("role") == "user", F.concat(F.lit('{"layer": "textbook", "data": {"textbook_info": {"book_title": "B"}, "chapters": [{"chapter_title": "C", "sections": [{"section_title": "S1", "raw_text": '), text, F.lit('}, {"section_title": "S2", "raw_text": ""}]}]}}')))
        .when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.concat(F.lit('{"layer": "resource", "data": {"pages": [{"page_no": '), F.col("turn").cast("string"), F.lit(', "page_text": '), text, F.lit("}]}}")))
        .when(F.col("role") == "assistant", F.concat(F.lit('{"layer": "syllabus", "data": {"teaching_goals": ["G one", '), text, F.lit('], "knowledge_points": {"id": "hidden away", "p": '), text, F.lit("}}}")))
        .when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"layer": "hotspot", "data": {"hotspot_info": {"title": "H"}, "hotspot_item": ['), text, F.lit("]}}")))
        .otherwise(F.concat(F.lit('{"data": {"x": '), text, F.lit("}}")))
    )
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit(".json")).alias("file"), F.col("turn").cast("int").alias("pos"), body.alias("doc"))


def kb_route(spark, d):
    return kb.route_documents(_kb_docs(spark, d)).select("file", "pos", "block", _md5(F.col("markdown")).alias("markdown_md5"))


def kb_markdown(spark, d):
    return kb.export_markdown(kb.route_documents(_kb_docs(spark, d))).select("file", _md5(F.col("markdown")).alias("markdown_md5"), F.length("markdown").cast("long").alias("n_chars"))


def kb_split(spark, d):
    e = table(spark, d, "events")
    files = e.groupBy("user_id").agg(F.concat(F.lit("["), t.join_in_order(F.col("props"), F.col("event_id"), ", "), F.lit("]")).alias("content"))
    files = files.select(F.col("user_id").alias("file"), F.when(F.col("user_id") % 3 == 0, F.col("content")).when(F.col("user_id") % 3 == 1, F.lit('{"k": -5}')).otherwise(F.lit("7")).alias("content"))
    return kb.split_documents(files).select("file", "pos", F.get_json_object("doc", "$.k").cast("long").alias("k"))


def goals_join(spark, d):
    goals = F.array(F.col("p_name"), F.concat(F.lit("  "), "p_type"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", t.clean_text(F.array_join(goals, " ")).alias("goals"))


# -- outlines -----------------------------------------------------------------------------------


def _outlines(spark, d):
    """An outline per order: its line items are stages, with points by the parity of the line."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    li = li.repartition("l_orderkey")  # narrow rows are dealt, not the longer texts made of them
    n = F.col("l_linenumber")
    point = lambda name, flag, hard: F.concat(F.lit("{"), name, F.lit('"explanation": "E'), F.col("l_suppkey").cast("string"), F.lit('", "is_key_point": '), F.when(F.col("l_returnflag") == flag, "true").otherwise("false"), F.lit(', "is_difficult_point": '), F.when(F.col("l_returnflag") == hard, "true").otherwise("false"), F.lit("}"))
    first = point(F.concat(F.lit('"point": "P'), F.col("l_partkey").cast("string"), F.lit('", ')), "R", "A")
    second = point(F.lit(""), "N", "N")
    points = F.when(n % 3 == 0, F.lit(', "core_knowledge_points": []')).when(n % 3 == 1, F.concat(F.lit(', "core_knowledge_points": ['), first, F.lit(", "), second, F.lit("]"))).otherwise(F.lit(""))
    game = F.when(F.col("l_quantity") > 45, F.lit(', "interactive_game": {"game_type": "drag_sort"}')).when(F.col("l_quantity") > 40, F.lit(', "interactive_game": null')).otherwise(F.lit(""))
    stage = F.concat(F.lit('{"stage": "S'), n.cast("string"), F.lit(" - "), "l_linestatus", F.lit('", "content_description": "D'), F.col("l_partkey").cast("string"), F.lit('", "duration": '), n.cast("string"), points, game, F.lit("}"))
    order = [n, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    made = li.groupBy("l_orderkey").agg(t.join_in_order(stage, order, ", ").alias("stages"))
    meta = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit('"course_metadata": {"title": "T'), F.col("l_orderkey").cast("string"), F.lit('", "teaching_methods": ["a", "b"], "teaching_objectives": ["x", "y"]}, '))).otherwise(F.lit('"course_metadata": {"total_duration": 90, "teaching_methods": "talk", "homework": "h"}, '))
    body = F.concat(F.lit("{"), meta, F.lit('"syllabus_content": ['), "stages", F.lit("]}"))
    return made.select(F.col("l_orderkey").alias("project_id"), F.when(F.col("l_orderkey") % 4 == 0, F.concat(F.lit('{"outline_data": '), body, F.lit("}"))).otherwise(body).alias("outline"))


def flatten_pages(spark, d):
    pages = outline.flatten_pages(_outlines(spark, d))
    return pages.select("project_id", "stage_pos", "point_pos", "title", "content", F.try_variant_get(F.try_parse_json("game"), "$.game_type", "string").alias("game_type"))


def page_numbers(spark, d):
    pages = outline.number_pages(outline.flatten_pages(_outlines(spark, d)), "stage_pos", "point_pos")
    return pages.select("project_id", "page_no", "n_pages", "title")


def _pages(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("project_id"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("title"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("content"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("i"), F.col("l_partkey").cast("string"))).otherwise("").alias("image_path"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("/g")).alias("game_url"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return outline.number_pages(rows, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def layout_elements(spark, d):
    return layout.elements(_pages(spark, d)).select("project_id", "page_no", "pos", "type", "content", "src", "url", "font_size", "bold", "color", "x", "y", "width", "height")


def layout_images(spark, d):
    there = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("path"))
    return layout.elements(layout.with_existing_images(_pages(spark, d), there)).groupBy("project_id", "page_no").agg(F.count("*").alias("n_elements"))


def layout_render(spark, d):
    """Some rows lack their style, some are of a type that is not drawn, some pictures are missing."""
    bare = F.col("page_no") % 3 == 0
    rows = layout.elements(_pages(spark, d)).withColumns({c: F.when(~bare, F.col(c)) for c in ("font_size", "bold", "color", "x", "y", "width", "height")})
    rows = rows.withColumn("type", F.when((F.col("page_no") % 5 == 0) & (F.col("pos") == 1), "chart").otherwise(F.col("type")))
    there = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("path"))
    shown = layout.render(rows, there, "http://h")
    inch = lambda c: F.round(F.col(f"{c}_in"), 4).alias(f"{c}_in")
    return shown.select("project_id", "page_no", "pos", "type", *map(inch, ("x", "y", "width", "height")), "font_size", F.col("bold").cast("int").alias("bold"), "rgb.r", "rgb.g", "rgb.b", "underline", "link", "line_spacing")


def layout_decks(spark, d):
    """Whole decks: every slide's id and every element's place, style and content, in order."""
    element = "struct<type:string,content:string,src:string,url:string,style:struct<fontSize:int,fontWeight:string,color:string,position:struct<x:int,y:int>,width:int,height:int>>"
    kind = f"struct<metadata:struct<title:string,author:string,size:struct<width:int,height:int>>,slides:array<struct<id:string,elements:array<{element}>>>>"
    decks = layout.decks(layout.elements(_pages(spark, d)), "me").select("project_id", F.from_json("deck", kind).alias("x"))
    part = lambda *columns: F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))
    line = lambda e: part(e["type"], e["content"], e["src"], e["url"], e["style"]["fontSize"], e["style"]["fontWeight"], e["style"]["color"], e["style"]["position"]["x"], e["style"]["position"]["y"], e["style"]["width"], e["style"]["height"])
    slide = lambda s: F.concat_ws("\n", s["id"], F.transform(s["elements"], line))
    meta = F.col("x.metadata")
    return decks.select("project_id", meta["title"].alias("title"), part(meta["author"], meta["size"]["width"], meta["size"]["height"]).alias("meta"), F.size("x.slides").cast("long").alias("n_slides"), _md5(F.concat_ws("\n", F.transform("x.slides", slide))).alias("slides_md5"))


def key_points(spark, d):
    out = lesson.key_points(_outlines(spark, d))
    return out.select("project_id", _md5(F.col("key_points")).alias("key_md5"), _md5(F.col("difficult_points")).alias("difficult_md5"))


def lesson_process(spark, d):
    out = lesson.process(_outlines(spark, d))
    return out.select("project_id", "stage_pos", "stage", _md5(F.col("activity")).alias("activity_md5"), "intent")


def lesson_info(spark, d):
    return lesson.info(_outlines(spark, d)).join(lesson.objectives(_outlines(spark, d)), "project_id")


def lesson_cells(spark, d):
    return lesson.cells(_outlines(spark, d)).groupBy("project_id").agg(F.count("*").alias("n_cells"), F.max(F.when(F.col("table_no") == 3, F.col("row") + 1)).cast("long").alias("process_rows"))


def parse_status(spark, d):
    """Every third document's reader fails, every third has no elements, the others have one a line."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("name"), F.encode(F.concat_ws("|", "doc_id", F.split("text", "\n")[0]), "utf-8").alias("content"))
    files = ingest.accept(docs)

    def partition(s):
        def one(data):
            key, _, line = bytes(data).decode("utf-8").partition("|")
            return None if int(key) % 3 == 0 else [] if int(key) % 3 == 1 else [{"kind": "Text", "text": line, "html": None}, {"kind": "Footer", "text": "no", "html": None}]

        return s.map(one)

    out = ingest.parse_results(ingest.document_blocks(files, enrich.Providers(partition=partition)))
    return out.select("file", "status", _md5(F.col("text")).alias("text_md5"), "element_count", "char_count", "message")


def queue_errors(spark, d):
    outlines = _outlines(spark, d)
    return outline.queue_errors(outlines, outline.flatten_pages(outlines).where("stage_pos > 2"))


def kb_empty_export(spark, d):
    """Sources with and without blocks, and broken ones."""
    c = table(spark, d, "conversations").where("turn = 0")
    text = F.when(F.col("conv_id") % 3 == 0, F.lit("7")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"layer": "L", "data": ["leaf of '), F.col("conv_id").cast("string"), F.lit('"]}'))).otherwise(F.lit("{broken"))
    sources = c.select(F.concat(F.col("conv_id").cast("string"), F.lit(".json")).alias("file"), text.alias("content")).distinct()
    return kb.export_markdown(kb.route_documents(kb.split_documents(sources)), sources)


def point_prefix(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", lesson.prefix(F.col("l_returnflag") == "A", F.col("l_returnflag") == "R").alias("prefix")).agg(F.count("*").alias("n"))


def methods_join(spark, d):
    p = table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"'), "p_brand", F.lit('"')))
    return p.select("p_partkey", lesson.methods(F.parse_json(raw)).alias("methods"))


def objectives_enum(spark, d):
    items = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", lesson.number_lines(items).alias("objectives"))


# -- exercises ----------------------------------------------------------------------------------


def last_writer(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "props")
    return games.last_written(e, ["user_id", "event_type"], "event_id")


def _templates(spark):
    return spark.createDataFrame([("click", "<a>/*INJECT_DATA*/</a>"), ("view", "<b>/*INJECT_DATA*/ /*INJECT_DATA*/</b>"), ("purchase", "<c></c>")], "game_type string, html string")


def template_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("game_type"))
    return games.with_template(e, _templates(spark)).select("event_id", "game_type", F.col("html").isNotNull().alias("known"))


def template_inject(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("game_type"), F.concat("props", F.when(F.col("event_id") % 2 == 0, F.lit("</script>")).otherwise("")).alias("payload"))
    return games.build(games.with_template(e, _templates(spark))).select("event_id", "page")


def _deck(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    pairs = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_regionkey").alias("game_id"), F.col("n_nationkey").alias("pair_id"), F.col("n_name").alias("left"), F.col("r_name").alias("right"))
    return games.cards(pairs)


def memory_cards(spark, d):
    return _deck(spark, d)


def memory_match(spark, d):
    return games.matches(_deck(spark, d)).select("game_id", "pair_id", "side", "label", "other_side", "other_label")


def _flips(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("game_id"), F.col("event_id").alias("at"), (F.floor(F.col("event_id") / 2) % 5).alias("pair_id"), F.when(F.col("event_id") % 3 == 0, "left").otherwise("right").alias("side"))


def memory_flips(spark, d):
    return games.flips(_flips(spark, d))


def memory_progress(spark, d):
    deck = _flips(spark, d).select("game_id", "pair_id", "side").distinct()
    return games.progress(games.flips(_flips(spark, d)), deck)


def drag_sort(spark, d):
    p = table(spark, d, "part").select(F.lit(1).alias("game_id"), F.col("p_partkey").cast("string").alias("word"), F.col("p_type").alias("target"))
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("at"))
    moves = li.select(F.lit(1).alias("game_id"), F.col("l_partkey").cast("string").alias("word"), F.when(F.col("l_partkey") % 2 == 0, "STANDARD").otherwise("PROMO").alias("category"))
    return games.drops(p, moves).select("word", "category", "right")


def quiz_check(spark, d):
    p = table(spark, d, "part")
    q = p.select(F.floor(F.col("p_partkey") / 50).alias("game_id"), F.col("p_partkey").alias("question"), F.array("p_brand", "p_type", "p_name").alias("options"), (F.col("p_size") % 3).alias("correct_index"), (F.col("p_partkey") % 4).cast("int").alias("selected"))
    return games.answers(q)


# -- ingest, retention, accounts ----------------------------------------------------------------


def _blocks(spark, d):
    """A file a document, whose elements are its lines, each eight times over, so that some pass the limit."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select(F.col("doc_id").alias("file"), "pos", F.when((F.col("doc_id") + F.col("pos")) % 5 != 0, F.repeat("line", 8)).alias("block"), F.lit(1).alias("n_elements"))


def concat_blocks(spark, d):
    out = ingest.parse_results(_blocks(spark, d), 10**9)
    return out.select("file", "status", "element_count", "char_count", _md5(F.col("text")).alias("text_md5"))


def truncate_guard(spark, d):
    out = ingest.response(ingest.parse_results(_blocks(spark, d)))
    return out.select("status", "file_name", "char_count", _md5(F.col("extracted_text")).alias("text_md5"))


def element_filter(spark, d):
    docs = table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("Title", "NarrativeText", "Text", "Table", "Image", "PageBreak"))), (F.col("doc_id") % 6).cast("int") + 1)
    html = F.when(F.col("doc_id") % 12 == 3, F.concat(F.lit("<table>"), "lang", F.lit("</table>")))
    return docs.select("doc_id", _md5(ingest.element_block(kind, F.col("text"), html)).alias("block_md5"))


def sheet_markdown(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("sheet"), "n_nationkey", "n_name")
    return ingest.sheet_text(rows, ["n_nationkey", "n_name"], "n_nationkey")


def _files(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit(".gitkeep")).otherwise(F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("name"), F.col("ts").alias("mtime"), (F.col("event_id") % 20 != 0).alias("is_file"))


def retention_expired(spark, d):
    files = _files(spark, d)
    now = files.agg(F.max("mtime")).first()[0]
    out = retention.expired(files, F.lit(now).cast("timestamp_ntz"))
    return out.select("event_id", retention.age_seconds(F.col("mtime"), F.lit(now)).alias("age_seconds"))


def token_expiry(spark, d):
    return table(spark, d, "events").select("event_id", retention.token_expiry(F.col("ts")).alias("expires"))


def _users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def _requests(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new "), (F.col("c_custkey") % 50).cast("string"))).alias("username"))


def user_lookup(spark, d):
    return accounts.lookup(_requests(spark, d), _users(spark, d)).groupBy("username", "found").agg(F.count("*").alias("n"))


def register_new(spark, d):
    return accounts.register(_requests(spark, d), _users(spark, d))


def owners_gone(spark, d):
    projects = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("teacher_id"))
    return accounts.without_owner(projects, _users(spark, d).where("id % 3 <> 0")).select("id", "teacher_id")


# -- providers (rows only) ----------------------------------------------------------------------


def embed_chunks(spark, d):
    rows = kb.chunk(_markdown(spark, d)).select("source", "pos", "text")
    made = rows.withColumn("vector", enrich.call(enrich.hash_embed, "array<double>", F.col("text"))).where("vector is not null")
    return vectors.dense_ids(made, "source", "pos").select("id", "vector", "text", "source")


def embedded_chunks(spark, d):
    """The collection without its vectors, which stand for a service's."""
    return embed_chunks(spark, d).select("id", "source", F.size("vector").alias("width"), _md5(F.col("text")).alias("text_md5"))


def enrich_pages(spark, d):
    pages = outline.flatten_pages(_outlines(spark, d)).withColumnRenamed("game", "interactive_game").withColumn("need_image", F.when(F.col("stage_pos") % 3 == 0, False).when(F.col("stage_pos") % 3 == 1, True))
    kinds = spark.createDataFrame([("drag_sort", ""), ("quiz", "")], "game_type string, html string")
    out = enrich.run(pages, kinds, enrich.Providers(complete=lambda s: s.str.upper(), draw=lambda s: s.str.encode("utf-8")))
    return out.select("project_id", "stage_pos", "point_pos", "content", "image_path", "game_url")


def outline_replies(spark, d):
    """Every conversation's first turn asks; a stand-in model answers with what it was asked."""
    c = table(spark, d, "conversations")
    requests = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("topic"), F.when(F.col("conv_id") % 2 == 0, F.col("role")).alias("outside"))
    collection = stage_table(embed_chunks(spark, d), "collection")
    answer = lambda s: s.map(lambda x: "Sure:\n```json\n" + json.dumps({"outline_data": {"asked": len(x)}}) + "\n```")
    out = retrieval.outline(requests, collection, enrich.Providers(complete=answer))
    return out.select("query_id", F.get_json_object("outline", "$.outline_data.asked").cast("long").alias("asked"), "error")


def deck_files(spark, d):
    """Decks written and read back: the texts of their frames."""
    return _read_back(spark, layout.page_decks(_pages(spark, d)), lambda rows, folder: office_write.presentations(rows, folder=folder))


#: Office files that a task writes, rounds of so many tasks a core, and rounds under way at once: only their files stand on disk.
TASK_FILES, ROUND_TASKS, ROUNDS = 2000, 1, 2


def _read_back(spark, rows, write):
    """Every file is written and read back, round by round; a round's files go once they are read.

    A round takes some files of the staged table through one job, so that neither disk nor a listing grows with the
    number of office files. Each task has a folder to itself, as many tasks slow each other down in one. While one round is
    planned or cleared away, another keeps the cores busy.
    """
    staged = stage_table(rows, "to-write", TASK_FILES)
    paths, out = sorted(map(unquote, staged.inputFiles())), new_path(spark, "read-back")
    step = ROUND_TASKS * max(6, spark.sparkContext.defaultParallelism)

    def run(k: int) -> str:
        folders = {new_path(spark, "office"): spark.read.schema(staged.schema).parquet(path) for path in paths[k : k + step]} or {new_path(spark, "office"): staged}
        found = (office.digests(write(part, folder), folder) for folder, part in folders.items())
        reduce(DataFrame.union, found).write.parquet(made := f"{out}/{k}")
        for folder in folders:
            remove(spark, folder)
        return made

    with ThreadPoolExecutor(ROUNDS) as pool:
        rounds = [pool.submit(inheritable_thread_target(spark)(run), k) for k in range(0, max(1, len(paths)), step)]
        try:
            made = [r.result() for r in rounds]
        finally:
            pool.shutdown(cancel_futures=True)
    discard(staged)
    return spark.read.schema(office.DIGESTS).parquet(*made)


def lesson_files(spark, d):
    """Lesson plans written and read back: title and tables."""
    return _read_back(spark, lesson.plans(_outlines(spark, d)), office_write.plan_documents).select("file", "n")


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, hit_projection, evidence_concat, evidence_assemble, clean_text_latin, clean_text_cjk, clean_text_spaces, chunk_split, chunk_min_len,
        chunk_short, chunk_ids, stage_title, ext_filter, ext_route, px_to_inch, hex_rgb, json_tolerant, game_mine, string_or_object, unwrap, precedence,
        leaf_text, kb_route, kb_markdown, kb_split, goals_join, flatten_pages, page_numbers, layout_elements, layout_images, layout_render, layout_decks,
        parse_status, queue_errors, kb_empty_export, key_points, lesson_process, lesson_info, lesson_cells, point_prefix, methods_join, objectives_enum, last_writer, template_lookup, template_inject,
        memory_cards, memory_match, memory_flips, memory_progress, drag_sort, quiz_check, concat_blocks, truncate_guard, element_filter, sheet_markdown,
        retention_expired, token_expiry, user_lookup, register_new, owners_gone, embed_chunks, embedded_chunks, enrich_pages, outline_replies, deck_files, lesson_files,
    )
}
