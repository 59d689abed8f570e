"""Operators on small inputs with awkward rows."""

import hashlib
import io
import json
import os
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.functions import wording as w
from foliospark.operators import accounts, enrich, export, games, ingest, kb, layout, lesson, outline, retention, retrieval, vectors
from foliospark.sources import folders, office, office_write, sinks
from foliospark.streaming import ingest as stream


def outlines(spark, *docs):
    return spark.createDataFrame([(k, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for k, d in enumerate(docs)], "project_id long, outline string")


STAGES = [
    {"stage": "P1-Bridge-in", "content_description": "d1"},
    {"stage": "Two", "core_knowledge_points": []},
    {"content_description": "unused", "core_knowledge_points": [{"point": "p", "explanation": "e", "is_key_point": True}, {"is_difficult_point": 1}], "interactive_game": {"game_type": "g"}},
    {"stage": "Four", "core_knowledge_points": None},
    {"stage": "Five", "interactive_game": None, "content_description": 'x {"game_type": "quiz"}'},
]


def test_flatten(spark):
    plain = {"syllabus_content": STAGES}
    got = outline.flatten_pages(outlines(spark, plain, {"outline_data": plain}, json.dumps(json.dumps(plain)), {"outline_data": json.dumps(plain)}, {}, "bad")).collect()
    one = [(r.stage_pos, r.point_pos, r.title, r.content, r.game and json.loads(r.game)) for r in sorted(got, key=lambda r: (r.project_id, r.stage_pos, r.point_pos)) if r.project_id == 0]
    assert one == [
        (0, 0, "in", "d1", None),
        (2, 0, "p", "e", {"game_type": "g"}),
        (2, 1, w.UNNAMED_STAGE, "", {"game_type": "g"}),
        (4, 0, "Five", f"x {w.GAME_LOADED}", {"game_type": "quiz"}),
    ]
    assert {p: sum(r.project_id == p for r in got) for p in range(6)} == {0: 4, 1: 4, 2: 4, 3: 0, 4: 0, 5: 0}


def test_choose_queue(spark):
    df = spark.createDataFrame([("[1]", "{}"), ("[]", '{"a": 1}'), (None, None), ("null", "[]")], "q string, o string")
    assert [r[0] for r in df.select(outline.choose_queue(F.col("q"), F.col("o"))).collect()] == ["[1]", '{"a": 1}', None, None]


def test_layout(spark):
    pages = spark.createDataFrame([(1, 1, 4, None, None, None, None), (1, 2, 4, "t", "c", "i.png", ""), (1, 3, 4, "t", "c", "gone.png", "/g"), (1, 4, 4, "t", "c", "i.png", "/g")], "project_id long, page_no int, n_pages int, title string, content string, image_path string, game_url string")
    files = spark.createDataFrame([("i.png",), ("i.png",)], "path string")
    rows = layout.elements(layout.with_existing_images(pages, files))
    kinds = {p: [r.type for r in sorted(rows.where(f"page_no = {p}").collect(), key=lambda r: r.pos)] for p in range(1, 5)}
    assert kinds == {1: ["heading", "text", "text"], 2: ["heading", "text", "image", "text"], 3: ["heading", "text", "game_link", "text"], 4: ["heading", "text", "image", "game_link", "text"]}
    assert rows.where("page_no = 1 and pos = 0").first().content == w.UNNAMED_PAGE
    deck = json.loads(layout.decks(rows).first().deck)
    assert deck["metadata"]["size"] == {"width": 1280, "height": 720} and [len(s["elements"]) for s in deck["slides"]] == [3, 4, 4, 5]
    assert layout.render(rows).where("type = 'heading'").first().rgb == (26, 32, 44)
    plain = spark.createDataFrame([(k, c, s, u, *[None] * 7) for k, c, s, u in (("text", "t", None, None), ("game_link", "g", None, "/x"), ("image", None, "i.png", None), ("image", None, "gone.png", None), ("chart", "c", None, None))], "type string, content string, src string, url string, font_size int, bold boolean, color string, x int, y int, width int, height int")
    got = {r.type: r for r in layout.render(plain, files, "http://h").collect()}
    assert set(got) == {"text", "game_link", "image"} and layout.render(plain).count() == 4
    assert (got["text"].font_size, got["text"].rgb, got["text"].line_spacing, got["text"].width, got["text"].x) == (20, None, 1.3, 800, 0)
    assert (got["game_link"].font_size, got["game_link"].rgb, got["game_link"].link, got["game_link"].underline) == (18, (0, 112, 192), "http://h/x", True)


def test_lesson(spark):
    doc = {"course_metadata": {"title": None, "teaching_methods": "talk", "teaching_objectives": ["x", "y"]}, "syllabus_content": STAGES}
    df = outlines(spark, doc, {})
    info = {r.project_id: r for r in lesson.info(df).collect()}
    assert (info[0].title, info[0].methods, info[0].minutes) == (None, "talk", "45 分钟")
    assert (info[1].title, info[1].methods, info[1].homework) == (w.UNNAMED_COURSE, "讲授法、案例分析法", w.HOMEWORK)
    points = lesson.key_points(df).first()
    assert (points.key_points, points.difficult_points) == ("p", "")
    steps = {r.stage_pos: r for r in lesson.process(df).collect()}
    assert steps[0].activity == "d1" and steps[1].activity == "" and steps[2].activity == f"{w.KEY}p\n    e\n\n{w.DIFFICULT}\n"
    assert lesson.objectives(df).where("project_id = 0").first().objectives == "  1. x\n  2. y\n"
    assert lesson.cells(df).where("project_id = 0").count() == 17 + 3 * 5


def test_kb(spark, tmp_path):
    docs = [
        {"layer": "textbook", "data": {"chapters": [{"chapter_title": "C", "sections": [{"section_title": "S", "raw_text": "教 学\n a"}, {"raw_text": " "}]}]}},
        {"layer": "resource", "data": {"resource_info": {"title": "R"}, "pages": [{"page_no": 3, "page_text": "body"}]}},
        {"layer": "syllabus", "data": {"teaching_goals": [""], "knowledge_points": {"b": "the later key", "a": "the other key"}}},
        {"layer": "hotspot", "data": {"hotspot_item": [{"hotspot_index": "not to be seen", "t": "news text"}]}},
        {"layer": "strange", "data": "a plain string"},
        {"data": {}},
    ]
    (tmp_path / "a.json").write_text(json.dumps(docs, ensure_ascii=False))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("7")
    (tmp_path / "d.txt").write_text("[]")
    split = kb.split_documents(kb.read_sources(spark, str(tmp_path)))
    assert split.count() == 6
    out = kb.export_markdown(kb.route_documents(split)).collect()
    assert [r.file for r in out] == ["a_clean.md"]
    every = {r.file: r.markdown for r in kb.export_markdown(kb.route_documents(split), kb.read_sources(spark, str(tmp_path))).collect()}
    assert every == {"a_clean.md": out[0].markdown, "c_clean.md": ""}
    rule = "\n\n---\n\n"
    assert out[0].markdown == rule.join([
        f"# 【教材】《{w.UNNAMED_BOOK}》- C - S\n\n教学 a", "# 【优质资源】R - 第 3 页\n\nbody", f"{w.GOALS_HEADING}\n\n", f"{w.POINTS_HEADING}\n\nthe later key the other key",
        f"# 【时事热点】新闻素材：{w.UNNAMED_HOTSPOT}\n\nnews text", "# 【strange】补充知识片段\n\na plain string", "",
    ])


def test_dense_ids_and_top_k(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as k").repartition(7)
    got = vectors.dense_ids(rows, "k").collect()
    assert sorted((r.id, r.k) for r in got) == [(k, k) for k in range(1000)]
    assert vectors.dense_ids(rows.limit(0), "k").collect() == []
    space = spark.createDataFrame([(k, [1.0, 0.0] if k < 5 else [0.0, 1.0] if k < 8 else None if k < 9 else [0.0, 0.0]) for k in range(11)], "id long, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 3.0]), (3, None)], "query_id long, vector array<float>")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in vectors.top_k(space, asked, 4).collect()}
    assert [got[1, k][0] for k in (1, 2, 3, 4)] == [0, 1, 2, 3] and [got[2, k][0] for k in (1, 2, 3, 4)] == [5, 6, 7, 0]
    assert len(got) == 8 and vectors.top_k(space, asked.limit(0)).collect() == []
    monkeypatch.setattr(vectors, "ROW_BYTES", 40)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 1)
    assert sorted(vectors.top_k(space, asked, 4).collect()) == sorted((q, r, *v) for (q, r), v in got.items())
    hits = spark.createDataFrame([(1, 2, None, "b"), (1, 1, "s", None)], "query_id long, rank int, source string, text string")
    assert vectors.evidence(hits).first().evidence == f"【来源: s】\n\n\n【来源: {w.EVIDENCE_SOURCE}】\nb"


def test_ingest(spark):
    files = spark.createDataFrame([("a.PDF",), ("b.txt",), ("c.tar.xlsx",), (None,)], "name string")
    assert [(r.ext, r.route) for r in ingest.accept(files).collect()] == [("pdf", "document"), ("xlsx", "sheet")]
    blocks = spark.createDataFrame([("f", 1, "b ", 1), ("f", 0, " a", 2), ("g", 0, None, 4), ("h", 0, "x" * 90_000, 1)], "file string, pos int, block string, n_elements int")
    got = {r.file: r for r in ingest.parse_results(blocks).collect()}
    assert (got["f"].text, got["f"].element_count) == ("a\n\nb", 3)
    assert got["g"].text == w.NOTHING_READ and got["g"].element_count == 4
    assert got["h"].char_count == 80_000 + len(w.CUT_NOTICE)


def test_games(spark):
    deck = games.cards(spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "c", "d")], "game_id int, pair_id int, left string, right string"))
    assert games.matches(deck).count() == 2 and deck.count() == 4
    assert sorted(r.place for r in games.shuffled(deck, 4).collect()) == [1, 2, 3, 4]
    flips = spark.createDataFrame([(1, 1, 1, "left"), (1, 2, 1, "right"), (1, 3, 2, "left"), (1, 4, 2, "left"), (1, 5, 2, "right")], "game_id int, at int, pair_id int, side string")
    moves = games.flips(flips)
    assert [(r.move, r.matched) for r in moves.sort("move").collect()] == [(0, True), (1, True)]
    assert games.progress(moves, deck).first().asDict() == {"game_id": 1, "matched_cards": 4, "cards": 4, "won": True}
    again = spark.createDataFrame([(1, k, 1, s) for k, s in enumerate(["left", "right"] * 2)] + [(2, 1, 1, "left"), (2, 2, 2, "left"), (2, 3, 1, "left")], "game_id int, at int, pair_id int, side string")
    assert sorted(tuple(r) for r in games.flips(again).collect()) == [(1, 0, 0, True), (2, 0, 1, False)]
    built = games.build(spark.createDataFrame([("<s>/*INJECT_DATA*/</s>", '{"a": "</script>"}'), (None, "{}")], "html string, payload string")).collect()
    assert built[0].page == '<s>{"a": "<\\/script>"}</s>' and built[1].page is None
    last = games.last_written(spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, at int, v string"), ["k"], "at")
    assert last.first().v == "new"


def test_enrich(spark):
    pages = spark.createDataFrame([(1, 0, "t", "c", True, '{"game_type": "quiz"}'), (1, 1, "t", "c", None, '{"x": 1}'), (1, 2, None, None, False, None)], "project_id long, page_pos int, title string, content string, need_image boolean, interactive_game string")
    templates = spark.createDataFrame([("quiz", "h")], "game_type string, html string")
    fail = lambda s: s.where(s.str.contains("Title: t"))
    got = sorted(enrich.run(pages, templates, enrich.Providers(complete=fail, draw=lambda s: s.str.encode("utf-8"))).collect(), key=lambda r: r.page_pos)
    assert [r.game_url for r in got] == ["/static/exports/interactive_game_1_quiz.html", "", None]
    assert got[0].image_path.startswith("img_") and got[2].image_path is None and got[2].content is None
    plain = enrich.run(pages, templates).sort("page_pos").collect()
    assert [r.content for r in plain] == ["c", "c", None] and [r.image_path for r in plain] == ["", "", None]


def test_accounts_and_retention(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, username string")
    asked = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "username string")
    assert [r.username for r in accounts.register(asked, users).collect()] == ["c"]
    assert accounts.lookup(asked, users).where("found").count() == 1 and accounts.lookup(asked, users).count() == 4
    assert accounts.find(users, "b").first().id == 2
    files = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', true), ('b', timestamp'2023-12-31 23:59:59', true), ('.gitkeep', timestamp'2020-01-01', true), ('d', timestamp'2020-01-01', false), (null, timestamp'2020-01-01', true) as t(name, mtime, is_file)")
    assert [r.name for r in retention.expired(files, F.lit("2024-01-02").cast("timestamp")).collect()] == ["b"]


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://x"><sheets><sheet name="S1" r:id="r1"/><sheet name="S2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><r><t>al</t></r><r><t>ice</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", '<w><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>5</v></c></row></sheetData></w>')
        z.writestr("xl/worksheets/s2.xml", '<w><sheetData><row><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></w>')


def test_office(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t></w:r><w:r><w:t>dy</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:d>')
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<p:s xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>T{k}</a:t></a:p></p:sp></p:s>')
    (tmp_path / "d.docx").write_text("no archive")
    spark.dataSource.register(office.OfficeSource)
    rows = spark.read.format("office").load(str(tmp_path)).sort("file", "pos").collect()
    assert [(r.file, r.kind, r.sheet, r.row, r.col, r.text) for r in rows if r.file != "d.docx"] == [
        ("a.xlsx", "Cell", "S1", 0, 0, "name"), ("a.xlsx", "Cell", "S1", 1, 0, "alice"), ("a.xlsx", "Cell", "S1", 1, 27, "5"), ("a.xlsx", "Cell", "S2", 2, 1, "in"),
        ("b.docx", "Title", None, None, None, "Head"), ("b.docx", "NarrativeText", None, None, None, "Body"), ("b.docx", "Table", None, None, None, "x | y"),
        ("c.pptx", "Title", None, None, None, "T2"), ("c.pptx", "Title", None, None, None, "T10"),
    ]
    assert [r.kind for r in rows if r.file == "d.docx"] == ["Error"]


def test_sinks(spark, tmp_path):
    out = tmp_path / "out"
    assert sinks.write_files(spark.createDataFrame([("a.html", "x"), ("../../b.html", "y")], "name string, content string"), str(out)) == 2
    assert sorted(p.name for p in out.iterdir()) == ["a.html", "b.html"]
    old = time.time() - 90_000
    os.utime(out / "a.html", (old, old))
    expired = retention.expired(folders.listing(spark, str(out)))
    assert [r.name for r in expired.collect()] == ["a.html"] and sinks.delete_files(expired) == 1
    assert [p.name for p in out.iterdir()] == ["b.html"]
    rows = spark.range(3)
    assert sinks.insert(rows, str(tmp_path / "t")) == 3 and sinks.insert(rows.limit(0), str(tmp_path / "t")) == 0
    (tmp_path / "template_quiz.html").write_text("q")
    assert folders.templates(spark, str(tmp_path)).collect() == [("quiz", "q")]


def test_streaming(spark, tmp_path):
    files, out = tmp_path / "in", tmp_path / "out"
    files.mkdir()
    for k in range(2):
        (files / f"{k}.md").write_text(f"a long enough piece {k}\n---\nshort")
        stream.chunk_into(stream.arriving(spark, str(files)), str(out), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(out)).collect()) == ["a long enough piece 0", "a long enough piece 1"]


def test_chunk_round_trip(spark):
    files = spark.createDataFrame([("a", "first long piece\n\n---\n\nsecond long piece")], "source string, markdown string")
    once = kb.chunk(files)
    again = kb.chunk(once.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("markdown")))
    assert once.collect() == again.collect()


@pytest.mark.parametrize("name", ["sheet", "none"])
def test_sheet_text(spark, name):
    rows = spark.createDataFrame([(name, 1, None), (name, 0, "x")], "sheet string, k int, v string")
    got = ingest.sheet_text(rows, ["k", "v"], "k").first()
    assert got.markdown == f"\n[📊 表格：{name}]\n| k | v |\n| --- | --- |\n| 0 | x |\n| 1 |  |\n" and got.n_rows == 2


def test_exports(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, 2, "Title <1>", "a\nb & c\x01", "i.png", "/g"), (1, 2, 2, "Second", "d", "", "")], "project_id long, page_no int, n_pages int, title string, content string, image_path string, game_url string")
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (90).to_bytes(4) + (45).to_bytes(4)
    pictures = spark.createDataFrame([("i.png", png), ("other.png", b"x")], "path string, content binary")
    files = office_write.presentations(layout.decks(layout.elements(pages), "me"), "http://host", pictures)
    with zipfile.ZipFile(io.BytesIO(files.first().content)) as z:
        assert z.read("ppt/media/image1_2.png") == png and "http://host/g" in z.read("ppt/slides/_rels/slide1.xml.rels").decode()
        first = z.read("ppt/slides/slide1.xml").decode()
        wide = round(450 / 1280 * 13.333 * 914_400)
        assert f'cx="{wide}" cy="{round(wide / 2)}"' in first and 'r:embed="i2"' in first and 'val="130000"' in first
    bare = office_write.presentations(layout.decks(layout.elements(pages)))
    with zipfile.ZipFile(io.BytesIO(bare.first().content)) as z:
        assert not [n for n in z.namelist() if "media" in n]
    plans = office_write.lesson_documents(lesson.cells(outlines(spark, {"syllabus_content": STAGES})))
    assert sinks.write_files(files.unionByName(plans), str(tmp_path)) == 2
    spark.dataSource.register(office.OfficeSource)
    rows = spark.read.format("office").load(str(tmp_path)).sort("file", "pos").collect()
    deck = [(r.kind, r.text) for r in rows if r.file.endswith(".pptx")]
    assert deck == [("Title", "Title <1>"), ("NarrativeText", "a\nb & c"), ("NarrativeText", w.GAME_LINK), ("NarrativeText", "1 / 2"), ("Title", "Second"), ("NarrativeText", "d"), ("NarrativeText", "2 / 2")]
    plan = [r for r in rows if r.file.endswith(".docx")]
    assert plan[0].kind == "Title" and [r.kind for r in plan[1:]] == ["Table"] * 4
    tools = enrich.Providers(convert=lambda s: s, pages=lambda s: s.map(lambda b: [b[:2], b[:2]]))
    pdfs = export.to_pdf(files, tools)
    got = export.response(pdfs, export.previews(pdfs, tools)).first()
    assert got.download_url_pdf == "/static/exports/presentation_1.pdf" and got.preview_images == ["/static/exports/preview_1_1.png", "/static/exports/preview_1_2.png"]
    none = export.to_pdf(files, enrich.Providers())
    got = export.response(none, export.previews(none, enrich.Providers())).first()
    assert got.download_url_pdf is None and got.preview_images == []


def test_providers_of_ingest(spark):
    files = ingest.accept(spark.createDataFrame([("a.png", b"x"), ("b.mp4", b"y"), ("c.pdf", b"z")], "name string, content binary"))
    tools = enrich.Providers(read_image=lambda s: s.map(lambda b: "seen"), partition=lambda s: s.map(lambda b: [{"kind": "Title", "text": "T", "html": None}, {"kind": "Image", "text": "no", "html": None}, {"kind": "Table", "text": "t", "html": "<table/>"}]))
    got = {r.file: r for r in ingest.parse_results(ingest.media_blocks(files, tools).unionByName(ingest.document_blocks(files, tools))).collect()}
    assert got["a.png"].text == f"{w.OCR_CAPTION}\nseen" and got["a.png"].element_count == 1
    assert got["b.mp4"].text == w.SPEECH_FAILED.format("no text") and got["b.mp4"].element_count == 0
    assert got["c.pdf"].text == f"T\n\n\n{w.TABLE_CAPTION}\n<table/>" and got["c.pdf"].element_count == 3


def test_no_file_is_lost(spark, tmp_path):
    files = ingest.accept(spark.createDataFrame([("bad.pdf", b"x"), ("empty.pdf", b""), ("good.pdf", b"y")], "name string, content binary"))
    tools = enrich.Providers(partition=lambda s: s.map(lambda b: None if b == b"x" else [{"kind": "Text", "text": "T", "html": None}] * len(b)))
    got = {r.file: r for r in ingest.parse_results(ingest.document_blocks(files, tools)).collect()}
    assert {k: v.status for k, v in got.items()} == {"bad.pdf": "error", "empty.pdf": "success", "good.pdf": "success"}
    assert got["bad.pdf"].text is None and got["bad.pdf"].message and got["empty.pdf"].text == w.NOTHING_READ and got["empty.pdf"].element_count == 0
    office_write_rows = office_write.lesson_documents(lesson.cells(outlines(spark, {"syllabus_content": STAGES})))
    sinks.write_files(office_write_rows, str(tmp_path))
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "broken.pptx").write_bytes(b"x")
    spark.dataSource.register(office.OfficeSource)
    read = {r.file: r for r in ingest.parse_results(ingest.office_blocks(spark.read.format("office").load(str(tmp_path)))).collect()}
    assert {k: v.status for k, v in read.items()} == {"word_project_0.docx": "success", "old.xls": "error", "broken.pptx": "error"}
    assert read["word_project_0.docx"].text.startswith(w.LESSON_TITLE) and "xlsx" in read["old.xls"].message
    with zipfile.ZipFile(tmp_path / "word_project_0.docx") as z:
        body = z.read("word/document.xml").decode()
    assert body.count(w.CELL_FILL) == 11 and '<w:b/>' in body


def test_users_and_collections(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS people")
    sinks.create_users(spark, "people")
    sinks.create_users(spark, "people")
    sinks.insert_users(spark.createDataFrame([(1, "a", "h", "teacher", True)], "id long, username string, hashed_password string, role string, is_active boolean"), "people")
    assert [(r.username, r.created_at == r.updated_at) for r in spark.table("people").collect()] == [("a", True)]
    sinks.reset_collection(spark.range(3), "things")
    sinks.reset_collection(spark.range(2), "things")
    assert spark.table("things").count() == 2
    for name in ("people", "things"):
        spark.sql(f"DROP TABLE {name}")


def test_folder_scans(spark, tmp_path):
    (tmp_path / "a.md").write_text("# a")
    (tmp_path / "b.txt").write_text("b")
    assert folders.markdown_files(spark, str(tmp_path)).collect() == [("a.md", "# a")]
    assert sorted((r.name, bytes(r.content)) for r in folders.uploads(spark, str(tmp_path)).collect()) == [("a.md", b"# a"), ("b.txt", b"b")]
    assert sorted(r.name for r in folders.listing(spark, str(tmp_path), str(tmp_path / "missing")).collect()) == ["a.md", "b.txt"]
    assert folders.listing(spark, str(tmp_path / "missing")).collect() == []


def test_deep_json(spark):
    df = spark.createDataFrame([("[" * 100_000,), ("[" * 100_000 + "]" * 100_000,), ('["a long leaf"]',)], "t string")
    assert [r[0] for r in df.select(jsonx.leaf_text("t")).collect()] == [None, None, "a long leaf"]


def test_login(spark):
    users = spark.createDataFrame([("a", "h1"), ("b", None)], "username string, hashed_password string")
    asked = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("z", "1"), (None, None)], "username string, password string")
    got = accounts.login(asked, users, lambda p, h: "h" + p == h).collect()
    assert sorted((r.username or "", r.password or "") for r in got if r.allowed) == [("a", "1")] and len(got) == 5


def test_workbook_blocks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    spark.dataSource.register(office.OfficeSource)
    got = ingest.parse_results(ingest.workbook_blocks(spark.read.format("office").load(str(tmp_path)))).first()
    empty = " | ".join([""] * 27)
    assert got.text.startswith(f"[📊 表格：S1]\n| name | {empty} |\n|" + " --- |" * 28 + "\n| alice |")
    assert got.text.endswith("[📊 表格：S2]\n|  | in |") and got.element_count == 2


def test_retrieval(spark):
    requests = spark.createDataFrame([(1, "alpha beta", "given"), (2, None, None)], "query_id long, topic string, outside string")
    chunks = spark.createDataFrame([(0, "alpha beta", "s0"), (1, "gamma delta", "s1")], "id long, text string, source string")
    tools = enrich.Providers(complete=lambda s: s.map(lambda x: '{"outline_data": {}}' if "given" in x else "no"))
    collection = chunks.withColumn("vector", enrich.call(tools.embed, "array<double>", F.col("text")))
    got = {r.query_id: r.evidence for r in retrieval.with_evidence(requests, collection, tools, 1).collect()}
    assert got == {1: f"{w.OUTSIDE_LABEL}\ngiven\n\n{w.CLOUD_LABEL}\n【来源: s0】\nalpha beta\n\n", 2: ""}
    replies = {r.query_id: (r.outline, r.error is None) for r in retrieval.outline(requests, None, tools).collect()}
    assert replies == {1: ('{"outline_data":{}}', True), 2: (None, False)}


def test_finished_decks_leave_in_small_batches(spark):
    """A batch of rows makes files of many times its size; they must not be held together."""

    class Frame:
        select = withColumn = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    big = b"\x89PNG\r\n\x1a\n" + bytes(1 << 20)
    deck = json.dumps({"slides": [{"elements": [{"type": "image", "src": "a"}]}]})
    rows = pa.RecordBatch.from_pylist([{"project_id": k, "name": str(k), "deck": deck, "pictures": [{"path": "a", "content": big}]} for k in range(20)])
    made = list(office_write.presentations(Frame())(iter([rows])))
    assert [x for b in made for x in b.column("project_id").to_pylist()] == list(range(20))
    assert max(b.nbytes for b in made) < 6 << 20


def test_archives_are_as_zipfile_makes_and_reads_them(tmp_path):
    """Members are written and read without zipfile; odd and damaged archives are left to it."""
    members = {"[Content_Types].xml": "<a/>", "ppt/é.xml": "é", "ppt/media/i.png": b"\x89PNG" + bytes(99), "empty": b""}
    want = io.BytesIO()
    with zipfile.ZipFile(want, "w") as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body if isinstance(body, bytes) else office_write._HEAD + body)
    assert office_write._archive([office_write._member(*m) for m in members.items()]) == want.getvalue()

    plain = {n: b if isinstance(b, bytes) else (office_write._HEAD + b).encode() for n, b in members.items()}
    assert office.parts(want.getvalue(), lambda n: n != "empty") == {n: b for n, b in plain.items() if n != "empty"}
    for kind in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", kind) as z:
            for name, body in plain.items():
                with z.open(name, "w") as f:
                    f.write(body)
            z.comment = b"a note" if kind == zipfile.ZIP_STORED else b""
        assert office.parts(made.getvalue(), bool) == plain
    broken = bytearray(want.getvalue())
    broken[broken.index(b"<a/>")] ^= 1
    with pytest.raises(zipfile.BadZipFile):
        office.parts(bytes(broken), bool)
    with pytest.raises(zipfile.BadZipFile):
        office.parts(want.getvalue()[:-5], bool)


def test_decks_of_pages(spark):
    """Decks made page by page are those made of element rows."""
    pages = spark.createDataFrame(
        [(1, 2, 2, None, "b", "i.png", "/g"), (1, 1, 2, "A", None, "", None), (2, 1, 1, "é\n", "c", None, "")],
        "project_id long, page_no int, n_pages int, title string, content string, image_path string, game_url string",
    )
    got = layout.page_decks(pages, "me").sort("project_id").collect()
    assert got == layout.decks(layout.elements(pages), "me").sort("project_id").collect() and len(got) == 2
    assert json.loads(got[0].deck)["slides"][1]["elements"][2]["src"] == "i.png"


def test_digests(spark, tmp_path):
    """Files are read by name, a damaged one as its error; a name's file may be written by the same task."""
    pages = spark.createDataFrame([(1, 1, 1, "T", "c", "", "")], "project_id long, page_no int, n_pages int, title string, content string, image_path string, game_url string")
    made = office_write.presentations(layout.page_decks(pages), folder=str(tmp_path / "out"))
    assert [(r.file, r.n, r.text_md5) for r in office.digests(made, str(tmp_path / "out")).collect()] == [("presentation_1.pptx", 3, hashlib.md5(b"Title:T\nNarrativeText:c\nNarrativeText:1 / 1").hexdigest())]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["presentation_1.pptx"]
    (tmp_path / "out" / "b.docx").write_text("no archive")
    assert [(r.file, r.n) for r in office.digests(spark.createDataFrame([("b.docx",)], "name string"), str(tmp_path / "out")).collect()] == [("b.docx", 1)]


def test_plans_are_taken_apart_by_column(spark, tmp_path):
    """Lists of cells leave an Arrow batch as they stood in it, whichever part of a batch it is; documents show them in order."""
    kind = pa.list_(pa.struct({"table_no": pa.int32(), "row": pa.int32(), "col": pa.int32(), "text": pa.string()}))
    plans = [[(3, 1, 0, "b"), (1, 0, 0, None)], [], [(2, 0, 0, "x\ny <&>"), (2, 0, 1, "z"), (2, 1, 0, "wide")]]
    as_rows = [[dict(zip(("table_no", "row", "col", "text"), c, strict=True)) for c in p] for p in plans]
    whole = pa.RecordBatch.from_pydict({"cells": pa.array(as_rows, kind)})
    assert list(office_write._cells(whole)) == plans and list(office_write._cells(whole.slice(1))) == plans[1:]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(as_rows)], "project_id long, cells array<struct<table_no:int,row:int,col:int,text:string>>")
    office_write.plan_documents(rows, str(tmp_path)).count()
    read = {k: [text for _, text in office.paragraphs((tmp_path / f"word_project_{k}.docx").read_bytes())] for k in range(3)}
    assert read == {0: [w.LESSON_TITLE, "", "b"], 1: [w.LESSON_TITLE], 2: [w.LESSON_TITLE, "xy <&> | z\nwide"]}
    with zipfile.ZipFile(tmp_path / "word_project_2.docx") as z:
        assert z.read("word/document.xml").decode().count('<w:gridSpan w:val="2"/>') == 1
