"""Text and JSON functions: the truth table, and properties against plain Python."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.functions import text as t
from foliospark.functions import wording as w


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first()




@pytest.mark.parametrize(
    ("raw", "want"),
    [("教 学 目 标", "教学 目标"), (None, ""), ("", ""), ("教　学", "教学"), (" a \n b\x1c", "a b"), ("a 教", "a 教"), (" 教 ", "教")],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, t.clean_text(F.col("x")))[0] == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab教学é \n\t\x1c\x85\xa0 　-")), max_size=20), min_size=20, max_size=20))
def test_clean_as_python(spark, texts):
    def clean(s):
        return re.sub(r"\s+", " ", re.sub(r"([^\x00-\xff])\s+([^\x00-\xff])", r"\1\2", s)).strip()

    df = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "k long, x string")
    assert [r[1] for r in df.select("k", t.clean_text(F.col("x"))).sort("k").collect()] == [clean(s) for s in texts]
    got = [r[1] for r in df.select("k", t.chunks(F.col("x"))).sort("k").collect()]
    assert got == [[c.strip() for c in s.split("---") if len(c.strip()) > 10] for s in texts]


@pytest.mark.parametrize(("raw", "want"), [("P1-Bridge-in", "in"), (" Intro ", " Intro "), ("a- b ", "b"), (None, None)])
def test_stage_title(spark, raw, want):
    assert one(spark, raw, t.stage_title(F.col("x")))[0] == want


def test_chunks(spark):
    assert one(spark, "a-----b---", F.split(F.col("x"), "---", -1))[0] == ["a", "--b", ""]
    assert one(spark, "0123456789--- 01234567890 ", t.chunks(F.col("x")))[0] == ["01234567890"]


@pytest.mark.parametrize(("n", "want"), [(80_000, 80_000), (80_001, 80_000 + len(w.CUT_NOTICE)), (3, 3)])
def test_guard(spark, n, want):
    assert one(spark, "x" * n, F.length(t.guard(F.col("x"))))[0] == want


@pytest.mark.parametrize(("raw", "want"), [("#2c3e50", (44, 62, 80)), ("##2c3e50", (44, 62, 80)), ("#fff", (0, 0, 0)), ("zzzzzz", (None,) * 3)])
def test_rgb(spark, raw, want):
    assert tuple(one(spark, raw, t.rgb(F.col("x")))[0]) == want


@pytest.mark.parametrize(("raw", "want"), [("a.PDF", "document"), ("a.b.xlsx", "sheet"), ("a.WEBP", "image"), ("x.mkv", "video"), ("pdf", "document"), ("noext", None), ("a.txt", None)])
def test_route(spark, raw, want):
    assert one(spark, raw, t.route(F.col("x")))[0] == want


def test_inches(spark):
    assert one(spark, 1280, t.inches(F.col("x")), kind="int")[0] == pytest.approx(13.333)


@pytest.mark.parametrize(
    ("raw", "want", "error"),
    [
        ('{"a": 1}', {"a": 1}, None),
        ('```json\n{"a": 1}\n```', {"a": 1}, None),
        ('```\n{"a": 1}\n```', {"a": 1}, None),
        ('so: {"a": {"b": 2}} done', {"a": {"b": 2}}, None),
        ("[1]", [1], None),
        ("null", None, jsonx.NOT_OBJECT),
        ('{bad} then {"a": 1}', None, jsonx.NOT_JSON),
        ("nothing", None, jsonx.NOT_OBJECT),
        ('{"a": ', None, jsonx.NOT_OBJECT),
    ],
)
def test_tolerant(spark, raw, want, error):
    got = one(spark, raw, jsonx.tolerant(F.col("x")).alias("r")).r
    assert (json.loads(got.json) if got.json else None, got.error) == (want, error)


def test_mine_game(spark):
    def mined(desc, own=None):
        game, text = jsonx.mine_game(F.col("x"), F.try_parse_json(F.lit(own).cast("string")))
        r = one(spark, desc, F.to_json(game).alias("g"), text.alias("t"))
        return (json.loads(r.g) if r.g else None), r.t

    g = '{"game_type": "quiz"}'
    assert mined(f"a {g} b {g}") == (json.loads(g), f"a {w.GAME_LOADED} b {w.GAME_LOADED}")
    assert mined(g, '{"game_type": "own"}') == ({"game_type": "own"}, g)
    assert mined(g, "{}")[0] == json.loads(g)
    assert mined('{"game_type": "m", "p": [{"l": 1}]}') == (None, '{"game_type": "m", "p": [{"l": 1}]}')
    assert mined("{x} " + g) == (None, "{x} " + g)
    assert mined("plain") == (None, "plain")


def test_missing_against_null(spark):
    r = one(spark, '{"a": null, "b": "", "c": 0}', *(jsonx.get(F.parse_json(F.col("x")), f"$.{k}", default=F.lit("d")).alias(k) for k in "abcz"))
    assert (r.a, r.b, r.c, r.z) == (None, "", "0", "d")
    values = ["null", "false", '""', "[]", "{}", "0", "1", '"x"', "[0]", "true"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    assert [r[1] for r in df.select("k", jsonx.truthy(F.parse_json(F.col("x")))).sort("k").collect()] == [False] * 6 + [True] * 4


def test_unwrap_and_coerce(spark):
    k = lambda v: F.try_variant_get(jsonx.unwrap(jsonx.string_or_object(v)), "$.k", "int")
    assert one(spark, '{"outline_data": {"k": 1}, "k": 2}', k(F.col("x")))[0] == 1
    assert one(spark, '{"outline_data": "{}", "k": 2}', k(F.col("x")))[0] == 2
    assert one(spark, '"{\\"k\\": 3}"', k(F.col("x")))[0] == 3
    assert one(spark, "broken", k(F.col("x")))[0] is None


def test_leaves(spark):
    doc = {"z": "first one", "metadata": {"x": "hidden text"}, "a": ["short", 5, True, None, {"id": "an identifier", "b": "  second one "}], "t": "12345", "u": "123456"}
    deep = "the deepest leaf"
    for _ in range(400):
        deep = [{"k": deep}]
    df = spark.createDataFrame([(0, json.dumps(doc)), (1, json.dumps(deep)), (2, "{"), (3, None), (4, "[]")], "k int, x string")
    got = [r[1] for r in df.select("k", jsonx.leaf_text(F.col("x"))).sort("k").collect()]
    assert got == ["first one\nsecond one\n123456", "the deepest leaf", None, None, ""]
