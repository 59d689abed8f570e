"""Quality rules and source mixing against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import packing, quality_rules, source_mixing

from ..conftest import DATA
from .common import documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_measures(spark):
    odd = spark.createDataFrame([(1, "a b c a b c a b c d a b c"), (2, "x\n x\nx\n\n\nx \n"), (3, "é\x0bü\fö # <|> " * 30), (4, "a a a a"), (5, "a b a b a")], "doc_id long, text string")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).where("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).unionByName(odd.select((F.col("doc_id") + 20_000).alias("doc_id"), "text"))
    want = sorted((r.doc_id, *measures(r.text)) for r in docs.collect())
    got = quality_rules.quality_rules(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.6


def test_other_scripts_need_no_stop_words(spark):
    rng = random.Random(1)
    words = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(80))
    rows = [(1, words("абвгдежзиклмнопрст")), (2, words("bcdfghjklmnpqrst")), (3, words("αβγδεζηθικλμ"))]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: True}


def fill(sizes, weights, total, cap=2.0):
    """Targets by sharing the excess again and again."""
    target, free = {}, dict(weights)
    left = total
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            del free[s]
    return target


@pytest.mark.parametrize("data", [DATA, "edges"])
def test_mix(spark, data):
    docs = documents(spark) if data == "edges" else spark.read.parquet(f"{data}/documents.parquet")
    out = source_mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    places = [r.position for r in out if r.position is not None]
    assert places == sorted(places) and all(0 <= p < 1 for p in places)
    assert sorted(map(str, out)) == sorted(map(str, source_mixing.mix(docs.repartition(3)).collect()))


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = source_mixing.mix_documents(docs)
    taken = Counter({r.doc_id: r.taken for r in source_mixing.mix(docs).collect() if r.taken})
    got = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert texts[r.doc_id].lstrip().startswith(r.text.lstrip()) and (r.text == texts[r.doc_id] or r.n_chars == len(r.text))
    assert got == taken


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "source mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA)
        assert docs.columns == before.columns and 0 < docs.count()
    out = corpus_pipeline.run(spark, DATA)
    pieces = out.collect()
    tokens = packing.pack(docs).agg(F.sum("length")).first()[0]
    assert sum(p.length for p in pieces) == tokens
