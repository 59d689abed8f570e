"""Nulls in any column, empty and long texts, repeated rows, empty tables, clashing column names."""

import pytest

import corpus_pipeline

from foliospark.llm import language_id, license_scan, line_dedup, media_columns, packing, quality_rules, simhash_dedup, source_mixing, toxicity

from .common import documents, nothing, rows


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 1), (4, 1, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def pages(spark):
    return spark.createDataFrame([(1, None, None, "x"), (2, "https://a.b.de/x", "", "x"), (None, "", "<html lang='fr'><p>le la les", "x"), (2, "::bad", "<html lang=zz>", "x")], "page_id long, url string, html string, lang string")


PER_DOCUMENT = {
    "quality": lambda s, d: quality_rules.quality_rules(d),
    "simhash": lambda s, d: simhash_dedup.simhash_components(d),
    "mixing": lambda s, d: source_mixing.mix(d),
    "lines": lambda s, d: line_dedup.line_dedup_digest(d),
    "license": lambda s, d: license_scan.license_scan(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "media": lambda s, d: media_columns.media_columns(d),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_row(spark, name):
    got = PER_DOCUMENT[name](spark, documents(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows())


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_empty_table(spark, name):
    assert PER_DOCUMENT[name](spark, nothing(spark)).collect() == []


def test_language_rows(spark):
    got = language_id.language_id(pages(spark), documents(spark)).collect()
    assert len(got) == 4 + len(rows())
    assert {r.kind for r in got} == {"page", "document"}
    assert language_id.language_id(pages(spark).limit(0), nothing(spark)).collect() == []
    alone = language_id.language_id(pages(spark), nothing(spark)).collect()
    assert {r.lang_found for r in alone} == {"und"}


def test_packing_rows(spark):
    assert packing.pack(nothing(spark)).collect() == []
    got = packing.pack(documents(spark)).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 3 * next(r.doc_tokens for r in got if r.doc_id == 3)


@pytest.mark.parametrize("keep", [quality_rules.keep_good, line_dedup.drop_common_lines, simhash_dedup.keep_one, source_mixing.mix_documents])
def test_stages_keep_columns(spark, keep):
    docs = documents(spark)
    out = keep(docs)
    assert out.dtypes == docs.dtypes
    out.collect()
    assert keep(nothing(spark)).collect() == []


def test_pipeline_on_awkward_rows(spark):
    """All stages one after the other over nulls, repeats, long and empty texts, and over no rows at all."""
    for docs in (documents(spark), nothing(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert all(p.length > 0 for p in pieces) and bool(pieces) == bool(docs.count())
