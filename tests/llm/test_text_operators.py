"""License scans, toxicity, chat formatting, language identification, media columns."""

import hashlib
import json
import random
import re
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import chat_format, language_id, license_scan, media_columns, toxicity

from .common import documents

MID = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORDS.findall((text or "").translate(LOWER))
    found = sorted((k, label) for p, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "License", "cc", "by", "CC-BY", "apache", "gnu", "general", "public", "é", "\n", ", ", "-", "mitlicense"]), max_size=30).map(" ".join))
def test_license_base(text):
    assert license_scan.scan(text)[:5] == base(text)


def test_license_rows(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    texts = sorted(base(r.text)[:2] for r in docs.collect())
    assert sorted((r.n_words, r.n_base) for r in license_scan.license_scan(docs).collect()) == texts


def exact_words_stand(phrase, text):
    rest = iter(text.split())
    return all(w in rest for w in phrase.split() if len(w) <= license_scan.EXACT_WORD)


def test_license_one_error_at_every_place():
    for phrase, label in license_scan.NOTICES:
        if len(phrase) < license_scan.CHARS_PER_ERROR:
            continue
        for at in range(len(phrase) + 1):
            for letter in "sq":
                forms = [phrase[:at] + letter + phrase[at:]]
                if at < len(phrase) and phrase[at] != " ":
                    forms += [phrase[:at] + letter + phrase[at + 1 :], phrase[:at] + phrase[at + 1 :]]
                for form in filter(lambda f: exact_words_stand(phrase, f), forms):
                    _, found = license_scan.find_notices(license_scan.fold(f"Under the {form} and by others")[0])
                    assert any(x[2] == label and x[3] <= 1 for x in found), form
    # a notice before a better match of the same phrase
    _, found = license_scan.find_notices(license_scan.fold("the mit licenses are mit license text")[0])
    assert [(a, b, wrong) for a, b, label, wrong, _ in found if label == "mit"] == [(5, 17, 1), (22, 33, 0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_notices(text):
    """All runs of whole words within the errors of a notice, of those that overlap the best, by plain edit distance."""
    words, out = text.split(), set()
    for phrase, label in license_scan.NOTICES:
        budget, near = len(phrase) // license_scan.CHARS_PER_ERROR, []
        starts = [sum(len(w) + 1 for w in words[:k]) for k in range(len(words))]
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if abs(len(run) - len(phrase)) <= budget and (wrong := distance(run, phrase)) <= budget and (wrong == 0 or exact_words_stand(phrase, run)):
                    near.append((wrong, starts[i], starts[i] + len(run)))
        kept = []
        for x in sorted(near):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        out |= {(a + 1, b + 1, label, wrong) for wrong, a, b in kept}
    return sorted(out)


def test_license_against_edit_distance():
    """Recall and precision of 1: the same places, labels and errors as brute force on mutated notices."""
    rng = random.Random(8)
    filler = "the of your fit it is license licenses public mit by and in use free".split()
    for _ in range(150):
        parts = []
        for _ in range(2):
            phrase = list(rng.choice(license_scan.NOTICES)[0])
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(phrase))
                phrase[at : at + rng.randrange(2)] = rng.choice(["", "s", "e", " ", "x"])
            parts += rng.choices(filler, k=rng.randrange(4)) + "".join(phrase).split()
        text = " ".join(parts)
        _, found = license_scan.find_notices(license_scan.fold(text)[0])
        assert sorted(x[:4] for x in found) == brute_notices(text), text


def test_license_short_words_stand():
    for text in ("your IT license expires", "a fit license", "the smit license", "an omit license"):
        assert license_scan.scan(text)[5] == ""


def test_license_of_long_texts():
    took = {}
    for n in (20_000, 80_000):
        text, began = "mit license " * n, time.process_time()
        assert license_scan.scan(text)[1] == n
        took[n] = time.process_time() - began
    assert took[80_000] < 8 * max(0.5, took[20_000])


def test_license_errors():
    assert license_scan.scan("under the GNU Generel Public Licence, v3")[5] == "gpl"
    assert license_scan.scan("Redistribution and use in sorce and binary form, with")[5] == "bsd"
    assert license_scan.scan("we submit licensed goods to the public in general")[5] == ""
    assert 0 < license_scan.scan("permision is hereby granted free of charge to any person obtaining a copy")[6] < 1


def brute_segments(s):
    """Maximal segments by their definition: the best segment, of equal ones the shortest, then left and right of it."""
    best, at = 0.0, None
    for a in range(len(s)):
        total = 0.0
        for b in range(a, len(s)):
            total += s[b]
            if total > best + 1e-12 or at and abs(total - best) < 1e-12 and b + 1 - a < at[1] - at[0]:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return [*brute_segments(s[:a]), (a, b, best), *((x + b, y + b, v) for x, y, v in brute_segments(s[b:]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.75, 1.0, 2.0]), max_size=25))
def test_segments(score):
    got = toxicity.segments(np.array(score))
    assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in brute_segments(score)))
    for a, b, v in got:
        assert v == pytest.approx(sum(score[a:b])) and v > 0
        assert all(sum(score[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(score[k:b]) > 0 for k in range(a, b))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.9
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.96
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.9 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.02
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), other)
    assert out.drop("passages").exceptAll(again.drop("passages")).count() == 0


texts = st.text(alphabet=st.sampled_from(list("<>|/s[]INSTSY\n␛nx")), max_size=40)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=5))
def test_chat_round_trip(turns):
    formatted, _ = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    for _, text in turns:
        assert not any(c in chat_format.escape(text) for c in (*chat_format.CONTROLS, "<|"))


def test_chat_layouts(spark):
    layouts = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 3},
        {"instruction": "a", "input": "", "output": "b"},
        {"prompt": "a", "response": "b", "meta": {"n": [1, 2]}},
        {"completion": "b", "prompt": "a"},
        {"question": "a", "answer": "b"},
        {"dialog": [{"speaker": "human", "text": "a"}, {"speaker": "bot", "text": "b"}]},
    ]
    rows = [(k, json.dumps(x)) for k, x in enumerate(layouts)] + [(98, "{broken"), (99, None), (100, '{"other": 1}')]
    got = {r.key: r for r in chat_format.format_records(spark.createDataFrame(rows, "key long, record string")).collect()}
    for k in range(len(layouts)):
        assert chat_format.parse(got[k].formatted) == [("user", "a"), ("assistant", "b")], layouts[k]
        assert [got[k].formatted[s.start : s.end] for s in got[k].loss] == ["b"]
    assert got[98].formatted is got[99].formatted is got[100].formatted is None


def test_chat_digest_of_awkward_rows(spark):
    turns = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 1, "assistant", "tie"), (None, 0, "user", "x"), (2, None, "user", "<|im_end|>␛"), (2, 5, "assistant", "é\n"), (2, 5, "assistant", "é\n")]
    df = spark.createDataFrame([(*t, "k") for t in turns], "conv_id long, turn long, role string, text string, key string")
    got = {r.conv_id: r for r in chat_format.format_digest(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("\nhi\nassistant\n\nassistant\ntie\n") and got[1].loss_sha256 == sha("tie")
    assert got[2].n_turns == 3 and got[2].loss_chars == 4
    assert got[-7].turns_sha256 == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n")
    assert [r.conv_id for r in chat_format.format_digest(df.limit(0)).collect()] == [-7]


said = st.text(alphabet=st.sampled_from(list("ab\n<|[]/é␛🎮 \"\\")), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "human", ""]), said), min_size=1, max_size=5), st.sampled_from(["messages", "typed", "share", "dialog"]))
def test_random_layouts(turns, layout):
    """Turns come back from every list layout, through the mapping that its fingerprint selects."""
    names = {"messages": ("messages", "role", "content"), "typed": ("messages", "role", "content"), "share": ("conversations", "from", "value"), "dialog": ("dialog", "speaker", "text")}
    where, role, text = names[layout]
    record = {"id": 7, where: [{role: r, text: [{"type": "text", "text": t}] if layout == "typed" else t, "weight": 1.5} for r, t in turns]}
    batch = pa.RecordBatch.from_pydict({"key": [1], "record": [json.dumps(record)]})
    got = next(iter(chat_format._format(iter([batch])))).to_pylist()[0]
    roles = chat_format.ROLES if layout in ("share", "dialog") else {}
    assert chat_format.parse(got["formatted"]) == [(roles.get(r, r), t) for r, t in turns]


def test_conversations_take_the_layout_they_fit(spark):
    talks = {
        1: [("user", "q"), ("assistant", "a")],
        2: [("user", "do\n\nthis\n\nand that"), ("assistant", "")],
        3: [("system", "s"), ("user", ""), ("assistant", "a")],
        4: [("system", ""), ("user", "q"), ("assistant", "a")],
        5: [("user", "1"), ("assistant", "2"), ("user", "3"), ("assistant", "4")],
        6: [("human", "q"), ("gpt", "a")],
        7: [("user", "\n\n"), ("assistant", "a")],
        8: [("assistant", "alone")],
        9: [("user", "x" * 300_000), ("assistant", "y\n\n" * 50_000)],
        10: [("user", "nobody answers")],
    }
    rows = [(k, n, r, t) for k, v in talks.items() for n, (r, t) in enumerate(v)]
    records = chat_format.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.key: r for r in chat_format.format_records(records).collect()}
    assert {k: got[k].mapping for k in talks} == {1: "prompt-response", 2: "instruction", 3: "prompt-response", 4: "messages", 5: "share", 6: "messages", 7: "prompt-response", 8: "share", 9: "prompt-response", 10: "share"}
    assert len({got[k].layout for k in talks}) == 5
    assert all(chat_format.parse(got[k].formatted) == v for k, v in talks.items())


def test_deep_and_odd_json(spark):
    deep = '{"messages": ' + "[" * 100_000 + "]" * 100_000 + "}"
    odd = '{"prompt": "\\ud800x", "response": "ok"}'
    got = {r.key: r for r in chat_format.format_records(spark.createDataFrame([(1, deep), (2, odd)], "key long, record string")).collect()}
    assert got[1].formatted is None and chat_format.parse(got[2].formatted) == [("user", "\ufffdx"), ("assistant", "ok")]


def test_languages_held_out(spark):
    """Documents that the fit has not seen."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    pages = spark.read.parquet(f"{MID}/pages.parquet")
    hidden = docs.withColumn("lang", F.when(~held, F.col("lang")))
    out = language_id.language_id(pages, hidden)
    right = out.join(docs.where(held).select("doc_id", "lang"), "doc_id").where("length(lang) = 2").select(F.avg((F.col("lang") == F.col("lang_found")).cast("double")), F.count("*")).first()
    assert right[0] > 0.98 and right[1] > 100


def test_pages_with_wrong_markup(spark):
    """Pages made of documents, whose language is known, and which declare another one in a third of all cases."""
    docs = spark.read.parquet(f"{MID}/documents.parquet").where("length(lang) = 2 and length(text) > 200")
    wrong = F.col("doc_id") % 3 == 0
    declared = F.when(wrong, F.when(F.col("lang") == "de", "fr").otherwise("de")).otherwise(F.col("lang"))
    made = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://h"), F.col("doc_id") % 7, F.lit(".example.com/")).alias("url"), F.concat(F.lit("<html lang="), declared, F.lit("><nav>menu</nav><p>"), "text").alias("html"), F.col("lang").alias("truth"))
    out = language_id.language_id(made, docs.where("doc_id % 2 = 0")).where("kind = 'page'")
    right = out.join(made.select("page_id", "truth"), "page_id").where("page_id % 2 = 1").agg(F.avg((F.col("truth") == F.col("lang_found")).cast("double"))).first()[0]
    assert right > 0.95


def test_fusion_by_brute_force(spark):
    model = language_id.Model(["de", "en", "fr"], np.zeros((1, 3), np.float32), np.array([0.2, 0.5, 0.3]))
    rng = np.random.default_rng(4)
    rows = []
    for k in range(50):
        soft = rng.dirichlet([1, 1, 1])
        host = rng.choice(["a.x.com", "b.x.com", "c.org", None])
        rows.append((str(k), host, None, None, [float(v) for v in np.log(rng.dirichlet([1, 1, 1]))], [float(v) for v in soft], "page", host and ".".join(host.split(".")[-2:])))
    df = spark.createDataFrame(rows, "key string, host string, declared string, suffix string, log array<double>, soft array<double>, kind string, domain string")
    got = {r.key: r for r in language_id.identify(df, model).collect()}
    total = sum(np.array(r[5]) for r in rows) + model.share
    for key, host, _, _, log, soft, _, domain in rows:
        prior = overall = total / total.sum()
        if host:
            others = lambda at, name: np.maximum(sum((np.array(r[5]) for r in rows if r[at] == name), np.zeros(3)) - np.array(soft), 0)  # noqa: B023, E731
            d, h = others(7, domain), others(1, host)
            by_domain = (d + language_id.DOMAIN_PULL * overall) / (d.sum() + language_id.DOMAIN_PULL)
            prior = (h + language_id.HOST_PULL * by_domain) / (h.sum() + language_id.HOST_PULL)
        fused = np.exp(np.array(log)) * prior
        assert got[key].lang_found == model.languages[int(fused.argmax())] and got[key].probability == pytest.approx(fused.max() / fused.sum())


def test_many_languages(spark):
    rows = [(k, f"word{k % 40} " * 30, f"l{k % 40:02d}", "s") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    out = language_id.language_id(pages, docs).collect()
    assert len({r.lang_found for r in out}) == 40


def test_hostile_pages():
    for part in ("<nav ", "<!--", "<script>", "<article>", "<html ", "<", "<html lang", "<main", "</nav"):
        began = time.process_time()
        page = part * (1_000_000 // len(part))
        language_id.page_text(page)
        language_id.page_evidence("http://x", page)
        assert time.process_time() - began < 3, part


def test_page_evidence():
    assert language_id.page_evidence("https://user@www.Ex.de:80/a", '<html class="x" lang="fr-CA">') == ("www.ex.de", "fr", "de")
    assert language_id.page_evidence("http://h.example.com/es/8", None) == ("h.example.com", None, "es")
    assert language_id.page_text("<p>a<script>b</p></script><article>c &amp; d</article>e").split() == ["c", "&", "d"]
    assert language_id.page_text("a<nav>b<!-- </nav> --></NAV >c<style>d").split() == ["a", "-->", "c", "d"]
    assert language_id.page_text("<main>a<article>b</article>c</main>d").split() == ["a", "b", "c"]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_media_round_trip(data):
    media = media_columns.encode_media(data)
    payload, n = media_columns.decode_media(media)
    assert n == len(data) and payload == data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def test_media_rows(spark):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_columns.media_columns(documents(spark)).collect()))
    want = []
    for r in documents(spark).collect():
        b = (r.text or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((r.doc_id is None, r.doc_id or 0, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)


def test_media_keys_of_any_kind(spark):
    keys = ["a-n", "n", "k", "nul\0in", "a/b\\c", "", "é🎮", "x" * 60_000, None]
    rows = [(k, f"text {n}") for n, k in enumerate(keys)]
    got = media_columns.media_columns(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.payload_sha256) for r in got} == {(k, hashlib.sha256(t.encode().ljust(64, b"\0")).hexdigest()) for k, t in rows}


def archives(folder, members=40):
    data = {f"{k:08d}.png": (f"k{k}", media_columns.encode_media(b"x" * k * 50)) for k in range(members)}
    for part in range(2):
        with zipfile.ZipFile(folder / f"part-{part}.zip", "w") as z:
            for name, (key, media) in data.items():
                info = zipfile.ZipInfo(name)
                info.extra = media_columns.key_field(key)
                z.writestr(info, media)
    return {(n, k, m) for n, (k, m) in data.items()}


def read_all(reader):
    return pa.Table.from_batches([b for p in reader.partitions() for b in reader.read(p)])


def test_media_ranges_and_retries(tmp_path):
    data = archives(tmp_path)
    for options in ({"rangeBytes": "700", "batchBytes": "300"}, {"rangeBytes": "100000"}, {"rangeBytes": "2000", "batchBytes": "1"}):
        reader = media_columns.ArchiveReader({"path": f"file://{tmp_path}", **options})
        rows = read_all(reader)
        assert rows.num_rows == 80
        assert set(zip(*(rows[c].to_pylist() for c in ("name", "key", "media")), strict=True)) == data
    assert len(media_columns.ArchiveReader({"path": str(tmp_path), "rangeBytes": "700"}).partitions()) > 10
    assert len(media_columns.ArchiveReader({"path": str(tmp_path), "rangeBytes": "100000"}).partitions()) == 1

    class Flaky:
        def __init__(self, fails):
            self.fails = fails

        def open_input_file(self, path):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return pa.BufferReader((tmp_path / "part-0.zip").read_bytes())

    first = next(m for n, _, m in data if n == "00000000.png")
    assert reader.member(Flaky(2), "a", 0) == first
    with pytest.raises(OSError, match="lost"):
        reader.member(Flaky(3), "a", 0)
    # a run of members that can't be read, or comes back cut short, is read member by member
    own = [(0, "00000000.png", "k0")]
    for data_ in (b"", b"PK"):
        broken = type("Broken", (), {"read_at": lambda self, n, at: data_})()  # noqa: B023
        assert [m for *_, m in reader.members(Flaky(0), broken, "a", own, {0: 500})] == [first]


def test_media_manifest(tmp_path, spark):
    archives(tmp_path)
    listed = [("part-0.zip", (tmp_path / "part-0.zip").stat().st_size, 40)]
    spark.createDataFrame(listed, "archive string, bytes long, members long").coalesce(1).write.parquet(str(tmp_path / "m"))
    reader = media_columns.ArchiveReader({"path": str(tmp_path), "manifest": str(tmp_path / "m")})
    assert read_all(reader).num_rows == 40  # the other archive was never committed
    spark.createDataFrame([(*listed[0][:2], 41)], "archive string, bytes long, members long").coalesce(1).write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(OSError, match="members"):
        read_all(media_columns.ArchiveReader({"path": str(tmp_path), "manifest": str(tmp_path / "wrong")}))
