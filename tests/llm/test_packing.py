import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from foliospark.llm import packing
from foliospark.sources.staging import stage_table

from ..conftest import DATA
from .common import documents


def test_every_id_lies_in_one_piece(spark, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).where("doc_id > 3").selectExpr("doc_id + 100000 as doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(900001, "It's <|endoftext|> THE<|startoftext|>,, we'll go. “Ünïcode” ǅ İstanbul ﬁ á x y 12,5%"), (900002, "\x1c\x85 tail　"), (900003, "don't!!! (ok) 'tis ... a-b <b>")], "doc_id long, text string"))
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces = packing.pack(docs).collect()
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], dtype="<u4").tobytes())
        covered[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for d, own in ids.items():
        at = 0
        for start, n in sorted(covered[d]):
            assert start == at and n > 0
            at += n
        assert at == len(own)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_tasks_hold_little_at_once(spark, monkeypatch):
    """Texts are read and handed on in small batches and staged in small row groups, a task packs several shards, and settings are put back."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join(map(str, rng.integers(0, 10**6, 4_000)))) for k in range(240)], "doc_id long, text string").coalesce(1)
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before, seen, groups = [spark.conf.get(k) for k in names], [], []

    def stage(df, *args, **named):
        seen.extend(int(spark.conf.get(k)) for k in names)
        out = stage_table(df, *args, **named)
        for f in Path(out._staged_path.removeprefix("file://")).glob("*.parquet"):
            m = pq.ParquetFile(f).metadata
            groups.extend(m.row_group(k).total_byte_size for k in range(m.num_row_groups))
        return out

    monkeypatch.setattr(packing, "stage_table", stage)
    pieces = packing.pack(docs)
    assert len(seen) == 2 and max(seen) <= 2_000
    assert [spark.conf.get(k) for k in names] == before
    total = sum(r.length for r in pieces.collect())
    assert 2 * total > 4 << 20 and max(groups) < 4 << 20
    assert pieces.rdd.getNumPartitions() == 1 + total // (4 * packing.SHARD_TOKENS) < total / packing.SHARD_TOKENS


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.integers(k * 100, k * 100 + 100, 5000) for k in range(10)]
    ids = [np.r_[rng.choice(topics[k % 10], 60), rng.integers(2000, 2100, 40)].astype(np.uint16) for k in range(200)]
    df = np.zeros(3000)
    for x in ids:
        df[np.unique(x)] += 1
    shard = packing.Shard(ids, np.log1p((200 - df + 0.5) / (df + 0.5)), 100.0)
    near = shard.neighbours(3)[:10]
    assert len(near) == 10 and all(d % 10 == 3 for d in near[near != 3])
    same = []
    window = defaultdict(list)
    for d, _, _, seq, _ in shard.pack(512):
        window[seq].append(d % 10)
    for w in window.values():
        same.append(max(w.count(x) for x in w) / len(w))
    assert np.mean(same) > 0.7


def test_scores_by_brute_force(monkeypatch):
    """BM25 over all terms of the seed, with frequent terms in dense rows, in postings, or both."""
    rng = np.random.default_rng(1)
    ids = [np.minimum(rng.zipf(1.4, rng.integers(1, 60)), 400).astype(np.uint16) for _ in range(50)]
    df = np.zeros(500)
    for x in ids:
        df[np.unique(x)] += 1
    idf, mean = np.log1p((50 - df + 0.5) / (df + 0.5)), np.mean([len(x) for x in ids])

    def bm25(seed, doc):
        tf = Counter(doc.tolist())
        return sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)) for t in set(seed.tolist()) if t in tf)

    for dense in (1, 4, 1000):
        monkeypatch.setattr(packing, "DENSE", dense)
        shard = packing.Shard(ids, idf.astype(np.float32), mean)
        for seed in (0, 7, 49):
            got, want = shard.scores(seed), np.array([bm25(ids[seed], d) for d in ids])
            others = np.arange(50) != seed  # a seed's own terms that stand nowhere else are left out
            assert np.allclose(got[others], want[others], rtol=1e-4, atol=1e-4)
            assert list(shard.neighbours(seed)[:5]) == [] or got[shard.neighbours(seed)[0]] >= got[others].max() - 1e-4


def test_near_copies_meet():
    """Copies with few changes of long and short documents have the same min-hash, and so the same shard."""
    rng = np.random.default_rng(3)
    same = 0
    for _ in range(200):
        doc = rng.integers(2, 40_000, rng.choice([60, 1000, 20_000]))
        copy = doc.copy()
        copy[rng.integers(0, len(doc), max(1, len(doc) // 50))] = 5
        both = np.r_[doc, 1, copy, 1].astype(np.uint32)
        a, b = packing.signatures(both, np.array([0, len(doc) + 1, len(both)]))
        same += a == b
    assert same > 170
