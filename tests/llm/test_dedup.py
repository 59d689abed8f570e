"""Line dedup, fingerprints and near-copies against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import line_dedup, simhash_dedup
from foliospark.llm.support import components

from ..conftest import DATA
from .common import documents

WS = " \t\n\x0b\f\r"


def union(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def lower(s):
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup(spark):
    for docs in (documents(spark), spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        holders = {}
        for d, t in rows:
            for line in t.split("\n"):
                if len(k := lower(line.strip(WS))) >= 40 and d is not None:
                    holders.setdefault(k, set()).add(d)
        want = []
        for d, t in rows:
            lines = t.split("\n")
            keep = [x for x in lines if len(h := holders.get(lower(x.strip(WS)), ())) < 5 or d == max(h)]
            want.append((d is None, d or 0, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
        got = [(r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_digest(docs).collect()]
        assert sorted(got) == sorted(want)
        assert any(x[3] for x in want)


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_components_of_fingerprints(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 6000").unionByName(documents(spark).where("coalesce(length(text), 0) < 9000").select("doc_id", "text", "lang", "source", "n_chars"))
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    prints = sorted({p for _, p in rows})
    root = union([(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if bin(a ^ b).count("1") <= 3], prints)
    least = {}
    for d, p in rows:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    got = simhash_dedup.simhash_components(docs).collect()
    key = lambda d, p, c: (d is None, d or 0, p, c)
    assert sorted(key(r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(key(d, f"{p:016x}", least.get(root[p])) for d, p in rows)


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_links_of_overfull_buckets(spark):
    prints = clustered(600, 1)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long")
    want = union([(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if bin(a ^ b).count("1") <= 3], prints)
    sizes = {n: sum(1 for r in want.values() if r == n) for n in set(want.values())}
    for limit in (100_000, 3):
        tree = {r.node: r.root for r in components(simhash_dedup.fingerprint_links(df, 3, limit)).collect()}
        groups = {}
        for x in prints:
            s = int(np.uint64(x).astype(np.int64))
            groups.setdefault(tree.get(s, s), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(x for x in prints if want[x] == n) for n in sizes)


def test_walk_finds_all_pairs():
    rng = np.random.default_rng(3)
    one = np.sort(np.r_[rng.integers(0, 1 << 62, 300, dtype=np.uint64), np.repeat(np.uint64(77), 70), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))])
    two = rng.integers(0, 1 << 62, (60, 2), dtype=np.uint64)
    two = np.concatenate([two, two ^ (np.uint64(1) << rng.integers(0, 64, (60, 2), dtype=np.uint64)), two[:20]])
    two = two[np.lexsort(two.T[::-1])]
    for keys, budgets in ((one[:, None], (0, 2, 20)), (two, (0, 2, 40))):
        for budget in budgets:
            forest = simhash_dedup.Forest(len(keys))
            lo, hi = np.array([0]), np.array([len(keys)])
            simhash_dedup.walk(keys, (lo, hi, lo, hi), budget, forest)
            near = np.bitwise_count(keys[:, None] ^ keys[None, :]).sum(axis=2) <= budget
            want = union(zip(*np.nonzero(near), strict=True), range(len(keys)))
            assert forest.roots(np.arange(len(keys))).tolist() == [want[k] for k in range(len(keys))]


def test_fingerprints_of_bits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 700):
        h = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        got = simhash_dedup.fingerprint(h)
        for w in range(2):
            assert int(got[w]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[:, w]) > n)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(2000, 2050)]
    want = union(edges, {x for e in edges for x in e})
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


@pytest.mark.parametrize("limits", [{}, {"split": 3, "block": 7}])
def test_near_copies(spark, limits):
    """Against brute force: components of all pairs at 0.8, with routes whole and cut again and again."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(30):
        text = [rng.choice(words) for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.randrange(1, 25)):
            copy = list(text)
            for at in rng.sample(range(len(text)), rng.randrange(0, 1 + len(text) // 40)):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group for r in simhash_dedup.near_groups(docs, **limits).collect()}
    sets = {d: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 500 and found >= (0.98 if limits else 0.999) * len(pairs)
    want = union(pairs, sets)
    assert all(want[a] == want[b] for a in sets for b in sets if got[a] == got[b])
    if not limits:
        kept = [r.doc_id for r in simhash_dedup.keep_one(docs).collect()]
        assert len(kept) == len(set(got.values())) and {got[d] for d in kept} == set(got.values())
        assert all(d == min(x for x in got if got[x] == got[d]) for d in kept)


def test_recall_at_the_similarity(spark):
    """Pairs between 0.8 and 0.9, of short and of long texts, are found by the walk and accepted."""
    rng = random.Random(2)
    rows = []
    for pair in range(400):
        n = rng.choice([12, 30, 100, 500])
        common = [f"c{pair}x{k}" for k in range(n + 4)]
        own = rng.randrange(0, max(1, n // 8) + 1)
        rows += [(2 * pair, " ".join(common + [f"a{pair}x{k}" for k in range(own)])), (2 * pair + 1, " ".join([f"b{pair}x{k}" for k in range(own)] + common))]
    got = {r.doc_id: r.group for r in simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in rows}
    like = {d: len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in range(0, 800, 2)}
    near = [d for d in like if like[d] >= 0.8]
    assert sum(got[d] == got[d + 1] for d in near) >= 0.99 * len(near) > 100
    assert all(got[d] != got[d + 1] for d in like if like[d] < 0.8)


def test_common_passage(spark):
    """A passage in every text makes one route of all; it is cut, and only the planted pairs are linked."""
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(120))
    rows = []
    for k in range(300):
        own = [f"o{k - k % 2 if k % 10 < 2 else k}x{j}" for j in range(60)]
        rows.append((k, passage + " " + " ".join(own) + (" end" if k % 2 else "")))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group for r in simhash_dedup.near_groups(docs, split=20).collect()}
    for k in range(300):
        same = [x for x in got if got[x] == got[k]]
        assert len(same) == (2 if k % 10 < 2 else 1)


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = simhash_dedup.keep_one(docs)
    assert kept.count() < docs.count()
    assert kept.select(F.lower("text")).distinct().count() == kept.count()


def test_near_copies_by_exact_similarity(spark):
    """Pairs a step above and below 0.8 are told apart, where sketches alone take about half of those below."""
    rng = random.Random(4)
    rows = []
    for pair in range(60):
        # 900 common shingles of 1124 or 1126: 0.8007 or 0.7993
        common = [f"c{pair}x{k}" for k in range(904)]
        for side in "ab":
            own = [f"{side}{pair}x{k}" for k in range(112 + pair % 2)]
            rows.append((len(rows), " ".join(common + own)))
    rng.shuffle(rows)
    got = {r.doc_id: r.group for r in simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in rows}
    for d in range(0, 120, 2):
        assert (got[d] == got[d + 1]) == (len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) >= 0.8)
    assert len(set(got.values())) == 90


def test_near_copies_with_repeated_passages(spark):
    """Copies that differ in how often a passage recurs."""
    rows = []
    for g in range(40):
        text = [f"w{g}x{k}" for k in range(404)]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text + text[90:114] * 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group for r in simhash_dedup.near_groups(docs).collect()}
    assert all(got[d] == got[d + 1] for d in range(0, 80, 2)) and len(set(got.values())) == 40
