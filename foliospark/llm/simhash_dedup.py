"""SimHash near-dedup: fingerprints joined with themselves by a binary trie walk over node pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.support import columns, components, private, stage_table

#: Fingerprints of one bucket in one task; node pairs that the walk holds at once; shingles counted at once.
BUCKET, FRONTIER, STRIDE = 100_000, 1 << 17, 1 << 15
#: Blocks that an overfull bucket's free bits are cut into, and blocks that two near fingerprints share at least.
PARTS = 6


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of ``words`` ASCII-lower-cased words, repeats included; of fewer words the whole sequence."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), dtype="<u8", count=len(found))


#: A byte's bits, one a byte.
_SPREAD = np.array([sum((x >> b & 1) << 8 * b for b in range(8)) for x in range(256)], dtype="<u8")


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The words of a fingerprint of hashes (n, words): bit b is 1 if set in over half of them; without hashes 0."""
    bytes_ = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8 * h.shape[1])
    ones = np.zeros(bytes_.shape[1] * 8, dtype=np.int64)
    for k in range(0, len(h), STRIDE):
        lanes = _SPREAD[bytes_[k : k + STRIDE]]
        for j in range(0, len(lanes), 255):
            ones += lanes[j : j + 255].sum(axis=0).view(np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


class Forest:
    """Union-find over 0..n-1; the root is the smallest index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            z = self.up[y]
            if np.array_equal(y, z):
                return y
            self.up[x] = z

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, high, low)
            a, b = low, high


def walk(keys: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int, forest: Forest, accept=None) -> None:
    """Joins every two keys that differ in at most ``budget`` bits, into ``forest``.

    ``keys`` (n, words) are numbers of one or more 64-bit words, in order inside each range that ``pairs``
    names to start from, (lo, hi, lo, hi); so a trie node is a range [lo, hi) of them that agree on the
    leading bits. A range may be paired with itself. The walk takes a block of node pairs, goes one bit
    down on both sides, adds a bit where the branches differ, and drops pairs that spent more than the
    budget; pairs of few keys are settled by counting the bits that differ. Blocks wait on a stack, so
    memory stays bounded. ``accept(i, j)`` may turn down pairs of keys within the budget.
    """
    zero = np.zeros(len(pairs[0]), dtype=np.int64)
    end = 64 * keys.shape[1]
    stack = [(*pairs, zero, zero)]
    while stack:
        alo, ahi, blo, bhi, spent, depth = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append(tuple(x[:half] for x in (alo, ahi, blo, bhi, spent, depth)))
            alo, ahi, blo, bhi, spent, depth = (x[half:] for x in (alo, ahi, blo, bhi, spent, depth))
        small = (ahi - alo) * (bhi - blo) <= 16
        if small.any():
            _settle(keys, alo[small], ahi[small], blo[small], bhi[small], budget, forest, accept)
            alo, ahi, blo, bhi, spent, depth = (x[~small] for x in (alo, ahi, blo, bhi, spent, depth))
        if not len(alo):
            continue
        mid_a, mid_b = _middle(keys, alo, ahi, depth), _middle(keys, blo, bhi, depth)
        same = (alo == blo) & (ahi == bhi)
        more = spent + (depth < end)
        kids = [(alo, mid_a, blo, mid_b, spent), (mid_a, ahi, mid_b, bhi, spent), (alo, mid_a, mid_b, bhi, more)]
        parts = [tuple(x) + (depth + 1,) for x in kids] + [tuple(x[~same] for x in (mid_a, ahi, blo, mid_b, more, depth + 1))]
        nxt = [np.concatenate([p[k] for p in parts]) for k in range(6)]
        live = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)
        live &= ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1))
        if live.any():
            stack.append(tuple(x[live] for x in nxt))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the bit at ``depth`` turns to 1 in each range: a binary search, all ranges at once.

    Below the last bit, a range of equal keys is halved.
    """
    below = depth >= 64 * keys.shape[1]
    word = np.minimum(depth >> 6, keys.shape[1] - 1)
    bit = np.uint64(1) << (63 - (depth & 63)).astype(np.uint64)
    a, b = np.where(below, (lo + hi) >> 1, lo), np.where(below, (lo + hi) >> 1, hi)
    while (open_ := a < b).any():
        m = (a + b) >> 1
        one = (keys[np.minimum(m, len(keys) - 1), word] & bit) != 0
        b = np.where(open_ & one, m, b)
        a = np.where(open_ & ~one, m + 1, a)
    return a


def _settle(keys, alo, ahi, blo, bhi, budget, forest, accept) -> None:
    n, m = ahi - alo, bhi - blo
    for first in range(0, len(alo), FRONTIER // 8):
        s = slice(first, first + FRONTIER // 8)
        each = n[s] * m[s]
        at = np.repeat(np.arange(len(each)), each)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        i, j = alo[s][at] + inner // m[s][at], blo[s][at] + inner % m[s][at]
        near = i < j
        i, j = i[near], j[near]
        near = np.bitwise_count(keys[i] ^ keys[j]).sum(axis=1) <= budget
        i, j = i[near], j[near]
        if accept is None:
            forest.join(i, j)
            continue
        for k in range(0, len(i), STRIDE // 8):
            x, y = i[k : k + STRIDE // 8], j[k : k + STRIDE // 8]
            apart = forest.roots(x) != forest.roots(y)
            x, y = x[apart], y[apart]
            if len(x):
                ok = accept(x, y)
                forest.join(x[ok], y[ok])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(hashes(shingles(t.as_py(), words))[:, None])[0] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(found, dtype="<u8").view("<i8"))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text, as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_fingerprints(words), f"doc_id {kind}, fp long")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by two columns: at least ``rows`` rows each, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not len(b):
            continue
        if n + len(b) >= rows:
            first, second = (b.column(x).to_numpy() for x in names)
            ends = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1]))
            before = held[-1] if held else b
            fresh = held and any(before.column(x)[-1].as_py() != b.column(x)[0].as_py() for x in names)
            if len(ends) or fresh:
                cut = int(ends[-1]) + 1 if len(ends) else 0
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held, n = [b.slice(cut)], len(b) - cut
                continue
        held.append(b)
        n += len(b)
    if n:
        yield pa.Table.from_batches(held)


def _starts(*columns_: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbouring rows begin, and the end."""
    new = np.ones(len(columns_[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns_])
    return np.r_[np.flatnonzero(new), len(new)]


def _join_buckets(budget: int):
    """Rows (mask, val, fp) sorted by the first two -> edges (a, b) that span each bucket's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ("mask", "val"), BUCKET):
            mask, val, fp = (part.column(c).to_numpy() for c in ("mask", "val", "fp"))
            fp = fp.view(np.uint64)
            bounds = _starts(mask, val)
            fp = fp[np.lexsort((fp, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))]
            forest = Forest(len(fp))
            many = np.diff(bounds) > 1
            lo, hi = bounds[:-1][many], bounds[1:][many]
            walk(fp[:, None], (lo, hi, lo, hi), budget, forest)
            root = forest.roots(np.arange(len(fp)))
            linked = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["a", "b"])

    return run


def finer_masks(mask: int, budget: int) -> list[int]:
    """Masks that cut a bucket of fingerprints equal under ``mask``: its free bits are cut into PARTS blocks, of
    which two fingerprints with at most ``budget`` differing bits share PARTS - budget."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << b for b in free[len(free) * k // PARTS : len(free) * (k + 1) // PARTS]) for k in range(PARTS)]
    return sorted({mask | sum(c) for c in combinations(parts, PARTS - budget)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(distinct: DataFrame, budget: int = 3, bucket_rows: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links.

    Two fingerprints that differ in at most ``budget`` bits agree on one of budget+1 blocks, so each
    is sent to one bucket per block and every link is found in some bucket by the trie walk, exactly.
    Of a bucket only a spanning forest is returned. A bucket of more than ``bucket_rows`` fingerprints is
    cut by the same argument over its free bits: 48 of them in 6 blocks, of which 3 must agree, so each
    fingerprint goes to 20 finer buckets; and once more, after which 12 bits are free and no bucket can
    be large. Overfull buckets are found by counts and joined as a table, whatever their number.
    """
    spark = distinct.sparkSession
    blocks = [(64 * t // (budget + 1), 64 * (t + 1) // (budget + 1)) for t in range(budget + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in blocks]
    level = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    ready = None
    while True:
        level = level.withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        # a bucket with few free bits can't be large
        finer = {m: finer_masks(m, budget) for m in masks if 64 - m.bit_count() > 2 * PARTS and budget < PARTS}
        over = stage_table(level.groupBy("mask", "val").count().where(F.col("count") > bucket_rows).select("mask", "val"), "overfull") if finer else None
        full = over is None or over.isEmpty()
        whole = level if full else level.join(over, ["mask", "val"], "left_anti").select(*level.columns)
        ready = whole if ready is None else ready.unionByName(whole)
        if full:
            break
        steps = spark.createDataFrame([(_signed(m), _signed(x)) for m, f in finer.items() for x in f], "mask long, finer long")
        level = level.join(over, ["mask", "val"], "left_semi").join(steps, "mask").select("fp", F.col("finer").alias("mask"))
        masks = sorted({x for f in finer.values() for x in f})
    return ready.repartition("mask", "val").sortWithinPartitions("mask", "val").select("mask", "val", "fp").mapInArrow(_join_buckets(budget), "a long, b long")


#: For near_dedup: routing min-hashes of a text, bins of its sketch, 64-bit words of its wide fingerprint.
ROUTES, BINS, WIDE = 6, 512, 4
#: Differing bits of 64 * WIDE up to which fingerprints are candidates. Sets at similarity 0.8 differ in 15 % of
#: the bits, small sets in up to 19 %: 39 and 48 bits on average, with deviations of 6; unrelated texts differ in 128.
NEAR_BITS = 76
#: Texts of a route from which on it is cut by further min-hashes, how many are equal then at most; texts of a block.
SPLIT, DEPTH, BLOCK = 1_000, 3, 4_096
#: Rows that are walked through at once, many routes together.
ROWS_AT_ONCE = 20_000
#: Standard errors by which a sketch must clear the similarity, up or down, to settle a pair without the texts.
ERRORS = 4
_BIN_BITS = BINS.bit_length() - 1
_ODD = (np.random.default_rng(5).integers(1, 1 << 62, ROUTES + WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def sketch(h: np.ndarray) -> np.ndarray:
    """One-permutation min-hash sketch of a text's distinct shingle hashes; an empty bin is 0."""
    bins = np.zeros(BINS, dtype=np.uint8)
    if len(h):
        x = np.sort(((h & np.uint64(BINS - 1)) << np.uint64(64 - _BIN_BITS)) | (h >> np.uint64(_BIN_BITS)))
        at = (x >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bins[at[first]] = np.maximum(x[first] & np.uint64(0xFF), np.uint64(1))
    return bins


def routes(h: np.ndarray) -> np.ndarray:
    """ROUTES min-hashes of a text's shingle hashes; none without words."""
    return np.array([(h * a).min() for a in _ODD[:ROUTES]] if len(h) else [], dtype=np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The fingerprint of 64 * WIDE bits of a set of shingle hashes."""
    x = h[:, None] * _ODD[ROUTES:]
    x ^= x >> np.uint64(32)
    return fingerprint(x * _ODD[ROUTES:])


def _sketches(words: int):
    names = ["doc_id", "text_key", "n1", "n2", "fp", "keys", "sketch", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, prints, keys, sketches, size = [], [], [], [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                node.append(xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split())))
                h = np.unique(hashes(shingles(text, words)))
                prints.append(wide_fingerprint(h).tobytes())
                size.append(len(h))
                keys.append(routes(h).view(np.int64))
                sketches.append(sketch(h).tobytes())
            n = np.frombuffer(b"".join(node), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(size, pa.int32())], names)

    return run


def judge(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(alike, in doubt) of pairs of sketches: in doubt within ERRORS standard errors of the similarity."""
    filled = np.count_nonzero(a | b, axis=1)
    over = np.count_nonzero((a == b) & (a != 0), axis=1) - similarity * filled
    error = ERRORS * np.sqrt(similarity * (1 - similarity) * filled)
    return over > error, np.abs(over) <= error


def _fixed(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    """A column of equally long binaries as an array (rows, width)."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), dtype=kind).reshape(-1, width)


def _join_routes(similarity: float):
    """Rows (key, pair, block, node, fp, sketch, size) sorted by key and pair -> rows (a, b, sure).

    Sure rows are edges of a forest that spans the links the sketches are certain of. Others name a text a
    that is in doubt with texts of the same b, the least of them. Candidates are the pairs whose fingerprints
    the trie walk finds within NEAR_BITS; of two blocks, only the pairs across.
    """

    def solve(part: pa.Table) -> pa.RecordBatch:
        key, pair, block, node, size = (part.column(c).to_numpy() for c in ("key", "pair", "block", "node", "size"))
        fp, data = _fixed(part.column("fp"), "<u8", WIDE), _fixed(part.column("sketch"), np.uint8, BINS)
        bounds = _starts(key, pair)
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.lexsort((*fp.T[::-1], block, group))
        block, node, size, fp, data = (x[order] for x in (block, node, size, fp, data))
        forest, near = Forest(len(fp)), Forest(len(fp))
        inside = np.zeros(len(fp), dtype=bool)
        doubts: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            i, j = (np.concatenate([x[k] for x in doubts]) for k in range(2))
            apart = forest.roots(i) != forest.roots(j)
            i, j = i[apart], j[apart]
            near.join(i, j)
            inside[i] = inside[j] = True
            doubts.clear()

        def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            # sets whose sizes differ by more than the similarity cannot reach it
            like = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            sure, doubt = judge(data[i], data[j], similarity)
            doubt &= like
            doubts.append((i[doubt], j[doubt]))
            if sum(len(x[0]) for x in doubts) > FRONTIER:
                fold()
            return sure & like

        lo, hi = bounds[:-1], bounds[1:]
        mid = lo + np.add.reduceat((block == block[np.repeat(lo, hi - lo)]).astype(np.int64), lo)
        two = mid < hi
        walk(fp, (lo, mid, np.where(two, mid, lo), hi), NEAR_BITS, forest, accept)
        if doubts:
            fold()
        root = forest.roots(np.arange(len(fp)))
        linked, unsure = np.flatnonzero(root != np.arange(len(fp))), np.flatnonzero(inside)
        least = node.copy()
        np.minimum.at(least, near.roots(unsure), node[unsure])
        a, b = np.r_[node[linked], node[unsure]], np.r_[node[root[linked]], least[near.roots(unsure)]]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < len(linked))], ["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ("key", "pair"), ROWS_AT_ONCE):
            yield solve(part)

    return run


def sweep(n: int, forest: Forest, test) -> None:
    """Gives every pair i < j of 0..n-1 that is not linked yet to ``test(i, j)``."""
    step = max(1, STRIDE // 8 // n)
    for k in range(0, n, step):
        rows, others = np.arange(k, min(k + step, n)), np.arange(k + 1, n)
        i, j = np.repeat(rows, len(others)), np.tile(others, len(rows))
        open_ = (i < j) & (forest.roots(i) != forest.roots(j))
        if open_.any():
            test(i[open_], j[open_])


def _settle_doubts(words: int, similarity: float):
    """Rows (group, a, text) sorted by the first -> edges (a, b) by the Jaccard similarity of shingle sets."""

    def solve(node: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        data = np.array([sketch(h) for h in sets])
        forest = Forest(len(sets))

        def test(i: np.ndarray, j: np.ndarray) -> None:
            sure, doubt = judge(data[i], data[j], similarity)
            forest.join(i[sure], j[sure])
            for x, y in zip(i[doubt], j[doubt], strict=True):
                pair = np.array([x, y])
                if len(np.unique(forest.roots(pair))) == 2 and jaccard(sets[x], sets[y]) >= similarity:
                    forest.join(pair[:1], pair[1:])

        sweep(len(sets), forest, test)
        root = forest.roots(np.arange(len(sets)))
        linked = np.flatnonzero(root != np.arange(len(sets)))
        node = np.array(node, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: list[int] = []
        sets: list[np.ndarray] = []
        now = None
        for batch in batches:
            for group, a, text in zip(batch.column("group").to_pylist(), batch.column("a").to_pylist(), batch.column("text"), strict=True):
                if now != group:
                    if len(sets) > 1:
                        yield solve(node, sets)
                    node, sets, now = [], [], group
                node.append(a)
                sets.append(np.unique(hashes(shingles(text.as_py(), words))))
        if len(sets) > 1:
            yield solve(node, sets)

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets, of which one at least is not empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _members(texts: DataFrame, split: int, block: int) -> DataFrame:
    """(key, pair, block, node): the texts of each route that two texts share, cut until routes are small.

    A route of more than ``split`` texts, which a passage common to many texts makes, is cut by each of
    the other min-hashes, and again until DEPTH of them are equal: so many of six do texts at similarity
    0.8 share with a probability of 0.983. If more than ``block`` are left, which a large group of near-copies
    makes, each pair of blocks is a group of its own: exact, but its work grows with the square.
    """
    level = texts.select("node", "keys", F.posexplode("keys").alias("j", "k")).select("node", F.expr("shiftleft(1, j)").alias("mask"), F.xxhash64("j", "k").alias("key"))
    ready = None
    for depth in range(1, DEPTH + 1):
        sizes = stage_table(level.groupBy("key").count().where("count > 1").withColumnRenamed("count", "n"), "routes")
        member = level.join(sizes, "key")
        last = depth == DEPTH or sizes.where(F.col("n") > split).isEmpty()
        whole = member if last else member.where(F.col("n") <= split)
        ready = whole if ready is None else ready.unionByName(whole)
        if last:
            break
        hot = member.where(F.col("n") > split).select("node", "mask").join(texts.select("node", "keys"), "node")
        hot = hot.select("node", "keys", F.explode(F.expr(f"filter(transform(sequence(0, {ROUTES - 1}), j -> mask | shiftleft(1, j)), m -> m <> mask)")).alias("mask"))
        finer = F.xxhash64("mask", F.expr("filter(keys, (x, j) -> (mask & shiftleft(1, j)) <> 0)"))
        level = hot.select("node", "mask", finer.alias("key")).distinct()
    blocks = F.when(F.col("n") > max(split, block), F.ceil(F.col("n") / block)).otherwise(1).cast("int")
    ready = ready.select("key", "node", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = ready.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("key", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).cast("long").alias("pair"), "block", "node")


def near_tree(docs: DataFrame, words: int = 5, similarity: float = 0.8, split: int = SPLIT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, tree): each row's text (doc_id, text_key, n1, n2), the different texts (n1, n2, node), and
    (node, root) of those that are linked to others.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least ``similarity``. Equal
    word sequences, known by 128-bit hashes, are collapsed first. Texts are routed by ROUTES min-hashes of
    their shingles, of which a pair at similarity 0.8 shares one but for 0.2^ROUTES; inside a route, the
    trie self-join of SimHash fingerprints of 64 * WIDE bits finds the candidates, and what it prunes is
    unlike. Sketches of BINS bins settle the candidates that clear the similarity by ERRORS standard
    errors, up or down; the texts of the others are fetched once more and their sets compared.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    rows = stage_table(rows.mapInArrow(_sketches(words), f"doc_id {kind}, text_key long, n1 long, n2 long, fp binary, keys array<long>, sketch binary, size int"), "sketches")
    texts = rows.groupBy("n1", "n2").agg(*(F.min(c).alias(c) for c in ("fp", "keys", "sketch", "size")), F.min("text_key").alias("text_key"))
    # numbers that no two texts share; staged, so they stay
    texts = stage_table(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    member = stage_table(_members(texts, split, block), "members")
    wide = member.join(texts.select("node", "fp", "sketch", "size"), "node").select("key", "pair", "block", "node", "fp", "sketch", "size")
    found = stage_table(wide.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_join_routes(similarity), "a long, b long, sure boolean"), "links")
    doubts = found.where("not sure").select("a", F.col("b").alias("group")).distinct()
    unsure = stage_table(doubts.select("a").distinct().join(texts.select("node", "text_key"), F.col("a") == F.col("node")).select("a", "text_key"), "unsure")
    again = docs.select(F.xxhash64("text").alias("hash"), F.col("text").cast("string")).join(unsure, F.col("hash") == F.col("text_key")).groupBy("a").agg(F.min("text").alias("text"))
    again = doubts.join(again.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).select("group", "a", "text")
    settled = again.repartition("group").sortWithinPartitions("group").mapInArrow(_settle_doubts(words, similarity), "a long, b long")
    return rows, texts, components(found.where("sure").select("a", "b").union(settled))


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, node, group): near-copies of whole texts share a group, see near_tree."""
    rows, texts, tree = near_tree(docs, words, similarity, split, block)
    named = texts.select("n1", "n2", "node").join(tree.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    named = named.select("n1", "n2", "node", F.coalesce("root", "node").alias("group"))
    return rows.select("doc_id", "text_key", "n1", "n2").join(named, ["n1", "n2"]).select("doc_id", "text_key", "node", "group")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-copies, the one with the smallest doc_id; all columns stay.

    Texts without words are copies of one another. A null doc_id stays only where its group has no
    other; of repeated rows one stays. The texts are shuffled once, for the join with the rows that stay.
    """
    p = private(docs)
    rows, texts, tree = near_tree(docs, words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    least = rows.groupBy("n1", "n2").agg(F.min(order).alias("x"), F.count("*").alias("rows"))
    named = texts.select("n1", "n2", "node").join(tree.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    best = least.join(named, ["n1", "n2"]).groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(F.struct("x")).alias("x"))
    stay = stage_table(best.select(F.col("x.x.doc_id").alias(p + "id"), F.col("x.x.text_key").alias(p + "key")), "stay")
    keyed = docs.withColumn(p + "hash", F.xxhash64("text"))
    found = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay[p + "id"]) & (keyed[p + "hash"] == stay[p + "key"]), "left_semi")
    repeated = rows.groupBy("doc_id", "text_key").count().where("count > 1")
    if not repeated.join(stay, repeated["doc_id"].eqNullSafe(stay[p + "id"]) & (repeated["text_key"] == stay[p + "key"]), "left_semi").isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id", p + "hash").orderBy(F.lit(0)))
        found = found.withColumn(p + "first", first).where(F.col(p + "first") == 1)
    return found.select(*columns(found)[: len(docs.columns)])


def simhash_components(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    The component of a document holds all that is reachable over links, fingerprints at ``budget`` or
    fewer differing bits; its id is the smallest doc_id in it. Texts without words have fingerprint 0
    and are linked like any other; null text is empty. A null doc_id is never the smallest, unless its
    component has no other (then null). Repeated rows stay; extra columns are ignored. Equal
    fingerprints are collapsed, with a map-side minimum of their doc_ids, before anything is joined.
    """
    prints = stage_table(fingerprints(docs, words), "simhash")
    distinct = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    tree = components(fingerprint_links(distinct, budget))
    moved = distinct.join(tree, distinct["fp"] == tree["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lows = moved.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage_table(moved.join(lows, "root").select(F.col("fp").alias("fp_too"), "component_id"), "simhash")
    return prints.join(named, F.col("fp") == F.col("fp_too")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
