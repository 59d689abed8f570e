"""Lexical retrieval packing: BM25 neighbours of each seed document fill its window."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.support import stage_table

WINDOW, END_ID = 2048, 1
#: Tokens and documents of one shard, which a task packs at a time.
SHARD_TOKENS, SHARD_DOCS = 2_000_000, 30_000
#: BM25's constants; neighbours that are handed out before the index is asked again.
K1, B, RANKED = 1.2, 0.75, 64
#: A term that stands in more than one document of so many has a dense row in a shard's index.
DENSE = 4
#: Texts, and bytes of them, whose words are looked up at once; documents whose ids are put together at once.
TEXTS_AT_ONCE, BYTES_AT_ONCE, ROWS_AT_ONCE = 10_000, 8 << 20, 200
#: Words whose ids a Python worker remembers, the first it meets, as numbers in arrays: 17 MB at most.
WORDS_KEPT = 1 << 19
#: Texts that are read, and that are handed to a worker, at once.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000}
#: Row groups and pages of the staged ids are small, so that a task that reads or writes them holds no large arrays.
STAGED = {"parquet.block.size": str(2 << 20), "parquet.page.size": str(128 << 10), "parquet.page.size.row.check.min": "10", "parquet.enable.dictionary": "false"}
#: Shards that a task packs one after the other: each task costs its JVM a sort page of up to 64 MB, however small the task.
TASK_SHARDS = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, and which of its ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ends = np.zeros(tok.get_vocab_size(), dtype=bool)
    ends[[n for w, n in tok.get_vocab().items() if w.endswith("</w>")]] = True
    return tok, ends


#: Marks that may end a chunk of letters: alone and together they are one word to the tokenizer.
_TAIL = '.,;:!?#*$%&|()"=+/-'
#: Letters whose lower case is one letter, composed, in the tokenizer's own normal form.
_LETTERS = "".join(c for c in map(chr, range(65, 0x250)) if c.isalpha() and c not in "ªµº\u0130\u0149")
_SIMPLE = f"^[{_LETTERS}]+[{re.escape(_TAIL)}]*$"


class Pieces:
    """Ids of pieces of text, one after the other: ``flat`` with the begin and the size of each piece."""

    def __init__(self):
        self.flat: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.count = 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> int:
        """The number of the first of these pieces."""
        first, self.count = self.count, self.count + len(size)
        self.flat.append(flat)
        self.size.append(size)
        return first

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.concatenate(self.size).astype(np.int64)
        return np.concatenate(self.flat), np.cumsum(size) - size, size


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every number of the ranges [begin, begin + size), one range after the other."""
    until = np.cumsum(size)
    at = np.repeat(begin - until + size, size)
    at += np.arange(len(at))
    return at


def _encode(tok, ends: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of words that are each one word to the tokenizer: encoded in one text and cut at word ends."""
    flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), 20_000):
        block = words[k : k + 20_000]
        ids = np.array(tok.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts = np.flatnonzero(ends[ids]) + 1
        own = (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(block) else _encode_each(tok, block)
        flat.append(own[0])
        size.append(own[1])
    return np.concatenate(flat), np.concatenate(size)


def _encode_each(tok, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
    return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


class Words:
    """Ids of the words that a worker has met, found by 128-bit hashes of the words."""

    def __init__(self):
        self.key = np.zeros((0, 2), dtype=np.uint64)
        self.begin, self.size, self.flat = np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)

    def places(self, key: np.ndarray) -> np.ndarray:
        """Where each key lies, -1 for none."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key[:, 0], key[:, 0]), len(self.key) - 1)
        return np.where((self.key[at] == key).all(axis=1), at, -1)

    def learn(self, key: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Remembers words while there is room; long ones are looked up anew."""
        keep = np.flatnonzero(size < 32)[: WORDS_KEPT - len(self.key)]
        if not len(keep):
            return
        flat, key, size = flat[ranges((np.cumsum(size) - size)[keep], size[keep])], key[keep], size[keep]
        begin = np.cumsum(size) - size + len(self.flat)
        both = np.concatenate([self.key, key])
        order = np.argsort(both[:, 0], kind="stable")
        self.key = both[order]
        self.begin = np.concatenate([self.begin, begin.astype(np.uint32)])[order]
        self.size = np.concatenate([self.size, size.astype(np.uint8)])[order]
        self.flat = np.concatenate([self.flat, flat])


@lru_cache(maxsize=1)
def _known(path: str) -> Words:
    return Words()


def _chunk_ids(path: str, chunks: pa.Array, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begin, size) of chunks between white space. The tokenizer joins nothing across it, and lowers case.

    A chunk of letters and marks is two words to it: the letters are encoded once in lower case, however
    many chunks have them, and the marks once. Other chunks are encoded as they are.
    """
    tok, ends = _tokenizer(path)
    simple = pc.match_substring_regex(chunks, _SIMPLE).to_numpy(zero_copy_only=False)
    plain = chunks.filter(pa.array(simple))
    base = pc.utf8_lower(pc.utf8_rtrim(plain, characters=_TAIL)).dictionary_encode()
    tail = pc.utf8_ltrim(plain, characters=_LETTERS).dictionary_encode()
    pieces = Pieces()
    pair = np.empty((len(chunks), 2), dtype=np.int64)
    pair[:, 1] = pieces.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
    words = base.dictionary.to_pylist()
    key = known.hashes(words)
    at = known.places(key)
    own = at >= 0
    late = np.flatnonzero(~own)
    flat, size = _encode(tok, ends, [words[k] for k in late])
    place = np.empty(len(words), dtype=np.int64)
    place[late] = pieces.add(flat, size) + np.arange(len(late))
    begin, n = known.begin[at[own]].astype(np.int64), known.size[at[own]].astype(np.int64)
    place[own] = pieces.add(known.flat[ranges(begin, n)], n) + np.arange(len(n))
    known.learn(key[late], flat, size)
    pair[simple, 0] = place[base.indices.to_numpy()]
    pair[simple, 1] = pieces.add(*_encode_each(tok, tail.dictionary.to_pylist())) + tail.indices.to_numpy()
    other = chunks.filter(pa.array(~simple)).to_pylist()
    pair[~simple, 0] = pieces.add(*_encode_each(tok, other)) + np.arange(len(other))
    flat, begin, size = pieces.close()
    n = size[pair].sum(axis=1)
    return flat[ranges(begin[pair.ravel()], size[pair.ravel()])], np.cumsum(n) - n, n


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of at most TEXTS_AT_ONCE texts and, but for a single longer one, BYTES_AT_ONCE bytes."""
    texts = texts.cast(pa.large_string())
    until = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    k = 0
    while k < len(texts):
        end = int(np.searchsorted(until, (until[k - 1] if k else 0) + BYTES_AT_ONCE, side="right"))
        end = min(max(end, k + 1), k + TEXTS_AT_ONCE, len(texts))
        yield texts.slice(k, end - k)
        k = end


def token_ids(path: str, texts: pa.Array, known: Words | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (ids, bounds) for each run of ROWS_AT_ONCE texts: all their ids, each text's with END_ID at its end."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    rows = len(texts)
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    del lists, texts
    index = coded.indices.to_numpy()
    flat, begin, size = _chunk_ids(path, coded.dictionary, known or Words())
    del coded
    end, flat = len(size), np.append(flat, np.uint32(END_ID))
    begin, size = np.append(begin, len(flat) - 1), np.append(size, 1)
    for k in range(0, rows, ROWS_AT_ONCE):
        own = starts[k : k + ROWS_AT_ONCE + 1]
        own, word = own - own[0], index[own[0] : own[-1]]
        word = np.insert(word, own[1:], end)
        n = size[word]
        until = np.r_[0, np.cumsum(n)]
        yield flat[ranges(begin[word], n)], until[own + np.arange(len(own))]


def signatures(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A min-hash of each document over all runs of GRAM of its ids; the highest number where it has none."""
    x = ids.astype(np.uint64)
    h = np.full(len(ids), np.uint64(1 << 63), dtype=np.uint64)
    if len(ids) >= GRAM:
        run = np.zeros(len(ids) - GRAM + 1, dtype=np.uint64)
        for k in range(GRAM):
            run = (run + x[k : len(ids) - GRAM + 1 + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            run ^= run >> np.uint64(29)
        h[: len(run)] = run >> np.uint64(1)
    # runs that reach into the next document don't count
    for k in range(1, GRAM):
        at = bounds[1:] - k
        h[at[at >= bounds[:-1]]] = np.uint64(1 << 63)
    return np.minimum(np.minimum.reduceat(h, bounds[:-1]), np.uint64((1 << 63) - 1)).astype(np.int64)


#: Ids of a run, by whose least hash a document is placed.
GRAM = 2


def _give_back() -> None:
    """Drops the tokenizer and returns freed memory to the system: a worker lives on beside others after its task."""
    _tokenizer.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _tokenize(path: str, vocabulary: int):
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(vocabulary + 2, dtype=np.int64)
        seen = np.zeros((200, vocabulary), dtype=bool)
        id_type, known = None, _known(path)
        for b in batches:
            id_type, done = b.schema.field("doc_id").type, 0
            for ids, bounds in (x for part in blocks(b.column("text")) for x in token_ids(path, part, known)):
                n = np.diff(bounds)
                for k in range(0, len(n), 200):
                    part = bounds[k : k + 201]
                    seen[: len(part) - 1] = False
                    seen[np.repeat(np.arange(len(part) - 1), np.diff(part)), ids[part[0] : part[-1]]] = True
                    frequency[:vocabulary] += seen[: len(part) - 1].sum(axis=0)
                frequency[vocabulary:] += len(n), len(ids)
                sig = signatures(ids, bounds)
                data = ids.astype(kind)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(n)), pa.array(sig), pa.array(n), packed, pa.nulls(len(n), pa.binary())], ["doc_id", "sig", "n", "ids", "df"])
                done += len(n)
        del seen
        _give_back()
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([frequency.astype("<i8").tobytes()], pa.binary())], ["doc_id", "sig", "n", "ids", "df"])

    return run


def _sum_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("df"):
            row = np.frombuffer(x.as_py(), dtype="<i8")
            total = row.copy() if total is None else total + row
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])


class Shard:
    """A BM25 index of one shard's documents over token ids, and the packing of them."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.ids = ids
        n = np.array([len(x) for x in ids], dtype=np.int64)
        # term and document share a number, 32 bits where both fit
        kind, low = (np.uint32, 15) if ids[0].dtype.itemsize == 2 and len(ids) <= 1 << 15 else (np.uint64, 32)
        keys = np.concatenate(ids).astype(kind)
        keys <<= kind(low)
        keys |= np.repeat(np.arange(len(ids), dtype=kind), n)
        keys.sort()
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        tf = np.diff(np.r_[new, len(keys)]).astype(np.float32)
        keys = keys[new]
        term, self.doc = (keys >> kind(low)).astype(np.int64), (keys & kind((1 << low) - 1)).astype(np.int32)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.doc] / mean))).astype(np.float32)
        ends = np.flatnonzero(np.r_[term[1:] != term[:-1], True]) + 1
        starts = np.r_[0, ends[:-1]]
        run = np.repeat(np.arange(len(ends)), ends - starts)
        self.starts, self.ends = starts, ends
        by_doc = np.argsort(self.doc, kind="stable")
        self.run_of = run[by_doc]
        self.bounds = np.r_[0, np.cumsum(np.bincount(self.doc, minlength=len(ids)))]
        self.unused = np.ones(len(ids), dtype=bool)
        # frequent terms: a row of weights over all documents each, so that a query adds rows up
        often = np.flatnonzero(ends - starts > max(1, len(ids) // DENSE))
        self.row = np.full(len(ends), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(ids)), dtype=np.float32)
        at = ranges(starts[often], (ends - starts)[often])
        self.dense[self.row[run[at]], self.doc[at]] = self.weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all terms of the seed."""
        runs = self.run_of[self.bounds[seed] : self.bounds[seed + 1]]
        row = self.row[runs]
        mask = np.zeros(len(self.dense), dtype=np.float32)
        mask[row[row >= 0]] = 1
        score = mask @ self.dense
        rare = runs[row < 0]
        n = self.ends[rare] - self.starts[rare]
        rare, n = rare[n > 1], n[n > 1]
        at = ranges(self.starts[rare], n)
        score += np.bincount(self.doc[at], weights=self.weight[at], minlength=len(score)).astype(np.float32)
        return score

    def neighbours(self, seed: int) -> np.ndarray:
        """The best RANKED unused documents by falling BM25 score for the seed; fewer if fewer share a term."""
        score = self.scores(seed) * self.unused
        top = np.argpartition(-score, RANKED)[:RANKED] if len(score) > RANKED else np.arange(len(score))
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]

    def pack(self, window: int) -> list[tuple[int, int, int, int, int]]:
        """Pieces (document, start, length, sequence from 0, offset).

        The document that opens a window is its seed; its neighbours fill what is left, best first, and
        the one that does not fit is cut and opens the next window. Without neighbours the next unused
        document goes on. The last window is dealt anew to sequences of powers of two, which need no padding.
        """
        pieces: list[tuple[int, int, int, int, int]] = []
        seq, used, cursor, seed = 0, 0, 0, -1
        queue: list[int] = []
        while True:
            while queue and not self.unused[queue[-1]]:
                queue.pop()
            if queue:
                d = queue.pop()
            else:
                if seed >= 0 and (near := self.neighbours(seed)).size:
                    queue = near[::-1].tolist()
                    seed = -1 if len(near) < RANKED else seed  # those may be used up: then the index is asked again
                    continue
                while cursor < len(self.ids) and not self.unused[cursor]:
                    cursor += 1
                if cursor == len(self.ids):
                    break
                d = cursor
                seed = d
            self.unused[d] = False
            n, start = len(self.ids[d]), 0
            while start < n:
                take = min(window - used, n - start)
                pieces.append((d, start, take, seq, used))
                start, used = start + take, used + take
                if used == window:
                    seq, used = seq + 1, 0
                    queue, seed = [], d
        tail = [p for p in pieces[-window:] if p[3] == seq]
        if tail:
            del pieces[-len(tail) :]
            left = [1 << k for k in range(window.bit_length() - 1, -1, -1) if used >> k & 1]
            room, offset = left.pop(0), 0
            for d, start, n, _, _ in tail:
                while n:
                    take = min(n, room - offset)
                    pieces.append((d, start, take, seq, offset))
                    start, n, offset = start + take, n - take, offset + take
                    if offset == room:
                        seq, offset, room = seq + 1, 0, left.pop(0) if left else 0
        return pieces


def _pack(idf: np.ndarray, mean: float, window: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        tokens = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, tokens
            pieces = Shard(ids, idf, mean).pack(window)
            d, start, n, seq, offset = np.array(pieces, dtype=np.int64).T
            crc = np.fromiter((zlib.crc32(ids[a][b : b + c].astype("<u4").tobytes()) for a, b, c, _, _ in pieces), np.int64, len(pieces))
            size = np.array([len(x) for x in ids], dtype=np.int64)
            doc_id = pa.concat_arrays(keys).take(pa.array(d))
            yield pa.RecordBatch.from_arrays([doc_id, *map(pa.array, (start, n, crc, size[d], seq + sequence, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += int(seq[-1]) + 1
            keys.clear(), ids.clear()
            tokens = 0

        for b in batches:
            begun = 0
            for k, x in enumerate(b.column("ids")):
                ids.append(np.frombuffer(x.as_buffer(), dtype=kind).copy())
                tokens += len(ids[-1])
                if tokens >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                    keys.append(b.column("doc_id").slice(begun, k + 1 - begun))
                    begun = k + 1
                    yield from close()
            keys.append(b.column("doc_id").slice(begun))
        if ids:
            yield from close()
        _give_back()

    return run


@contextlib.contextmanager
def _small_batches(spark: SparkSession, **most: int) -> Iterator[None]:
    """Jobs that run meanwhile hold fewer rows at once: a setting above its bound is lowered to it, then put back."""
    before = {name: spark.conf.get(name) for name in most}
    lower = [name for name, now in before.items() if not 0 < int(now) <= most[name]]
    for name in lower:
        spark.conf.set(name, most[name])
    try:
        yield
    finally:
        for name in lower:
            spark.conf.set(name, before[name])


def pack(docs: DataFrame, tokenizer: str | None = None, vocabulary: int = 49_408, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Texts are tokenized once; ids are kept as two bytes in a staged table, from which only document
    frequencies, at most ``vocabulary`` numbers, reach the driver. Documents are dealt to shards by
    range of a hashed min-hash over all runs of GRAM of their ids, ties by doc_id, so that like texts meet and a
    group of copies of any size is spread over shards. A seed's neighbours come from its own shard. A task indexes and packs one shard at a time, bounded by
    SHARD_TOKENS and SHARD_DOCS beside its last document, and about TASK_SHARDS of them; a shard wastes nothing, as its last window
    is cut into powers of two.

    Null and empty texts are the one id END_ID. A null doc_id is packed like any other; rows that
    repeat a doc_id are packed each on their own; extra columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = tokenizer or default_tokenizer()
    coded = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_tokenize(path, vocabulary), f"doc_id {kind}, sig long, n long, ids binary, df binary")
    with _small_batches(spark, **BATCH_ROWS):
        tokens = stage_table(coded, "tokens", options=STAGED)
    frequency = np.zeros(vocabulary + 2)
    for term, n in tokens.select("df").where("df is not null").mapInArrow(_sum_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        frequency[term] = n
    count, total = frequency[vocabulary:]
    idf = np.log1p((count - frequency[:vocabulary] + 0.5) / (frequency[:vocabulary] + 0.5)).astype(np.float32)
    tasks = int(total // (TASK_SHARDS * SHARD_TOKENS)) + 1
    # low min-hashes are those of long documents: hashed again, documents of all lengths mix, and tasks get like numbers of tokens
    rows = tokens.where("df is null").select("doc_id", F.xxhash64("sig").alias("place"), "n", "ids").repartitionByRange(tasks, "place", "doc_id").sortWithinPartitions("place", "doc_id", "n")
    solve = _pack(idf, max(1.0, total / max(1.0, count)), window, vocabulary > 1 << 16)
    return rows.select("doc_id", "ids").mapInArrow(solve, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
