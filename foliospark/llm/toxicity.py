"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features are hashed to so many bins, which bounds every table the driver holds.
BINS = 1 << 18
#: A word's features: the word, and its beginnings of these lengths, as stems show through endings.
STEMS = (7, 6, 5, 4, 3)
#: Labelled rows of which the model is fitted, in the order of a hash of doc_id: a bound on the broadcast.
MAX_LABELLED = 20_000
#: Weight of the corpus prior in words; z from which a word's log-odds count; drift of every other word.
PRIOR_WORDS, Z_LEAST, DRIFT = 500.0, 5.0, 0.1
#: Folds of the labelled rows; how far the logistic step makes up for toxic rows being fewer (0 not, 1 wholly).
FOLDS, BALANCE = 5, 0.5
#: Expected chance segments a text, below which a segment is significant.
E_VALUE = 0.05
EULER = 0.5772156649
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_~`«»„“”"


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of every word, bounds of each text's words, features of every code).

    Words stand between white space; their features are taken in lower case without edge marks and
    hashed to bins. Bin 0 means none, for words without letters and stems that are whole words.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    for mark in "\n\t\r":
        texts = pc.replace_substring(texts, mark, " ")
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words = [w.lower().strip(_EDGES) for w in coded.dictionary.to_pylist()]
    table = np.zeros((len(words), 1 + len(STEMS)), dtype=np.int64)
    bin_of = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % (BINS - 1) + 1
    table[:, 0] = [bin_of(w) if w else 0 for w in words]
    for k, n in enumerate(STEMS, 1):
        table[:, k] = [bin_of(f"{w[:n]}+") if len(w) > n else 0 for w in words]
    return coded.indices.to_numpy().astype(np.int64), bounds, table


def _count(kinds: int):
    """(kind, text) -> (kind, bin, n): documents of each kind that hold a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kinds, BINS), dtype=np.int64)
        for b in batches:
            code, bounds, table = encode(b.column("text"))
            kind = b.column("kind").to_numpy()
            # a word counts once a document, or a text that repeats one word would outweigh the rest
            once = np.unique(np.repeat(np.arange(len(kind)), np.diff(bounds)) * max(1, len(table)) + code) if len(code) else code
            held, code = np.divmod(once, max(1, len(table)))
            for column in table.T:
                total += np.bincount(kind[held] * BINS + column[code], minlength=kinds * BINS).reshape(kinds, BINS)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(total[kind, at])], ["kind", "bin", "n"])

    return run


def _totals(docs: DataFrame, kinds: int) -> np.ndarray:
    """Counts by kind and bin of (kind, text); at most kinds * BINS numbers reach the driver."""
    counted = docs.select("kind", "text").mapInArrow(_count(kinds), "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    total = np.zeros((kinds, BINS))
    if found.num_rows:
        total[found["kind"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
    total[:, 0] = 0
    return total


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Each bin's log-odds with an informative Dirichlet prior, the corpus's shares; 0 where it is not significant.

    The significance is the signed root of the likelihood ratio against one rate for both classes, in the
    units of a normal z; unlike the ratio of log-odds to their deviation it holds where a count is 0.
    """
    prior = PRIOR_WORDS * (corpus + 0.01) / (corpus + 0.01).sum()

    def logit(y):
        y, rest = y + prior, y.sum() + prior.sum() - y - prior
        return np.log(y / rest)

    delta = logit(toxic) - logit(clean)
    share = toxic.sum() / max(1.0, toxic.sum() + clean.sum())
    both = toxic + clean
    gain = lambda y, e: y * np.log(np.maximum(y, 1e-12) / np.maximum(e, 1e-12))
    z = np.sqrt(np.maximum(0.0, 2 * (gain(toxic, both * share) + gain(clean, both * (1 - share)))))
    z[0] = 0.0
    return np.where(z >= Z_LEAST, delta, 0.0).astype(np.float32) if toxic.any() and clean.any() else np.zeros(BINS, np.float32)


def word_scores(table: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Each code's score: the log-odds of its most special significant feature, if any, less the drift."""
    found = odds[table]
    best = (found != 0).argmax(axis=1)
    return found[np.arange(len(table)), best].astype(np.float64) - DRIFT


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of one text's word scores, in linear time.

    Words of one sign are merged first; then the stack of candidate segments is kept so that
    each new one either stands or absorbs those it reaches back to.
    """
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    total = np.r_[0.0, np.cumsum(score)]
    breaks = np.flatnonzero(np.diff(up) > 1)
    starts, ends = up[np.r_[0, breaks + 1]], up[np.r_[breaks, len(up) - 1]] + 1
    kept: list[list[float]] = []  # start, end, sum before, sum after, place of the last one with a smaller sum before
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        low, high = total[a], total[b]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append([a, b, low, high, j])
                break
            a, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(int(a), int(b), float(high - low)) for a, b, low, high, _ in kept]


@dataclass
class Model:
    odds: np.ndarray
    rate: float  # lambda of the extreme-value law
    log_k: float
    slope: float
    offset: float

    def evidence(self, found: list[tuple[int, int, float]], words: int) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of ln(1 + 1/E) over all segments, and the significant ones with their E-values."""
        space = np.log(max(words, 1)) + self.log_k
        rated = [(a, b, self.rate * s - space) for a, b, s in found]
        return float(sum(np.logaddexp(0.0, x) for _, _, x in rated)), [(a, b, float(np.exp(-x))) for a, b, x in rated if x >= -np.log(E_VALUE)]

    def probability(self, x):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(x) + self.offset, -50, 50)))


def _rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1; 1 if no score is positive."""
    if not (share[score > 0].sum() > 0):
        return 1.0
    low, high = 0.0, 1.0
    f = lambda r: float((share * np.exp(np.minimum(r * score, 700))).sum()) - 1
    while f(high) < 0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


#: Word scores are counted on a grid for the rate.
GRID = 20


def _tops(odds: list[np.ndarray]):
    """(toxic, fold, text) -> (toxic, words, sums of the maximal segments, counts of the scores on the grid), by the odds of each row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, bounds, table = encode(b.column("text"))
            values = [word_scores(table, x) for x in odds]
            sums, grid = [], []
            for x, y, fold in zip(bounds[:-1], bounds[1:], b.column("fold").to_pylist(), strict=True):
                value = values[fold][code[x:y]]
                sums.append([s for _, _, s in segments(value)])
                at, n = np.unique(np.rint(value * GRID).astype(np.int64), return_counts=True)
                grid.append(dict(zip(at.tolist(), n.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(np.diff(bounds)), pa.array(sums, pa.list_(pa.float64())), pa.array([list(g.items()) for g in grid], pa.map_(pa.int64(), pa.int64()))], ["toxic", "words", "sums", "grid"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from all documents' word counts and at most ``max_labelled`` labelled training rows.

    Labels of rows whose crc32(doc_id) is divisible by 5 are never read. The labelled rows are few by
    their bound, so they are broadcast and the texts stay where they are. The extreme-value law and the
    logistic step are fitted to scores that each row gets from the log-odds of the other FOLDS - 1 folds:
    by log-odds that have seen the row itself, toxic rows would look easier than unseen ones are.
    """
    train = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").alias("id"), F.col("toxic").cast("long").alias("toxic")).where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    train = train.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_labelled)
    texts = docs.select("doc_id", F.col("text").cast("string"))
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS))
    labelled = texts.join(F.broadcast(train), F.col("doc_id") == F.col("id")).select("toxic", fold.alias("fold"), "text")
    corpus = _totals(texts.select(F.lit(0).cast("long").alias("kind"), "text"), 1)[0]
    counts = _totals(labelled.select((F.col("toxic") * FOLDS + F.col("fold")).alias("kind"), "text"), 2 * FOLDS).reshape(2, FOLDS, BINS)
    every = counts.sum(axis=1)
    odds = log_odds(every[1], every[0], corpus)
    apart = [log_odds(every[1] - counts[1, k], every[0] - counts[0, k], corpus) for k in range(FOLDS)]
    tops = labelled.mapInArrow(_tops(apart), "toxic long, words long, sums array<double>, grid map<bigint,bigint>").toArrow()
    toxic, words = tops["toxic"].to_numpy(), np.maximum(1, tops["words"].to_numpy())
    sums = tops["sums"].to_pylist()
    seen: dict[int, int] = {}
    for is_toxic, row in zip(toxic, tops["grid"].to_pylist(), strict=True):
        for at, n in row if not is_toxic else ():
            seen[at] = seen.get(at, 0) + n
    share = np.array(list(seen.values()), dtype=float)
    model = Model(odds, _rate(np.array(list(seen)) / GRID, share / max(1.0, share.sum())) if seen else 1.0, 0.0, 1.0, -4.0)
    clean = [i for i in range(len(sums)) if toxic[i] == 0 and sums[i]]
    # the mean of rate * maximum - ln(words) is ln K plus Euler's constant under the law
    if clean:
        model.log_k = float(np.mean([model.rate * max(sums[i]) - np.log(words[i]) for i in clean])) - EULER
    x = np.array([model.evidence([(0, 0, s) for s in row], n)[0] for row, n in zip(sums, words, strict=True)])
    model.slope, model.offset = _logistic(np.log1p(x), toxic.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps, lightly regularised towards slope 1, offset -4.

    A toxic row weighs more, by BALANCE of the ratio of clean to toxic ones in powers: a missed one costs more.
    """
    weight = np.where(y > 0, max(1.0, (len(y) - y.sum()) / max(1.0, y.sum())) ** BALANCE, 1.0)
    w = np.array([1.0, -4.0])
    pull = np.array([0.05, 0.05])
    a = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (weight * (y - p)) - pull * (w - [1.0, -4.0]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, bounds, table = encode(b.column("text"))
            value = word_scores(table, model.odds)[code]
            x, spans = [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                got, hits = model.evidence(segments(value[a:z]), z - a)
                x.append(got)
                spans.append([{"first_word": s, "words": e - s, "e_value": v} for s, e, v in hits])
            p = model.probability(np.array(x))
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("e_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "passages"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, passages (every significant toxic segment).

    Passages are counted in pieces between white space. Empty and null texts have no evidence and the
    score of a clean text; a null doc_id counts as an empty one for held_out and is never labelled.
    Labels that are null or repeated: nulls are skipped, each repeat counts as a row of the fit. Without
    labels of both classes nothing is toxic. Extra columns are ignored; an empty table gives none.
    """
    model = fit(docs, labels, max_labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_judge(model), f"doc_id {kind}, score double, predicted int, passages array<struct<first_word:long,words:long,e_value:double>>")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "passages")
