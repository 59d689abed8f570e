"""License scans: short notices found with bounded errors, from exact seeds to verified spans."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices, as words, with the label each stands for.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("released into the public domain", "public-domain"),
    ("spdx license identifier", "spdx"),
    ("all rights reserved", "all-rights-reserved"),
)
#: One error is allowed for so many characters of a notice, and none in words of so few letters.
CHARS_PER_ERROR, EXACT_WORD = 10, 4

#: Bytes of words in lower case, everything else a space: 0-9, a-z and all of 0x80 and above.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str | None) -> tuple[str, int]:
    """The words with one space around each, one character a byte, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else " ", len(words)


def split_seeds(phrase: str, errors: int) -> list[tuple[int, str]]:
    """(offset, seed): errors + 1 pieces of a phrase, of which one is untouched by that many errors."""
    n = errors + 1
    cuts = [len(phrase) * k // n for k in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=4)
def _machine(phrases: tuple, notices: tuple, chars_per_error: int):
    """An automaton over all seeds, and the phrases with patterns that allow their errors."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for k, (phrase, label) in enumerate([*phrases, *notices]):
        raw = phrase.encode().decode("latin-1")
        errors = 0 if k < len(phrases) else len(raw) // chars_per_error
        pattern = regex.compile(f"(?b)(?:{regex.escape(raw, literal_spaces=True)}){{e<={errors}}}")
        patterns.append((raw, label, errors, pattern, [x for x in raw.split(" ") if len(x) <= EXACT_WORD]))
        # the spaces around a phrase are part of an exact seed, so that short phrases start no search inside words
        for at, seed in split_seeds(f" {raw} ", errors):
            seeds.setdefault(seed, []).append((k, at))
    machine = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        machine.add_word(seed, (len(seed), uses))
    machine.make_automaton()
    return machine, patterns


def _matches(folded: str, starts: list[int], raw: str, errors: int, pattern, exact: list[str]) -> list[tuple[int, int, int]]:
    """(errors, start, end) of runs of whole words that begin at one of the places and are within the errors of a phrase.

    A run's length and letters rule most out: each letter of the phrase that it lacks is an error. The rest
    is matched from end to end by the pattern, whose best match has the fewest errors.
    """
    near = []
    letters = frozenset(raw)
    for start in starts:
        least = max(1, len(raw) - errors)
        reach = folded[start : start + len(raw) + errors + 1]
        if exact and not _holds(exact, reach):
            continue
        end = reach.find(" ", least)
        while end >= 0:
            if len(letters.difference(reach[:end])) <= errors and (m := pattern.fullmatch(reach, 0, end)):
                wrong = sum(m.fuzzy_counts)
                if wrong == 0 or _holds(exact, reach[:end]):
                    near.append((wrong, start, start + end))
            end = reach.find(" ", end + 1)
    return near


def _best(near: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of matches (errors, start, end) that overlap the one with the fewest errors, then the first."""
    best: list[tuple[int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    for x in sorted(near):
        at = bisect(starts, x[1])
        if (at == 0 or ends[at - 1] <= x[1]) and (at == len(starts) or x[2] <= starts[at]):
            best.append(x)
            starts.insert(at, x[1])
            ends.insert(at, x[2])
    return best


def _holds(words: list[str], text: str) -> bool:
    """Whether the words stand in the text, in this order."""
    rest = iter(text.split(" "))
    return all(w in rest for w in words)


def find_notices(folded: str, phrases=PHRASES, notices=NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, int, float]]]:
    """Base places (character, label), and verified notices (start, end, label, errors, likeness), sorted.

    A seed's place fixes where its phrase may begin, give or take the errors; from the words that begin there,
    every run of whole words is compared that could be the phrase with its errors. Of those that overlap the
    best stays. Words of EXACT_WORD letters or fewer must stand as they are: one edit makes another word of them.
    """
    machine, patterns = _machine(tuple(phrases), tuple(notices), chars_per_error)
    begins: dict[int, set[int]] = {}
    base = []
    found = []
    for end, (n, uses) in machine.iter(folded):
        for k, at in uses:
            raw, label, errors, *_ = patterns[k]
            start = end + 2 - n - at
            if errors == 0:
                if k < len(phrases):
                    base.append((start, label))
                else:
                    found.append((start, start + len(raw), label, 0, 1.0))
                continue
            space = folded.find(" ", max(0, start - errors - 1), start + errors)
            while space >= 0:
                begins.setdefault(k, set()).add(space + 1)
                space = folded.find(" ", space + 1, start + errors)
    for k, starts in begins.items():
        raw, label, errors, pattern, exact = patterns[k]
        near = _matches(folded, sorted(starts), raw, errors, pattern, exact)
        found += [(x, y, label, wrong, 1 - wrong / len(raw)) for wrong, x, y in _best(near)]
    return sorted(set(base)), sorted(set(found))


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
    folded, n = fold(text)
    base, found = find_notices(folded)
    # spaces before a character, less the one at the beginning, are the words before it
    gaps = np.flatnonzero(np.frombuffer(folded.encode("latin-1"), dtype=np.uint8) == 32) if base or found else np.zeros(0)
    word = lambda at: int(np.searchsorted(gaps, at)) - 1
    first, last = (word(base[0][0]), word(base[-1][0])) if base else (None, None)
    labels = {x[1] for x in base}
    every = labels | {x[2] for x in found}
    score = max([1.0] * bool(base) + [x[4] for x in found], default=0.0)
    spans = [{"first_word": word(a), "words": word(b) - word(a) + 1, "label": label, "errors": wrong} for a, b, label, wrong, _ in found]
    return n, len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(every)), score, spans


_OUT = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("errors", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_OUT)]
    for b in batches:
        rows = [scan(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True))], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    One map over whole texts, no shuffle. spans lists every verified notice with its place in words
    and its errors; score is the likeness of the best one, 1 for an exact phrase and 0 without any.
    Null and empty texts have no words, empty label strings and score 0. Null doc_ids and repeated
    rows stay as they are; extra columns are ignored; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,words:long,label:string,errors:long>>")
