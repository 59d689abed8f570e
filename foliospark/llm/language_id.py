"""Language ID: Bayesian fusion of text, declared markup language, address suffix and host priors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.support import stage_table

#: Byte trigrams are hashed to so many bins.
BINS = 1 << 16
#: Labelled rows of the fit, in the order of a hash of doc_id. Every language among them can be an answer.
MAX_LABELLED = 20_000
#: Trigrams of a text that count as independent evidence, at most.
EFFECTIVE = 40.0
#: How likely a declared language, or an address suffix, names the true one.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.90, 0.80
#: Pseudo-counts that a host borrows from its domain, and a domain from all.
HOST_PULL, DOMAIN_PULL = 5.0, 20.0
#: Probability from which an answer is kept.
SURE = 0.5
#: Top-level domains that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}

_DROPPED = ("script", "style", "nav", "footer", "header", "template")
_OPEN = re.compile(rf"(?i)<!--|<({'|'.join(_DROPPED)})\b")
_CLOSE = {x: re.compile(rf"(?i)</{x}\s*>") for x in (*_DROPPED, "article", "main")}
_MAIN = {x: re.compile(rf"(?i)<{x}\b[^<>]*>") for x in ("article", "main")}
_TAG = re.compile(r"<[^<>]*>")
_HTML = re.compile(r"(?i)<html\b([^<>]*)")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_SEGMENT = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)")


def _without_parts(s: str) -> str:
    """The page without comments, scripts and the like: one pass forward. What is never closed stays."""
    out, at, begun = [], 0, 0
    unclosed: set[str] = set()
    while m := _OPEN.search(s, at):
        name = (m[1] or "").lower()
        end = -1
        if name not in unclosed:
            if name:
                end = c.end() if (c := _CLOSE[name].search(s, m.end())) else -1
            else:
                end = k + 3 if (k := s.find("-->", m.end())) >= 0 else -1
        if end < 0:
            unclosed.add(name)
            at = m.end()
        else:
            out += s[begun : m.start()], " "
            at = begun = end
    return "".join(out) + s[begun:] if out else s


def page_text(source: str | None) -> str:
    """The readable text of a page: its article or main part if it has one, without markup. Linear in its length."""
    s = _without_parts(source or "")
    parts = []
    for name, opening in _MAIN.items():
        if m := opening.search(s):
            last = None
            for last in _CLOSE[name].finditer(s, m.end()):
                pass
            if last:
                parts.append((m.start(), m.end(), last.start()))
    if parts:
        _, a, b = min(parts)
        s = s[a:b]
    return html.unescape(_TAG.sub(" ", s))


def page_evidence(url: str | None, source: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, declared language, language of the address) of a page; null where there is none."""
    declared = next((x for m in _HTML.finditer(source or "") if (x := _LANG.search(m[1]))), None)
    host = _HOST.match(url or "")
    segment = _SEGMENT.match(url or "")
    name = host[1].lower() if host else None
    suffix = segment[1].lower() if segment else SUFFIXES.get(name.rpartition(".")[2]) if name else None
    return name, declared[1].lower() if declared else None, suffix


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of every byte trigram of the lower-cased texts, bounds of each text's)."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    x = np.frombuffer(b"".join(raw) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    code = ((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    # a trigram that reaches into the next text is left out
    bounds = np.r_[0, np.cumsum(n)]
    keep = np.ones(len(code), dtype=bool)
    keep[bounds[1:] - 1] = False
    keep[bounds[1:] - 2] = False
    return code[keep].astype(np.int64), np.r_[0, np.cumsum(n - 2)]


def _blocks(values: list, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    begin, held = 0, 0
    for k, v in enumerate(values):
        held += len(v)
        if held >= size:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(values):
        yield begin, len(values)


def _count(languages: list[str]):
    place = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column("text"), "").to_pylist()
            kinds = np.array([place[x] for x in b.column("lang").to_pylist()], dtype=np.int64)
            for i, j in _blocks(texts):
                code, bounds = trigrams(texts[i:j])
                at, n = np.unique(np.repeat(kinds[i:j], np.diff(bounds)) * BINS + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at // BINS), pa.array(at % BINS), pa.array(n)], ["kind", "bin", "n"])

    return run


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BINS, languages): log-likelihoods
    share: np.ndarray  # of the languages in the fit

    def text_evidence(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods of each text, as if it had at most EFFECTIVE independent trigrams."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, j in _blocks(texts):
            code, bounds = trigrams(texts[i:j])
            n = np.diff(bounds)
            full = n > 0
            if full.any():
                sums = np.stack([np.add.reduceat(column[code], bounds[:-1][full]) for column in self.table.T], axis=1)
                out[i:j][full] = sums / n[full, None] * np.minimum(n[full, None], EFFECTIVE)
        return out


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Trigram likelihoods by language from at most ``max_labelled`` labelled documents, 256 KB a language."""
    labelled = docs.where("doc_id is not null and lang is not null and lang <> ''")
    chosen = labelled.select(F.col("doc_id").alias("id"), F.col("lang").alias("id_lang")).orderBy(F.xxhash64("id"), "id", "id_lang").limit(max_labelled)
    shares = chosen.groupBy("id_lang").count().orderBy("id_lang").collect()
    languages = sorted(r[0] for r in shares)
    if not languages:
        return Model(["und"], np.zeros((BINS, 1), np.float32), np.ones(1))
    rows = labelled.select("doc_id", "lang", F.col("text").cast("string")).join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("id_lang")))
    found = rows.select("lang", "text").mapInArrow(_count(languages), "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages), BINS))
    if found.num_rows:
        total[found["kind"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
    mean = (total.sum(axis=0) + 0.5) / (total.sum() + 0.5 * BINS)
    # each language borrows a thousand trigrams from the mean of all
    table = np.log((total + 1000.0 * mean) / (total.sum(axis=1, keepdims=True) + 1000.0)).T
    n = {r[0]: r[1] for r in shares}
    share = np.array([n[x] for x in languages], dtype=float)
    return Model(languages, np.ascontiguousarray(table.astype(np.float32)), share / share.sum())


def _pages(model: Model):
    place = {x: k for k, x in enumerate(model.languages)}
    rest = max(1, len(model.languages) - 1)

    def told(found: list[str | None], right: float) -> np.ndarray:
        out = np.zeros((len(found), len(model.languages)))
        for row, lang in zip(out, found, strict=True):
            if lang in place:
                row[:] = np.log((1 - right) / rest)
                row[place[lang]] = np.log(right)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "html" in b.schema.names:
                sources = b.column("html").to_pylist()
                seen = [page_evidence(u, h) for u, h in zip(b.column("url").to_pylist(), sources, strict=True)]
                texts = [page_text(h) for h in sources]
            else:
                seen = [(h, None, None) for h in b.column("host").to_pylist()]
                texts = [t or "" for t in b.column("text").to_pylist()]
            host, declared, suffix = ([x[k] for x in seen] for k in range(3))
            log = model.text_evidence(texts) + told(declared, DECLARED_RIGHT) + told(suffix, SUFFIX_RIGHT)
            soft = np.exp(log + np.log(model.share) - (log + np.log(model.share)).max(axis=1, keepdims=True)) if len(log) else log
            soft = soft / soft.sum(axis=1, keepdims=True) if len(soft) else soft
            vectors = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(host, pa.string()), pa.array(declared, pa.string()), pa.array(suffix, pa.string()), vectors(log), vectors(soft)], ["key", "host", "declared", "suffix", "log", "soft"])

    return run


def identify(evidence: DataFrame, model: Model) -> DataFrame:
    """(kind, key, host, domain, declared, suffix, log, soft) -> the same with lang, probability and kept.

    A host's prior is the sum of its rows' soft answers, smoothed towards its domain's and that
    towards all rows', with the row's own answer taken out. Sums are grouped with partial aggregates;
    rows without a host have the prior of all. Only narrow rows are joined back; the table of hosts is
    staged first, so that its size decides the join and a hot host can be split.
    """
    n = len(model.languages)
    rows = stage_table(evidence, "evidence")
    sums = [F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(n)]
    vector = lambda p: F.array(*(F.col(f"{p}{k}") for k in range(n)))
    hosts = stage_table(rows.where("host is not null").groupBy("kind", "host", "domain").agg(*sums).select("kind", "host", "domain", vector("s").alias("host_sum")), "hosts")
    again = [F.sum(F.col("host_sum")[k]).alias(f"s{k}") for k in range(n)]
    domains = stage_table(hosts.groupBy("kind", "domain").agg(*again).select(F.col("kind").alias("d_kind"), F.col("domain").alias("d_domain"), vector("s").alias("domain_sum")), "domains")
    everything = rows.agg(*sums).first()
    total = np.array([x or 0.0 for x in everything]) + model.share
    overall = F.array(*(F.lit(float(x)) for x in total / total.sum()))
    known = hosts.join(domains, (F.col("kind") == F.col("d_kind")) & F.col("domain").eqNullSafe(F.col("d_domain"))).select(F.col("kind").alias("h_kind"), F.col("host").alias("h_host"), "host_sum", "domain_sum")
    joined = rows.join(known, (F.col("kind") == F.col("h_kind")) & (F.col("host") == F.col("h_host")), "left")
    less = lambda s: F.zip_with(s, F.col("soft"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    added = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda s, prior, pull: F.transform(F.zip_with(s, prior, lambda a, p: a + pull * p), lambda x: x / (added(s) + pull))
    joined = joined.withColumn("domain_left", less(F.col("domain_sum"))).withColumn("host_left", less(F.col("host_sum")))
    joined = joined.withColumn("domain_prior", smooth(F.col("domain_left"), overall, DOMAIN_PULL))
    joined = joined.withColumn("prior", F.coalesce(smooth(F.col("host_left"), F.col("domain_prior"), HOST_PULL), overall))
    joined = joined.withColumn("fused", F.zip_with("log", "prior", lambda a, p: a + F.log(F.greatest(p, F.lit(1e-9)))))
    joined = joined.withColumn("best", F.array_max("fused")).withColumn("z", F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best"))))
    names = F.array(*map(F.lit, model.languages))
    lang = F.element_at(names, F.array_position("fused", F.col("best")).cast("int"))
    return joined.select("kind", "key", "host", "declared", "suffix", lang.alias("lang_found"), (1 / F.col("z")).alias("probability"))


def _domain(host):
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


_EVIDENCE = "key string, host string, declared string, suffix string, log array<double>, soft array<double>"


def language_id(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of every page and of every document.

    Rows: kind ('page' or 'document'), page_id, doc_id (one of them null), host, declared, suffix,
    lang_found, probability, kept (probability of at least SURE). A document has no markup or address;
    its source stands for the host. The lang column is read for the bounded fit only; a language that no
    row of the fit has is no answer.

    Empty and null texts are judged by the other evidence, and without any by the prior of all rows.
    Null urls and sources have no host; null ids and repeated rows stay; extra columns are ignored; an
    empty table gives none of its rows. Equal scores go to the first language by name.
    """
    model = fit(docs)
    cast = lambda c: F.col(c).cast("string")
    from_pages = pages.select(cast("page_id").alias("key"), cast("url").alias("url"), cast("html").alias("html")).mapInArrow(_pages(model), _EVIDENCE)
    from_docs = docs.select(cast("doc_id").alias("key"), cast("source").alias("host"), cast("text").alias("text")).mapInArrow(_pages(model), _EVIDENCE)
    evidence = from_pages.withColumn("kind", F.lit("page")).unionByName(from_docs.withColumn("kind", F.lit("document"))).withColumn("domain", _domain(F.col("host")))
    found = identify(evidence, model)
    page = F.col("kind") == "page"
    return found.select("kind", F.when(page, F.col("key")).cast(pages.schema["page_id"].dataType).alias("page_id"), F.when(~page, F.col("key")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "host", "declared", "suffix", "lang_found", "probability", (F.col("probability") >= SURE).alias("kept"))
