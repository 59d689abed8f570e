"""Chat formatting: schema fingerprints select declarative mappings from any layout to canonical turns."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates, as plain text; any <|name|> is one as well.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Set after the first character of a control string inside a text; doubled where a text has it itself.
MARK = "␛"
_CONTROL = re.compile(f"{MARK}|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS) + r"|<(?=\|)")
_MARKED = re.compile(f"{MARK}({MARK}?)")

#: Declarative mappings: the field paths that a layout must have, those it may have, and where turns lie.
#: "turns" is a list path with the fields of role and text; "fields" are single paths with fixed roles,
#: joined by a blank line where several share a role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    {"name": "messages", "must": ("messages[].content:text", "messages[].role:text"), "turns": ("messages", "role", "content")},
    {"name": "messages-typed", "must": ("messages[].content[].text:text", "messages[].role:text"), "turns": ("messages", "role", "content")},
    {"name": "share", "must": ("conversations[].from:text", "conversations[].value:text"), "turns": ("conversations", "from", "value"), "roles": ROLES},
    {"name": "dialog", "must": ("dialog[].speaker:text", "dialog[].text:text"), "turns": ("dialog", "speaker", "text"), "roles": ROLES},
    {"name": "instruction", "must": ("instruction:text", "output:text"), "fields": (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))},
    {"name": "prompt-response", "must": ("prompt:text", "response:text"), "fields": (("system", "system"), ("prompt", "user"), ("response", "assistant"))},
    {"name": "prompt-completion", "must": ("completion:text", "prompt:text"), "fields": (("prompt", "user"), ("completion", "assistant"))},
    {"name": "question-answer", "must": ("answer:text", "question:text"), "fields": (("context", "user"), ("question", "user"), ("answer", "assistant"))},
)


def field_paths(value, at: str = "") -> Iterator[str]:
    """Nested field paths with the kind of each leaf; list places are not part of a path, null counts as text."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, at + "[]")
        if not value:
            yield at + "[]:empty"
    else:
        yield f"{at}:{'text' if value is None or isinstance(value, str) else 'flag' if isinstance(value, bool) else 'number'}"


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


#: Fingerprints of the layouts as they are; records with more fields are matched once per fingerprint.
KNOWN = {fingerprint(set(m["must"])): m for m in MAPPINGS}


def select_mapping(paths: set[str], known: dict) -> tuple[str, dict | None]:
    """The fingerprint, and the mapping with the most of the layout's own fields; remembered in ``known``."""
    key = fingerprint(paths)
    if key not in known:
        fits = [m for m in MAPPINGS if paths.issuperset(m["must"])]
        found = max(fits, key=lambda m: len(m["must"]), default=None)
        if len(known) < 10_000:
            known[key] = found
        return key, found
    return key, known[key]


def _text(value) -> str:
    """A field's text; half a surrogate pair, which JSON can name, becomes U+FFFD."""
    if value is None:
        return ""
    if isinstance(value, str) and not value.isascii() and re.search("[\ud800-\udfff]", value):
        return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    if isinstance(value, list):
        return "".join(_text(v.get("text") if isinstance(v, dict) else v) for v in value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]]:
    if "turns" in mapping:
        where, role, text = mapping["turns"]
        names = mapping.get("roles", {})
        return [(names.get(r := _text(t.get(role)), r), _text(t.get(text))) for t in record[where] if isinstance(t, dict)]
    turns: list[tuple[str, str]] = []
    for field, role in mapping["fields"]:
        value = _text(record.get(field))
        if not value and f"{field}:text" not in mapping["must"]:
            continue
        if turns and turns[-1][0] == role:
            turns[-1] = (role, f"{turns[-1][1]}\n\n{value}")
        else:
            turns.append((role, value))
    return turns


def escape(text: str) -> str:
    """No control string is left, and unescape() gives the text back."""
    return _CONTROL.sub(lambda m: m[0] + MARK, text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it under the loss mask: each assistant's text."""
    parts: list[str] = []
    spans = []
    at = 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", MARK + "n") + MIDDLE, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, CLOSE
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted text."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition(MIDDLE)
        role = re.sub(f"{MARK}([{MARK}n]?)", lambda m: "\n" if m[1] == "n" else m[1], role)
        turns.append((role, unescape(body[: -len(CLOSE)])))
    return turns


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = dict(KNOWN)
    for b in batches:
        rows = []
        for x in b.column("record"):
            key = mapping = text = spans = None
            # records nested deeper than the reader follows are treated as broken JSON
            with contextlib.suppress(ValueError, RecursionError):
                if isinstance(record := json.loads(x.as_py() or "null"), dict):
                    key, mapping = select_mapping(set(field_paths(record)), known)
                    text, spans = render(canonical_turns(record, mapping)) if mapping else (None, None)
            rows.append((key, mapping["name"] if text is not None else None, text, [{"start": a, "end": z} for a, z in spans] if text is not None else None))
        kinds = (pa.string(), pa.string(), pa.string(), _SPANS)
        yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["key", "layout", "mapping", "formatted", "loss"])


def format_records(records: DataFrame) -> DataFrame:
    """(key, record) -> (key, layout, mapping, formatted, loss).

    ``record`` is JSON of any known layout; ``layout`` is the fingerprint of its field paths. Records of
    unknown layouts, null ones and broken or too deeply nested JSON stay, with null mapping and formatted text. Spans under
    the loss mask count characters of ``formatted``. One map, no shuffle.
    """
    kind = records.schema["key"].dataType.simpleString()
    return records.select("key", "record").mapInArrow(_format, f"key {kind}, layout string, mapping string, formatted string, loss array<struct<start:long,end:long>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        rows = []
        for f, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
            turns = parse(f or "")
            loss = "".join(unescape(f[s["start"] : s["end"]]) for s in spans or ())
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(f or "")))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_records(turns: DataFrame) -> DataFrame:
    """(key, record): one JSON record per conv_id, its rows by turn, in the layout that its turns fit.

    A question with its answer is a prompt and a response, with a system text before it if there is one; a
    question whose first paragraph stands apart is an instruction with its input; a longer talk of user
    and assistant is a share; all others are messages. Reading them takes the mapping that each
    layout's fingerprint selects.

    A conversation is one training text, so its rows meet in one row; only they are gathered. Ties of
    turn are ordered by role and text, null turns come first, null roles and texts are empty, repeated
    rows stay, and rows of a null conv_id are one conversation. Extra columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("content"))
    gathered = turns.groupBy(F.col("conv_id").alias("key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    roles = F.transform("rows", lambda x: x["role"])
    said = lambda k: F.get("rows", F.lit(k))["content"]
    are = lambda *names: roles == F.array(*map(F.lit, names))
    json_of = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    lead = F.instr(said(0), "\n\n")
    rest = F.substr(said(0), lead + 2, F.length(said(0)))
    share = F.transform("rows", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["content"].alias("value")))
    messages = F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    record = (
        F.when(are("user", "assistant") & (lead > 0) & (rest != ""), json_of(instruction=F.substring(said(0), 1, lead - 1), input=rest, output=said(1)))
        .when(are("user", "assistant"), json_of(prompt=said(0), response=said(1)))
        .when(are("system", "user", "assistant") & (said(0) != ""), json_of(system=said(0), prompt=said(1), response=said(2)))
        .when(F.forall(roles, lambda r: r.isin("user", "assistant")), json_of(conversations=share))
        .otherwise(json_of(messages=messages))
    )
    return gathered.select("key", record.alias("record"))


def format_digest(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from the formatted texts."""
    spark = conversations.sparkSession
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    formatted = format_records(conversation_records(every))
    return formatted.select("key", "formatted", "loss").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
