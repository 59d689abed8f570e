"""JSON of any shape: tolerant reading, missing against null, embedded objects, string leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliospark.functions import wording as w
from foliospark.functions.text import strip

NOT_OBJECT, NOT_JSON = "no JSON object in the reply", "the reply's JSON can't be read"


def tolerant(text: Column) -> Column:
    """Struct (json, error) from a model's reply.

    The reply without fences is parsed; else what lies from its first to its last brace. Characters
    of the fence are stripped as a set, so a bare ``null`` loses its first letter and is no JSON.
    """
    bare = strip(F.btrim(strip(text), F.lit(w.FENCE)))
    whole = F.try_parse_json(bare)
    span = F.regexp_extract(bare, w.OBJECT_SPAN, 0)
    inner = F.try_parse_json(F.when(span != "", span))
    value = F.when(whole.isNotNull(), F.to_json(whole)).when(inner.isNotNull(), F.to_json(inner))
    error = F.when(whole.isNotNull() | inner.isNotNull(), F.lit(None)).when(span == "", F.lit(NOT_OBJECT)).otherwise(F.lit(NOT_JSON))
    return F.struct(value.alias("json"), error.cast("string").alias("error"))


def string_or_object(text: Column) -> Column:
    """A variant; a JSON string is parsed once more."""
    value = F.try_parse_json(text)
    inner = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_parse_json(inner)).otherwise(value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def unwrap(value: Column) -> Column:
    """The object under outline_data if it is one, else the value itself."""
    inner = F.try_variant_get(value, "$.outline_data", "variant")
    return F.when(is_object(inner), inner).otherwise(value)


def truthy(value: Column) -> Column:
    """Whether a variant counts as true: neither missing, null, false, zero nor empty."""
    s = F.to_json(value)
    return F.coalesce(~s.isin("null", "false", '""', "[]", "{}", "0", "0.0", "-0.0", "-0"), F.lit(False))


def get(value: Column, path: str, kind: str = "string", default: Column | None = None) -> Column:
    """A field; the default only where it is missing, not where it is null."""
    found = F.try_variant_get(value, path, kind)
    if default is None:
        return found
    missing = F.try_variant_get(value, path, "variant").isNull()
    return F.when(missing, default).otherwise(found)


def mine_game(description: Column, game: Column) -> tuple[Column, Column]:
    """(game, description): a game written into the description, if the stage has none of its own.

    The span runs from the first brace to the first closing brace after the key; if it is no JSON,
    both stay as they are, else every occurrence of it becomes a marker.
    """
    span = F.regexp_extract(description, w.GAME_SPAN, 0)
    mined = F.try_parse_json(F.when(span != "", span))
    use = ~truthy(game) & F.coalesce(description.contains(w.GAME_KEY), F.lit(False)) & mined.isNotNull()
    return F.when(use, mined).otherwise(game), F.when(use, F.replace(description, span, F.lit(w.GAME_LOADED))).otherwise(description)


_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _leaves(value, out: list[str]) -> None:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(v for k, v in reversed(x.items()) if k not in w.SKIPPED_KEYS)
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, str) and len(x := x.strip(_SPACES)) > w.LEAF_LONGER_THAN:
            out.append(x)


@F.pandas_udf(StringType())
def leaf_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Long enough string leaves of a JSON text, by line, in the document's own order.

    Variants sort their keys, so this is the one JSON function that needs Python; it goes over Arrow
    batches with a stack of its own. Broken JSON, null, and nesting beyond the reader's depth give null.
    """

    def one(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        out: list[str] = []
        _leaves(value, out)
        return "\n".join(out)

    for batch in texts:
        yield batch.map(one)


def to_json(value: Column) -> Column:
    """JSON text that keeps nulls."""
    return F.to_json(value, {"ignoreNullFields": "false"})

