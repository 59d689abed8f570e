"""String and number functions over columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import wording as w

#: The 29 code points that count as white space, as a regular-expression class body.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(text: Column) -> Column:
    """Gaps between two characters beyond U+00FF closed, other white space one space, ends stripped; null is empty.

    A character that ended one match does not begin the next.
    """
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), f"([^\\x00-\\xFF])[{SPACE}]+([^\\x00-\\xFF])", "$1$2")
    return strip(F.regexp_replace(joined, f"[{SPACE}]+", " "))


def stage_title(stage: Column) -> Column:
    """The stripped part after the last hyphen; without one the title as it is."""
    return F.when(stage.contains("-"), strip(F.substring_index(stage, "-", -1))).otherwise(stage)


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def route(name: Column) -> Column:
    """sheet, image, video, document, or null for a name that is not allowed."""
    e = extension(name)
    return F.when(e.isin(*w.SHEETS), "sheet").when(e.isin(*w.IMAGES), "image").when(e.isin(*w.VIDEOS), "video").when(e.isin(*w.DOCUMENTS), "document")


def chunks(markdown: Column) -> Column:
    """Stripped pieces between rules, wherever they stand, that are long enough to be searched."""
    pieces = F.transform(F.split(markdown, w.RULE, -1), strip)
    return F.filter(pieces, lambda x: F.length(x) > w.CHUNK_LONGER_THAN)


def guard(text: Column, limit: int = w.MAX_CHARS) -> Column:
    """At most ``limit`` characters, then a notice if any were cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(w.CUT_NOTICE))).otherwise(text)


def or_placeholder(text: Column) -> Column:
    done = strip(F.coalesce(text, F.lit("")))
    return F.when(done == "", F.lit(w.NOTHING_READ)).otherwise(done)


def fill(template: str, *values: Column) -> Column:
    """The template with {0}, {1} ... replaced by columns, null as empty."""
    out: list[Column] = []
    rest = template
    for k, v in enumerate(values):
        before, _, rest = rest.partition(f"{{{k}}}")
        out += [F.lit(before), F.coalesce(v.cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def inches(px: Column) -> Column:
    return px / w.CANVAS[0] * F.lit(w.CANVAS_INCHES[0])


def rgb(color: Column) -> Column:
    """Struct r, g, b of a hex colour; black unless six digits follow the leading number signs. Bad digits are null."""
    bare = F.ltrim(color, F.lit("#"))
    part = lambda k: F.when(F.length(bare) != 6, F.lit(0)).when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.conv(F.substring(bare, k, 2), 16, 10).cast("int"))
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def join_in_order(value: Column, order: Column | list[Column], sep: str) -> Column:
    """Aggregate: the group's strings in order, nulls left out; nothing gives null."""
    order = order if isinstance(order, list) else [order]
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), value.alias("v")))))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda x: x["v"]), sep))
