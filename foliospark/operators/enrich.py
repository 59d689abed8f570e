"""Enrichment: pages through text, picture and game providers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import wording as w
from foliospark.operators import games


def hash_embed(texts: pd.Series, size: int = 64) -> pd.Series:
    """A repeatable stand-in for an embedding service: signed word hashes, unit length; empty texts give null."""

    def one(text):
        v = np.zeros(size)
        for word in (text or "").split():
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        return (v / n).tolist() if n else None

    return texts.map(one)


@dataclass
class Providers:
    """Functions over pandas series that stand for outside services; each may return null for a failure.

    ``complete`` and ``draw`` take prompts; ``read_image`` and ``read_speech`` take bytes, ``partition``
    takes bytes and gives a list of (kind, text, html), ``convert`` takes a deck and gives a PDF, of which
    ``pages`` gives a list of pictures.
    """

    embed: Callable = hash_embed
    complete: Callable | None = None
    draw: Callable | None = None
    read_image: Callable | None = None
    read_speech: Callable | None = None
    partition: Callable | None = None
    convert: Callable | None = None
    pages: Callable | None = None


def call(provider: Callable | None, kind: str, argument: Column) -> Column:
    """A provider as a column; null everywhere without one. Not deterministic, so it is never moved or computed twice."""
    if provider is None:
        return F.lit(None).cast(kind)

    def run(batch: pd.Series) -> pd.Series:
        return provider(batch)

    return F.pandas_udf(run, kind).asNondeterministic()(argument)


def page_prompt(title: Column, content: Column) -> Column:
    return F.concat(F.lit("Summarise this slide in short numbered points, at most 150 characters in all, and say nothing else.\nTitle: "), title, F.lit("\nNotes: "), content)


def picture_prompt(title: Column, content: Column) -> Column:
    return F.concat(F.lit("A clean illustration on white, without letters or digits. Topic: "), title, F.lit(". Context: "), F.substring(content, 1, 50))


def wants_image(need_image: Column) -> Column:
    """Everything but a literal false."""
    return ~need_image.eqNullSafe(F.lit(False))


def with_text(pages: DataFrame, providers: Providers) -> DataFrame:
    """``pages`` with the provider's text as content; the old content where it fails."""
    made = call(providers.complete, "string", page_prompt(F.coalesce("title", F.lit(w.UNNAMED_PAGE)), F.coalesce("content", F.lit(""))))
    return pages.withColumn("content", F.coalesce(made, "content"))


def image_name(title: Column) -> Column:
    """A picture's file name, from a hash of the title."""
    return F.concat(F.lit("img_"), F.substring(F.sha2(F.coalesce(title, F.lit("")), 256), 1, 16), F.lit(".png"))


def with_image(pages: DataFrame, providers: Providers) -> DataFrame:
    """``pages`` with image and image_path; the path is empty on failure and null where none is wanted."""
    made = call(providers.draw, "binary", picture_prompt(F.coalesce("title", F.lit(w.UNNAMED_PAGE)), F.coalesce("content", F.lit(""))))
    drawn = pages.withColumn("image", F.when(wants_image(F.col("need_image")), made))
    return drawn.withColumn("image_path", F.when(~wants_image(F.col("need_image")), F.lit(None).cast("string")).when(F.col("image").isNotNull(), image_name(F.col("title"))).otherwise(F.lit("")))


def with_game(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """``pages`` with game_url: the project's page of that game type, "" if it has no template, null without a game."""
    game = F.try_parse_json("interactive_game")
    kind = F.when(F.col("interactive_game").isNotNull(), F.coalesce(F.try_variant_get(game, "$.game_type", "string"), F.lit(w.DEFAULT_GAME)))
    known = templates.select(F.col("game_type").alias("__type")).distinct()
    joined = pages.withColumn("__kind", kind).join(known, F.col("__kind") == F.col("__type"), "left")
    url = F.when(F.col("__type").isNotNull(), games.game_url(F.col("project_id"), F.col("__kind"))).when(F.col("__kind").isNotNull(), F.lit(""))
    return joined.withColumn("game_url", url).drop("__kind", "__type")


def run(pages: DataFrame, templates: DataFrame, providers: Providers | None = None) -> DataFrame:
    """All three stages; pages keep their own order columns."""
    providers = providers or Providers()
    return with_game(with_image(with_text(pages, providers), providers), templates)
