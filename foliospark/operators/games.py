"""Small exercises: cards, sorting, quizzes, and pages built from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import wording as w


def cards(pairs: DataFrame) -> DataFrame:
    """(game_id, pair_id, left, right) -> two cards a pair: (game_id, pair_id, side, label)."""
    return pairs.select("game_id", "pair_id", F.expr("stack(2, 'left', left, 'right', right) AS (side, label)"))


def matches(deck: DataFrame) -> DataFrame:
    """Pairs of cards that belong together: one pair id, different sides; both orders once."""
    other = deck.select("game_id", "pair_id", F.col("side").alias("other_side"), F.col("label").alias("other_label"))
    return deck.join(other, ["game_id", "pair_id"]).where("side < other_side")


def shuffled(deck: DataFrame, seed: int = 0) -> DataFrame:
    """``deck`` with place, a repeatable random order of each game's cards."""
    order = Window.partitionBy("game_id").orderBy(F.xxhash64(F.lit(seed), "game_id", "pair_id", "side"), "pair_id", "side")
    return deck.withColumn("place", F.row_number().over(order))


def flips(events: DataFrame) -> DataFrame:
    """(game_id, at, pair_id, side) in order -> moves of two flips: (game_id, move, at, matched).

    A flip of the open card, or of one whose pair is found, counts for nothing. The second flip that counts
    ends the move: both cards of a pair stay open, others are turned back. A last open card makes no move.
    A game's flips are gathered into one row and gone through in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema if f.name in ("at", "pair_id", "side")}
    card = f"struct<at:{kinds['at']},pair_id:{kinds['pair_id']},side:{kinds['side']}>"
    start = F.struct(F.lit(None).cast(card).alias("open"), F.array().cast(f"array<{kinds['pair_id']}>").alias("found"), F.array().cast(f"array<struct<at:{kinds['at']},matched:boolean>>").alias("moves"))

    def flip(state, x):
        first = state["open"]
        same = first["pair_id"] == x["pair_id"]
        idle = F.array_contains(state["found"], x["pair_id"]) | F.coalesce(same & (first["side"] == x["side"]), F.lit(False))
        opened = F.struct(x.alias("open"), state["found"].alias("found"), state["moves"].alias("moves"))
        found = F.when(same, F.array_append(state["found"], x["pair_id"])).otherwise(state["found"])
        moved = F.struct(F.lit(None).cast(card).alias("open"), found.alias("found"), F.array_append(state["moves"], F.struct(first["at"].alias("at"), same.alias("matched"))).alias("moves"))
        return F.when(idle, state).when(first.isNull(), opened).otherwise(moved)

    rows = events.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("at", "pair_id", "side"))).alias("flips"))
    played = rows.select("game_id", F.posexplode(F.aggregate("flips", start, flip)["moves"]).alias("move", "m"))
    return played.select("game_id", F.col("move").cast("long").alias("move"), "m.at", "m.matched")


def progress(moves: DataFrame, deck: DataFrame) -> DataFrame:
    """(game_id, matched_cards, cards, won): two cards for each move that found a pair."""
    matched = moves.groupBy("game_id").agg((2 * F.count_if("matched")).alias("matched_cards"))
    total = deck.groupBy("game_id").agg(F.count("*").alias("cards"))
    return total.join(matched, "game_id", "left").select("game_id", F.coalesce("matched_cards", F.lit(0)).cast("long").alias("matched_cards"), "cards", F.coalesce(F.col("matched_cards") == F.col("cards"), F.lit(False)).alias("won"))


def drops(items: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(game_id, word, category)`` with right: whether the word's target is the category."""
    key = items.select("game_id", "word", "target").distinct()
    return moves.join(key, ["game_id", "word"], "left").select("game_id", "word", "category", F.coalesce(F.col("target") == F.col("category"), F.lit(False)).alias("right"))


def answers(questions: DataFrame) -> DataFrame:
    """(game_id, question, options, correct_index, selected) -> with right, the chosen and the next question or null."""
    last = F.max("question").over(Window.partitionBy("game_id"))
    return questions.select("game_id", "question", F.get("options", F.col("selected")).alias("chosen"), (F.col("selected") == F.col("correct_index")).alias("right"), F.when(F.col("question") < last, F.col("question") + 1).alias("next_question"))


def with_template(games: DataFrame, templates: DataFrame) -> DataFrame:
    """``games`` joined with templates(game_type, html); games of other types have a null template."""
    return games.withColumn("game_type", F.coalesce("game_type", F.lit(w.DEFAULT_GAME))).join(templates.select("game_type", "html"), "game_type", "left")


def build(games: DataFrame) -> DataFrame:
    """(…, html, payload) with page, the template with its placeholder replaced by the payload.

    Closing tags in the payload are escaped, so that no text ends the script. Null without a template.
    """
    safe = F.replace("payload", F.lit("</"), F.lit("<\\/"))
    return games.withColumn("page", F.replace("html", F.lit(w.PLACEHOLDER), safe))


def last_written(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by ``order`` of every key; one maximum a key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("__last"))
    return best.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest))


def game_url(project, game_type):
    return F.concat(F.lit("/static/exports/interactive_game_"), project.cast("string"), F.lit("_"), game_type, F.lit(".html"))
