"""Retrieval-augmented outlines: a topic's evidence, a prompt, and the model's reply as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import jsonx
from foliospark.operators import vectors
from foliospark.operators.enrich import Providers, call
from foliospark.sources.staging import stage_table


def outline_prompt(topic, evidence):
    """What a model is asked for; wording of our own."""
    return F.concat(
        F.lit("Plan a lesson on this topic in six stages, as one JSON object named outline_data with course_metadata (with teaching_methods and homework) and syllabus_content. "),
        F.lit("A stage may have an interactive_game of type memory_match, drag_sort or scenario_quiz. Rely on the evidence only.\nTopic: "),
        F.coalesce(topic, F.lit("")),
        F.lit("\nEvidence:\n"),
        evidence,
    )


def with_evidence(requests: DataFrame, collection: DataFrame | None, providers: Providers, k: int = 3) -> DataFrame:
    """``requests(query_id, topic, outside)`` with evidence, from outside text and the k nearest chunks of the topic.

    Only the topic is embedded. Without a collection, or where the provider fails, evidence is the outside text alone.
    """
    if collection is None:
        found = requests.select("query_id", F.lit(None).cast("string").alias("found"))
    else:
        asked = stage_table(requests.select("query_id", call(providers.embed, "array<double>", F.col("topic")).alias("vector")), "topics")
        hits = vectors.top_k(collection, asked, k).join(collection.select("id", "text", "source"), "id")
        found = vectors.evidence(hits).withColumnRenamed("evidence", "found")
    return requests.join(found, "query_id", "left").withColumn("evidence", vectors.assemble(F.col("outside"), F.col("found"))).drop("found")


def outline(requests: DataFrame, collection: DataFrame | None, providers: Providers, k: int = 3) -> DataFrame:
    """(query_id, outline, error): the model's reply as JSON, or why there is none.

    Replies are staged before they are read twice, so that a provider is asked once.
    """
    asked = with_evidence(requests, collection, providers, k)
    replies = stage_table(asked.select("query_id", call(providers.complete, "string", outline_prompt(F.col("topic"), F.col("evidence"))).alias("reply")), "replies")
    return replies.select("query_id", jsonx.tolerant(F.coalesce("reply", F.lit(""))).alias("x")).select("query_id", F.col("x.json").alias("outline"), "x.error")
