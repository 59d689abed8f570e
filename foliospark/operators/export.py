"""Exports: decks through conversion and preview providers, and what a caller gets back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.enrich import Providers, call


def to_pdf(files: DataFrame, providers: Providers) -> DataFrame:
    """``files(project_id, name, content)`` with pdf_name and pdf; the name is empty where the provider fails."""
    made = files.withColumn("pdf", call(providers.convert, "binary", F.col("content")))
    return made.withColumn("pdf_name", F.when(F.col("pdf").isNotNull(), F.regexp_replace("name", r"\.[^.]*$", ".pdf")).otherwise(F.lit("")))


def previews(pdfs: DataFrame, providers: Providers) -> DataFrame:
    """(project_id, page_no, name, url, content) of each page's picture, from 1; none where the provider fails."""
    pages = pdfs.withColumn("__pages", call(providers.pages, "array<binary>", F.col("pdf")))
    rows = pages.select("project_id", F.posexplode("__pages").alias("at", "content"))
    name = F.concat(F.lit("preview_"), F.col("project_id").cast("string"), F.lit("_"), (F.col("at") + 1).cast("string"), F.lit(".png"))
    return rows.select("project_id", (F.col("at") + 1).alias("page_no"), name.alias("name"), F.concat(F.lit("/static/exports/"), name).alias("url"), "content")


def response(pdfs: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, download_url_pptx, download_url_pdf or null, preview_images in page order)."""
    urls = pages.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "url"))), lambda x: x["url"]).alias("preview_images"))
    url = lambda c: F.concat(F.lit("/static/exports/"), F.substring_index(c, "/", -1))
    joined = pdfs.select("project_id", url(F.col("name")).alias("download_url_pptx"), F.when(F.col("pdf_name") != "", url(F.col("pdf_name"))).alias("download_url_pdf")).join(urls, "project_id", "left")
    return joined.withColumn("preview_images", F.coalesce("preview_images", F.array().cast("array<string>")))
