"""Folder scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, markdown) of the .md files in a folder, whole."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("markdown"))


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, mtime, length, is_file, directory) of the files in folders, contents unread; missing folders are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda path: (p := jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(conf).exists(p)
    found = [p for p in paths if there(p)]
    if not found:
        return spark.createDataFrame([], "path string, name string, mtime timestamp, length long, is_file boolean, directory string")
    files = spark.read.format("binaryFile").load(found).select("path", F.col("modificationTime").alias("mtime"), "length")
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "mtime", "length", F.lit(True).alias("is_file"), F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("directory"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, content) of uploaded files."""
    return spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), "path", "content")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(game_type, html) of the template_{type}.html files in a folder."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter="template_*.html")
    return found.select(F.regexp_extract(F.col("_metadata.file_name"), r"^template_(.*)\.html$", 1).alias("game_type"), F.col("value").alias("html"))


def table(spark: SparkSession, url: str, name: str, user: str, password: str, **options: str) -> DataFrame:
    """A database table over JDBC; the driver's jar is a matter of deployment."""
    return spark.read.jdbc(url, name, properties={"user": user, "password": password, **options})
