"""Staged tables: Parquet in the folder that all executors share, which cuts a plan's lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="foliospark-"))
    return made


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage_table(df: DataFrame, tag: str, file_rows: int = 0, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and returns it reread.

    A lost executor then costs the tasks it ran, never the stages before this table. ``file_rows``
    limits the rows of each of its files; ``options`` go to the Parquet writer.
    """
    path = new_path(df.sparkSession, tag)
    df.write.options(**options or {}).option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    if path := getattr(df, "_staged_path", None):
        remove(df.sparkSession, path)


#: Names that Spark and Arrow give the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_filesystem(uri: str):
    """(file system, path) of a Spark URI or a local path, for readers and writers over Arrow."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if not sep:
        return fs.FileSystem.from_uri(f"file://{os.path.abspath(uri)}" if not uri.startswith("file:") else "file://" + uri[5:])
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def staged() -> int:
    """How many paths have been made so far."""
    return len(_staged)


def discard_since(count: int, keep: DataFrame) -> None:
    """Deletes what was staged after the first ``count`` paths, but for ``keep``."""
    kept = getattr(keep, "_staged_path", None)
    rest = _staged[count:]
    del _staged[count:]
    for spark, path in rest:
        if path == kept:
            _staged.append((spark, path))
        else:
            remove(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
