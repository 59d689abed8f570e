"""Retention: which produced files are old enough to go."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import wording as w


def expired(files: DataFrame, now: Column | datetime | None = None, hours: int = w.KEPT_HOURS) -> DataFrame:
    """Rows of (name, mtime, is_file, …) that are files, not on the list to keep, and older than ``hours``.

    The comparison is strict: a file of exactly that age stays. It compares mtime with one constant, so
    it reaches the scan. Null times and names stay on disk.
    """
    now = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    return files.where(F.col("is_file") & ~F.col("name").isin(*w.KEPT_FILES) & (F.col("mtime") < now - F.make_dt_interval(hours=F.lit(hours))))


def age_seconds(mtime: Column, now: Column) -> Column:
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(mtime.cast("timestamp"))


def token_expiry(issued: Column, minutes: int = w.TOKEN_MINUTES) -> Column:
    return issued + F.make_dt_interval(mins=F.lit(minutes))
