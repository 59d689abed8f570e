"""Accounts: lookups and registrations in bulk."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(users: DataFrame, username: str) -> DataFrame:
    """The user of that name, at most one; the predicate reaches the scan."""
    return users.where(F.col("username") == F.lit(username)).limit(1)


def lookup(requests: DataFrame, users: DataFrame) -> DataFrame:
    """``requests(username, …)`` with found, whether there is such a user; one row per request."""
    known = users.select("username").distinct().withColumn("__known", F.lit(True))
    return requests.join(known, "username", "left").withColumn("found", F.coalesce("__known", F.lit(False))).drop("__known")


def login(requests: DataFrame, users: DataFrame, verify: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """``requests(username, password)`` with allowed: there is such a user and ``verify(password, hash)`` holds."""

    def check(password: pd.Series, hashed: pd.Series) -> pd.Series:
        return verify(password, hashed)

    known = users.select("username", "hashed_password").dropDuplicates(["username"])
    joined = requests.join(known, "username", "left")
    ok = F.when(F.col("hashed_password").isNotNull() & F.col("password").isNotNull(), F.pandas_udf(check, "boolean")("password", "hashed_password"))
    return joined.select(*(F.col(f"`{c}`") for c in requests.columns), F.coalesce(ok, F.lit(False)).alias("allowed"))


def register(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests whose name is free, one of each name, to be appended to the users; null names never are."""
    fresh = requests.where("username is not null").dropDuplicates(["username"])
    return fresh.join(users.select("username"), "username", "left_anti").withColumns({"role": F.lit("teacher"), "is_active": F.lit(True)})


def without_owner(projects: DataFrame, users: DataFrame) -> DataFrame:
    """Projects whose owner is gone, which a cascading delete would take."""
    return projects.join(users.select(F.col("id").alias("teacher_id")), "teacher_id", "left_anti")
