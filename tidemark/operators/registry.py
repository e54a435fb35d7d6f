"""Schema documents of a log as of a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BINDING, SCHEMA_TABLE
from .snapshot import snapshot


def documents(log: DataFrame, version: int | None = None) -> DataFrame:
    """(space, name, version, body, commit_version, is_binding) of every visible schema document."""
    rows = snapshot(log.where(F.col("table_name") == SCHEMA_TABLE), version)
    form = r"^(.+)/v(\d+)\.json$"
    named = rows.where(F.col("record_id").rlike(form)).select("space", F.regexp_extract("record_id", form, 1).alias("name"), F.regexp_extract("record_id", form, 2).cast("int").alias("version"), "body", "commit_version")
    return named.withColumn("is_binding", F.col("name").startswith(BINDING))


def latest(log: DataFrame, version: int | None = None) -> DataFrame:
    """The highest visible version of each name."""
    return documents(log, version).groupBy("space", "name", "is_binding").agg(F.max("version").alias("version"), F.max_by(F.struct("body", "commit_version"), "version").alias("d")).select("space", "name", "is_binding", "version", "d.*")
