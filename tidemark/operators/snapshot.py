"""Reads of a log as of a version. Every operator here is one shuffle on the record's key at most, and newest
versions are maxima, so a record with very many versions is reduced before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonexpr
from ..schema import KEY, RECORD

_PAYLOAD = ("body", "schema_version", "commit_version", "deleted")


def _newest(when: Column | None = None) -> Column:
    place, payload = F.struct("commit_version", "seq"), F.struct(*_PAYLOAD)
    return F.max_by(payload, place if when is None else F.when(when, place))


def table(log: DataFrame, space: str, name: str) -> DataFrame:
    return log.where((F.col("space") == space) & (F.col("table_name") == name))


def snapshot(log: DataFrame, version: int | None = None, include_deleted: bool = False) -> DataFrame:
    """Newest version of each record at or before ``version`` (None: the last); of a transaction's several, the last.

    Filters on bodies belong after this: they choose among visible records, not among versions.
    """
    seen = log if version is None else log.where(F.col("commit_version") <= version)
    out = seen.groupBy(*KEY).agg(_newest().alias("r")).select(*KEY, "r.*")
    if not include_deleted:
        return out.where(~F.col("deleted")).select(*RECORD)
    return out.withColumn("body", F.when(~F.col("deleted"), F.col("body"))).select(*RECORD)


def get(log: DataFrame, record_id: str, version: int | None = None) -> DataFrame:
    """The record, or no row if it isn't there or deleted at the version."""
    return snapshot(log.where(F.col("record_id") == record_id), version)


def history(log: DataFrame) -> DataFrame:
    """Each record's committed versions with the version that replaced it."""
    last = log.groupBy(*KEY, "commit_version").agg(F.max_by(F.struct("body", "schema_version", "deleted"), "seq").alias("r")).select(*KEY, "commit_version", "r.*")
    return last.withColumn("replaced_by", F.lead("commit_version").over(Window.partitionBy(*KEY).orderBy("commit_version")))


def diff(log: DataFrame, before: int, after: int) -> DataFrame:
    """Rows (key, before, after) of records whose value differs between two versions; null where not visible.

    One pass: both newest versions of a record come from the same aggregate, and records not touched in between
    drop out before bodies are compared. Bodies that differ in text are compared as JSON values. A JSON null is a
    value, not an absence. Equal versions have no difference.
    """
    low, high = min(before, after), max(before, after)
    seen = log.where(F.col("commit_version") <= high)
    both = seen.groupBy(*KEY).agg(_newest(F.col("commit_version") <= low).alias("old"), _newest().alias("new"), F.max("commit_version").alias("touched"))
    value = lambda c: F.when(~F.col(f"{c}.deleted"), F.col(f"{c}.body"))
    changed = both.where(F.col("touched") > low).select(*KEY, value("old").alias("old"), value("new").alias("new"))
    maybe = changed.where(~F.col("old").eqNullSafe(F.col("new")))
    differ = maybe.where(F.col("old").isNull() | F.col("new").isNull() | (jsonexpr.canonical(F.col("old")) != jsonexpr.canonical(F.col("new"))))
    names = ("old", "new") if before <= after else ("new", "old")
    return differ.select(*KEY, F.col(names[0]).alias("before"), F.col(names[1]).alias("after"))


def visible_at(log: DataFrame, versions: DataFrame, column: str = "version", width: int = 65_536) -> DataFrame:
    """Number of visible records at each of the versions.

    Beginnings and ends of visibility are summed by version, then along versions: within pieces of ``width`` versions,
    and over the pieces' sums, of which there is one row for each.
    """
    steps = history(log).select(F.col("commit_version").alias("start"), F.col("replaced_by").alias("end"), "deleted").where(~F.col("deleted"))
    points = steps.select(F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(steps.where("end is not null").select(F.col("end").alias("at"), F.lit(-1).alias("d"))).groupBy("at").agg(F.sum("d").alias("d"))
    asked = versions.select(F.col(column).alias("at")).distinct()
    piece = F.floor(F.col("at") / width).alias("piece")
    both = points.select("at", "d", F.lit(0).alias("asked"), piece).unionByName(asked.select("at", F.lit(0).cast("long").alias("d"), F.lit(1).alias("asked"), piece))
    before = both.groupBy("piece").agg(F.sum("d").alias("d")).select("piece", F.sum("d").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.sum("d").over(Window.partitionBy("piece").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("inside", inside).where("asked = 1").join(before, "piece")
    return found.select(F.col("at").alias(column), (F.col("inside") + F.coalesce("before", F.lit(0))).alias("visible"))


def chains(log: DataFrame) -> DataFrame:
    """Per record: number of versions, first and last."""
    return log.groupBy(*KEY).agg(F.countDistinct("commit_version").alias("n_versions"), F.min("commit_version").alias("first_version"), F.max("commit_version").alias("last_version"))


def global_version(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("commit_version"), F.lit(0)).alias("version"))


def retained(log: DataFrame, oldest_pin: int | None) -> DataFrame:
    """What garbage collection keeps: all after the oldest pinned version, and the newest at or before it.

    Without a pin only the newest version of each record. A chain never goes empty.
    """
    columns = log.columns
    place = F.struct("commit_version", "seq")
    seen = log if oldest_pin is None else log.where(F.col("commit_version") <= oldest_pin)
    anchors = seen.groupBy(*KEY).agg(F.max_by(F.struct(*columns), place).alias("r")).select("r.*")
    return anchors if oldest_pin is None else anchors.unionByName(log.where(F.col("commit_version") > oldest_pin))


def manifest(log: DataFrame, shard: Column | int = 32) -> DataFrame:
    """Statistics of each shard of each table: keys, versions and rows, for skipping. ``shard``: a number of them, dealt by id, or a column."""
    shard = F.pmod(F.crc32("record_id"), F.lit(shard)) if isinstance(shard, int) else shard
    return log.groupBy("space", "table_name", shard.cast("int").alias("shard")).agg(
        F.min("record_id").alias("key_min"), F.max("record_id").alias("key_max"), F.min("commit_version").alias("version_min"), F.max("commit_version").alias("version_max"), F.count("*").alias("n_rows")
    )


#: An entry counts as so many bytes at least.
ENTRY_BYTES = 64


def sizes(log: DataFrame) -> DataFrame:
    """(space, table_name, n_rows, version_min, version_max, bytes) of each table; bytes by identifiers and bodies."""
    used = F.octet_length("record_id") + F.coalesce(F.octet_length("body"), F.lit(0))
    return log.groupBy("space", "table_name").agg(F.count("*").alias("n_rows"), F.min("commit_version").alias("version_min"), F.max("commit_version").alias("version_max"), F.sum(F.greatest(F.lit(ENTRY_BYTES), used)).cast("long").alias("bytes"))
