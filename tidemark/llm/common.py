"""Shared pieces of the corpus operators: reading, held-out split, cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python strings at a time, whatever the size of the Arrow batch.
SLICE_ROWS = 128

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may go without; it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    return found


_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, path: str) -> None:
    """Write Parquet, after which Spark deletes the shuffle files of this write; :func:`release` deletes ``path``."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    _written[path] = spark
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The files are removed when the application ends, or before by :class:`Tables`.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    store(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


class Tables:
    """What one caller has :func:`cut`, so that it can delete tables that nothing reads any more. Not those of other callers."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, set()

    def cut(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.paths.add(out._tidemark_path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for path in [x._tidemark_path for x in frames]:
            self.paths.discard(path)
            delete(self.spark, path)

    def drop_all(self, *keep: DataFrame) -> None:
        for path in self.paths - {x._tidemark_path for x in keep}:
            delete(self.spark, path)
        self.paths &= {x._tidemark_path for x in keep}


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def release() -> None:
    """Delete all tables of :func:`store` of sessions that still run."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    _written.clear()


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session is gone, and its shared folder is the cluster's
        _written.clear()


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows without an id count as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 2


def strings(column: pa.Array) -> Iterator[str | None]:
    """The values one after another, a slice at a time, so that a batch is never wholly in Python strings."""
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def components(edges: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None) -> DataFrame:
    """Connected components of ``edges`` (two long columns): rows (node, label), label the smallest
    node, which has no row of its own.

    Alternating large-star and small-star steps; each is a partial aggregation of minima and a join on the
    node, so a node with many neighbours is pre-aggregated and its join can be split by AQE. Every step is
    written to the shared folder. Ends when a pair of steps leaves the edges as they were. The result is one of
    ``tables``; the steps before are deleted.
    """
    tables = tables or Tables(edges.sparkSession)
    now = tables.cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # after the large star every edge points from a node to a smaller one
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, now = now, tables.cut(small)
        tables.drop(before)
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    out = tables.cut(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")))
    tables.drop(now)
    return out
