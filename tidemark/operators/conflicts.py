"""Concurrency and recovery as DataFrames: write-write conflicts, read-write edges, the log of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def write_conflicts(staged: DataFrame, log: DataFrame) -> DataFrame:
    """Staged rows (key columns, snapshot) that a commit after their snapshot wrote first."""
    newest = log.groupBy(*KEY).agg(F.max("commit_version").alias("newest"))
    return staged.join(newest, list(KEY)).where(F.col("newest") > F.col("snapshot"))


def rw_edges(ops: DataFrame) -> DataFrame:
    """Edges (reader, writer): the writer changed what the reader read, and they ran at the same time.

    ``ops``: txn, key, is_write, begin, finish. Distinct reads and writes are joined on the key and on pieces of time
    as long as the longest transaction, of which each has two at most: a key that all read and write is dealt over the
    pieces, and gives pairs of neighbours in time alone.
    """
    span = ops.agg(F.greatest(F.max(F.col("finish") - F.col("begin")), F.lit(1)).alias("w")).first().w or 1
    pieces = lambda x: F.explode(F.sequence(F.floor(F.col(f"{x}b") / span), F.floor(F.col(f"{x}f") / span))).alias("piece")
    side = lambda write, name, x: ops.where(F.col("is_write") == write).select("key", F.col("txn").alias(name), F.col("begin").alias(f"{x}b"), F.col("finish").alias(f"{x}f")).distinct().select("*", pieces(x))
    met = side(False, "reader", "r").join(side(True, "writer", "w"), ["key", "piece"])
    return met.where("reader <> writer and rb < wf and wb < rf").select("reader", "writer").distinct()


def dangerous_pairs(ops: DataFrame) -> DataFrame:
    """Pairs of transactions (a < b) that each read what the other wrote."""
    a, b = F.least("reader", "writer").alias("a"), F.greatest("reader", "writer").alias("b")
    return rw_edges(ops).groupBy(a, b).agg(F.count("*").alias("ways")).where("ways = 2").select("a", "b")


def transaction_status(wal: DataFrame) -> DataFrame:
    """Last status of each transaction of a log (seq, txn_id, kind): begin and stage never override another."""
    status = F.when(F.col("kind").isin("begin", "stage"), "active").otherwise(F.col("kind"))
    place = F.struct((~F.col("kind").isin("begin", "stage")).cast("int"), F.col("seq"))
    return wal.where("txn_id is not null").groupBy("txn_id").agg(F.max_by(status, place).alias("status"))


def recovery_actions(wal: DataFrame, log: DataFrame) -> DataFrame:
    """(txn_id, status, action): what a restart does. ``wal`` rows of kind stage carry the keys.

    Finished ones are skipped, active ones aborted; one that was committing is completed if each of its keys is in
    the log under it, else aborted.
    """
    status = transaction_status(wal)
    keys = wal.where("kind = 'stage'").select("txn_id", "key").distinct()
    done = log.select("txn_id", F.concat_ws("/", *KEY).alias("key"), F.lit(1).alias("there")).distinct()
    per = keys.join(done, ["txn_id", "key"], "left").groupBy("txn_id").agg(F.count("*").alias("n_keys"), F.count("there").alias("n_there"))
    action = F.when(F.col("status").isin("committed", "aborted"), "skip").when(F.col("status") == "active", "abort").when((F.col("n_keys") > 0) & (F.col("n_keys") == F.col("n_there")), "complete").otherwise("abort")
    return status.join(per, "txn_id", "left").select("txn_id", "status", action.alias("action"))


def stale(transactions: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """Active transactions without a heartbeat for longer than the timeout."""
    return transactions.where((F.col("status") == "active") & (F.col("heartbeat_ms") < now_ms - timeout_ms))
