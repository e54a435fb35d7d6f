"""Exact top-k by inner product: columnar branch and bound.

Vectors are stored by dimension in blocks of ``ROWS`` candidates. For a query, the sum over the first ``STEP``
dimensions is made for a whole block; a candidate stays only if that, plus the product of the norms of what is
left of both vectors (no inner product of the rest is larger), reaches the query's k-th best so far. Survivors
are compacted and the next dimensions follow. All sums are of 64-bit whole numbers; bounds are rounded up.

Queries are a stated set, taken in blocks of at most ``QUERIES``, so what goes to executors is bounded; every
block meets all candidates where they are. A task sends its own best k of each query, and a window
over (query, task group) and then over the query keeps k of them.

Defined cases: vectors that are null, empty or hold null or non-finite numbers take no part. Ties go to the
smaller id. Rows without an id take no part. A repeated row counts as often as it occurs among candidates, never
for its own id; a query id on several rows asks once, with the row that sorts first. Vectors of another length
than the query's are no candidates. Where the product of two vectors' norms reaches 2**62 a score might not fit into
64 bits, and the job fails with an error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, STEP, ROWS, QUERIES = 10, 16, 4096, 4096

#: Bound on the product of two vectors' norms, below which sums of 64-bit numbers are exact.
MOST_SCORE = 2.0**62


def whole(vector: Column) -> Column:
    """floor(1024 x) of each component as long, or null if the vector can't take part."""
    bad = vector.isNull() | (F.size(vector) == 0) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(1024.0) * x.cast("double"))))


def _rest(v: np.ndarray) -> np.ndarray:
    """Norm of what is left of each vector before each step: [step, vector]."""
    squares = (v.astype(np.float64) ** 2).cumsum(axis=0)
    done = [np.zeros(v.shape[1]), *squares[STEP - 1 :: STEP]]
    return np.sqrt(np.maximum(squares[-1] - np.array(done), 0)) * (1 + 1e-9)


def search(ids: np.ndarray, columns: np.ndarray, queries: tuple[np.ndarray, np.ndarray], best: dict[int, tuple[np.ndarray, np.ndarray]], k: int = K) -> None:
    """Meet a block of candidates (columns[dimension, candidate]) with all queries of their length; updates ``best``."""
    rest = _rest(columns)
    q_ids, q = queries
    q_rest = _rest(q)
    for n in range(len(q_ids)):
        scores, found = best.get(n, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        floor = scores[-1] if len(scores) == k else None
        if len(ids) and rest[0].max() * q_rest[0, n] >= MOST_SCORE:
            raise OverflowError(f"the inner products of vector {q_ids[n]} don't fit into 64 bits")
        live, part = np.flatnonzero(ids != q_ids[n]), None
        for step, at in enumerate(range(0, len(q), STEP)):
            block = columns[at : at + STEP]
            more = q[at : at + STEP, n] @ (block if part is None else block[:, live])
            part = more[live] if part is None else part + more
            if floor is not None:
                left = np.ceil(rest[step + 1, live] * q_rest[step + 1, n]) if step + 1 < len(rest) else 0
                stay = part + left >= floor
                live, part = live[stay], part[stay]
                if not len(live):
                    break
        if len(live):
            scores, found = np.append(scores, part), np.append(found, ids[live])
            if len(scores) > 4 * k:
                near = scores >= np.partition(scores, -k)[-k]
                scores, found = scores[near], found[near]
            order = np.lexsort((found, -scores))[:k]
            best[n] = (scores[order], found[order])


def _nearest(candidates: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's best k for a block of queries."""
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sorted({len(v) for _, v in queries}):
        own = [x for x in queries if len(x[1]) == size]
        by[size] = (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64).T.copy())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {size: {} for size in by}
        for batch in batches:
            for part in common.slices(batch, ROWS):
                vectors, ids = part.column(1), part.column(0).to_numpy()
                sizes = np.asarray(vectors.value_lengths())
                flat, starts = vectors.flatten().to_numpy(), np.cumsum(np.append(0, sizes))[:-1]
                for size, queries in by.items():
                    rows = np.flatnonzero(sizes == size)
                    if len(rows):
                        columns = np.ascontiguousarray(flat[starts[rows][:, None] + np.arange(size)].T)
                        search(ids[rows], columns, queries, best[size], k)
        for size, found in best.items():
            for n, (scores, ids) in found.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), by[size][0][n])), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(meet, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of ``vectors`` where ``asks`` holds, against all rows."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.select("vec_id", whole(F.col("v")).alias("v"), "asks").where("vec_id is not null and v is not null")
    stated = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    total = stated.count()
    parts = -(-total // QUERIES) or 1
    out = None
    for part in range(parts):  # blocks by hash: one pass over all candidates for each
        block = stated if parts == 1 else stated.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
        found = _nearest(rows.select("vec_id", "v"), [(x.vec_id, x.v) for x in block.collect()], k)
        found = common.cut(found) if parts > 1 else found  # the driver holds one block
        out = found if out is None else out.unionByName(found)
    # a query's rows first meet by group of tasks, so that many tasks don't all send to one
    order = (F.desc("score"), "vec_id")
    near = out.withColumn("group", F.spark_partition_id() % 64)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "group").orderBy(*order))).where(F.col("r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each hundredth vector."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
