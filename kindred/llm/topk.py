"""Exact top-k inner products by block-at-a-time pruning.

Rows are packed into parts, each a series of blocks of consecutive rows with
the largest and smallest component of every dimension. For a query, a block's
bound is the sum over dimensions of what the extreme components would give;
blocks are scored through their forward index from the highest bound down until
the bounds fall below the k-th score found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, table, written

BLOCK = 256


def _pack(rows: int):
    """Up to ``rows`` vectors of a partition in one row: ids and components, int64 each."""

    def run(batches):
        ids, vectors = [], []

        def made():
            wide = max(len(v) for v in vectors)
            m = np.zeros((len(vectors), wide), np.int64)
            for k, v in enumerate(vectors):
                m[k, : len(v)] = v
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())], ["ids", "data", "n"])

        for b in batches:
            values = b.column("v")
            flat, offsets = np.asarray(values.flatten()), np.asarray(values.offsets)
            offsets = offsets - offsets[0]
            for k, i in enumerate(b.column("vec_id").to_pylist()):
                ids.append(i)
                vectors.append(flat[offsets[k] : offsets[k + 1]])
                if len(ids) == rows:
                    yield made()
                    ids, vectors = [], []
        if ids:
            yield made()

    return run


def _product(a: np.ndarray, b: np.ndarray, clip: bool = False) -> np.ndarray:
    """a @ b.T in whole numbers: floating point only where it is exact. What does not fit a long is an OverflowError, or the nearest long if ``clip``."""
    most = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    got = a.astype(object) @ b.T.astype(object)
    return (np.clip(got, 1 - 2**63, 2**63 - 1) if clip else got).astype(np.int64)


def search_part(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query row, candidate id and score of the k best candidates in one part, and the number of (query, block) pairs scored."""
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(data, starts), np.minimum.reduceat(data, starts)
    bound = _product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1), np.concatenate([top, low], 1), True)
    order = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    best = np.full((len(queries), k), none)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    scored = 0
    for r in range(len(starts)):
        at = order[:, r]
        active = np.flatnonzero(bound[np.arange(len(queries)), at] >= best[:, -1])  # equal: a tie may have a smaller id
        if not len(active):
            break
        for j in np.unique(at[active]):
            q = active[at[active] == j]
            own = ids[starts[j] : starts[j] + block]
            s = _product(queries[q], data[starts[j] : starts[j] + block])
            s[query_ids[q][:, None] == own[None, :]] = none
            scored += len(q)
            cand = np.concatenate([best[q], s], 1)
            name = np.concatenate([who[q], np.broadcast_to(own, s.shape)], 1)
            pick = np.lexsort((name, -np.maximum(cand, none + 1)), axis=1)[:, :k]
            best[q], who[q] = np.take_along_axis(cand, pick, 1), np.take_along_axis(name, pick, 1)
    row, col = np.nonzero(best != none)
    return row, who[row, col], best[row, col], scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, part_rows: int = 16_384, query_rows: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query with all ``vectors`` but its own.

    Both have vec_id and v, an array of whole numbers; a shorter array counts
    as padded with zeros. Rows with a null id, null array or null component
    take no part. Ties go to the smaller vec_id; repeated rows are candidates
    each; of queries with one id the smallest array counts. Each part of the
    rows meets each chunk of the queries once, in a task of its own.
    """
    ship(vectors.sparkSession)
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    vectors = vectors.select("vec_id", "v").where(good)
    queries = queries.select("vec_id", "v").where(good).groupBy("vec_id").agg(F.min("v").alias("v"))
    code = F.expr("aggregate(transform(slice(v, 1, 16), x -> if(x > 0, 1, 0)), 0, (a, x) -> a * 2 + x)")  # rows of like signs share blocks: tighter bounds

    def packed(df: DataFrame, rows: int) -> DataFrame:
        n = -(-df.count() // rows)
        df = df.withColumn("code", code).repartition(max(n, 1), F.xxhash64("vec_id")).sortWithinPartitions("code", "vec_id").select("vec_id", "v")
        return written(written(df.mapInArrow(_pack(rows), "ids binary, data binary, n int")).withColumn("part", F.monotonically_increasing_id()))

    parts, chunks = packed(vectors, part_rows), packed(queries, query_rows)
    units = parts.select("part").crossJoin(F.broadcast(chunks.select(F.col("part").alias("chunk"))))  # names only: one for each task to come
    units = units.join(parts, "part").join(chunks.select(F.col("part").alias("chunk"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "chunk")
    units = units.repartition(F.col("part"), F.col("chunk"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                data, q = np.frombuffer(row["data"], np.int64).reshape(len(ids), -1), np.frombuffer(row["q_data"], np.int64).reshape(len(q_ids), -1)
                wide = max(data.shape[1], q.shape[1])
                data, q = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (data, q))
                for lo in range(0, len(q), 512):
                    at, who, score, _ = search_part(q[lo : lo + 512], q_ids[lo : lo + 512], data, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[lo : lo + 512][at]), pa.array(who), pa.array(score)], ["query_id", "vec_id", "score"])

    found = units.select("ids", "data", "q_ids", "q_data").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(x: Column) -> Column:
    """Floor as a long; a number beyond longs is an error."""
    return F.when((x >= -(2.0**63)) & (x < 2.0**63), F.floor(x)).otherwise(F.raise_error(F.lit("a component times 256 does not fit a long")).cast("long"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * 256).alias("x"))
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))  # also drops NaN, which is above every number
    rows = rows.select("vec_id", F.transform("x", whole).alias("v"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


ORACLE_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
