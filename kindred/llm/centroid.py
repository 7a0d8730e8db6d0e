"""Centroid clustering in exact integers behind a float32 screen.

A matrix product in float32 gives every (vector, centroid) pair an interval that
surely holds the true value; where one centroid's interval lies below all others
it is the nearest, and where intervals overlap the pairs concerned are computed
again in integers. Sums and means are integers throughout, so that neither the
partitioning nor the order of the rows changes a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share, table, written

SCALE, FITS, SCREENED = 256, 2**25, 2.0**60  # units of a component; int64 is exact up to FITS; float32 does not overflow up to SCREENED
LIMB = 40  # bits of the digits that sums are passed on in
LONGEST = 2**63 - 1


def integers(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors, floor(256 * x) as integral doubles, of the rows with ``dims`` finite components."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
    ids, flat = ids.filter(right), lists.filter(right).flatten()
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan), dtype=np.float64).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(x * SCALE)
    finite = np.isfinite(y).all(1)
    return ids.filter(pa.array(finite)), y[finite]


class Centroids:
    """Centroids as exact integers, and what screening needs of them; at most some hundred, so small enough to broadcast."""

    def __init__(self, rows: list[list[int]], dims: int):
        self.exact = np.array(rows, dtype=object).reshape(-1, dims)
        self.largest = np.array([max(abs(v) for v in r) for r in rows], dtype=object)
        self.plain = np.array([m <= FITS for m in self.largest], dtype=bool)
        self.int64 = np.where(self.plain[:, None], self.exact, 0).astype(np.int64)
        screened = np.array([m <= SCREENED for m in self.largest], dtype=bool)
        inside = np.where(screened[:, None], self.exact, 0).astype(np.float64)
        self.single = inside.astype(np.float32)
        self.norm = np.sqrt((inside**2).sum(1))
        self.square = np.where(screened, [float(sum(int(v) ** 2 for v in r)) if ok else 0.0 for r, ok in zip(rows, screened, strict=True)], 0.0)
        self.unscreened = ~screened

    def distance(self, y: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of y to centroids j: int64, or Python integers where those might not do."""
        plain = (np.abs(y) <= FITS).all(1) & self.plain[j]
        out = np.zeros(len(y), np.int64)
        d = y[plain].astype(np.int64) - self.int64[j[plain]]
        out[plain] = np.einsum("ij,ij->i", d, d)
        if not plain.all():
            out = out.astype(object)
            for r in np.flatnonzero(~plain):
                out[r] = sum((int(a) - b) ** 2 for a, b in zip(y[r], self.exact[j[r]], strict=True))
        return out

    def nearest(self, y: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row, the smallest of equally near ones."""
        # |fl(y.c) - y.c| <= ((1+u)^2 / (1 - dims u) - 1) |y||c| for any order of summation, u = 2^-24: rounding y and c to float32, then the product
        dims = y.shape[1]
        wide = (np.abs(y) > SCREENED).any(1)
        inside = np.where(wide[:, None], 0.0, y)
        dot = (inside.astype(np.float32) @ self.single.T).astype(np.float64)
        middle = self.square - 2 * dot
        error = (dims + 6) * 2.0**-24 * 2 * np.sqrt((inside**2).sum(1))[:, None] * self.norm + 2.0**-48 * (self.square + 2 * np.abs(dot))
        low, high = middle - error, middle + error
        low[:, self.unscreened], high[:, self.unscreened] = -np.inf, np.inf
        low[wide], high[wide] = -np.inf, np.inf
        best = np.argmin(low, 1)
        short = low <= high.min(1)[:, None]
        open_ = np.flatnonzero(short.sum(1) > 1)
        row, j = np.nonzero(short[open_])  # by row, then by number
        if len(row):
            d = self.distance(y[open_[row]], j)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(d, starts)[row]
            hit = np.flatnonzero(d == least)
            first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
            best[open_[row[first]]] = j[first]
        return best


def _sums(docs: DataFrame, shared, dims: int) -> list:
    """(cluster, limb, n, components' sums) of the vectors by nearest centroid: a few rows for each task, added up by cluster."""

    def run(batches):
        c = shared.value
        total, n = np.zeros(c.exact.shape, dtype=object), np.zeros(len(c.exact), np.int64)
        for b in batches:
            _, y = integers(b, dims)
            if not len(y):
                continue
            at = c.nearest(y)
            plain = (np.abs(y) <= FITS).all(1)
            part = np.zeros(c.exact.shape, np.int64)
            np.add.at(part, at[plain], y[plain].astype(np.int64))  # a batch's sums fit
            total += part
            for r in np.flatnonzero(~plain):
                total[at[r]] += np.array([int(v) for v in y[r]], dtype=object)
            n += np.bincount(at, minlength=len(n))
        rows, limb = [], 0
        while np.any(total != 0) or not limb:
            digit = np.vectorize(lambda v: (1 if v >= 0 else -1) * (abs(v) & ((1 << LIMB) - 1)), otypes=[object])(total)
            rows += [(int(k), limb, int(n[k]) if not limb else 0, [int(v) for v in digit[k]]) for k in np.flatnonzero(n)]
            total = np.vectorize(lambda v: (1 if v >= 0 else -1) * (abs(v) >> LIMB), otypes=[object])(total)
            limb += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["cluster", "limb", "n", "s"])

    got = docs.select("vec_id", "embedding").mapInArrow(run, "cluster int, limb int, n long, s array<long>")
    return got.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dims)]).alias("s")).collect()  # at most a row for each centroid and limb


def seeds(docs: DataFrame, k: int, dims: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids, ties by components."""

    def run(batches):
        for b in batches:
            ids, y = integers(b, dims)
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), dims).cast(pa.list_(pa.float64()))], ["vec_id", "y"])

    kept = docs.select("vec_id", "embedding").mapInArrow(run, "vec_id long, y array<double>")
    hashed = kept.withColumn("h", F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    return [[int(v) for v in r["y"]] for r in hashed.orderBy("h", "y").limit(k).collect()]  # k rows


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of the ``vectors`` (vec_id, embedding) with ``dims`` finite components.

    Null vectors, vectors of other lengths and those with a null, infinite or
    NaN component take no part and have no row. Repeated rows and ids are
    vectors of their own; a null id is hashed as empty text. Of equally near
    centroids the smaller number wins, of equal seed hashes the smaller vector.
    With fewer than k vectors there are as many centroids; an empty table has
    no rows. Components of any finite size are taken exactly; a distance or an
    inertia beyond the range of a long is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    docs = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    share(spark, None)  # executors need this package for the seeds as well
    now = seeds(docs, k, dims)
    if not now:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        shared = share(spark, Centroids(now, dims))
        total: dict[int, list[int]] = {}
        count: dict[int, int] = {}
        for r in _sums(docs, shared, dims):
            count[r["cluster"]] = count.get(r["cluster"], 0) + r["n"]
            total[r["cluster"]] = [a + (b << (LIMB * r["limb"])) for a, b in zip(total.get(r["cluster"], [0] * dims), r["s"], strict=True)]
        now = [[v // count[j] for v in total[j]] if count.get(j) else c for j, c in enumerate(now)]
        shared.unpersist()
    shared = share(spark, Centroids(now, dims))

    def run(batches):
        c = shared.value
        for b in batches:
            ids, y = integers(b, dims)
            at = c.nearest(y) if len(y) else np.zeros(0, np.int64)
            d = c.distance(y, at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array([int(v) if v <= LONGEST else None for v in d], pa.int64())], ["vec_id", "cluster", "distance"])

    found = written(docs.mapInArrow(run, "vec_id long, cluster int, distance long"))
    sums = found.groupBy("cluster").agg(F.count("*").alias("n"), F.count("distance").alias("m"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows

    def whole(rows) -> int | None:
        s = sum(int(r["s"] or 0) for r in rows)
        return s if s <= LONGEST and all(r["n"] == r["m"] for r in rows) else None

    every = whole(sums)
    facts = [(r["cluster"], whole([r]), every, hashlib.sha256(",".join(map(str, now[r["cluster"]])).encode()).hexdigest()) for r in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    near = f"""SELECT r, j, d FROM (SELECT v.r, c.j, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.y[i] - c.c[i]) * (v.y[i] - c.c[i]))) AS d FROM v CROSS JOIN {{c}} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1"""
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(c=f'c{n}')})")
        steps.append(
            f"""c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT j, list(q ORDER BY i) AS c FROM (SELECT j, i, (s - ((s % n) + n) % n) // n AS q FROM (
  SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT a.j, unnest(range({dims})) AS i, unnest(v.y) AS x FROM a{n} a JOIN v USING (r)) GROUP BY j, i)) GROUP BY j) m USING (j))"""
        )
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS y
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT CAST(r AS INTEGER) AS j, y AS c FROM v WHERE r < {k}), {', '.join(steps)}, f AS MATERIALIZED ({near.format(c=f'c{rounds}')})
SELECT v.vec_id, f.j AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM f JOIN v USING (r) JOIN c{rounds} c ON c.j = f.j"""


ORACLE_OP12 = _oracle()
