"""Centroid clustering of quantised vectors by weighted deduplication.

Equal quantised vectors are grouped with their multiplicities, and Lloyd's rounds run on the distinct ones: each task
assigns its vectors to the nearest centroid and adds up weighted integer sums, of which it returns one row for each
centroid and component.  All arithmetic is on whole numbers, so the result does not depend on how rows are dealt.  The
assignments of the distinct vectors are joined back to the vec_ids at the end; equal vectors that hold a third of all
rows are a skewed join there, whose large side adaptive execution splits.

What reaches the driver and every task is the centroids: ``k`` times ``dims`` numbers, whatever the input.

Defined results: a vector takes part if it has ``dims`` components, none null or non-finite, and none beyond ``LARGEST``
when quantised, as the squared distance would leave 64 bits; others give no row.  Repeated rows are vectors each.  A
vec_id that is null takes part, but begins no centroid.  Where vectors that tie by the hash of their vec_id begin
centroids, the smaller vector comes first.  With fewer vectors than ``k`` there are fewer centroids; an empty table
gives an empty result.  Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import small
from .tables import cut, in_arrow, table

K, DIMS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
LARGEST = 1 << 26
#: Rows whose distances to all centroids a task holds at a time.
ROWS = 1024


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): whole numbers below each component times ``scale``."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    sound = F.forall(scaled, lambda x: F.coalesce(x.between(-LARGEST, LARGEST), F.lit(False)))  # NaN is above all numbers
    rows = vectors.select("vec_id", F.when((F.size("embedding") == dims) & sound, F.transform(scaled, lambda x: F.floor(x).cast("int"))).alias("q"))
    return rows.where("q is not null")


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors whose vec_ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.where("vec_id is not null").withColumn("h", order).orderBy("h", "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in chosen], np.int64)


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smallest, if several are) and the squared distance."""
    best, distance = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for c, centre in enumerate(centroids):
        apart = x - centre
        d = np.einsum("ij,ij->i", apart, apart)
        closer = d < distance
        best[closer], distance[closer] = c, d[closer]
    return best, distance


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, n, cluster, distance) of distinct vectors and their multiplicities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, ROWS):
            best, distance = nearest(_vectors(batch, 0), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["q", "n", "cluster", "distance"])

    return in_arrow(distinct.select("q", "n"), run, "q array<int>, n long, cluster int, distance long")


def round_of_lloyd(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)  # the last is the count
        for batch in small(batches, ROWS):
            x, n = _vectors(batch, 0), batch.column(1).to_numpy(zero_copy_only=False)
            best, _ = nearest(x, centroids)
            weights = (best == np.arange(k)[:, None]) * n
            sums += weights @ np.column_stack([x, np.ones_like(n)])
        held = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = in_arrow(distinct.select("q", "n"), run, "cluster int, sums array<long>")
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("part").alias("total"))
    total = {(r["cluster"], r["at"]): r["total"] for r in sums.collect()}
    out = centroids.copy()
    for c in range(k):
        if n := total.get((c, dims)):
            out[c] = [total[c, i] // n for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, q, multiplicity, cluster, distance, cluster_inertia, inertia, centroid) of each vector that takes part:
    its quantised form, how many rows share it, its centroid's number and components, the squared distance to it, and
    the sums of distances over the cluster and over all."""
    rows = quantised(vectors, dims, scale)
    distinct = cut(rows.groupBy("q").agg(F.count("*").alias("n")))
    centroids = first_centroids(rows, k, seed).reshape(-1, dims)
    for _ in range(rounds):
        if len(centroids):
            centroids = round_of_lloyd(distinct, centroids)
    found = cut(assigned(distinct, centroids))
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("total")).collect()}
    facts = rows.sparkSession.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), m) for c, m in enumerate(centroids.tolist())], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    known = found.join(F.broadcast(facts), "cluster")  # of ``k`` rows
    return rows.join(known, "q").select("vec_id", "q", F.col("n").alias("multiplicity"), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("centroid_sha256"))


def oracle(k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in SQL, without grouping equal vectors."""
    steps = [f"""
v AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs({scale} * CAST(x AS DOUBLE)) <= {LARGEST})) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS INTEGER) AS c, q FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]  # fmt: skip
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT)))"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, v.vec_id, v.q, min({{'d': CAST({apart} AS BIGINT), 'c': c.c}}) AS best FROM v, c{r} AS c GROUP BY ALL)")
        if r < rounds:
            steps.append(f"""
p{r} AS (SELECT best.c AS c, generate_subscripts(q, 1) AS pos, unnest(q) AS x FROM a{r}),
m{r} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM p{r} GROUP BY c, pos),
n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS q FROM m{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN n{r} USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.best.c AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.best.c = c.c"""
