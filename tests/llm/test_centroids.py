"""Centroid clustering against plain rounds over all vectors, with ties, copies, odd and huge vectors."""

from hashlib import sha256

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from verdigris.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, scale=64, seed=1):
    """Lloyd in Python's whole numbers over (vec_id, q)."""
    centres = [q for _, q in sorted((sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in rows if i is not None)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((apart(q, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in rows:
            groups.setdefault(near(q)[1], []).append(q)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    best = [(i, *near(q)) for i, q in rows]
    return sorted(((i, c, d, sum(e for _, e, o in best if o == c), sum(e for _, e, _ in best), centres[c]) for i, d, c in best), key=repr)


def got(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_against_plain_rounds(spark, rounds):
    r = np.random.default_rng(rounds)
    spots = r.integers(-3, 3, (40, 6)) / 8  # many ties and equal vectors
    rows = [(i, spots[r.integers(0, 40)].tolist()) for i in range(400)] + [(900, spots[0].tolist())] * 200 + [(None, [0.1] * 6)]
    df = spark.createDataFrame([(i, q, None) for i, q in rows], SCHEMA).repartition(5)
    quantised = [(i, np.floor(np.array(q, np.float32).astype(float) * 64).astype(int).tolist()) for i, q in rows]
    assert got(centroids.cluster(df, k=7, dims=6, rounds=rounds)) == plain(quantised, 7, rounds)


def test_a_vector_that_a_third_of_all_rows_share(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    hot = vectors.limit(1).select(F.explode(F.sequence(F.lit(10_000), F.lit(10_300))).alias("vec_id"), "embedding", "label")
    out = centroids.cluster(vectors.unionByName(hot))
    rows = out.collect()
    assert len(rows) == vectors.count() + 301
    assert max(r["multiplicity"] for r in rows) >= 302
    assert sum(r["distance"] for r in rows) == rows[0]["inertia"]


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [2, 0], [1, 0]])
    best, distance = centroids.nearest(x, np.array([[2, 0], [0, 0], [2, 0]]))
    assert best.tolist() == [1, 0, 0] and distance.tolist() == [0, 0, 1]


def test_floor_of_negative_means(spark):
    df = spark.createDataFrame([(1, [-1 / 64.0], 0), (2, [-2 / 64.0], 0)], SCHEMA)
    rows = centroids.cluster(df, k=1, dims=1, rounds=1).collect()
    assert {tuple(r["centroid"]) for r in rows} == {(-2,)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    values = [(1, None), (2, []), (3, [0.5]), (4, [0.5, None]), (5, [0.5, nan]), (6, [inf, 0.0]), (7, [-inf, 0.0]), (8, [3e38, 0.0]), (9, [0.5, 0.25]), (9, [0.5, 0.25]), (10, [-0.0, 0.0]), (None, [0.5, 0.25]), (11, [2.0**19, -(2.0**20)])]
    df = spark.createDataFrame([(i, v, None) for i, v in values], SCHEMA).withColumns({c: F.lit("x") for c in ("q", "n", "cluster", "distance", "h", "centroid", "inertia", "dotted.name")})
    rows = centroids.cluster(df, dims=2).collect()
    assert sorted((str(r["vec_id"]), list(r["q"])) for r in rows) == [("10", [0, 0]), ("11", [2**25, -(2**26)]), ("9", [32, 16]), ("9", [32, 16]), ("None", [32, 16])]
    assert centroids.cluster(df.limit(0)).count() == 0
    assert centroids.cluster(df.where("vec_id is null"), dims=2).count() == 0  # nothing to begin with

