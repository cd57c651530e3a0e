"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one for each shard.

Vectors get one more component that turns largest inner product into least distance.  In a shard, greedy beam
searches from fixed entries propose neighbours of each point; pruning walks them from near to far and drops those
that a kept one covers (``ALPHA`` times nearer to it), which keeps edges diverse; edges are made mutual and pruned
again.  A beam search then takes the queries through every shard, and the exact scores decide.

Each shard measures its own recall against brute force on ``SAMPLE`` of the queries when it is built: its beam is
doubled from ``SEARCH_BEAM`` until recall reaches ``RECALL``; a shard that no beam up to ``MOST_BEAM`` can serve, or that
has under twice as many points, is scanned instead, which is exact.

Equal vectors are one point: it answers with its ``K + 1`` smallest ids, which is exact, however many copies.  Shards
hold about ``SHARD_ROWS`` points by a hash of their id.  A search task loads its shard once and streams all queries past
it in Arrow batches; work and rows moved grow with queries times shards.

Defined results: rows without id, and vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; ids that occur twice stand as they are (each row is a candidate); with fewer
candidates than ``K`` all are returned; ties go to the smaller id; components of any finite size are fine (a score that
overflows is infinite); an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, table

K = 20
QUERY_EVERY = 20
SHARD_ROWS = 16_384
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
#: The widest beam; beyond it a scan of the shard costs less.
MOST_BEAM = 512
#: Of squared distances.
ALPHA = 1.44
ENTRIES = 8
EXPAND = 4
#: Queries on which each shard measures its recall, and the recall that it asks for.
SAMPLE = 64
RECALL = 0.95


def lifted(x: np.ndarray) -> np.ndarray:
    """Unit-free: the nearest point to (q, 0) is the one with the largest inner product with q."""
    x = x.astype(np.float64)
    x = x / max(np.abs(x).max(), 5e-324)  # before squaring, which could overflow
    x = x / max(np.sqrt(np.einsum("ij,ij->i", x, x).max()), 1e-300)
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
    return np.hstack([x, rest[:, None]]).astype(np.float32)


def directions(q: np.ndarray) -> np.ndarray:
    """Queries in the space of ``lifted`` points, at unit length."""
    q = q / np.abs(q).max(1, keepdims=True)
    return np.hstack([q / np.sqrt(np.square(q).sum(1, keepdims=True)), np.zeros((len(q), 1))]).astype(np.float32)


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """For each row of q, the ``width`` nearest points met, nearest first; -1 fills up."""
    b, w = len(q), graph.shape[1]
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, len(points) + 1), bool)
    seen[:, -1] = True  # stands for -1
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)

    def take(ids, dist, done, more):
        more = np.sort(more, 1)
        fresh = ~seen[rows, more]
        fresh[:, 1:] &= more[:, 1:] != more[:, :-1]
        seen[rows, more] = True
        d = norms[more] - 2 * np.einsum("bwd,bd->bw", points[more], q)
        d = np.where(fresh, d, np.inf)
        every = np.hstack([dist, d])
        best = np.argsort(every, 1, kind="stable")[:, :width]
        dist = np.take_along_axis(every, best, 1)
        ids = np.take_along_axis(np.hstack([ids, more]), best, 1)
        done = np.take_along_axis(np.hstack([done, ~fresh]), best, 1)
        return np.where(np.isfinite(dist), ids, -1), dist, done | ~np.isfinite(dist)

    ids, dist, done = take(ids, dist, done, np.broadcast_to(entries, (b, len(entries))))
    while True:
        rank = np.cumsum(~done, 1)
        pick = ~done & (rank <= EXPAND)
        active = np.flatnonzero(pick.any(1))
        if not len(active):
            return ids
        next_ids = np.full((b, EXPAND), -1, np.int64)
        r, c = np.nonzero(pick)
        next_ids[r, rank[r, c] - 1] = ids[r, c]
        done |= pick
        more = graph[next_ids].reshape(b, EXPAND * w)
        more = np.where(np.repeat(next_ids >= 0, w, 1), more, -1)
        ids, dist, done = take(ids, dist, done, more)


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each point in ``of``, at most ``degree`` of its candidates (-1: none), diverse ones, nearest first."""
    b, c = candidates.shape
    order = np.sort(candidates, 1)
    valid = (order >= 0) & (order != of[:, None])
    valid[:, 1:] &= order[:, 1:] != order[:, :-1]
    x = points[order]
    d = np.square(x - points[of][:, None]).sum(2)
    d[~valid] = np.inf
    rank = np.argsort(d, 1, kind="stable")
    order, d = np.take_along_axis(order, rank, 1), np.take_along_axis(d, rank, 1)
    x = np.take_along_axis(x, rank[:, :, None], 1)
    n2 = np.square(x).sum(2)
    between = n2[:, :, None] + n2[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    open_ = np.isfinite(d)
    out = np.full((b, degree), -1, np.int64)
    rows = np.arange(b)
    for k in range(degree):
        first = np.argmax(open_, 1)
        any_ = open_[rows, first]
        if not any_.any():
            break
        out[any_, k] = order[rows, first][any_]
        open_ &= ~((alpha * between[rows, first] <= d) & any_[:, None])
        open_[rows[any_], first[any_]] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) of a shard; -1 fills up rows of the graph."""
    m = len(points)
    rng = np.random.default_rng(5)
    norms = np.append(np.square(points).sum(1), np.float32(0))
    padded = np.vstack([points, np.zeros((1, points.shape[1]), np.float32)])
    centre = int(np.argmin(np.square(points - points.mean(0)).sum(1)))
    entries = np.unique(np.append(rng.integers(0, m, ENTRIES - 1), centre))
    wide = 2 * degree
    graph = np.full((m + 1, wide), -1, np.int64)
    if m <= degree:
        graph[:m, :m] = np.arange(m)
        return graph, entries
    graph[:m, : degree // 2] = rng.integers(0, m, (m, degree // 2))
    step = max(1, min(256, (1 << 26) // m))
    for a in (1.0, alpha):
        order = rng.permutation(m)
        for lo in range(0, m, step):
            of = order[lo : lo + step]
            found = beam_search(padded, norms, graph, entries, points[of], beam)
            graph[of] = -1
            new = robust_prune(padded, of, found, a, degree)
            graph[of, :degree] = new
            src, dst = np.repeat(of, degree), new.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            _add(padded, graph, dst, src, a, degree)
    crowded = np.flatnonzero((graph[:m] >= 0).sum(1) > degree)
    for lo in range(0, len(crowded), 1024):
        of = crowded[lo : lo + 1024]
        kept = robust_prune(padded, of, graph[of], alpha, degree)
        graph[of] = -1
        graph[of, :degree] = kept
    return graph[:, :degree].copy(), entries


def _add(points: np.ndarray, graph: np.ndarray, to: np.ndarray, edge: np.ndarray, alpha: float, degree: int) -> None:
    """Adds edges to -> edge; rows that overflow are pruned."""
    order = np.argsort(to, kind="stable")
    to, edge = to[order], edge[order]
    node, first, count = np.unique(to, return_index=True, return_counts=True)
    wide = graph.shape[1]
    width = int(count.max())
    more = np.full((len(node), width), -1, np.int64)
    more[np.repeat(np.arange(len(node)), count), np.arange(len(to)) - np.repeat(first, count)] = edge
    every = np.hstack([graph[node], more])
    every = -np.sort(-every, 1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    size = (every >= 0).sum(1)
    fits = size <= wide
    packed = -np.sort(-every[fits], 1)
    graph[node[fits]] = packed[:, :wide]
    over = np.flatnonzero(~fits)
    for lo in range(0, len(over), 512):
        at = over[lo : lo + 512]
        kept = robust_prune(points, node[at], every[at], alpha, degree)
        graph[node[at]] = -1
        graph[node[at], :degree] = kept


class Shard:
    """Points of a shard with their graph; ``beam`` 0: they are scanned."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, graph: np.ndarray, entries: np.ndarray, beam: int):
        self.ids, self.raw, self.graph, self.entries, self.beam = ids, raw, graph, entries, beam
        self.scaled: np.ndarray | None = None
        points = lifted(raw)
        self.norms = np.append(np.square(points).sum(1), np.float32(0))
        self.points = np.vstack([points, np.zeros((1, points.shape[1]), np.float32)])

    def best(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, point, score) of the ``k`` best that are found for each of some queries, by row, score and id."""
        if beam:
            found = beam_search(self.points, self.norms, self.graph, self.entries, directions(q), max(beam, k))
            r, c = np.nonzero(found >= 0)
            at = found[r, c]
        else:
            if self.scaled is None:
                self.scaled = self.raw / np.abs(self.raw).max()
            score = (q / np.abs(q).max(1, keepdims=True)) @ self.scaled.T
            nth = min(k, len(self.ids)) - 1
            last = -np.partition(-score, nth, axis=1)[:, nth] - 1e-9 * np.abs(score).max(1)
            r, at = np.nonzero(score >= last[:, None])
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("ij,ij->i", self.raw[at], q[r])
        order = np.lexsort((self.ids[at], -score, r))
        place = np.arange(len(r)) - np.searchsorted(r[order], r[order])
        order = order[place < k]
        return r[order], at[order], score[order]

    def tune(self, sample: np.ndarray, k: int, beam: int) -> None:
        """Sets the least beam that reaches ``RECALL`` on the sample, or 0."""
        self.beam = 0
        if not len(sample):
            return
        r, at, _ = self.best(sample, k, 0)
        truth = r * len(self.ids) + at
        while beam <= min(MOST_BEAM, len(self.ids) // 2):
            r, at, _ = self.best(sample, k, beam)
            if np.isin(truth, r * len(self.ids) + at).mean() >= RECALL:
                self.beam = beam
                return
            beam *= 2

    def pack(self) -> bytes:
        head = np.array([len(self.ids), self.raw.shape[1], self.graph.shape[1], len(self.entries), self.beam], np.int64)
        return b"".join(x.tobytes() for x in (head, self.ids, self.raw, self.entries.astype(np.int64), self.graph.astype(np.int32)))

    @staticmethod
    def unpack(blob: bytes) -> Shard:
        n, width, degree, entries, beam = np.frombuffer(blob, np.int64, 5).tolist()
        at, parts = 40, []
        for kind, shape in ((np.int64, (n,)), (np.float64, (n, width)), (np.int64, (entries,)), (np.int32, (n + 1, degree))):
            size = int(np.prod(shape))
            parts.append(np.frombuffer(blob, kind, size, at).reshape(shape))
            at += size * np.dtype(kind).itemsize
        ids, raw, first, graph = parts
        return Shard(ids, raw, graph.astype(np.int64), first, beam)


def _build_shard(sample: np.ndarray, k: int, beam: int):
    """For the rows of one shard, in any number of batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [p for p in parts if len(p)]
        if not found:
            return
        group = pd.concat(found).sort_values("vec_id")
        raw = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        shard = Shard(group["vec_id"].to_numpy(np.int64), raw, *build(lifted(raw)), 0)
        shard.tune(sample, k, beam)
        yield pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "packed": [shard.pack()], "beam": [shard.beam]})

    return run


def _search(k: int):
    """Rows of one shard after the other: first the packed shard, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            packed, ids, vectors = batch.column(0), batch.column(1), batch.column(2)
            edges = [*np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            lo = 0
            for edge in edges:
                if edge > lo and shard is not None:
                    part = vectors.slice(lo, edge - lo)
                    q = part.flatten().to_numpy(zero_copy_only=False).reshape(edge - lo, -1)
                    qid = ids.slice(lo, edge - lo).to_numpy(zero_copy_only=False)
                    step = max(1, min(256, (1 << 24) // len(shard.ids)))
                    for a in range(0, len(q), step):
                        r, at, score = shard.best(q[a : a + step], k, shard.beam)
                        yield pa.RecordBatch.from_arrays([pa.array(qid[a + r]), pa.array(shard.ids[at]), pa.array(score)], ["query_id", "vec_id", "score"])
                if edge < batch.num_rows:
                    shard = Shard.unpack(packed[edge].as_py())
                lo = edge + 1

    return run


def nearest(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query, a row whose id ``query_every`` divides."""
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    src = src.where(sound)
    common = src.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    src = src.where(F.size("embedding") == (common[0] if common else -1)).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    keyed = src.withColumn("key", F.xxhash64("embedding"))
    # The K + 1 smallest ids of each distinct vector: the rank limit is applied in every task before the shuffle.
    order = Window.partitionBy("key", "embedding").orderBy("vec_id")
    members = cut(keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1))
    points = members.where("place = 1").select("vec_id", "embedding", "key")
    shards = max(1, -(-points.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    asked = src.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    sample = [r[0] for r in asked.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).select("embedding").collect()]
    index = points.select("vec_id", "embedding", shard.alias("shard")).repartitionById(shards, "shard")  # one task for each
    index = index.mapInPandas(_build_shard(np.array(sample, float), k + 1, beam), "shard int, packed binary, beam int")
    index = cut(index).select("shard", "packed", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("embedding"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("binary").alias("packed"), "query_id", "embedding")
    dealt = index.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("packed").isNull())
    hits = dealt.select("packed", "query_id", "embedding").mapInArrow(_search(k + 1), "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.distinct().withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= k + 1).drop("r")
    key = points.select(F.col("vec_id").alias("rep"), "key", "embedding")
    ids = members.select("key", "embedding", F.col("vec_id").alias("member"), "place").where("place > 1").join(key, ["key", "embedding"]).select("rep", "member")
    every = hits.unionByName(hits.join(ids, F.col("vec_id") == F.col("rep")).select("query_id", F.col("member").alias("vec_id"), "score"))
    every = every.where("query_id <> vec_id")
    ranked = every.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
