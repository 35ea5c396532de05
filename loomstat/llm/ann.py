"""Approximate nearest neighbours by learned partitions.

On a hashed sample (one vector in ``ONE_IN``, at least about ``SAMPLE`` and at most about ``MOST_SAMPLE``) the driver links each to
its nearest neighbours, cuts that graph into parts of nearly equal size, about ``PART_SAMPLE`` of the sample
in each (balanced means first, then moves along edges within the capacity), and trains a small network to
tell which parts a vector's neighbours are in. A fifth of the sample is held out of both: the network puts
every vector of the table in its most probable part, and sends a query to its most probable parts, as many
as keep the recall of the held-out vectors above ``RECALL``. There all vectors are compared, in tiles of
bounded size, so a part that is large, or one vector that is very common, is split over tasks and nothing
is left out.

Nearness is the inner product in double precision; ties go to the smaller vec_id. Vectors that are null,
zero, of another length than most, or hold null or non-finite components take no part, nor do null ids.
Rows of one vec_id count as one, the nearest; equal rows are dropped before tiles are made. A query has as many rows as there are candidates, up to k.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, shuffle_parts, written
from .tiles import packs

K = 20
SAMPLE = 6000
MOST_SAMPLE = 24_000
ONE_IN = 200
PART_SAMPLE = 200
RECALL = 0.96
LINKS = 12
#: Queries, and vectors that they are compared with, of a tile; a query is sent once for each block of the latter.
TILE_ROWS, BLOCK_ROWS = 4096, 16_384
SEED = 23


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row."""
    out = np.zeros((len(x), k), np.int64)
    for s in range(0, len(x), 1000):
        sim = x[s : s + 1000] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out[s : s + 1000] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 8) -> np.ndarray:
    """Part of each node of a neighbour graph; none holds more than (1 + slack) of its share."""
    rng = np.random.default_rng(SEED)
    n, room = len(x), int(np.ceil(len(x) / parts * (1 + slack)))
    centre = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(10):
        sim = x @ centre.T
        part[:] = -1
        left = np.full(parts, room)
        # Those that have most to lose choose first.
        best = np.partition(sim, -2, axis=1) if parts > 1 else sim
        for v in np.argsort(-(best[:, -1] - best[:, -2]) if parts > 1 else np.zeros(n)):
            for p in np.argsort(-sim[v]):
                if left[p]:
                    part[v], left[p] = p, left[p] - 1
                    break
        for p in range(parts):
            if (part == p).any():
                centre[p] = x[part == p].mean(0)
                centre[p] /= max(np.linalg.norm(centre[p]), 1e-12)
    back = [[] for _ in range(n)]
    for v, row in enumerate(near):
        for w in row:
            back[w].append(v)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[np.r_[near[v], np.array(back[v], np.int64)]], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != part[v])] = -1
            p = int(votes.argmax())
            if votes[p] > votes[part[v]]:
                size[part[v]] -= 1
                size[p] += 1
                part[v], moved = p, moved + 1
        if not moved:
            break
    return part


class Router:
    """A network from vectors to probabilities of parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 40, rate: float = 4e-3):
        rng = np.random.default_rng(SEED)
        self.scale = float(np.sqrt((x**2).mean())) or 1.0
        x = x / self.scale
        d, parts = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        first, second, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                a, b, c, e = self.w
                h = np.maximum(x[at] @ a + b, 0)
                z = h @ c + e
                z = np.exp(z - z.max(1, keepdims=True))
                g = (z / z.sum(1, keepdims=True) - target[at]) / len(at)
                dh = (g @ c.T) * (h > 0)
                step += 1
                for k, grad in enumerate((x[at].T @ dh + 1e-4 * a, dh.sum(0), h.T @ g + 1e-4 * c, g.sum(0))):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    self.w[k] = self.w[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        a, b, c, e = self.w
        return np.argsort(-(np.maximum(x / self.scale @ a + b, 0) @ c + e), axis=1, kind="stable")


def fit(sample: np.ndarray, parts: int, k: int = K, recall: float = RECALL) -> tuple[Router | None, int]:
    """The router and the number of parts that a query has to see."""
    if parts < 2:
        return None, 1
    held = np.random.default_rng(SEED).permutation(len(sample)) < len(sample) // 5
    own, asks = sample[~held], sample[held]
    near = _nearest(own, min(LINKS, len(own) - 1))
    part = balanced_parts(own, near, parts)
    target = 0.4 * np.eye(parts)[part] + 0.6 * np.eye(parts)[part[near]].mean(1)
    router = Router(own, target)
    place = np.argsort(router.rank(asks), axis=1)  # how early a query sees each part
    first = router.rank(sample)[:, 0]
    sim = asks @ sample.T
    sim[np.arange(len(asks)), np.flatnonzero(held)] = -np.inf
    true = np.argpartition(-sim, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
    seen_at = place[np.arange(len(asks))[:, None], first[true]]
    for probes in range(1, parts + 1):
        if (seen_at < probes).mean() >= recall:
            return router, probes
    return router, parts


def usable(c: str, length: int | None = None) -> Column:
    """Vectors that take part."""
    e = F.col(c)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    ok = e.isNotNull() & ~F.coalesce(F.exists(e, bad), F.lit(True)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    return ok if length is None else ok & (F.size(e) == length)


def _vectors(col: pa.Array, length: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, length).astype(np.float64)


def _top(q: np.ndarray, c: np.ndarray, q_id: np.ndarray, c_id: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, candidate id, score) of the k nearest ids of each query in a tile; an id is as near as its nearest row."""
    ids, others, scores = [], [], []
    order = np.argsort(c_id, kind="stable")
    c, c_id = c[order], c_id[order]
    starts = np.flatnonzero(np.r_[True, c_id[1:] != c_id[:-1]]) if len(c) else np.zeros(0, np.int64)
    for s in range(0, len(q), 256):
        sim = q[s : s + 256] @ c.T
        sim[q_id[s : s + 256, None] == c_id[None, :]] = -np.inf
        best = sim if len(starts) == len(c) else np.maximum.reduceat(sim, starts, axis=1)
        kth = np.partition(best, -min(k, len(starts)), axis=1)[:, -min(k, len(starts))] if len(c) else np.zeros(0)
        a, b = np.nonzero((sim >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]) & (sim > -np.inf))
        exact = (q[s + a] * c[b]).sum(1)  # the same sum wherever a pair stands
        order = np.lexsort((c_id[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        if len(starts) < len(c):
            nearest = np.sort(np.unique(a * len(starts) + np.searchsorted(starts, b, "right"), return_index=True)[1])
            a, b, exact = a[nearest], b[nearest], exact[nearest]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        ids.append(q_id[s + a[keep]]), others.append(c_id[b[keep]]), scores.append(exact[keep])
    return tuple(np.concatenate(x) for x in (ids, others, scores))


def search(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, part_sample: int = PART_SAMPLE, tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that queries (a condition on id_col) picks."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL").where(usable("v"))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, n = lengths["length"], lengths["count"]
    rows = rows.where(F.size("v") == length)
    sample = max(sample, min(n // ONE_IN, MOST_SAMPLE))
    share = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
    fitted = rows.where(share).select("vec_id", "v").distinct().toArrow().sort_by("vec_id")
    router, probes = fit(_vectors(fitted.column("v").combine_chunks(), length), fitted.num_rows // part_sample, k)

    def route(depth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                order = router.rank(_vectors(b.column(1), length))[:, :depth] if router else np.zeros((b.num_rows, 1), np.int64)
                at = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(order.ravel().astype(np.int32))], ["vec_id", "v", "part"])

        return run

    schema = f"vec_id long, v {dict(rows.dtypes)['v']}, part int"
    index = written(rows.select("vec_id", "v").distinct().mapInArrow(route(1), schema), "index")
    asked = written(rows.where("asks").select("vec_id", "v").distinct().mapInArrow(route(probes), schema), "asked")

    def blocks(t: DataFrame, name: str, of: int) -> DataFrame:
        return t.groupBy("part").agg(F.ceil(F.count("*") / of).cast("int").alias(name))

    # One row for each part: MOST_SAMPLE / part_sample or sample / part_sample at most.
    shape = F.broadcast(blocks(index, "c_blocks", block_rows).join(blocks(asked, "q_blocks", tile_rows), "part"))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, "part").select("part", each("c_blocks").alias("c"), block("q_blocks").alias("q"), F.lit(0).alias("side"), "vec_id", "v")
    right = index.join(shape, "part").select("part", block("c_blocks").alias("c"), each("q_blocks").alias("q"), F.lit(1).alias("side"), "vec_id", "v")
    tiles = left.unionByName(right).repartition(shuffle_parts(spark), "part", "c", "q").sortWithinPartitions("part", "c", "q", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in packs(batches, 3):
            side, ids = t.column("side").to_numpy(), t.column("vec_id").to_numpy()
            v = _vectors(t.column("v").combine_chunks(), length)
            for s, e in zip(at[:-1], at[1:], strict=True):
                m = s + int(np.searchsorted(side[s:e], 1))
                if m > s and m < e:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _top(v[s:m], v[m:e], ids[s:m], ids[m:e], k)], ["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(compare, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: list[tuple[int, list[float]]], queries: list[int], k: int = K) -> dict[int, list[int]]:
    """Ids of the k nearest of each query, nearest first; for tests."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = ids[keep][order].tolist()
    return out
