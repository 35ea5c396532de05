"""Clusters of edges, and networks of bundles.

Edge distances compare first with first and second with second endpoints. Distances between bundles are
partial minima over tiles of edges. Trees are built on the driver from a matrix of up to ``HELD`` rows; while there are
more, tasks find the nearest cluster of each one, and clusters that are each other's nearest merge, which for
these linkages gives the same tree. Edges are clustered exactly, however many there are (edges of one place have
distance 0 and count by their number); only where ``max_exact`` is given and there are more different places, a hashed sample of so many
edges is, and every edge goes to the nearest centroid of the sample's clusters. A matrix of more than ``DOUBLE`` rows is kept in
single precision.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import edge_distances
from .linkage import METHODS, cut_tree, linkage, merges_of, nth_largest, tree
from ..tables import discard, numbered, plain_unions, ship, written
from .complete import complete_cut
from .graph import components
from .spatial import _begins, _leaves, centroids, nearest_centroid, relabel, tile_pairs, whole_groups

#: Rows of a matrix up to which it has double precision.
DOUBLE = 20_000
#: Rows of a matrix that the driver holds: 32 MB.
HELD = 2_000
#: Rows of a leaf in which near rows of large bundles are looked for; edges of a block are 1 / BLOCKS of all, within bounds.
LEAF_ROWS, BLOCKS, MOST_BLOCK = 32, 24, 40_000
#: Edges of a block at most where bundles are so large that it has few of them, and how many bundles of mean size that may be.
LARGE_BLOCK, FEW_BUNDLES = 400_000, 500
#: Rows that are packed together.
PACKED = 200_000
#: Rows that are dealt to their tiles at a time.
DEALT = 1024
#: Bundles beyond which those of one place are one row of the matrix.
COLLAPSED = 8_000
ENDS = [f"{c}{s}" for s in (1, 2) for c in "ijk"]


def edge_pairs(edges: DataFrame, flag: str = "max", block: int = 1000) -> DataFrame:
    """(a, b, dist) for all pairs of edges, a < b: the larger, smaller or mean distance of their ends."""
    one, two = edge_distances()
    dist = {"max": F.greatest(one, two), "min": F.least(one, two), "mean": (one + two) / 2.0}[flag]
    return tile_pairs(edges.select("edge_id", *ENDS), "edge_id", block).select(F.col("a.edge_id").alias("a"), F.col("b.edge_id").alias("b"), dist.alias("dist"))


def four_way_distance(flag: str) -> Column:
    """Distance of edges a and b over all four pairings of their ends."""
    from ..functions.columns import euclid

    ep = lambda t, k: [F.col(f"{t}.{c}{k}") for c in "ijk"]
    d = [euclid(ep("a", p), ep("b", q)) for p in (1, 2) for q in (1, 2)]
    return {"max": F.greatest(*d), "min": F.least(*d), "mean": sum(d[1:], d[0]) / 4.0}[flag]


def _gaps(x: np.ndarray, p: np.ndarray, least: bool) -> np.ndarray:
    """Squared distances of rows of six coordinates: the smaller or larger one of both ends."""
    out = None
    for h in (0, 3):
        d = np.subtract.outer(x[:, h], p[:, h])
        d *= d
        for c in (h + 1, h + 2):
            e = np.subtract.outer(x[:, c], p[:, c])
            e *= e
            d += e
        # Missing ends count as in the SQL, where least and greatest leave them out.
        out = d if out is None else (np.fmin if least else np.fmax)(out, d, out=out)
    return out


def _nearest_rows(x: np.ndarray, left: np.ndarray, row: np.ndarray, right: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Per pair of groups, row of the left and column of the right rows, which ascend, the least squared distance of their points.

    Points lie in leaves; a pair of leaves is looked at only if its boxes are nearer than what was found for the pair of groups.
    """
    best = np.full((row[-1] + 1, column[-1] + 1), np.inf)

    def leaves(of: np.ndarray, group: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        known = ~np.isnan(x[of]).any(1)
        of, group = of[known], group[known]
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        parts = [(g, of[a:b][part]) for a, b, g in zip(cuts, [*cuts[1:], len(of)], group[cuts], strict=True) for part in _leaves(x[of[a:b]], LEAF_ROWS)]
        return [part for _, part in parts], np.array([g for g, _ in parts], np.int64)

    (one, g), (two, k) = leaves(left, row), leaves(right, column)
    if not one or not two:
        return np.full_like(best, np.nan)
    low, high = (np.stack([f(x[part], axis=0) for part in two]) for f in (np.min, np.max))
    some = x[[part[0] for part in two]]
    size, columns = np.array([len(part) for part in two]), np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    for part, to in zip(one, g, strict=True):
        d = ((x[part[0]] - some) ** 2).sum(1)
        best[to, k[columns]] = np.minimum(best[to, k[columns]], np.minimum.reduceat(d, columns))
    for part, to in zip(one, g, strict=True):
        q = x[part]
        bound = (np.maximum(np.maximum(low - q.max(0), q.min(0) - high), 0.0) ** 2).sum(1) * (1 - 1e-12)
        look = np.flatnonzero(bound < best[to, k])
        if not len(look):
            continue
        r = x[np.concatenate([two[m] for m in look])]
        d = np.subtract.outer(q[:, 0], r[:, 0]) ** 2
        for c in (1, 2):
            d += np.subtract.outer(q[:, c], r[:, c]) ** 2
        near = np.minimum.reduceat(d.min(0), np.r_[0, np.cumsum(size[look])[:-1]])
        np.minimum.at(best, (to, k[look]), near)
    best[np.isinf(best)] = np.nan
    return best


def _minima(p: np.ndarray, of: np.ndarray, left: np.ndarray, right: np.ndarray, least: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the left rows, of the right rows, distances): per pair of names, ascending, the least of their rows' gaps."""
    left, right = (x[np.argsort(of[x], kind="stable")] for x in (left, right))
    own, row = np.unique(of[left], return_inverse=True)
    names, starts = np.unique(of[right], return_index=True)
    if least and len(left) * len(right) > 16 * LEAF_ROWS**2 * len(own) * len(names):
        return own, names, np.sqrt(np.fmin(*(_nearest_rows(p[:, h], left, row, right, np.searchsorted(names, of[right])) for h in (slice(0, 3), slice(3, 6)))))
    best = np.full((len(own), len(names)), np.nan)
    q, step = p[right], max(1, (1 << 17) // len(right))
    for s in range(0, len(left), step):
        r = row[s : s + step]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        near = _gaps(p[left[s : s + step]], q, least)
        near = np.fmin.reduceat(near, first, axis=0) if len(first) < len(r) else near
        near = np.fmin.reduceat(near, starts, axis=1) if len(starts) < len(right) else near
        best[r[first]] = np.fmin(best[r[first]], near)
    return own, names, np.sqrt(best)


def _packed(rows: DataFrame) -> DataFrame:
    """(b, rows) of rows (b, l, ENDS): those of a block in few compressed values, so that copies of them take little disk."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(t: pa.Table) -> pa.RecordBatch:
            b, x = t.column("b").to_numpy(), np.stack([t.column(c).to_numpy().astype(float) for c in ("l", *ENDS)])
            order = np.lexsort((x[1], x[0], b))
            b, x = b[order], x[:, order]
            at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(b[at], pa.int32()), pa.array([_pack(x[:, s:e]) for s, e in zip(at, [*at[1:], len(b)], strict=True)], pa.binary())], ["b", "rows"])

        held: list[pa.RecordBatch] = []
        for t in batches:
            held.append(t)
            if sum(h.num_rows for h in held) >= PACKED:
                yield blocks(pa.Table.from_batches(held))
                held = []
        if sum(h.num_rows for h in held):
            yield blocks(pa.Table.from_batches(held))

    return rows.select("b", "l", *ENDS).mapInArrow(run, "b int, rows binary")


def _pack(x: np.ndarray) -> bytes:
    """Rows of numbers: as differences of whole ones where that loses nothing, else as they are."""
    whole = np.isfinite(x).all() and (np.abs(x) < 2**30).all() and (x == np.rint(x)).all() and not np.signbit(x[x == 0]).any()
    v = np.diff(x.astype(np.int32), axis=1, prepend=np.int32(0)) if whole else x
    # Bytes of one rank lie together.
    return bytes([int(whole)]) + zlib.compress(v.reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    kind, v = (np.int32 if data[0] else float), np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint8)
    v = np.ascontiguousarray(v.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(1 + len(ENDS), -1)
    return np.cumsum(v, axis=1, dtype=np.int32).astype(float) if data[0] else v


def _unpacked(t: pa.Table) -> pa.Table:
    """The rows (x, y, side, l, ENDS) of packed ones (x, y, side, rows)."""
    parts = [_unpack(v) for v in t.column("rows").to_pylist()]
    times = [p.shape[1] for p in parts]
    head = [pa.array(np.repeat(t.column(c).to_numpy(), times)) for c in ("x", "y", "side")]
    x = np.concatenate(parts, 1)
    return pa.table([*head, pa.array(x[0].astype(np.int32)), *(pa.array(v) for v in x[1:])], names=["x", "y", "side", "l", *ENDS])


def _on_tiles(dealt: DataFrame, columns: list[str], look: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, packed: bool = False) -> DataFrame:
    """What look finds for each tile of rows (x, y, side, columns, ENDS): it gets the tile, its places, and its left and right rows.

    packed: the columns and ENDS are in rows, as _packed makes them.
    """
    ship(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["x", "y"], *[64] * packed):
            at = np.flatnonzero(_begins(t, ["x", "y"]))
            for a, b in zip(at, [*at[1:], t.num_rows], strict=True):
                tile = t.slice(a, b - a)
                if packed:
                    tile = _unpacked(tile)
                side = tile.column("side").to_numpy()
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if tile.column("x")[0] == tile.column("y")[0]:
                    right = left
                if len(left) and len(right):
                    yield from look(tile, np.stack([tile.column(c).to_numpy() for c in ENDS], 1), left, right)

    fields = ["rows"] if packed else [*columns, *ENDS]
    return dealt.select("x", "y", "side", *fields).repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(run, schema)


def bundle_distances(edges: DataFrame, label: str = "bundle", block: int = 4000) -> DataFrame:
    """(a, b, dist), a < b: the least distance of an end of one bundle's edges to the same end of the other's.

    Bundles are dealt whole into blocks of some block edges, so a tile of two blocks has all of a pair. Those of more edges are
    cut; they come first, and pairs of tiles of their blocks are summed up.
    """
    plain_unions(edges.sparkSession)
    rows = edges.select("edge_id", F.col(label).cast("int").alias("l"), *(F.col(c).cast("double").alias(c) for c in ENDS))
    counts = rows.groupBy("l").agg(F.count("*").alias("c"))
    counts = written(numbered(counts, [-F.col("c"), F.col("l")], "first", "c"), "blocks")
    n, bundles = counts.agg(F.sum("c"), F.count("*")).first()
    most = max(MOST_BLOCK, min(LARGE_BLOCK, FEW_BUNDLES * (n or 0) // max(1, bundles)))
    block = max(block, min(most, -(-(n or 0) // BLOCKS)))
    large = counts.where(F.col("c") > block).agg(F.sum("c")).first()[0]
    last, cut = max(0, (n or 0) - 1) // block, -(-(large or 0) // block)
    at = F.when(F.col("c") > block, F.pmod(F.xxhash64("edge_id"), "c")).otherwise(0)
    dealt = rows.join(counts, "l").select(F.floor((F.col("first") + at) / block).cast("int").alias("b"), "l", *ENDS)
    dealt = _packed(dealt).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(int(last)))))
    dealt = dealt.select(F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") > F.col("o")).cast("int").alias("side"), "rows")

    def look(t: pa.Table, p: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, names, best = _minima(p, t.column("l").to_numpy(), left, right)
        step = max(1, (1 << 17) // len(names))
        for s in range(0, len(own), step):
            u = own[s : s + step, None]
            r, m = np.nonzero(u < names if left is right else u != names)
            u, v = u[r, 0], names[m]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int32()), pa.array(np.maximum(u, v), pa.int32()), pa.array(best[s + r, m], pa.float64())], ["a", "b", "dist"])

    pairs = lambda d: _on_tiles(d, ["l"], look, "a int, b int, dist double", packed=True)
    if not cut:
        return pairs(dealt)
    return pairs(dealt.where(F.col("x") >= cut)).unionByName(pairs(dealt.where(F.col("x") < cut)).groupBy("a", "b").agg(F.min("dist").alias("dist")))


def maxmin(edges: DataFrame, label: str = "bundle", form: str = "pairs", block: int = 2000) -> DataFrame:
    """(label, maxmin): cohesion of each bundle.

    ``pairs``: the largest, over all pairs of its edges, of the smaller end distance. ``edges``: the largest,
    over its edges, of the distance to the next one.
    """
    if form == "pairs":
        label_of = F.col(label).cast("int").alias(label)
        edges = edges.select("edge_id", label_of, *ENDS)
        # An edge alone is at distance 0 of itself, if its ends are known.
        none = sum((F.col(c).cast("double") - F.col(c) for c in ENDS[1:]), F.col("i1").cast("double") - F.col("i1"))
        alone = edges.groupBy(label).agg(F.count("*").alias("n"), F.max(F.coalesce(none, F.lit(float("nan")))).alias("v")).where("n = 1").select(label, "v")
        return alone.unionByName(_within(edges, label, True, block).select(label, "v")).groupBy(label).agg(F.max("v").alias("maxmin"))
    return _within(edges, label, False, block).groupBy(label, "edge_id").agg(F.min("v").alias("d")).groupBy(label).agg(F.max("d").alias("maxmin"))


def _within(edges: DataFrame, label: str, largest: bool, block: int) -> DataFrame:
    """Of pairs of edges of a label: (label, edge_id, v), v the least of each edge's smaller end distances to others, or with largest
    the largest of all (edge_id is any); by tiles of a label, so v has still to be summed up. Labels of one edge are left out."""
    ship(edges.sparkSession)
    plain_unions(edges.sparkSession)
    counts = edges.groupBy(label).agg(F.count("*").alias("__n")).where("__n > 1")
    dealt = edges.select("edge_id", label, *(F.col(c).cast("double").alias(c) for c in ENDS)).join(counts, label)
    n = F.ceil(F.col("__n") / block)
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64("edge_id"), n)).withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    dealt = dealt.select("edge_id", label, *ENDS, F.least("__b", "__o").alias("__x"), F.greatest("__b", "__o").alias("__y"), (F.col("__b") > F.col("__o")).alias("__right"))
    by = [label, "__x", "__y"]

    def found(t: pa.Table) -> pa.Table:
        p = np.stack([t.column(c).to_numpy() for c in ENDS], 1)
        right, same = t.column("__right").to_numpy(zero_copy_only=False), t.column("__x").to_numpy() == t.column("__y").to_numpy()
        at, row, best = np.flatnonzero(_begins(t, by)), [], []
        for a, b in zip(at, [*at[1:], t.num_rows], strict=True):
            u, v = (np.arange(a, b),) * 2 if same[a] else (a + np.flatnonzero(~right[a:b]), a + np.flatnonzero(right[a:b]))
            if not len(u) or not len(v):
                continue
            most, one, two = 0.0, np.full(len(u), np.inf), np.full(len(v), np.inf)
            for s in range(0, len(u), 256):
                q = p[u[s : s + 256]]
                near = np.minimum(*(((q[:, None, h] - p[None, v, h]) ** 2).sum(2) for h in (slice(0, 3), slice(3, 6))))
                if largest:
                    most = np.maximum(most, near.max())
                    continue
                if same[a]:
                    near[np.arange(len(q)), s + np.arange(len(q))] = np.inf
                one[s : s + 256] = near.min(1)
                two = np.minimum(two, near.min(0))
            if largest:
                row.append(u[:1])
                best.append([most])
            else:
                row += [u] if same[a] else [u, v]
                best += [one] if same[a] else [one, two]
        row, best = (np.concatenate([*x, np.zeros(0, k)]) for x, k in ((row, np.int64), (best, float)))
        return t.select([label, "edge_id"]).take(pa.array(row.astype(np.int64))).append_column("v", pa.array(np.sqrt(best)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by):
            yield from found(t).to_batches()

    kinds = dict(edges.dtypes)
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"{label} {kinds[label]}, edge_id {kinds['edge_id']}, v double")


def _square(pairs: DataFrame, names: list[int]) -> np.ndarray:
    """The matrix of pairs (a, b, dist) of names, which are ascending; it comes to the driver partition by partition, packed."""
    ship(pairs.sparkSession)
    at = np.array(names, np.int64)
    d = np.zeros((len(at), len(at)), float if len(at) <= DOUBLE else np.float32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.searchsorted(at, b.column(c).to_numpy()).astype(np.int32).tobytes() for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (x, y, b.column(2).to_numpy().astype(float).tobytes())], ["a", "b", "d"])

    # Written first, as what is brought here partition by partition is also computed so.
    packed = written(pairs.select("a", "b", "dist").mapInArrow(pack, "a binary, b binary, d binary"), "pairs")
    for r in packed.toLocalIterator(prefetchPartitions=True):
        a, b, v = np.frombuffer(r.a, np.int32), np.frombuffer(r.b, np.int32), np.frombuffer(r.d)
        d[a, b] = v
        d[b, a] = v
    discard(packed)
    return d


def _parts(low: np.ndarray, high: np.ndarray, rows: np.ndarray, block: int) -> list[np.ndarray]:
    """Clusters in parts of up to block rows, or of one cluster, that lie near each other: halved along their widest side."""
    mid, parts, todo = (low + high) / 2, [], [np.arange(len(rows))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or rows[own].sum() <= block:
            parts.append(own)
            continue
        x = mid[own]
        order = own[np.argsort(x[:, np.argmax(x.max(0) - x.min(0))], kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return parts


def _apart(low: np.ndarray, high: np.ndarray, least: bool) -> np.ndarray:
    """Per pair of boxes, what the gaps between their rows are at least."""
    d = [np.zeros((len(low), len(low))) for _ in range(2)]
    for c in range(6):
        d[c // 3] += np.maximum(np.maximum(low[:, None, c] - high[None, :, c], low[None, :, c] - high[:, None, c]), 0.0) ** 2
    return np.sqrt(np.minimum(*d) if least else np.maximum(*d))


def _between(best: np.ndarray, one: np.ndarray, two: np.ndarray, flag: str, weight: np.ndarray, own: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Distances of clusters, whose numbers one and two of the rows and columns ascend, from those of their members own and names."""
    r, c = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) for x in (one, two))
    if flag != "average":
        f = np.minimum if flag == "single" else np.maximum
        return f.reduceat(f.reduceat(best, r, axis=0), c, axis=1)
    u, v = weight[own], weight[names]
    total = np.add.reduceat(np.add.reduceat(best * u[:, None] * v[None], r, axis=0), c, axis=1)
    return total / (np.add.reduceat(u, r)[:, None] * np.add.reduceat(v, c)[None])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, in any order of the two, by which equal distances are told apart."""
    x = np.minimum(a, b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(a, b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(33))).view(np.int64)


def _dealt(rows: DataFrame, x: np.ndarray, y: np.ndarray, block_of: np.ndarray, place: np.ndarray, blocks: int) -> DataFrame:
    """Rows (x, y, side, at, ENDS) for each of the tiles x, y that the block of a row's member is in; at is the member's place.

    The arrays go to tasks with the function. As a table to join with, broadcast in every round, they fill the driver's memory.
    """
    ship(rows.sparkSession)
    two = x != y
    b = np.r_[x, y[two]]
    order = np.argsort(b, kind="stable")
    tile = [v.astype(np.int32)[order] for v in (np.r_[x, x[two]], np.r_[y, y[two]], np.r_[np.zeros(len(x)), np.ones(two.sum())])]
    begin, place = np.searchsorted(b[order], np.arange(blocks + 1)), place.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for s in range(0, t.num_rows, DEALT):
                own = t.slice(s, DEALT)
                member = own.column(0).to_numpy()
                first, times = begin[block_of[member]], np.diff(begin)[block_of[member]]
                row = np.repeat(np.arange(len(member)), times)
                k = np.arange(len(row)) + np.repeat(first - np.cumsum(times) + times, times)
                ends = [c.take(pa.array(row)) for c in own.columns[1:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(v[k]) for v in tile), pa.array(place[member][row].astype(np.int64)), *ends], ["x", "y", "side", "at", *ENDS])

    return rows.select("member", *ENDS).mapInArrow(run, "x int, y int, side int, at long, " + ", ".join(f"{c} double" for c in ENDS))


def grown_tree(rows: DataFrame, n: int, flag: str, weight: np.ndarray | None = None, least: bool = True, block: int = 4000) -> np.ndarray:
    """The tree of n members 0 to n - 1, which rows (member, ENDS) make up; a distance of two is the least gap of their rows.

    While there are more than HELD clusters, the nearest one of each is found by tiles, in the cluster's own block first, and then
    in those blocks alone whose boxes are no farther than what was found; of equally near ones the one whose pair has the smallest
    mixed number, so that many pairs merge in a round. weight: how many points a member stands for.
    """
    if flag not in METHODS:
        raise ValueError("method is single, complete or average")
    rows = written(rows.select(F.col("member").cast("int").alias("member"), *(F.col(c).cast("double").alias(c) for c in ENDS)), "members")
    boxes = rows.groupBy("member").agg(F.count("*").alias("c"), *(f(c).alias(f"{k}{c}") for k, f in (("l", F.min), ("h", F.max)) for c in ENDS)).orderBy("member").toArrow()
    count, (low, high) = boxes.column("c").to_numpy(), (np.stack([boxes.column(f"{k}{c}").to_numpy() for c in ENDS], 1) for k in "lh")
    points = np.ones(n) if weight is None else np.array(weight, float)
    top, height, merges = np.arange(n), np.zeros(n), []

    def merge(a: int, b: int, h: float) -> None:
        # Rounding may leave a mean below the height of what it joins.
        height[a] = max(h, height[a], height[b])
        merges.append((int(a), int(b), float(height[a])))

    while True:
        names, of = np.unique(top, return_inverse=True)
        m = len(names)
        near, far, held = np.full((m, 6), np.inf), np.full((m, 6), -np.inf), np.bincount(of, count, m).astype(np.int64)
        np.minimum.at(near, of, low)
        np.maximum.at(far, of, high)
        parts = _parts(near, far, held, block)
        in_block, rank = np.empty(m, np.int32), np.empty(m, np.int64)
        rank[np.concatenate(parts)] = np.arange(m)
        for k, own in enumerate(parts):
            in_block[own] = k
        # Members by the places of their clusters, so that those of a cluster follow each other.
        place = np.empty(n, np.int64)
        place[np.argsort(rank[of], kind="stable")] = np.arange(n)
        cluster_at, points_at, pos = np.empty(n, np.int64), np.empty(n), place
        cluster_at[pos], points_at[pos] = of, points

        def tiles(x: np.ndarray, y: np.ndarray, look: Callable, schema: str, block_of: np.ndarray = in_block[of], place: np.ndarray = place, blocks: int = len(parts)) -> DataFrame:
            return _on_tiles(_dealt(rows, x, y, block_of, place, blocks), ["at"], look, schema)

        def matrix(t: pa.Table, p: np.ndarray, left: np.ndarray, right: np.ndarray, cluster_at: np.ndarray = cluster_at, points_at: np.ndarray = points_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own, other, best = _minima(p, t.column("at").to_numpy(), left, right, least)
            one, two = cluster_at[own], cluster_at[other]
            first = lambda x: x[np.r_[True, x[1:] != x[:-1]]]
            return first(one), first(two), _between(best, one, two, flag, points_at, own, other)

        def all_pairs(t: pa.Table, p: np.ndarray, left: np.ndarray, right: np.ndarray, matrix: Callable = matrix) -> Iterator[pa.RecordBatch]:
            one, two, d = matrix(t, p, left, right)
            r, c = np.nonzero(one[:, None] < two[None]) if left is right else np.nonzero(np.ones(d.shape, bool))
            yield pa.RecordBatch.from_arrays([pa.array(one[r], pa.int64()), pa.array(two[c], pa.int64()), pa.array(d[r, c])], ["a", "b", "dist"])

        def nearest(t: pa.Table, p: np.ndarray, left: np.ndarray, right: np.ndarray, matrix: Callable = matrix, names: np.ndarray = names) -> Iterator[pa.RecordBatch]:
            one, two, d = matrix(t, p, left, right)
            d[np.isnan(d) | (one[:, None] == two[None])] = np.inf
            for a, b, v in ((one, two, d),) if left is right else ((one, two, d), (two, one, d.T)):
                best = v.min(1)
                r, c = np.nonzero((v == best[:, None]) & np.isfinite(v))
                h = _mixed(names[a[r]], names[b[c]])
                order = np.lexsort((h, r))
                r, c, h = r[order], c[order], h[order]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])[: len(r)]
                r, c, h = r[first], c[first], h[first]
                yield pa.RecordBatch.from_arrays([pa.array(a[r], pa.int64()), pa.array(best[r]), pa.array(h, pa.int64()), pa.array(b[c], pa.int64())], ["a", "d", "h", "b"])

        if m <= HELD:
            break
        bound = _apart(np.stack([near[k].min(0) for k in parts]), np.stack([far[k].max(0) for k in parts]), least) * (1 - 1e-9)
        best, mixed, to = np.full(m, np.inf), np.full(m, np.iinfo(np.int64).max), np.full(m, -1)

        def found(x: np.ndarray, y: np.ndarray, best: np.ndarray = best, mixed: np.ndarray = mixed, to: np.ndarray = to) -> None:
            if not len(x):
                return
            got = tiles(x, y, nearest, "a long, d double, h long, b long").groupBy("a").agg(F.min(F.struct("d", "h", "b")).alias("s")).select("a", "s.*").toArrow()
            a, d, h, b = (got.column(c).to_numpy() for c in ("a", "d", "h", "b"))
            nearer = (d < best[a]) | (d == best[a]) & (h < mixed[a])
            best[a[nearer]], mixed[a[nearer]], to[a[nearer]] = d[nearer], h[nearer], b[nearer]

        k = np.arange(len(parts))
        if len(parts) > 1:
            next_to = (bound + np.where(np.eye(len(parts), dtype=bool), np.inf, 0.0)).argmin(1)
        else:
            next_to = k
        done = np.zeros((len(parts), len(parts)), bool)
        done[k, k] = True
        done[np.minimum(k, next_to), np.maximum(k, next_to)] = True
        found(*np.nonzero(done))
        most = np.array([best[own].max() for own in parts])
        found(*np.nonzero(np.triu((bound <= np.maximum(most[:, None], most[None])) & ~done)))
        a = np.flatnonzero((to > np.arange(m)) & (to[to] == np.arange(m)))
        if not len(a):
            break
        for x, y, h in zip(names[a], names[to[a]], best[a], strict=True):
            merge(x, y, h)
        names[to[a]] = names[a]
        top = names[of]
    if m > 1:
        x, y = np.triu_indices(len(parts))
        d = _square(tiles(x, y, all_pairs, "a long, b long, dist double"), list(range(m)))
        for x, y, h in merges_of(d, flag, np.bincount(of, points, m)):
            merge(names[x], names[y], h)
    return tree(n, merges, weight)


def linkage_table(spark, z: np.ndarray) -> DataFrame:
    """(step, left, right, height, size) of a tree."""
    return spark.createDataFrame([(k, int(a), int(b), float(h), int(n)) for k, (a, b, h, n) in enumerate(z)], "step int, left int, right int, height double, size long")


def tree_of(table: DataFrame) -> np.ndarray:
    return np.array([(r.left, r.right, r.height, r["size"]) for r in table.orderBy("step").collect()], float).reshape(-1, 4)


def write_npy(table: DataFrame, path: str) -> None:
    """The tree as a matrix of (left, right, height, size) in an .npy file."""
    from ..sources.image import file_system

    fs, p = file_system(path)
    with fs.open_output_stream(p) as f:
        np.lib.format.write_array(f, tree_of(table))


def read_npy(spark, path: str) -> DataFrame:
    from io import BytesIO

    from ..sources.image import file_system, read_bytes

    fs, p = file_system(path)
    return linkage_table(spark, np.load(BytesIO(read_bytes(fs, p)), allow_pickle=False))


def _mapped(edges: DataFrame, label: str, names: list[int], labels: np.ndarray, to: str) -> DataFrame:
    t = edges.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(names, labels, strict=True)], f"{label} int, {to} int")
    return edges.drop(to).withColumn(label, F.col(label).cast("int")).join(F.broadcast(t), label)


def hc1(edges: DataFrame, flag: str = "complete", k: int = 10, max_exact: int | None = None) -> DataFrame:
    """edges with bundle: at most k clusters by the larger end distance; complete or average linkage. Edges with a missing end are left out.

    All places are clustered, unless max_exact asks for a sample of so many edges where there are more.
    """
    spark, n = edges.sparkSession, edges.count()
    kind = dict(edges.dtypes)["edge_id"]
    if n <= k:
        own = edges.select("edge_id", F.col("edge_id").alias("bundle"))
        return relabel(edges.drop("bundle").join(own, "edge_id"), "bundle")
    at = [F.col(c).cast("double").alias(c) for c in ENDS]

    def places_of(e: DataFrame) -> DataFrame:
        return written(e.select("edge_id", *at).dropna().groupBy(*ENDS).agg(F.min("edge_id").alias("first"), F.count("*").alias("times")), "places")

    places, few = places_of(edges), None
    if max_exact is not None and places.count() > max_exact:
        few = written(edges.orderBy(F.xxhash64("edge_id", F.lit(42)), "edge_id").limit(max_exact).select("edge_id", *at), "sample")
        places = places_of(few)
    labels = complete_cut(places, k, HELD) if flag == "complete" else _average_cut(places, k, flag)
    # A cluster is named by its first edge.
    labels = written(labels, "labels")
    first = labels.groupBy("root").agg(F.min("first").cast(kind).alias("bundle"))
    own = labels.join(first, "root").select("bundle", *(F.col(c).alias(f"__{c}") for c in ENDS))
    to_place = lambda e: e.join(own, [F.col(c).cast("double") == F.col(f"__{c}") for c in ENDS]).drop(*(f"__{c}" for c in ENDS))
    if few is not None:
        return relabel(edges.drop("bundle").join(nearest_centroid(edges, centroids(to_place(few), "bundle"), "bundle"), "edge_id"), "bundle")
    return relabel(to_place(edges.drop("bundle")), "bundle")


def _average_cut(places: DataFrame, k: int, flag: str) -> DataFrame:
    """places with root, as complete_cut, for another linkage; the driver holds some numbers for each place."""
    spark, rows = places.sparkSession, places.orderBy("first").toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in ENDS], 1)
    times = rows.column("times").to_numpy().astype(float)
    if len(x) <= HELD:
        d = np.zeros((len(x), len(x)), float if len(x) <= DOUBLE else np.float32)
        for s in range(0, len(x), 64):
            d[s : s + 64] = np.maximum(*(np.sqrt(((x[s : s + 64, None, h] - x[None, :, h]) ** 2).sum(2)) for h in (slice(0, 3), slice(3, 6))))
        z = linkage(d, flag, times, own=True)
    else:
        members = spark.createDataFrame(pa.table([pa.array(np.arange(len(x)), pa.int32()), *(pa.array(v) for v in x.T)], names=["member", *ENDS]))
        z = grown_tree(members, len(x), flag, times, least=False, block=1500)
    return spark.createDataFrame(rows.append_column("root", pa.array(cut_tree(z, k), pa.int64())))


def _alike(edges: DataFrame) -> DataFrame:
    """(bundle, alike): the smallest bundle of the same place, for bundles whose edges all lie in one place; others are their own."""
    place = F.struct(*(F.col(c).cast("double").alias(c) for c in ENDS))
    spans = edges.groupBy(F.col("bundle").cast("int").alias("bundle")).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    spans = written(spans.select("bundle", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("place")), "spans")
    first = spans.where("place IS NOT NULL").groupBy("place").agg(F.min("bundle").alias("alike"))
    return written(spans.join(first, "place", "left").select("bundle", F.coalesce("alike", "bundle").alias("alike")), "alike")


def _distinct_places(edges: DataFrame, alike: DataFrame) -> DataFrame:
    """Edges of the bundles that stand for all alike, one of each place."""
    own = alike.where("bundle = alike").select("bundle")
    return edges.withColumn("bundle", F.col("bundle").cast("int")).join(own, "bundle", "left_semi").groupBy("bundle", *ENDS).agg(F.min("edge_id").alias("edge_id"))


def _tree(edges: DataFrame, names: np.ndarray, flag: str, weight: np.ndarray | None = None) -> np.ndarray:
    """The tree of the bundles names, which are ascending."""
    if len(names) <= HELD:
        return linkage(_square(bundle_distances(edges), names.tolist()), flag, weight, own=True)
    member = edges.sparkSession.createDataFrame(pa.table({"bundle": pa.array(names, pa.int32()), "member": pa.array(np.arange(len(names)), pa.int32())}))
    return grown_tree(edges.withColumn("bundle", F.col("bundle").cast("int")).join(F.broadcast(member), "bundle"), len(names), flag, weight)


def _collapsed_tree(edges: DataFrame, flag: str) -> tuple[list[int], np.ndarray]:
    """Bundles and their tree: those of one place, at distance 0 and alike to all others, merge first and count by their number."""
    alike = _alike(edges)
    rows = alike.orderBy("bundle").toArrow()
    names, to = rows.column("bundle").to_numpy(), rows.column("alike").to_numpy()
    own, group, size = np.unique(to, return_inverse=True, return_counts=True)
    z, top = [], {}
    for leaf, g in enumerate(group.tolist()):
        if g in top:
            at, count = top[g]
            z.append((min(at, leaf), max(at, leaf), 0.0, count + 1))
            top[g] = (len(names) + len(z) - 1, count + 1)
        else:
            top[g] = (leaf, 1)
    shift = len(names) + len(z) - len(own)
    for a, b, h, n in _tree(_distinct_places(edges, alike), own, flag, size):
        a, b = (top[int(x)][0] if x < len(own) else int(x) + shift for x in (a, b))
        z.append((min(a, b), max(a, b), h, n))
    return names.tolist(), np.array(z, float).reshape(-1, 4)


def single_cut(edges: DataFrame, height: float) -> DataFrame:
    """(bundle, root): single linkage cut at height, which is the components of bundles that near to each other; root is the smallest."""
    alike = _alike(edges)
    near = bundle_distances(_distinct_places(edges, alike)).where(F.col("dist") <= height).select("a", "b")
    found = components(alike.where("bundle = alike").select(F.col("bundle").alias("node")), near)
    return alike.join(found, F.col("alike") == F.col("node")).select("bundle", "root")


def hc2(edges: DataFrame, flag: str = "average", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """edges with network, at most k of them, and the tree over bundles (in the order of their numbers)."""
    names = [r[0] for r in edges.select(F.col("bundle").cast("int")).distinct().orderBy("bundle").collect()]
    if len(names) <= 1:
        return edges.withColumn("network", F.lit(0)), linkage_table(edges.sparkSession, np.zeros((0, 4)))
    if len(names) > COLLAPSED:
        names, z = _collapsed_tree(edges, flag)
    else:
        z = _tree(edges, np.array(names, np.int64), flag)
    out = relabel(_mapped(edges, "bundle", names, cut_tree(z, min(k, len(names))), "network"), "network")
    return out, linkage_table(edges.sparkSession, z)


def recut(edges: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """edges with networks of another cut of the tree; unchanged if it is empty."""
    z = tree_of(tree)
    if not len(z):
        return edges
    names = [r[0] for r in edges.select(F.col("bundle").cast("int")).distinct().orderBy("bundle").collect()]
    return relabel(_mapped(edges, "bundle", names, cut_tree(z, max(1, min(k, len(z) + 1))), "network"), "network")


def dendrogram(edges: DataFrame, tree: DataFrame, n: int = 5) -> tuple[DataFrame, float]:
    """(bundle, network, label) of each bundle and the height of the n-th largest merge."""
    parts = edges.select("bundle", "network").distinct()
    return parts.withColumn("label", F.format_string("B%d (N%d)", F.col("bundle").cast("int"), F.col("network").cast("int"))), nth_largest(tree_of(tree), n)
