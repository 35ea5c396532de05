"""Edges between voxels: neighbours, isolation, bundles, pruning.

An edge table is (edge_id, i1, j1, k1, i2, j2, k2, ...). Neighbours within a Chebyshev distance d are looked up
in blocks of ``SIDE`` voxels along a side: a voxel is dealt to its block and to those whose rim it is in, and a
task looks for the (2 ceil(d) + 1)**3 cells around it among the voxels of a block. What a voxel's edges say is
summed up before that, so a voxel with very many edges is one row, and no pair of edges is formed.
Coordinates are rounded half to even. Edges with null coordinates are never neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import to_voxel
from ..tables import discard, numbered, plain_unions, ship, written
from .graph import components

#: Voxels along a side of a block in which neighbours are looked up.
SIDE = 16
#: Rows that a task gathers before it looks for neighbours; a block has (SIDE + 2 ceil(d))**3 voxels of a group at most.
GATHERED = 1 << 16
#: Centroids that go to every task at a time, some 56 bytes each; those of a leaf of their tree; edges that look for theirs together.
CENTRES, LEAF, LOOKED = 500_000, 128, 2048
#: Blocks of rows that are paired, and rows of one at most.
PAIRED, MOST_PAIRED = 16, 16_384


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """(edge_id, side, i, j, k) for both ends of each edge."""
    ep = lambda s: F.struct(F.lit(s).alias("side"), *(to_voxel(F.col(f"{c}{s}")).alias(c) for c in "ijk"))
    return edges.select("edge_id", *keep, F.inline(F.array(ep(1), ep(2))))


def voxels(edges: DataFrame) -> DataFrame:
    """All distinct voxels at ends of edges."""
    return endpoints(edges).select("i", "j", "k").distinct()


def _numbered_values(t: pa.Table, columns: list[str]) -> list[np.ndarray]:
    """Whole numbers that are equal where the values of the columns, of one type, are."""
    both = pa.chunked_array([c for n in columns for c in t.column(n).chunks], t.schema.field(columns[0]).type).combine_chunks()
    return np.split(both.dictionary_encode().indices.to_numpy(), len(columns))


def _begins(t: pa.Table, by: list[str]) -> np.ndarray:
    """Whether a row differs in the columns by from the row before it."""
    new = np.arange(t.num_rows) == 0
    for c in by:
        (x,) = _numbered_values(t, [c])
        new[1:] |= x[1:] != x[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], gathered: int = GATHERED) -> Iterator[pa.Table]:
    """Tables of gathered rows or more, the last one of fewer, cut where the columns by change; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= gathered:
            t = pa.Table.from_batches(held).combine_chunks()
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero(_begins(t, by))[-1])
            held = t.slice(cut).to_batches()
            if cut:
                yield t.slice(0, cut)
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _in_blocks(v: DataFrame, d: float, group: list[str], look: Callable[[pa.Table, np.ndarray, np.ndarray, Callable], pa.Table], schema: str) -> DataFrame:
    """What look finds for distinct voxels v (group, i, j, k, ...) without nulls.

    look gets a table of whole blocks, which of its rows are in their own block and not in a rim, the key of each row, and a
    function from keys and an offset to (found, row) of the voxels there.
    """
    ship(v.sparkSession)
    n = ceil(d)
    wide, blocks = SIDE + 2 * n, ["__bi", "__bj", "__bk"]
    dealt = v
    for c, b in zip("ijk", blocks, strict=True):
        at = lambda o: F.floor((F.col(c).cast("long") + o) / SIDE)  # noqa: B023, E731
        dealt = dealt.withColumn(b, F.explode(F.sequence(at(-n), at(n))))
    dealt = dealt.repartition(*group, *blocks).sortWithinPartitions(*group, *blocks)

    def found(t: pa.Table) -> pa.Table:
        key, own = np.cumsum(_begins(t, [*group, *blocks])), np.ones(t.num_rows, bool)
        for c, b in zip("ijk", blocks, strict=True):
            at = t.column(c).to_numpy().astype(np.int64) - t.column(b).to_numpy() * SIDE
            own &= (at >= 0) & (at < SIDE)
            key = key * wide + at + n
        order = np.argsort(key)
        keys = key[order]

        def there(of: np.ndarray, o: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
            want = of + (o[0] * wide + o[1]) * wide + o[2]
            pos = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return keys[pos] == want, order[pos]

        return look(t, own, key, there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [*group, *blocks]):
            yield from found(t).to_batches()

    return dealt.mapInArrow(run, schema)


def _fields(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def _near_voxels(ends: DataFrame, d: float, group: list[str]) -> DataFrame:
    """(group, i, j, k) of the voxels that have, in themselves and within d, ends of two edges (of the group) or more."""
    cell = [*group, "i", "j", "k"]
    per_voxel = ends.dropna(subset=cell).groupBy(*cell).agg(F.min("edge_id").alias("lo"), F.max("edge_id").alias("hi"))
    n = ceil(d)
    offsets = [o for o in product(range(-n, n + 1), repeat=3) if any(o)]

    def look(t, own, key, there):
        lo, hi = _numbered_values(t, ["lo", "hi"])
        one = lo == hi
        near = own & ~one
        rest = np.flatnonzero(own & one)
        for o in offsets:
            hit, row = there(key[rest], o)
            hit &= ~one[row] | (lo[row] != lo[rest])
            near[rest[hit]] = True
            rest = rest[~hit]
        return t.select(cell).take(pa.array(np.flatnonzero(near)))

    return _in_blocks(per_voxel, d, group, look, _fields(per_voxel, cell))


def filter_isolated(edges: DataFrame, d: float = 1.0) -> DataFrame:
    """Edges with an end within d of an end of another edge."""
    ends = endpoints(edges)
    near = ends.join(_near_voxels(ends, d, []), ["i", "j", "k"], "left_semi").select("edge_id").distinct()
    return edges.join(near, "edge_id", "left_semi")


def _voxel_node(group: list[str] = []) -> Column:  # noqa: B006
    return F.struct(*group, "i", "j", "k")


def _adjacent(v: DataFrame, d: float, group: list[str]) -> DataFrame:
    """(a, b): neighbouring ones of distinct voxels, as nodes, each pair once."""
    n, cell, other = ceil(d), [*group, "i", "j", "k"], [f"__{c}" for c in "ijk"]
    offsets = [o for o in product(range(-n, n + 1), repeat=3) if o > (0, 0, 0)]

    def look(t, own, key, there):
        mine, parts = np.flatnonzero(own), []
        for o in offsets:
            hit, row = there(key[mine], o)
            a, b = t.select(cell).take(pa.array(mine[hit])), t.select(["i", "j", "k"]).take(pa.array(row[hit]))
            parts.append(pa.table([*a.columns, *b.columns], names=[*cell, *other]))
        return pa.concat_tables(parts)

    kinds = dict(v.dtypes)
    pairs = _in_blocks(v.select(*cell).dropna(), d, group, look, f"{_fields(v, cell)}, " + ", ".join(f"__{c} {kinds[c]}" for c in "ijk"))
    return pairs.select(_voxel_node(group).alias("a"), F.struct(*group, *(F.col(f"__{c}").alias(c) for c in "ijk")).alias("b"))


def voxel_components(edges: DataFrame, d: float = 1.0, group: list[str] = []) -> DataFrame:  # noqa: B006
    """(group, i, j, k, root): components of the voxels at ends of edges, neighbours within d, inside each group."""
    v = written(endpoints(edges, *group).select(*group, "i", "j", "k").dropna().distinct(), "voxels")
    found = components(v.select(_voxel_node(group).alias("node")), _adjacent(v, d, group))
    return found.select("node.*", "root")


def edge_components(edges: DataFrame, d: float = 1.0) -> DataFrame:
    """(edge_id, component): edges with any ends within d, directly or by way of others; numbered by first edge."""
    ends = written(endpoints(edges), "ends")
    v = ends.select("i", "j", "k").dropna().distinct()
    own = ends.dropna().groupBy("edge_id").agg(F.min(_voxel_node()).alias("a"), F.max(_voxel_node()).alias("b"))
    plain_unions(edges.sparkSession)
    found = components(v.select(_voxel_node().alias("node")), _adjacent(v, d, []).unionByName(own.select("a", "b")))
    labelled = own.join(found, F.col("a") == F.col("node")).select("edge_id", "root")
    first = labelled.groupBy("root").agg(F.min("edge_id").alias("first"))
    return labelled.join(numbered(first, [F.col("first")], "component"), "root").select("edge_id", "component")


def relabel(edges: DataFrame, label: str, *also: str) -> DataFrame:
    """Renumbers label by the number of edges, largest first, ties by the old label; columns in also become the same."""
    counts = edges.groupBy(label).agg(F.count("*").alias("__c"))
    new = numbered(counts, [-F.col("__c"), F.col(label)], "__new").select(F.col(label).alias("__old"), "__new")
    out = edges.join(new, F.col(label) == F.col("__old"))
    return out.withColumns({c: F.col("__new").cast("int") for c in (label, *also)}).drop("__old", "__new")


def bundle_cc(edges: DataFrame, d: float = 1.0) -> DataFrame:
    """edges with bundle and network: the voxel component of both ends if it is one, else a bundle of its own."""
    c = voxel_components(edges, d)
    ends = endpoints(edges).join(c, ["i", "j", "k"], "left")
    both = ends.groupBy("edge_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("root").alias("n"))
    same = (F.col("lo") == F.col("hi")) & (F.col("n") == 2)
    tagged = both.select("edge_id", F.when(same, F.col("lo")).alias("root"), F.when(same, None).otherwise(F.col("edge_id")).alias("alone"))
    return _numbered_bundles(edges, tagged, ["root", "alone"])


def _numbered_bundles(edges: DataFrame, tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Bundles numbered by size, largest first, then by their first edge.

    Written on the way: later steps read edges several times, and a plan that holds all of this each time fills the driver's memory.
    """
    tagged = written(tagged, "tagged")
    sizes = tagged.groupBy(*keys).agg(F.count("*").alias("n"), F.min("edge_id").alias("first"))
    named = numbered(sizes.select("n", "first"), [-F.col("n"), F.col("first")], "label").select("first", F.col("label").cast("int").alias("bundle"))
    t, s = tagged.alias("t"), sizes.alias("s")
    on = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = c if on is None else on & c
    labels = written(t.join(s, on).select("t.edge_id", "s.first").join(named, "first").select("edge_id", "bundle"), "labels")
    discard(tagged)
    return edges.drop("bundle", "network").join(labels, "edge_id").withColumn("network", F.col("bundle"))


def bundle_strict(edges: DataFrame, d: float = 1.0) -> DataFrame:
    """edges with bundle and network: edges that share an end, in any direction, and whose other ends are within d; chains join.

    A node is an end with the other end seen from it, so edges at a shared voxel meet by the equi-join on it.
    """
    at = lambda s: [to_voxel(F.col(f"{c}{s}")) for c in "ijk"]
    seen = lambda a, b: F.struct(*(v.alias(f"s{c}") for v, c in zip(at(a), "ijk", strict=True)), *(v.alias(c) for v, c in zip(at(b), "ijk", strict=True)))
    nodes = written(edges.select("edge_id", seen(1, 2).alias("x"), seen(2, 1).alias("y")), "seen")
    v = nodes.select("x.*").unionByName(nodes.select("y.*")).distinct()
    near = _adjacent(v, d, ["si", "sj", "sk"])
    found = components(v.select(_voxel_node(["si", "sj", "sk"]).alias("node")), near.unionByName(nodes.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    tagged = nodes.join(found, F.col("x") == F.col("node")).select("edge_id", "root")
    return _numbered_bundles(edges, tagged, ["root"])


def drop_small(edges: DataFrame, least: int = 2, label: str = "network") -> DataFrame:
    """Edges of groups with least edges or more, renumbered."""
    big = edges.groupBy(label).agg(F.count("*").alias("__c")).where(F.col("__c") >= least).select(label)
    kept = written(edges.join(big, label, "left_semi"), "kept")
    return relabel(kept, label, *(c for c in ("bundle", "network") if c in edges.columns and c != label))


def prune_isolated(edges: DataFrame, d: float = 1.0, label: str = "network", max_rounds: int = 1000) -> DataFrame:
    """Drops, again and again, edges of a group with an end that no other edge of the group is near; renumbers."""
    cur, n = written(edges, "prune"), edges.count()
    for _ in range(max_rounds):
        ends = endpoints(cur, label)
        bad = ends.join(_near_voxels(ends, d, [label]), [label, "i", "j", "k"], "left_anti").select("edge_id").distinct()
        old, cur = cur, written(cur.join(bad, "edge_id", "left_anti"), "prune")
        discard(old)
        if (left := cur.count()) == n:
            break
        n = left
    return relabel(cur, label, *(c for c in ("bundle", "network") if c in edges.columns and c != label))


def prune_small_clusters(edges: DataFrame, least: int = 3, d: float = 1.0, label: str = "network") -> DataFrame:
    """Drops edges with an end in a component of fewer than least voxels of its group, once; renumbers."""
    c = written(voxel_components(edges, d, [label]), "clusters")
    small = c.groupBy(label, "root").agg(F.count("*").alias("__n")).where(F.col("__n") < least)
    cells = c.join(small, [label, "root"], "left_semi").select(label, "i", "j", "k")
    bad = endpoints(edges, label).join(cells, [label, "i", "j", "k"], "left_semi").select("edge_id").distinct()
    kept = written(edges.join(bad, "edge_id", "left_anti"), "kept")
    discard(c)
    return relabel(kept, label, *(x for x in ("bundle", "network") if x in edges.columns and x != label))


def select_labels(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges of the chosen (network, bundle) pairs; a null bundle stands for all of its network."""
    all_of = chosen.where("bundle IS NULL").select("network").distinct()
    some = chosen.where("bundle IS NOT NULL").select("network", "bundle").distinct()
    whole = edges.join(all_of, "network", "left_semi")
    return whole.unionByName(edges.join(all_of, "network", "left_anti").join(some, ["network", "bundle"], "left_semi"))


def removed_by(edges: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(edge_id, removed_by): the first of the named steps after which an edge is gone, null if none."""
    out = edges.select("edge_id")
    for name, kept in steps:
        out = out.join(kept.select("edge_id", F.lit(True).alias(name)).distinct(), "edge_id", "left")
    why = None
    for name, _ in steps:
        why = F.when(F.col(name).isNull(), name) if why is None else why.when(F.col(name).isNull(), name)
    return out.select("edge_id", why.alias("removed_by"))


def centroids(edges: DataFrame, *by: str) -> DataFrame:
    """Mean of each coordinate of both ends."""
    return edges.groupBy(*by).agg(*(F.avg(F.col(f"{c}{s}").cast("double")).alias(f"{c}{s}") for s in (1, 2) for c in "ijk"))


def tile_pairs(rows: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """All pairs a, b of rows with a.key < b.key, as an equi-join on tiles of two blocks of the order of key: a of the first, b of the second.

    Blocks are larger where there are more rows, as a row goes to a tile for each block and one more.
    """
    spark = rows.sparkSession
    placed = written(numbered(rows, [F.col(key)], "__at"), "placed")
    n = placed.count()
    block = max(block, min(MOST_PAIRED, -(-n // PAIRED)))
    last = max(0, n - 1) // block
    at = placed.withColumn("__b", F.call_function("div", F.col("__at"), F.lit(block).cast("long")).cast("int")).drop("__at")
    a = at.withColumn("__x", F.col("__b")).withColumn("__y", F.explode(F.sequence(F.col("__b"), F.lit(last))))
    b = at.withColumn("__x", F.explode(F.sequence(F.lit(0), F.col("__b")))).withColumn("__y", F.col("__b"))
    # By number: few rows make many pairs here, and partitions must not be put together by their size.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), (last + 1) * (last + 2) // 2)
    a, b = (x.repartition(parts, "__x", "__y").alias(name) for x, name in ((a, "a"), (b, "b")))
    return a.join(b, (F.col("a.__x") == F.col("b.__x")) & (F.col("a.__y") == F.col("b.__y")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))


def _leaves(at: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Rows of points in parts of most or fewer that lie near each other, each ascending, halved along their widest side."""
    parts, todo = [], [np.arange(len(at))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            parts.append(np.sort(own))
            continue
        x = at[own]
        order = np.argsort(x[:, np.argmax(x.max(0) - x.min(0))], kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return parts


def nearest_centroid(edges: DataFrame, centres: DataFrame, label: str, digits: int | None = None) -> DataFrame:
    """(edge_id, label) of the centroid next to each edge in all six coordinates; ties to the smaller label.

    digits: squared distances equal to so many decimals are ties. Centroids with nulls take no part; edges with nulls get the
    smallest label. Centroids go to every task, CENTRES of them at a time; a task looks into the leaves of a tree whose boxes are
    no farther than the best found.
    """
    ship(edges.sparkSession)
    cols = [f"{c}{s}" for s in (1, 2) for c in "ijk"]
    rows = written(numbered(centres.select(label, *(F.col(c).cast("double").alias(c) for c in cols)).dropna(), [F.col(label)], "__at"), "centres")
    kind, n = _fields(edges, ["edge_id"]), rows.count()
    cur = edges.select("edge_id", *(F.col(c).cast("double").alias(c) for c in cols))
    cur = cur.withColumns({"__d": F.lit(float("inf")), label: F.lit(None).cast(dict(centres.dtypes)[label])})
    schema = f"{kind}, {', '.join(f'{c} double' for c in cols)}, __d double, {_fields(centres, [label])}"
    for first in range(0, n, CENTRES):
        last = first + CENTRES >= n
        cur = cur.mapInArrow(_nearest(rows.where(f"__at >= {first} AND __at < {first + CENTRES}").orderBy("__at"), cols, label, digits), schema)
        cur = cur if last else written(cur, "nearest")
    return (cur if n else cur.limit(0)).select("edge_id", label)


def _nearest(rows: DataFrame, cols: list[str], label: str, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces, in batches of edges, the distance and label found so far by those of a nearer one of these centroids."""
    t = rows.toArrow()
    names, at = t.column(label).combine_chunks(), np.stack([t.column(c).to_numpy() for c in cols], 1)
    parts = _leaves(at)
    low, high = np.stack([at[p].min(0) for p in parts]), np.stack([at[p].max(0) for p in parts])

    def search(x: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, row = np.full(len(x), np.inf), np.full(len(x), len(at))

        def look(own: np.ndarray, part: np.ndarray) -> None:
            for s in range(0, len(own), 512):
                e = own[s : s + 512]
                d = ((x[e, None, :] - at[None, part]) ** 2).sum(2)
                d = d if digits is None else np.round(d, digits)
                k = d.argmin(1)
                d, k = d[np.arange(len(e)), k], part[k]
                nearer = (d < best[e]) | (d == best[e]) & (k < row[e])
                best[e[nearer]], row[e[nearer]] = d[nearer], k[nearer]

        bound = np.zeros((len(x), len(parts)))
        for c in range(6):
            bound += np.maximum(np.maximum(low[None, :, c] - x[:, None, c], x[:, None, c] - high[None, :, c]), 0.0) ** 2
        # Rounding must not hide a tie.
        bound = bound * (1 - 1e-9) - (0.0 if digits is None else 10.0**-digits)
        bound[~np.isfinite(x).all(1)] = np.inf
        bound[bound > most[:, None]] = np.inf
        near = bound.argmin(1)
        near[~np.isfinite(bound[np.arange(len(x)), near])] = -1
        for p in np.unique(near[near >= 0]):
            look(np.flatnonzero(near == p), parts[p])
        bound[np.arange(len(x)), near] = np.inf
        for p in np.flatnonzero((bound <= best[:, None]).any(0)):
            own = np.flatnonzero((bound[:, p] <= best) & np.isfinite(bound[:, p]))
            look(own, parts[p])
        return best, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(6)], 1)
            most, none = b.column(7).to_numpy(), b.column(8).is_null().to_numpy(zero_copy_only=False)
            found = [search(x[s : s + LOOKED], most[s : s + LOOKED]) for s in range(0, len(x), LOOKED)]
            best, row = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            row = np.where(none & (row == len(at)), 0, row)
            new = none | (best < most)
            names_of = pc.if_else(pa.array(new), names.take(pa.array(np.where(new, row, 0))), b.column(8))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(np.where(new, best, most)), names_of], [*b.schema.names])

    return run
