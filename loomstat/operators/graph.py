"""Connected components of edge lists, on one machine where a check of their size allows it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, plain_unions, ship, written

#: Edges that the driver may hold: some 2 MB of numbers, or 5 MB of places; joining them takes some ten times that.
LOCAL = 100_000
#: Edges that a task joins at a time.
PIECE = 200_000


def _numbers(col: pa.ChunkedArray) -> np.ndarray | None:
    """A column of numbers, or of structs of numbers, as rows of numbers, in one column of whole numbers where they fit; None for other types and for nulls."""
    fields = [col.combine_chunks()] if not pa.types.is_struct(col.type) else col.combine_chunks().flatten()
    whole = [pa.types.is_integer(f.type) for f in fields]
    if not all(w or pa.types.is_floating(f.type) for w, f in zip(whole, fields, strict=True)) or any(f.null_count for f in fields):
        return None
    rows = [f.to_numpy(zero_copy_only=False) for f in fields]
    if not all(whole):  # doubles do not hold all whole numbers
        return None if any(w and f.type.bit_width > 32 for w, f in zip(whole, fields, strict=True)) else np.stack(rows, 1)
    if len(rows[0]):
        low, width = [int(x.min()) for x in rows], [int(x.max()) - int(x.min()) + 1 for x in rows]
        if np.prod([float(w) for w in width]) < 2**62:
            key = np.zeros(len(rows[0]), np.int64)
            for x, a, w in zip(rows, low, width, strict=True):
                key = key * w + (x.astype(np.int64) - a)
            return key[:, None]
    return np.stack(rows, 1)


def _null_first(v) -> tuple:
    return tuple((x is not None, x) for x in v) if isinstance(v, tuple) else (v is not None, v)


def _least(t: pa.Table) -> pa.Table:
    """(u, root) of edges (u, v); nodes are numbered in their order, and each takes the least number that it meets."""
    n = t.num_rows
    both = pa.chunked_array(t.column("u").chunks + t.column("v").chunks, t.column("u").type)
    rows = _numbers(both)
    if rows is not None:
        _, first, number = np.unique(rows[:, 0] if rows.shape[1] == 1 else rows, axis=0, return_index=True, return_inverse=True)
        number = number.reshape(-1)
    else:
        values = [tuple(v.values()) if isinstance(v, dict) else v for v in both.to_pylist()]
        keys = sorted({v: k for k, v in reversed([*enumerate(values)])}.items(), key=lambda x: _null_first(x[0]))
        at = {v: k for k, (v, _) in enumerate(keys)}
        first, number = np.array([k for _, k in keys], np.int64), np.array([at[v] for v in values], np.int64)
    a, b, label = number[:n], number[n:], np.arange(len(first))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):  # the root of an end as well, so that trees are joined and not only their leaves
            np.minimum.at(new, x, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return pa.table({"u": both.take(pa.array(first)), "root": both.take(pa.array(first[label]))})


def _local(edges: DataFrame) -> DataFrame:
    """(u, root) of a small table of edges (u, v), joined on the driver."""
    t = edges.toArrow()
    as_roots = edges.select("u", F.col("v").alias("root"))
    return edges.sparkSession.createDataFrame(_least(t), as_roots.schema) if t.num_rows else as_roots


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, root) for every row of nodes (node); root is the smallest node of the component.

    edges are (a, b) of the same type as node, which may be any type with an order. Tasks join the edges piece by piece;
    what is left are links between the roots of pieces that share a node. Up to ``local`` of them are joined on the driver,
    more of them by pieces again, or, where that no longer halves them, by large-star and small-star steps until nothing changes.
    """
    plain_unions(nodes.sparkSession)
    cur = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "edges")
    roots = _roots(cur, cur.count(), max_rounds, local)
    return nodes.select("node").distinct().join(roots, F.col("node") == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"))


def _roots(cur: DataFrame, n: int, max_rounds: int, local: int) -> DataFrame:
    """(u, root) for every node of a written table of n edges (u, v), u <> v."""
    if n <= local:
        return _local(cur)
    pieces = written(_by_piece(cur), "pieces")
    # A node has a root from each piece that it is in.
    at = written(pieces.groupBy("u").agg(F.min("root").alias("m"), F.collect_set("root").alias("roots")), "nodes")
    discard(cur, pieces)
    links = written(at.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
    left = links.count()
    top = _roots(links, left, max_rounds, local) if left <= max(local, n // 2) else forest(links, max_rounds)
    top = top.select(F.col("u").alias("__m"), "root")
    return at.select("u", "m").join(top, F.col("m") == F.col("__m"), "left").select("u", F.coalesce("root", "m").alias("root"))


def _by_piece(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of each piece of the edges: the least node that it meets there. Pieces are of near nodes, by their order."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= PIECE:
                yield from _least(pa.Table.from_batches(held)).to_batches()
                held = []
        if sum(x.num_rows for x in held):
            yield from _least(pa.Table.from_batches(held)).to_batches()

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return edges.repartitionByRange(n, "u").mapInArrow(run, edges.select("u", F.col("v").alias("root")).schema)


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (u, v) with m of least (u, m).

    The join is on a struct, so that least, which is summed up by u, is shuffled again for it: where one side of a join is an
    aggregate over its own shuffle, AQE cannot split a key, and a node of very many edges would land in one task.
    """
    return rows.join(least.select(F.struct("u").alias("key"), "m"), F.struct(rows["u"]) == F.col("key")).select("u", "v", "m")


def forest(cur: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) for every node but the smallest of each component of a written table of edges (u, v), u <> v, which is deleted."""
    seen = None
    for _ in range(max_rounds):
        near = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # v > u >= m, so that edges point down.
        down = _with_least(near.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(down, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, cur = cur, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return cur.select("u", F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")
