"""Groups compared pair by pair in tiles, so that no task holds more of a group than two blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, group: str, node: str, block: int, parts: int) -> DataFrame:
    """rows with (t1, t2, side, pick): each two rows of a group meet in one tile at least.

    A group of up to ``block`` rows is one tile, of side 0. Larger ones are dealt into blocks by a hash of
    node; the tile of blocks i < j holds i as side 0 and j as side 1, where only pairs across count, and
    the tile (i, i) holds i alone. Groups of one row are left out.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("in_group")).where("in_group > 1")
    out = rows.join(counts.hint("merge"), group).withColumn("blocks", F.ceil(F.col("in_group") / block).cast("int"))
    out = out.withColumn("own", F.pmod(F.xxhash64(node, F.lit(5)), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumn("t1", F.least("own", "other")).withColumn("t2", F.greatest("own", "other"))
    out = out.withColumn("side", F.when(F.col("own") == F.col("t2"), 1).otherwise(0) * F.when(F.col("t1") == F.col("t2"), 0).otherwise(1))
    return out.drop("blocks", "own", "other", "in_group").repartition(parts, group, "t1", "t2").sortWithinPartitions(group, "t1", "t2")


def packs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream sorted by its first columns: (rows, starts of the groups with the row count last)."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for i in range(keys):
            c = t.column(i).combine_chunks()
            if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
                c = c.dictionary_encode().indices if not isinstance(c, pa.ChunkedArray) else c.combine_chunks().dictionary_encode().indices
            c = c.to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    same = lambda a, b: all(a.column(i)[0].as_py() == b.column(i)[b.num_rows - 1].as_py() for i in range(keys))
    for b in batches:
        if not b.num_rows:
            continue
        if held and same(b, held[0]):  # the group that is held goes on through this batch, which is sorted
            held.append(b)
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        at = cut(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), np.r_[at[:-1], at[-1]]
            held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        at = cut(t)
        yield t, np.r_[at, t.num_rows]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each of n nodes to the first one of its component of the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]
