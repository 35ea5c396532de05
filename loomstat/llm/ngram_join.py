"""Jaccard self-join of word n-gram sets by a chosen-path tree.

A document is the set of its 5-word sequences (the words themselves as one sequence if there are fewer).
Documents with equal sets form one node. Every node keeps 64 minimum hashes of its set; a tree samples
two of these places at each of its nodes, from the path alone, and sends a set on by the values it has
there, so that sets which share them stay together. A bucket small enough is compared pair by pair; a
larger one is split again, down to ``DEPTH``, and what is still large is compared in tiles. Trees are
repeated until a pair at the threshold meets with the probability ``RECALL`` at least.

Comparisons in buckets use the minimum hashes and keep pairs whose estimate is within five standard
errors of the threshold. The components of these pairs are then compared by their exact sets, which
gives the links, their count, and the classes. No step lists all pairs of a group: buckets pass on
edges to the first node of a component, and links are counted in the tile that finds them.

Null, empty and blank texts have no sequence and no link; each is a class of its own. The class id is the
smallest doc_id of the class; a null doc_id counts after all others, and a class of null ids has a null id.
Rows equal in all columns are copies like any other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import components, shuffle_parts, prepare, written
from .tiles import packs, stars, tiled

N = 5
THRESHOLD = (4, 5)  # a fraction, so that comparisons are exact
RECALL = 0.999999
PLACES = 64
SAMPLED = 2
DEPTH = 2
SMALL = 256
BLOCK = 512
_A = np.random.default_rng(71).integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(threshold: float, recall: float = RECALL, sampled: int = SAMPLED, depth: int = DEPTH) -> int:
    """Trees after which a pair at the threshold has met with the probability recall."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - (1 - threshold * meet) ** sampled
    return 1 if meet >= 1 else ceil(log(1 - recall) / log(1 - meet))


def _grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-word sequences, sorted by both."""
    starts, ends, ptr = tc.spans(buf, off)
    words, rows = tc.word_hashes(buf, starts, ends), tc.rows_of(ptr)
    g = tc.gram_hashes(words, n, tc.BASES[1])
    ok = rows[: len(g)] == rows[n - 1 :] if len(g) else np.zeros(0, bool)
    row, g = rows[: len(g)][ok], g[ok]
    few = np.flatnonzero((np.diff(ptr) < n) & (np.diff(ptr) > 0))
    if len(few):
        p = tc.sums(words, tc.BASES[1])
        row, g = np.r_[row, few], np.r_[g, tc.span_hash(p, ptr[few], ptr[few + 1], tc.BASES[1])]
    if not len(row):
        return row, g
    # Sort by hash inside each row: rows are short runs, so one sort of the hashes and a stable one of the rows.
    order = np.argsort(g)
    order = order[np.argsort(row[order], kind="stable")]
    row, g = row[order], g[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])]
    return row[keep], g[keep]


def _signature(g: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """16 bytes for each set: two sums over its sorted hashes, of different bases."""
    two = [tc.mix(tc.span_hash(tc.sums(g, b), first, end, b) + (end - first).astype(np.uint64)) for b in tc.BASES[1:]]
    return np.stack(two, 1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _matrix(col: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    data, off = tc.buffers(col)
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), dtype).reshape(-1, width)


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, tk, sig, n_grams, mh): for each document; sig is null and n_grams 0 if it has no words."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in tc.chunks(b.column(2)):
                row, g = _grams(buf, off, n)
                have, first = np.unique(row, return_index=True)
                end = np.r_[first[1:], len(row)] if len(row) else first
                count = np.zeros(j - i, np.int64)
                count[have] = end - first
                sig, mh = np.zeros((j - i, 2), np.uint64), np.zeros((j - i, PLACES), np.uint32)
                if len(have):
                    sig[have] = _signature(g, first, end)
                    for k in range(PLACES):
                        mh[have, k] = np.minimum.reduceat(g * _A[k], first) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), _binary(sig), pa.array(count), _binary(mh)], ["doc_id", "tk", "sig", "n_grams", "mh"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").mapInArrow(run, "doc_id long, tk long, sig binary, n_grams long, mh binary")


def _children(nodes: DataFrame, sampled: int) -> DataFrame:
    """(path, sig) one level down, from (path, sig, mh)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            mh = _matrix(b.column(2), np.uint32, PLACES)
            for k in range(sampled):
                place = (tc.mix(path + np.uint64(k * 2 + 1)) % np.uint64(PLACES)).astype(np.int64)
                value = mh[np.arange(len(mh)), place].astype(np.uint64)
                child = tc.mix(path ^ tc.mix((place.astype(np.uint64) << np.uint64(40)) + value + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1)], ["path", "sig"])

    return nodes.select("path", "sig", "mh").mapInArrow(run, "path long, sig binary").distinct()


def leaves(nodes: DataFrame, runs: int, sampled: int = SAMPLED, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """(path, sig): buckets of two or more nodes at the ends of the trees, from (sig, mh)."""
    seeds = [int(x) for x in np.random.default_rng(5).integers(-(2**62), 2**62, runs)]
    level, out = nodes.select(F.explode(F.array(*map(F.lit, seeds))).alias("path"), "sig", "mh"), None
    for d in range(depth):
        now = written(_children(level, sampled), "level")
        counts = now.groupBy("path").agg(F.count("*").alias("c")).where("c > 1")
        if d < depth - 1:
            counts = written(counts, "counts")
            ends = now.join(counts.where(F.col("c") <= small).hint("merge"), "path").select("path", "sig")
            level = now.join(counts.where(F.col("c") > small).hint("merge"), "path").select("path", "sig").join(nodes.select("sig", "mh"), "sig")
        else:
            ends = now.join(counts.hint("merge"), "path").select("path", "sig")
        out = ends if out is None else out.unionByName(ends)
    return out


def _sketch_edges(leaf_rows: DataFrame, nodes: DataFrame, least: int, parts: int, block: int) -> DataFrame:
    """(a, b): stars over the pairs of a bucket that agree in ``least`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in packs(batches, 3):
            sig, mh = t.column("sig").combine_chunks(), _matrix(t.column("mh"), np.uint32, PLACES)
            side = t.column("side").to_numpy()
            left, right = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s < 2:  # a block that is alone in its tile
                    continue
                if e - s == 2:
                    if (mh[s] == mh[s + 1]).sum() >= least and (side[s] != side[s + 1] or not side[s]):
                        left.append(np.array([s + 1])), right.append(np.array([s]))
                    continue
                pa_, pb_ = [], []
                for x in range(s, e - 1):
                    near = np.flatnonzero((mh[x + 1 : e] == mh[x]).sum(1) >= least)
                    pa_.append(np.full(len(near), x - s)), pb_.append(near + x + 1 - s)
                a, b = np.concatenate(pa_), np.concatenate(pb_)
                if side[s:e].any():
                    ok = side[s:e][a] != side[s:e][b]
                    a, b = a[ok], b[ok]
                a, b = stars(e - s, a, b)
                left.append(a + s), right.append(b + s)
            if left:
                yield pa.RecordBatch.from_arrays([sig.take(pa.array(np.concatenate(x))) for x in (left, right)], ["a", "b"])

    rows = leaf_rows.join(nodes.select("sig", "mh"), "sig")
    return tiled(rows, "path", "sig", block, parts).select("path", "t1", "t2", "side", "sig", "mh").mapInArrow(run, "a binary, b binary").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(root, sig, copies, grams) of wanted (kd, tk, root, sig, copies); grams are the sorted hashes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in tc.chunks(b.column(3)):
                row, g = _grams(buf, off, n)
                ends = (np.searchsorted(row, np.arange(j - i + 1)) * 8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(g)])], ["root", "sig", "copies", "grams"])

    from .substring_dedup import _keyed

    return _keyed(docs).join(wanted, ["kd", "tk"]).select("root", "sig", "copies", "text").mapInArrow(run, "root binary, sig binary, copies long, grams binary").dropDuplicates(["sig"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted arrays without repeats."""
    tokens, inv, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    new = np.cumsum(times > 1) - 1
    keep = times[inv] > 1
    row, col, width = row[keep], new[inv[keep]], int((times > 1).sum())
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 4096
    for c in range(0, width, step):
        s, e = np.searchsorted(col, (c, c + step))
        m = np.zeros((len(sets), min(step, width - c)), np.float32)
        m[row[s:e], col[s:e] - c] = 1
        out += m @ m.T
    return out


def _exact(sets: DataFrame, threshold: tuple[int, int], parts: int, block: int) -> DataFrame:
    """(sig, other, links): for each node of a tile its links there, weighted by copies, and an edge of the star."""
    up, down = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in packs(batches, 3):
            sig, side, copies = t.column("sig").combine_chunks(), t.column("side").to_numpy(), t.column("copies").to_numpy()
            data, off = tc.buffers(t.column("grams"))
            ids, others, links = [], [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                sets = [np.frombuffer(data[off[x] : off[x + 1]].tobytes(), np.uint64) for x in range(s, e)]
                size = np.array([len(x) for x in sets])
                both = _common(sets)
                # |A and B| >= up/down * |A or B|
                near = (up + down) * both >= up * (size[:, None] + size[None, :])
                np.fill_diagonal(near, False)
                if side[s:e].any():
                    near &= side[s:e][:, None] != side[s:e][None, :]
                a, b = np.nonzero(near)
                other = np.arange(e - s)
                own, first = stars(e - s, a, b)
                other[own] = first
                some = np.flatnonzero(near.any(1))
                ids.append(some + s), others.append(other[some] + s), links.append((near @ copies[s:e])[some])
            i, o = np.concatenate(ids), np.concatenate(others)
            yield pa.RecordBatch.from_arrays([sig.take(pa.array(i)), sig.take(pa.array(o)), pa.array(np.concatenate(links).astype(np.int64))], ["sig", "other", "links"])

    rows = tiled(sets, "root", "sig", block, parts)
    return rows.select("root", "t1", "t2", "side", "sig", "copies", "grams").mapInArrow(run, "sig binary, other binary, links long")


def jaccard_join(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, tk, class_id, n_links, class_key) for each row of docs.

    n_links is the number of other documents whose sets have a Jaccard similarity of the threshold or
    more, copies included; a class is a connected component of these links. tk is xxhash64(text), and
    class_key tells classes apart whatever their ids are; it is null for a document without words.
    """
    parts = shuffle_parts(docs.sparkSession)
    at = threshold[0] / threshold[1]
    least = max(1, int(PLACES * at - 5 * (PLACES * at * (1 - at)) ** 0.5))
    sigs = written(signatures(docs, n), "signatures")
    found = sigs.where("n_grams > 0")
    nodes = found.groupBy("sig").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("kd"), "tk")).alias("k"), F.min("mh").alias("mh"))
    nodes = written(nodes.select("sig", "copies", "least_id", "k.kd", "k.tk", "mh"), "nodes")
    buckets = leaves(nodes, runs_for(at, recall), small=small)
    near = components(_sketch_edges(buckets, nodes, least, parts, block))
    wanted = nodes.join(near.withColumnRenamed("node", "sig"), "sig").select("kd", "tk", "root", "sig", "copies")
    exact = written(_exact(_sets(docs, wanted, n), threshold, parts, block), "links")
    classes = components(exact.where("sig != other").select(F.col("sig").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "sig")
    links = exact.groupBy("sig").agg(F.sum("links").alias("links"))
    by_node = nodes.select("sig", "copies", "least_id").join(classes, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    ids = by_node.groupBy("root").agg(F.min("least_id").alias("class_id"))
    by_node = by_node.join(ids, "root").join(links, "sig", "left").select("sig", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("root").alias("class_key"))
    rows = sigs.select("doc_id", "tk", F.when(F.col("n_grams") > 0, F.col("sig")).alias("sig"))
    none = rows.where("sig is null").select("doc_id", "tk", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("binary").alias("class_key"))
    return rows.where("sig is not null").join(by_node, "sig").select("doc_id", "tk", "class_id", "n_links", "class_key").unionByName(none)


#: jaccard_join(documents), without its keys, from all shared n-word sequences.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
                                ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i : i + {N - 1}], ' ')) END) AS s FROM d),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
near AS (SELECT a.r AS a, b.r AS b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY ALL) p
         JOIN n a ON a.r = p.a JOIN n b ON b.r = p.b WHERE {sum(THRESHOLD)} * c >= {THRESHOLD[0]} * (a.n + b.n)),
walk AS (SELECT r, r AS root FROM d UNION SELECT near.b, walk.root FROM walk JOIN near ON walk.r = near.a),
class AS (SELECT r, min(root) AS root FROM walk GROUP BY r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, coalesce(links, 0) AS n_links
FROM d JOIN class USING (r) LEFT JOIN (SELECT a AS r, count(*) AS links FROM near GROUP BY a) USING (r)"""


def brute_force(rows: list[tuple[int | None, str | None]], n: int = N) -> list[tuple]:
    """What jaccard_join gives, without tk, from all pairs; for tests."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    near = [[j for j in range(len(rows)) if i != j and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in range(len(rows))]
    out: list[tuple] = [()] * len(rows)
    seen: set[int] = set()
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j), todo.append(j)
            seen |= group
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                out[j] = (rows[j][0], least, len(near[j]))
    return out
