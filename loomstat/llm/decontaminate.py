"""Benchmark decontamination by latent semantic retrieval and a longest common subsequence.

Texts are cut into passages of two neighbouring blocks of ``BLOCK`` words. Columns of the passage matrix
are the words of the corpus, hashed into ``COLUMNS``, weighed by inverse document frequency. Its singular
vectors come from a distributed randomised SVD of two passes: the first adds each passage, with a random
sign, to one of ``SKETCH`` rows and counts the blocks of each column; the rows span the range. The second
projects every passage into it and sums the squares, a matrix of SKETCH by SKETCH, whose eigenvectors turn
the range into singular vectors. The first ``RANK`` of them are the latent space, far fewer than there are
passages or items; coordinates are divided by the singular values, so that what most passages share (a
language, common words) does not drown the rest. Words that stand in like passages lie near each other
there, so a passage that says an item in other words is retrieved where its words alone would not do.

A third pass compares every passage with every item by cosine. Pairs above ``COSINE`` that have enough of
the item's words at all, and places where a text shares ``SHARE`` of an item's runs of ``GRAM`` words, whatever the
cosine, are then decided by words: the best window of about the item's length must hold ``LCS`` of its words in order,
and ``ANSWER`` of its answer (what follows the last question mark, or else its last sentence). An item of fewer than
``LEAST`` words, of which a part matches by chance, is found where all its words stand in a row.

Words are lower-cased runs of letters and digits. What the passes sum up has a fixed size, however large corpus
and benchmark are. The benchmark goes to the tasks in parts of at most ``PART_BYTES`` of text, all of them in the
same pass over the corpus; a part is read to the driver to be numbered, and no two at once.

Null and empty texts have no passages and are clean; rows are judged one by one, so repeated rows and null
ids are kept apart. An empty benchmark leaves everything clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import prepare, shuffle_parts

BLOCK = 32
COLUMNS = 1 << 14
SKETCH = 48
RANK = 32
#: Items whose words are numbered together.
ITEMS = 512
LEAST = 8
COSINE = 0.6
LCS = 0.7
ANSWER = 0.6
#: An item all of whose words stand in a row has every run of so many words; an edit breaks GRAM runs at most.
GRAM = 3
SHARE = 0.125
#: Bytes of text of the benchmark in a part. Its arrays take some five times as much in a task.
PART_BYTES = 16 << 20
#: Words of a text projected at a time.
AT_ONCE = 1 << 15


def _words(arr: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row) of lower-cased texts."""
    for i, _, buf, off in tc.chunks(pc.utf8_lower(arr), size):
        starts, ends, ptr = tc.spans(buf, off, tc.PUNCT_SPACE)
        yield i, tc.word_hashes(buf, starts, ends), ptr


def answer_of(text: str) -> str:
    """What follows the last question mark, or else the last sentence."""
    head, mark, tail = text.rpartition("?")
    if mark and re.search(r"\w", tail):
        return tail
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if re.search(r"\w", x)]
    return parts[-1] if parts else ""


@dataclass
class Space:
    """Some items: their words by number, and where they lie in the latent space."""

    ids: list[int | None]
    items: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray  # sorted hashes
    latent: np.ndarray | None = None

    def reach(self, item: int, near: np.ndarray) -> int:
        """How many of an item's words can be in a subsequence of near at most."""
        if not hasattr(self, "_times"):
            self._times = np.zeros((len(self.items), len(self.vocabulary)), np.uint16)
            for k, x in enumerate(self.items):
                np.add.at(self._times[k], x, 1)
        there = np.sort(near)
        return int(self._times[item, there[np.diff(there, prepend=-1) > 0]].sum())

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the items' runs of GRAM words, the first entry of each, and the item of each entry."""
        if not hasattr(self, "_grams"):
            keys = [np.unique(_keys(x)) for x in self.items]
            of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            known, first = np.unique(keys[order], return_index=True)
            self._maybe = np.zeros(1 << 20, bool)
            self._maybe[known >> np.uint64(44)] = True
            self._grams = known, np.r_[first, len(keys)], of[order]
        return self._grams

    def shared(self, t: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, word) where a text begins to hold SHARE of an item's runs, about an item's length apart."""
        known, first, of = self.grams()
        at = np.flatnonzero((t[:-2] >= 0) & (t[1:-1] >= 0) & (t[2:] >= 0)) if len(t) >= GRAM else np.zeros(0, np.int64)
        row = np.searchsorted(ptr, at, "right") - 1
        inside = at + GRAM <= ptr[row + 1]
        at, row = at[inside], row[inside]
        key = _mixed(t[at], t[at + 1], t[at + 2])
        m = self._maybe[key >> np.uint64(44)]
        at, row, key = at[m], row[m], key[m]
        k = np.minimum(np.searchsorted(known, key), len(known) - 1)
        m = known[k] == key
        at, row, k = at[m], row[m], k[m]
        n = first[k + 1] - first[k]
        item = of[np.repeat(first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(k) else np.zeros(0, np.int64)
        at, row = np.repeat(at, n), np.repeat(row, n)
        order = np.lexsort((at, item, row))
        at, row, item = at[order], row[order], item[order]
        size = np.array([len(x) for x in self.items])[item]
        need = np.maximum(1, ((size - GRAM + 1) * SHARE).astype(np.int64))
        end = np.arange(len(at)) + need - 1
        ok = end < len(at)
        end = np.minimum(end, max(0, len(at) - 1))
        ok &= (row[end] == row) & (item[end] == item) & (at[end] - at <= size + np.maximum(4, size // 4))
        out: list[tuple[int, int, int]] = []
        for x in zip(row[ok].tolist(), item[ok].tolist(), at[ok].tolist(), strict=True):
            if not out or out[-1][:2] != x[:2] or x[2] > out[-1][2] + len(self.items[x[1]]) // 2:
                out.append(x)
        return out

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 outside the vocabulary."""
        if not hasattr(self, "_first"):
            self._first = np.zeros(1 << 18, bool)
            self._first[self.vocabulary >> np.uint64(46)] = True
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self._first[hashes >> np.uint64(46)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tc.mix(a.astype(np.uint64) * np.uint64(tc.BASES[0]) + b.astype(np.uint64) * np.uint64(tc.BASES[1]) + c.astype(np.uint64) * np.uint64(tc.BASES[2]))


def _keys(t: np.ndarray) -> np.ndarray:
    return _mixed(t[:-2], t[1:-1], t[2:])


@dataclass
class Short:
    """Items of one number of words, to be found word for word."""

    length: int
    known: np.ndarray  # sorted hashes
    first: np.ndarray
    ids: list[int | None]


def shorts(rows: list[tuple[int | None, np.ndarray]]) -> list[Short]:
    made = []
    for n in sorted({len(x) for _, x in rows if 0 < len(x) < LEAST}):
        own = sorted(((int(tc.gram_hashes(x, n, tc.BASES[1])[0]), k) for k, (_, x) in enumerate(rows) if len(x) == n))
        known, first = np.unique(np.array([h for h, _ in own], np.uint64), return_index=True)
        made.append(Short(n, known, np.r_[first, len(own)], [rows[k][0] for _, k in own]))
    return made


def parts_of(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in parts of about PART_BYTES of text, by a hash of them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    for k in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        # About PART_BYTES.
        yield sorted(((r.item_id, r.text) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def spaces(rows: list[tuple[int | None, str]], latent: "Latent") -> tuple[list[Space], list[Short]]:
    """Items of a part, ITEMS at a time, and the short ones of it."""
    hashed = []
    for start in range(0, len(rows), 1000):
        part = rows[start : start + 1000]
        for texts in ([t for _, t in part], [answer_of(t) for _, t in part]):
            out = []
            for _, words, ptr in _words(pa.array(texts, pa.string()), 1 << 30):
                out += [words[ptr[i] : ptr[i + 1]] for i in range(len(texts))]
            hashed.append(out)
    items, answers = [x for o in hashed[::2] for x in o], [x for o in hashed[1::2] for x in o]
    keep = [k for k, x in enumerate(items) if len(x) >= LEAST]
    made = []
    for start in range(0, len(keep), ITEMS):
        own = keep[start : start + ITEMS]
        s = Space([rows[k][0] for k in own], [], [], np.unique(np.concatenate([items[k] for k in own])))
        s.items, s.answers = [s.terms(items[k]) for k in own], [s.terms(answers[k]) for k in own]
        at = np.stack([latent.blocks(items[k], np.array([0, len(items[k])]))[0].sum(0) for k in own])
        s.latent = np.ascontiguousarray((at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)).T.astype(np.float32))
        made.append(s)
    return made, shorts([(i, x) for (i, _), x in zip(rows, items, strict=True)])


def _blocks(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each word, row of each block, and its first word."""
    n = np.diff(ptr)
    blocks = -(-n // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    row = tc.rows_of(ptr)
    of_word = first[row] + (np.arange(len(row)) - ptr[row]) // BLOCK
    row_of = np.repeat(np.arange(len(n)), blocks)
    return of_word, row_of, ptr[row_of] + (np.arange(first[-1]) - first[row_of]) * BLOCK


def _present(words: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, column) of the columns that each block has, sorted."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Sorted as 32 bits where they fit, which is much faster than np.unique.
    low = int(of_word[0])
    kind = np.uint32 if int(of_word[-1]) - low < (1 << 32) // COLUMNS else np.int64
    key = (of_word - low).astype(kind) * kind(COLUMNS) + (words & np.uint64(COLUMNS - 1)).astype(kind)
    key.sort()
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new].astype(np.int64)
    return (key >> (COLUMNS.bit_length() - 1)) + low, key & (COLUMNS - 1)


@dataclass
class Latent:
    """Weights that take the columns of a block into a space."""

    project: np.ndarray  # COLUMNS rows

    def blocks(self, words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of each block, block of each word, row and first word of each block."""
        of_word, row_of, first = _blocks(ptr)
        out = np.zeros((len(row_of), self.project.shape[1]), np.float32)
        # Whole blocks, about AT_ONCE words at a time, whatever the length of a text.
        cuts = [0, *np.searchsorted(first, np.arange(AT_ONCE, len(words), AT_ONCE)).tolist(), len(first)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e > s:
                a, b = first[s], first[e] if e < len(first) else len(words)
                block, column = _present(words[a:b], of_word[a:b])
                start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                out[block[start]] = np.add.reduceat(self.project[column], start, axis=0)
        return out, of_word, row_of, first

    def passages(self, words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with each block and the next one of its text together."""
        out, of_word, row_of, first = self.blocks(words, ptr)
        on = row_of[1:] == row_of[:-1]
        out[:-1] += out[1:] * on[:, None]
        return out, of_word, row_of, first


def _added(df: DataFrame, parts: int) -> list:
    """Sums of rows (j, total, row) by j; a row is an array of int64 for j = -1, else of float32."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for j, total, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(row, np.int64 if j == -1 else np.float32)
                if j in held:
                    held[j][0] += total
                    held[j][1] += x
                else:
                    held[j] = [total, x.astype(np.int64 if j == -1 else np.float64)]
        for j, (total, x) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([total], pa.int64()), pa.array([x.tobytes()])], ["j", "total", "row"])

    return df.repartition(parts, "j").mapInArrow(add, SUMS).collect()


SUMS = "j int, total long, row binary"


def fit(docs: DataFrame) -> Latent:
    """The latent space of all passages of docs, by two passes; what comes to the driver has SKETCH + 1 rows, however large docs are."""
    parts = min(SKETCH, shuffle_parts(docs.sparkSession))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, df, total = np.zeros(SKETCH * COLUMNS, np.float32), np.zeros(COLUMNS, np.int64), 0
        for b in batches:
            for _, words, ptr in _words(b.column(0), tc.CHUNK):
                if not len(words):
                    continue
                of_word, row_of, first = _blocks(ptr)
                total += len(row_of)
                # A passage's row and sign come from its words.
                on = row_of[1:] == row_of[:-1]
                mark = np.add.reduceat(tc.mix(words), first)
                mark = tc.mix(mark + np.r_[np.where(on, mark[1:], 0), 0].astype(np.uint64))
                to, sign = (mark % np.uint64(SKETCH)).astype(np.int64), np.where(mark >> np.uint64(63), 1, -1).astype(np.float32)
                block, column = _present(words, of_word)
                df += np.bincount(column, minlength=COLUMNS)
                np.add.at(out, to[block] * COLUMNS + column, sign[block])
                m = np.r_[False, on][block]
                np.add.at(out, to[block[m] - 1] * COLUMNS + column[m], sign[block[m] - 1])
        for j in range(SKETCH):
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([0], pa.int64()), pa.array([out[j * COLUMNS : (j + 1) * COLUMNS].tobytes()])], ["j", "total", "row"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total], pa.int64()), pa.array([df.tobytes()])], ["j", "total", "row"])

    rows = {r.j: r for r in _added(docs.select("text").mapInArrow(sketch, SUMS), parts)}
    total = rows[-1].total if rows else 0
    df = np.frombuffer(rows[-1].row, np.int64) if rows else np.zeros(COLUMNS, np.int64)
    idf = np.log((total + 1) / (df + 1)) + 0.1
    y = np.stack([np.frombuffer(rows[j].row) for j in range(SKETCH)]) * idf if rows else np.zeros((1, COLUMNS))
    _, size, basis = np.linalg.svd(y, full_matrices=False)
    basis = basis[size > 1e-9 * max(size[0], 1e-9)]
    into = Latent(np.ascontiguousarray((basis * idf).T.astype(np.float32)))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(basis), len(basis)))
        for b in batches:
            for _, words, ptr in _words(b.column(0), tc.CHUNK):
                if len(words):
                    z = into.passages(words, ptr)[0]
                    out += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([out.astype(np.float32).tobytes()])], ["j", "total", "row"])

    got = _added(docs.select("text").mapInArrow(squares, SUMS), 1) if len(basis) else []
    value, turn = np.linalg.eigh(np.frombuffer(got[0].row).reshape(len(basis), len(basis)) if got else np.zeros((len(basis),) * 2))
    value, turn = value[::-1][:RANK], turn[:, ::-1][:, :RANK]
    turn = turn[:, value > 1e-9 * max(value.max(initial=0), 1e-9)] / np.sqrt(value[value > 1e-9 * max(value.max(initial=0), 1e-9)])
    return Latent(np.ascontiguousarray(((basis * idf).T @ turn).astype(np.float32)))


def common(item: np.ndarray, window: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    where: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    state = full
    for w in window.tolist():
        if m := where.get(w):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(item) - state.bit_count()


def compare(item: np.ndarray, answer: np.ndarray, words: np.ndarray, lcs: float) -> tuple[float, float]:
    """Shares of the item and of its answer in the best window of words; (0, 0) if none holds lcs of it."""
    m = len(item)
    known = np.flatnonzero(words >= 0)
    if len(known) < lcs * m or common(item, words[known]) < lcs * m:
        return 0.0, 0.0
    length, best, at = m + max(4, m // 4), 0, 0
    for s in range(0, max(1, len(words) - length + max(1, m // 8)), max(1, m // 8)):
        if (n := common(item, words[s : s + length])) > best:
            best, at = n, s
    if best < lcs * m:
        return 0.0, 0.0
    return best / m, common(answer, words[at : at + length]) / max(1, len(answer))


def _hits(text: pa.Array, latent: Latent, made: list[Space], few: list[Short], cosine: float, lcs: float, answer: float) -> list[list[tuple]]:
    """For each text, (item_id, cosine, share of the item, share of the answer) of the items that it holds."""
    out: list[list[tuple]] = [[] for _ in range(len(text))]
    for i, words, ptr in _words(text, tc.CHUNK):
        if not len(words):
            continue
        part, of_word, row_of, first = latent.passages(words, ptr) if made else (None,) * 4
        norm = np.linalg.norm(part, axis=1) if made else None
        for s in few:
            h = tc.gram_hashes(words, s.length, tc.BASES[1])
            if not len(h):
                continue
            k = np.minimum(np.searchsorted(s.known, h), len(s.known) - 1)
            at = np.flatnonzero(s.known[k] == h)
            row = np.searchsorted(ptr, at, "right") - 1
            for row, k in sorted({(a, b) for a, b, w in zip(row.tolist(), k[at].tolist(), at.tolist(), strict=True) if w + s.length <= ptr[a + 1]}):
                out[i + row] += [(x, 1.0, 1.0, 1.0) for x in s.ids[s.first[k] : s.first[k + 1]]]
        for s in made:
            t = s.terms(words)
            cos = part @ s.latent
            p, q = np.nonzero(cos >= cosine * np.maximum(norm, 1e-9)[:, None])
            best: dict[tuple[int, int], tuple] = {}
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                row = row_of[x]
                if (row, y) in best and best[row, y][1] >= 0.999:
                    continue
                m = len(s.items[y])
                near = t[max(ptr[row], first[x] - m) : min(ptr[row + 1], first[x] + 2 * BLOCK + m)]
                if s.reach(y, near) < lcs * m:
                    continue
                share, told = compare(s.items[y], s.answers[y], near, lcs)
                if share and told >= answer and share > best.get((row, y), (0, 0))[1]:
                    best[row, y] = (float(cos[x, y] / norm[x]), share, told)
            for row, y, word in s.shared(t, ptr):
                if (row, y) in best and best[row, y][1] >= 0.999:
                    continue
                m = len(s.items[y])
                near = t[max(ptr[row], word - m) : min(ptr[row + 1], word + 2 * m + 8)]
                share, told = compare(s.items[y], s.answers[y], near, lcs)
                if share and told >= answer and share > best.get((row, y), (0, 0))[1]:
                    x = of_word[word]
                    best[row, y] = (float(cos[x, y] / max(norm[x], 1e-9)), share, told)
            for (row, y), found in best.items():
                out[i + row].append((s.ids[y], *found))
    return out


def find(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, short: bool = True) -> DataFrame:
    """docs with hits: the items that the row's text holds, as (item_id, cosine, lcs, answer); short items unless told otherwise."""
    prepare(docs.sparkSession)
    kind = "array<struct<item_id:long,cosine:double,lcs:double,answer:double>>"
    out = docs.withColumn("hits", F.array().cast(kind))
    at, to = out.columns.index("text"), out.columns.index("hits")
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    latent = None
    for rows in parts_of(benchmark):
        latent = latent or fit(docs)
        made, few = spaces(rows, latent)

        def run(batches: Iterator[pa.RecordBatch], made: list[Space] = made, few: list[Short] = few if short else []) -> Iterator[pa.RecordBatch]:
            for b in batches:
                old = b.column(to).to_pylist()
                hits = _hits(b.column(at), latent, made, few, cosine, lcs, answer)
                new = [x + [dict(zip(("item_id", "cosine", "lcs", "answer"), h, strict=True)) for h in more] for x, more in zip(old, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, arrow) if k == to else c for k, c in enumerate(b.columns)], b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) for each row of docs and item that it holds."""
    return find(docs.select("doc_id", "text"), benchmark, **how).select("doc_id", F.inline("hits"))
