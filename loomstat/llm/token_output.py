"""Token ids as ORC files, and reading them back stripe by stripe.

Documents are dealt by ranges of doc_id and sorted before they are encoded, so each file holds a range,
files follow each other in ascending doc_id order, and only texts are shuffled. A row is (doc_id, part,
start_in_part, n_tokens, ids): integer run-length encoding keeps all but the ids small, row indexes give the
least and largest doc_id of every 10,000 rows, and a Bloom filter on doc_id lets a reader that looks for a
document skip whole stripes. Where a file begins in the stream of all ids comes from the sums of the parts.

Encoding is that of the tokenizers library, without special tokens, with one end id after each document.
A byte-level pre-tokenizer always cuts before a space that stands before another character, so the
pieces of a text between spaces are encoded by the library once, many at a time, and remembered, and so
are those that begin a line; texts with runs of white space or with an added token go to it whole.

Null and empty texts have the end id alone. Null doc_ids come first; rows of one doc_id are ordered by
their text and all kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import fresh_path, prepare, shuffle_parts

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
STRIPE_BYTES = 16 << 20
COLUMNS = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Pieces remembered by a worker; beyond that it starts anew, which costs time and changes nothing.
REMEMBERED = 1_500_000
#: Slots of a worker's hash table at first; it doubles before three eighths of it are full.
TABLE = 1 << 16
#: Pieces that the library gets in one call.
AT_ONCE = 500


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


class Encoder:
    """Ids of texts by a tokenizer, with a hash table of the pieces that it has encoded."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        d = json.loads(spec)
        pre = d.get("pre_tokenizer") or {}
        self.by_piece = d.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and d["model"]["type"] == "BPE" and not d["model"].get("dropout") and not d.get("truncation") and not d.get("padding")
        self.added = [x["content"] for x in d.get("added_tokens") or ()]
        if self.by_piece:
            # Tokens that begin with a space, as the byte-level alphabet writes it, and the one of a line's end.
            self.begins = {" ": np.zeros(self.tok.get_vocab_size() + len(self.added), bool)}
            self.begins["\n"] = self.begins[" "].copy()
            self.begins[" "][[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True
            self.begins["\n"][self.tok.encode("\n", add_special_tokens=False).ids] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.int32)
        self.at, self.n, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if there is none."""
        size = len(self.keys)
        out, slot, todo = np.full(len(h), -1, np.int64), (h % np.uint64(size)).astype(np.int64), np.arange(len(h))
        while len(todo):
            key = self.keys[slot[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.entry[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) % size
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Gives distinct new hashes their entries."""
        size = len(self.keys)
        slot, todo = (h % np.uint64(size)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]
            mine = free[self.keys[slot[free]] == h[free]]  # of several for a slot, the last has it
            self.entry[slot[mine]] = entry[mine]
            todo = np.setdiff1d(todo, mine, assume_unique=True)
            slot[todo] = (slot[todo] + 1) % size

    def _room(self, count: int) -> None:
        """A table in which so many entries take three eighths of the slots at most."""
        size = len(self.keys)
        while 8 * count > 3 * size:
            size *= 2
        if size > len(self.keys):
            full = np.flatnonzero(self.keys)
            h, entry = self.keys[full], self.entry[full]
            self.keys, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._insert(h, entry)

    def _put(self, ids: list[np.ndarray]) -> np.ndarray:
        """Copies ids behind the pool, without keeping them; where each begins."""
        n = np.array([len(x) for x in ids], np.int64)
        end = self.used + int(n.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * end - self.used, np.uint32)])
        if ids:
            self.pool[self.used : end] = np.concatenate(ids)
        return self.used + np.cumsum(n) - n

    def _add(self, h: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Entries of new pieces, each with the space or line end before it; n is -1 if there is more white space at an end."""
        ids: list[np.ndarray] = [_NONE] * len(pieces)
        for mark, begins in self.begins.items():
            own = [k for k, p in enumerate(pieces) if p[0] == mark and not p[1].isspace() and not p[-1].isspace()]
            for i in range(0, len(own), AT_ONCE):
                part = own[i : i + AT_ONCE]
                got = np.array(self.tok.encode_batch_fast(["".join([pieces[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
                cut = np.flatnonzero(begins[got])
                split = np.split(got, cut[1:]) if len(cut) == len(part) else [self.whole(pieces[k]) for k in part]
                for k, x in zip(part, split, strict=True):
                    ids[k] = x
        at, n = self._put(ids), np.array([len(x) or -1 for x in ids], np.int64)
        self.used += int(np.maximum(n, 0).sum())
        end = self.count + len(pieces)
        if end > len(self.at):
            self.at, self.n = (np.concatenate([x[: self.count], np.zeros(2 * end - self.count, np.int64)]) for x in (self.at, self.n))
        new = np.arange(self.count, end)
        self.at[new], self.n[new], self.count = at, n, end
        self._room(end)
        self._insert(h, new)
        return new

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after the other, each text followed by end_id, and where each begins."""
        out, sizes = [], [np.zeros(1, np.int64)]
        odd = np.full(len(texts), not self.by_piece)
        for x in self.added:
            odd |= pc.match_substring(texts.fill_null(""), x).to_numpy(zero_copy_only=False)
        for i, j, buf, off in tc.chunks(texts):
            if self.count > REMEMBERED:
                self._clear()
            ids, n = self._chunk(buf, off, odd[i:j], end_id)
            out.append(ids)
            sizes.append(n)
        return (np.concatenate(out) if out else _NONE), np.cumsum(np.concatenate(sizes))

    def _chunk(self, buf: np.ndarray, off: np.ndarray, odd: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        full = np.flatnonzero(np.diff(off))
        begin = (buf == 32) | (buf == 10)
        begin[off[full]] = True
        starts = np.flatnonzero(begin)
        ends, ptr = np.r_[starts[1:], len(buf)].astype(np.int64), np.searchsorted(starts, off)
        row, first = tc.rows_of(ptr), np.zeros(len(starts), bool)
        first[ptr[full]] = True
        data = buf.tobytes()
        h = np.maximum(tc.word_hashes(buf, starts, ends), np.uint64(1))
        short = (ends - starts == 1) & ~first
        plain = ~first & ~short & ~odd[row]
        entry = np.zeros(len(starts), np.int64)
        entry[plain] = found = self._find(h[plain])
        miss = np.flatnonzero(plain)[found < 0]
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            entry[miss] = self._add(new, [data[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])[back]
        at, n = self.at[entry], np.where(plain, self.n[entry], 0)
        odd = odd.copy()
        odd[row[short | (n < 0)]] = True
        # The first piece of a text stands for all of it where pieces do not serve.
        own = []
        for r, s, e in zip(full.tolist(), starts[ptr[full]].tolist(), ends[ptr[full]].tolist(), strict=True):
            piece = data[s:e].decode()
            if not odd[r] and len(piece) > 1 and piece[-1].isspace():
                odd[r] = True
            own.append(self.whole(data[off[r] : off[r + 1]].decode() if odd[r] else piece))
        n[odd[row]] = 0
        ends_at = [] if end_id is None else [np.array([end_id], np.uint32)]
        put = self._put(own + ends_at)
        at[ptr[full]], n[ptr[full]] = put[: len(own)], [len(x) for x in own]
        if ends_at:
            place, rows = np.arange(len(at)) + row, len(off) - 1
            all_at, all_n, all_row = (np.empty(len(at) + rows, np.int64) for _ in range(3))
            last = ptr[1:] + np.arange(rows)
            for x, a, b in ((all_at, at, put[-1]), (all_n, n, 1), (all_row, row, np.arange(rows))):
                x[place], x[last] = a, b
            at, n, row = all_at, all_n, all_row
        total = np.cumsum(n)
        where = np.arange(total[-1] if len(total) else 0) + np.repeat(at - total + n, n)
        return self.pool[where], np.bincount(row, n, len(off) - 1).astype(np.int64)


_NONE = np.zeros(0, np.uint32)
_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One for each worker and tokenizer."""
    if (k := hash(spec)) not in _encoders:
        _encoders[k] = Encoder(spec)
    return _encoders[k]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Writes the ids of docs (doc_id, text) as ORC files below path."""
    prepare(docs.sparkSession)
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = encoder(spec), 0
        for b in batches:
            ids, off = encode(b.column(2), end_id)
            values = pa.array(ids.view(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start + off[:-1]), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            start += int(off[-1])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "k").sortWithinPartitions("doc_id", "k", "text")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(run, COLUMNS)
    rows.write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", 10_000).option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of files that write_tokens has written; start counts the ids of all documents before."""
    rows = spark.read.schema(COLUMNS).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    base = sums.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    # A row for each file: parts are as many as shuffle partitions.
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, start, ids)."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")).cast("B")
            off = np.r_[0, np.cumsum(n)] * 4
            crc = [zlib.crc32(data[s:e]) for s, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        pa.default_memory_pool().release_unused()

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to the shared folder and digests what the files hold."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return digest(read_tokens(spark, path))


def brute_force(rows: list[tuple[int, str | None]], tokenizer: str | None = None) -> list[tuple]:
    """What round_trip gives for distinct ids, by the library alone; for tests."""
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(tokenizer or default_path()), 0, []
    for d, text in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
