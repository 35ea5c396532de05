"""Repeated passages: a log-structured index of window fingerprints, merge-joined batch by batch.

Every window of ``window`` words is represented by an anchor, the leftmost smallest hash among the
``gram``-word sequences in it, and by the hash of the words that all windows of this anchor cover (its
context). Equal windows have equal anchors, so windows under an anchor that occurs once are not
repeated, and those under equal contexts are. Only windows between the two cases, under an anchor with
several contexts (a mixed one), are hashed one by one, and verified by 96 bits of two hashes of all words.

The index has two logs of sorted immutable runs: of anchors (count, contexts, one place) and of the windows
under mixed anchors (count, one place). ``FingerprintIndex.add`` takes a batch: its anchors, summed up
before their shuffle, become a run, a table bucketed and sorted by hash, which is merge-joined without a
shuffle with the older runs. That tells which windows of the batch are repeated, and which older place,
seen once until now, is repeated by the batch. Beyond the batch, texts are read only of older documents
with anchors that the batch turned mixed. When there are ``max_runs`` runs of a log they are compacted to one.
An index is a folder: ``save`` leaves a manifest in it and ``FingerprintIndex(spark, path)`` opens it again; an
index without a path is deleted by ``close``. Joins that lead back from hashes to places have a written table
on one side and a plain shuffle on the other, so AQE splits a passage that very many texts share.

Null and empty texts have no words. Rows that are equal in doc_id and text count as two documents, so
their windows repeat each other. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import delete_path, discard, fresh_path, prepare, shuffle_parts, written

WINDOW = 35
GRAM = 8
NO_ID = -(2**63)


def _anchors(words: np.ndarray, ptr: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window (word of the array), number of windows, anchor hash and context hash of each anchor."""
    g = tc.gram_hashes(words, gram, tc.BASES[1])
    span, m = window - gram + 1, len(words) - window + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if m <= 0:
        return none
    # Leftmost place of the least hash among span of them, by doubling.
    best, have = np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        a, b = best[: len(best) - step], best[step:]
        best, have = np.where(g[a] <= g[b], a, b), have + step
    row = tc.rows_of(ptr)
    ok = row[:m] == row[window - 1 :]
    at = np.flatnonzero(ok)
    if not len(at):
        return none
    anchor, row = best[at], row[at]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first, n = at[new], np.diff(np.r_[new, len(at)])
    p = tc.sums(words, tc.BASES[2])
    context = tc.span_hash(p, first, first + n + window - 1, tc.BASES[2])
    context = tc.mix(context ^ tc.mix((anchor[new] - first).astype(np.uint64) * np.uint64(4096) + n.astype(np.uint64)))
    return row[new], first, n, g[anchor[new]], context


def _word_chunks(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, _, buf, off in tc.chunks(text):
        starts, ends, ptr = tc.spans(buf, off)
        yield i, tc.word_hashes(buf, starts, ends), ptr


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kd"), F.xxhash64("text").alias("tk"), "text")


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(kd, tk, first, n, h, c): for each anchor of each document its windows, from word first on, and its hashes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kd, tk = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, words, ptr in _word_chunks(b.column(2)):
                row, first, n, h, c = _anchors(words, ptr, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kd[i + row], tk[i + row], (first - ptr[row]).astype(np.int32), n.astype(np.int32), h.view(np.int64), c.view(np.int64))], ["kd", "tk", "first", "n", "h", "c"])

    return _keyed(docs).mapInArrow(run, "kd long, tk long, first int, n int, h long, c long")


#: What a run holds for each key: in an anchor's row also its least and largest context.
ANCHORS = ("anchors", ["h"], "h long, n long, lo long, hi long, kd long, tk long, first int, wide int")
WINDOWS = ("windows", ["w1", "w2"], "w1 long, w2 int, n long, kd long, tk long, first int")


class FingerprintIndex:
    """Sorted immutable runs in a folder, which may be one of an older index."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, max_runs: int = 2, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.kept, self.max_runs = spark, path is not None, max_runs
        self.path = path or fresh_path(spark, "index")
        self.about = {"buckets": buckets or shuffle_parts(spark), "window": window, "gram": gram, "runs": {"anchors": [], "windows": []}}
        if path and self._manifest().exists():
            self.about = json.loads(self._manifest().read())
        self.names: list[str] = []

    def _manifest(self):
        return _File(self.spark, f"{self.path}/manifest.json")

    def save(self) -> None:
        self._manifest().write(json.dumps(self.about))

    def close(self) -> None:
        """Forgets the tables of the session; deletes the folder if the index was given none."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        if not self.kept:
            delete_path(self.spark, self.path)

    def _write(self, log: tuple, entries: DataFrame) -> DataFrame:
        """A new run of a log."""
        kind, keys, schema = log
        name, at = f"loomstat_run_{uuid.uuid4().hex}", f"{kind}-{uuid.uuid4().hex}"
        n = self.about["buckets"]
        entries.repartition(n, keys[0]).write.bucketBy(n, keys[0]).sortBy(keys[0]).option("path", f"{self.path}/{at}").saveAsTable(name)
        self.names.append(name)
        self.about["runs"][kind].append(at)
        return self.spark.table(name)

    def _run(self, log: tuple, at: str) -> DataFrame:
        kind, keys, schema = log
        name = f"loomstat_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema.replace(' long', ' BIGINT')}) USING parquet CLUSTERED BY ({keys[0]}) SORTED BY ({keys[0]}) INTO {self.about['buckets']} BUCKETS LOCATION '{self.path}/{at}'")
        self.names.append(name)
        return self.spark.table(name)

    def entries(self, log: tuple, runs: list[str] | None = None) -> DataFrame:
        """Runs of a log as one table, by merge joins of buckets."""
        out = None
        for at in self.about["runs"][log[0]] if runs is None else runs:
            t = self._run(log, at)
            out = t if out is None else self._merged(log, out, t)
        return self.spark.createDataFrame([], log[2]) if out is None else out

    def _merged(self, log: tuple, left: DataFrame, right: DataFrame) -> DataFrame:
        kind, keys, schema = log
        a, b = left.alias("a"), right.alias("b")
        both = a.join(b.hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
        first = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        how = {"n": F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0)), "lo": F.least("a.lo", "b.lo") if kind == "anchors" else None, "hi": F.greatest("a.hi", "b.hi") if kind == "anchors" else None}
        return both.select(*((how[c] if c in how else first(c)).alias(c) for c in left.columns))

    def compact(self, log: tuple) -> None:
        """Merges the runs of a log into a new one and deletes them."""
        old = list(self.about["runs"][log[0]])
        if len(old) < 2:
            return
        entries = self.entries(log, old)
        self.about["runs"][log[0]] = []
        self._write(log, entries)
        for at in old:
            delete_path(self.spark, f"{self.path}/{at}")

    def _grow(self, log: tuple, entries: DataFrame, more: list) -> DataFrame:
        """Adds a run, and says of its keys that the index has now twice or more what older runs know of them."""
        old = self.entries(log).select(*log[1], *(F.col(c).alias(f"old_{c}") for c in [x.split()[0] for x in log[2].split(", ")][len(log[1]) :]))
        run = self._write(log, entries)
        both = run.join(old.hint("merge"), log[1], "left").where("n + coalesce(old_n, 0) > 1")
        return written(both.select(*log[1], *more), "status")

    def add(self, batch: DataFrame, older: DataFrame | None = None) -> DataFrame:
        """(kd, tk, first, n): windows, of the batch and of older documents, that the batch shows to be repeated.

        older: documents (doc_id, text) of all batches before; only those are read whose anchors turn mixed.
        """
        window, gram = self.about["window"], self.about["gram"]
        at = lambda *c: F.min(F.struct(*c)).alias("at")
        sums = fingerprints(batch, window, gram).groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), at("kd", "tk", "first", F.col("n").alias("wide")))
        mixed = F.least("lo", "old_lo") != F.greatest("hi", "old_hi")
        turned = mixed & (F.coalesce("old_n", F.lit(0)) > 0) & F.coalesce(F.col("old_lo") == F.col("old_hi"), F.lit(False))
        status = self._grow(ANCHORS, sums.select("h", "n", "lo", "hi", "at.*"), [mixed.alias("mixed"), turned.alias("turned"), *(f"old_{c}" for c in ("n", "kd", "tk", "first", "wide"))])
        found = written(fingerprints(batch, window, gram).join(status.select("h", "mixed"), "h").select("kd", "tk", "first", "n", "mixed"), "found")
        place = [F.col("old_kd").alias("kd"), F.col("old_tk").alias("tk"), F.col("old_first").alias("first"), F.col("old_wide").alias("n")]
        sure = found.where("not mixed").drop("mixed").unionByName(status.where("not mixed AND old_n = 1").select(*place))

        hashes = _windows(batch, found.where("mixed"), window)
        again = status.where("turned AND old_n > 1").select("h")
        before = status.where("turned AND old_n = 1").select(*place)
        if older is not None and not status.where("turned").isEmpty():
            if not again.isEmpty():
                before = before.unionByName(fingerprints(older, window, gram).join(again, "h").select("kd", "tk", "first", "n"))
            hashes = hashes.unionByName(_windows(older, written(before, "before"), window))
        hashes = written(hashes, "windows")
        sums = hashes.groupBy("w1", "w2").agg(F.count("*").alias("n"), at("kd", "tk", "first"))
        seen = self._grow(WINDOWS, sums.select("w1", "w2", "n", "at.*"), [f"old_{c}" for c in ("n", "kd", "tk", "first")])
        more = hashes.join(seen, ["w1", "w2"]).select("kd", "tk", "first").unionByName(seen.where("old_n = 1").select(*place[:3]))
        out = written(sure.unionByName(more.withColumn("n", F.lit(1))), "repeated")
        discard(status, found, hashes, seen)
        for log in (ANCHORS, WINDOWS):
            if len(self.about["runs"][log[0]]) >= self.max_runs:
                self.compact(log)
        return out


class _File:
    """A small file in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def read(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str) -> None:
        out = self.fs.create(self.path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def _windows(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Two hashes (w1, and half of w2) of each window in found (kd, tk, first, n)."""
    lists = found.groupBy("kd", "tk").agg(F.collect_set(F.struct("first", "n")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kd, tk = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = b.column(3)
            n_at = at.value_lengths().to_numpy(zero_copy_only=False)
            flat = at.flatten()
            first, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            own = np.r_[0, np.cumsum(n_at)]
            for i, words, ptr in _word_chunks(b.column(2)):
                j = i + len(ptr) - 1
                part = slice(own[i], own[j])
                row = np.repeat(np.arange(i, j), n_at[i:j])
                row, k = np.repeat(row, n[part]), n[part]
                s = np.repeat(first[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                at_word = s + ptr[row - i]
                w1, w2 = (tc.span_hash(tc.sums(words, base), at_word, at_word + window, base) for base in tc.BASES[1:])
                w2 = (w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kd[row], tk[row], s.astype(np.int32), w1.view(np.int64), w2)], ["kd", "tk", "first", "w1", "w2"])

    return _keyed(docs).join(lists, ["kd", "tk"]).select("kd", "tk", "text", "at").mapInArrow(run, "kd long, tk long, first int, w1 long, w2 int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """(kd, tk, first, n): the windows of docs whose words also start at another place, by an index that takes docs in batches."""
    index, out = FingerprintIndex(docs.sparkSession, window=window, gram=gram), None
    try:
        of = F.pmod(F.xxhash64("text"), F.lit(batches))
        for b in range(batches):
            found = index.add(docs.where(of == b), docs.where(of < b) if b else None)
            out = found if out is None else out.unionByName(found)
    finally:
        index.close()
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words that no repeated window covers, joined by a space."""
    lists = repeated_windows(docs, window, gram, batches).groupBy("kd", "tk").agg(F.collect_set(F.struct("first", "n")).alias("at"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, total, gone, kept = b.column(0), [], [], []
            for text, at in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes.split() splits at \x20 and \x09-\x0D alone
                total.append(len(words))
                if at.is_valid:
                    cover = np.zeros(len(words) + 1, np.int32)
                    first, n = (at.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + n + window - 1, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    gone.append(len(words) - int(stay.sum()))
                    words = [words[i] for i in np.flatnonzero(stay)]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kd"), F.xxhash64("text").alias("tk"), "text")
    return keyed.join(lists, ["kd", "tk"], "left").select("doc_id", "text", "at").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, **how: int) -> DataFrame:
    """remove_repeats with the hash of the kept words in place of them."""
    return remove_repeats(docs, **how).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: digest(documents) from a table of all windows.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT s.r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k FROM s JOIN d USING (r)),
again AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM again),
per AS (SELECT r, list(i) AS at, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT d.r, list(word ORDER BY i) AS w FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) d ANTI JOIN gone USING (r, i) GROUP BY d.r)
SELECT doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(array_to_string(kept.w, ' '), '')) AS kept_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)"""


def brute_force(texts: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """What digest gives, from a table of all windows; for tests."""
    split = [(d, (t or "").encode().split()) for d, t in texts]
    times: dict[tuple, int] = {}
    for _, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            times[k] = times.get(k, 0) + 1
    out = []
    for d, w in split:
        gone: set[int] = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
