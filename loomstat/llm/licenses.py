"""License scan: TF-IDF cosine of lines and paragraphs to templates, then inheritance along paths.

Segments of a file are its lines and its paragraphs (lines up to an empty one); a header or a licence file
is found wherever it stands. Templates are notices, titles and paragraphs of ``licence_texts``. Terms are
weighed by the files that hold them, counted in one pass over all files: each word of a template by
itself, all others in ``BUCKETS`` buckets of their hash, which bounds the table of counts. A second pass
scores the segments of whole texts: sparse vectors of term counts times weights, foreign words with their
own. Only segments whose words outside the templates leave room for ``COSINE`` are multiplied with the
templates, which drops none that could reach it.

A template counts only for segments that have the numbers of its version, and the same words that tell
near licences apart (``DECIDING``); so an unknown version, or a licence without template, is reported as
nothing rather than as its neighbour. The best segment at or above ``COSINE`` is the file's own licence,
unless another that it contains by nature was found (``REFINES``: a text of three clauses holds that of
two). A line ``SPDX-License-Identifier:`` says it outright: its expression, any identifiers with AND, OR,
WITH and parentheses, is the licence with score 1, the first in the file.

A licence file (LICENSE, COPYING, UNLICENSE, NOTICE, with any ending) gives its licence to its directory
and all below. A file without one of its own takes that of the nearest such ancestor. Only distinct
directories are joined to their ancestors, so a directory with a third of all files is joined once.

Null and empty texts have no licence of their own but may inherit one; files with a null path inherit
nothing. Of several licences at one place the higher score wins, then the name; of licence files of one
directory likewise, then the path. Repeated rows are judged alike. Other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .licence_texts import DECIDING, REFINES, templates as all_templates
from .shared import prepare, written

COSINE = 0.8
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
#: Buckets of the words that no template has.
BUCKETS = 1 << 18
#: Segments multiplied with the templates at a time.
AT_ONCE = 2048
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
SPDX_TOKEN = re.compile(r"\s*(?:([()])|(AND|OR|WITH)(?![A-Za-z0-9.+\-:])|([A-Za-z0-9.\-:]*[A-Za-z0-9.]\+?)(?=[\s()]|$))", re.I)
TEMPLATES = all_templates()


def spdx(line: str) -> str | None:
    """The longest expression of identifiers that a line begins with, in one spelling; None if there is none."""
    tokens, at = [], 0
    while m := SPDX_TOKEN.match(line, at):
        tokens.append(m[1] or (m[2].upper() if m[2] else m[3]))
        at = m.end()

    words = {"AND", "OR", "WITH", "(", ")"}

    def term(k: int) -> tuple[str, int] | None:
        if k < len(tokens) and tokens[k] == "(":
            inner = expression(k + 1)
            return (f"({inner[0]})", inner[1] + 1) if inner and inner[1] < len(tokens) and tokens[inner[1]] == ")" else None
        if k >= len(tokens) or tokens[k] in words:
            return None
        if k + 2 < len(tokens) and tokens[k + 1] == "WITH" and tokens[k + 2] not in words:
            return f"{tokens[k]} WITH {tokens[k + 2]}", k + 3
        return tokens[k], k + 1

    def expression(k: int) -> tuple[str, int] | None:
        got = term(k)
        while got and got[1] < len(tokens) and tokens[got[1]] in ("AND", "OR") and (more := term(got[1] + 1)):
            got = f"{got[0]} {tokens[got[1]]} {more[0]}", more[1]
        return got

    found = expression(0)
    return found[0] if found else None


class Terms:
    """Words of the templates by number, then the buckets of all others; and what templates ask of a segment."""

    def __init__(self, templates: list[tuple[str, str]]):
        hashed = []
        for _, words, ptr, _ in _words(pa.array([t for _, t in templates] + DECIDING + list("123456789"), pa.string())):
            hashed += [words[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        self.known = np.unique(np.concatenate(hashed))
        self.n = len(self.known)
        terms = [np.searchsorted(self.known, h) for h in hashed]
        self.templates, marks = terms[: len(templates)], terms[len(templates) :]
        self.counts = np.stack([np.bincount(t, minlength=self.n) for t in self.templates]) if templates else np.zeros((0, self.n))
        deciding, digits = (np.concatenate(x) for x in (marks[: len(DECIDING)], marks[len(DECIDING) :]))
        has = self.counts > 0
        self.asked = np.zeros((len(templates), self.n), np.float32)
        self.asked[:, np.r_[deciding, digits]] = has[:, np.r_[deciding, digits]]
        self.shut = np.zeros((len(templates), self.n), np.float32)
        self.shut[:, deciding] = ~has[:, deciding]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known >> np.uint64(48)] = True

    def of(self, words: np.ndarray) -> np.ndarray:
        out = self.n + (words % np.uint64(BUCKETS)).astype(np.int64)
        at = np.flatnonzero(self.maybe[words >> np.uint64(48)])
        k = np.minimum(np.searchsorted(self.known, words[at]), self.n - 1)
        same = self.known[k] == words[at]
        out[at[same]] = k[same]
        return out


def _words(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(first row, word hashes, first word of each row, (line, paragraph) of each word), of lower-cased texts."""
    for i, _, buf, off in tc.chunks(pc.utf8_lower(arr)):
        starts, ends, ptr = tc.spans(buf, off, tc.PUNCT_SPACE)
        new_line = buf == 10
        visible = ~tc.WORD_SPACE[buf]
        line_at, seen = np.cumsum(new_line), np.r_[0, np.cumsum(visible)]
        at = np.flatnonzero(new_line)
        empty = seen[at] == seen[np.r_[0, at[:-1] + 1]] if len(at) else np.zeros(0, bool)  # nothing since the last line's end
        blank = np.zeros(len(buf), np.int64)
        blank[at[empty]] = 1
        row = tc.rows_of(ptr)
        lines = [np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (row[1:] != row[:-1])]) - 1 if len(starts) else row for k in (line_at[starts], np.cumsum(blank)[starts])]
        yield i, tc.word_hashes(buf, starts, ends), ptr, tuple(lines)


def _idf(files: DataFrame, terms: Terms) -> np.ndarray:
    """Weight of each term from the files that have it; the table has as many rows as there are terms, however many files."""
    width = terms.n + BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(width, np.int64), 0
        for b in batches:
            for _, words, ptr, _ in _words(b.column(0)):
                total += int((np.diff(ptr) > 0).sum())
                df += np.bincount(np.unique(tc.rows_of(ptr) * width + terms.of(words)) % width, minlength=width)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[total, df[some]])], ["term", "n"])

    got = files.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n, df = got.column("term").to_numpy(), got.column("n").to_numpy(), np.zeros(width, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    total = int(n[term < 0].sum())
    return np.log((1 + total) / (1 + df)) + 1


def own_licences(files: DataFrame, templates: list[tuple[str, str]] | None = None, cosine: float = COSINE) -> DataFrame:
    """files with own_licence and own_score, null where no segment reaches cosine."""
    prepare(files.sparkSession)
    templates = TEMPLATES if templates is None else templates
    terms = Terms(templates)
    idf = _idf(files, terms)
    names, n, width = [name for name, _ in templates], terms.n, terms.n + BUCKETS
    weights = terms.counts * idf[:n]
    weights = (weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12) * idf[:n]).T
    asked, shut, needs = terms.asked.T, terms.shut.T, terms.asked.sum(1)
    idf = idf.astype(np.float64)
    at_text = files.columns.index("text")

    def segments(t: np.ndarray, seg: np.ndarray, row: np.ndarray, found: dict[int, dict[str, float]], first: int) -> None:
        """Adds to found what the segments of a chunk are, by row and licence."""
        count = int(seg[-1]) + 1
        square, own = idf[t] ** 2, t < n
        # Repeated words make a vector longer than this, never shorter; what the templates' words can reach is at most their own length.
        foreign = np.bincount(seg, square * ~own, count)
        pair, times = np.unique(seg[own] * n + t[own], return_counts=True)
        inside = np.bincount(pair // n, (times * idf[pair % n]) ** 2, count)
        maybe = np.flatnonzero(inside >= (cosine - 1e-9) ** 2 * (inside + foreign))
        maybe = maybe[inside[maybe] > 0]
        if not len(maybe):
            return
        place = np.full(count, -1)
        place[maybe] = np.arange(len(maybe))
        mine = place[seg] >= 0
        pair, times = np.unique(place[seg[mine]] * width + t[mine], return_counts=True)
        at, term = pair // width, pair % width
        length = np.sqrt(np.bincount(at, (times * idf[term]) ** 2, len(maybe)))
        row_of = np.zeros(count, np.int64)
        row_of[seg] = row
        for s in range(0, len(maybe), AT_ONCE):
            e = min(s + AT_ONCE, len(maybe))
            cut = slice(*np.searchsorted(at, (s, e)))
            own = term[cut] < n
            x = np.zeros((e - s, n))
            x[at[cut][own] - s, term[cut][own]] = times[cut][own]
            cos = np.round(x @ weights / length[s:e, None], 9)
            near = np.flatnonzero((cos >= cosine).any(1))
            if not len(near):
                continue
            has = (x[near] > 0).astype(np.float32)
            good = (cos[near] >= cosine) & (has @ asked == needs) & (has @ shut == 0)
            for a, k in zip(*(v.tolist() for v in np.nonzero(good)), strict=True):
                scores = found.setdefault(first + int(row_of[maybe[s + near[a]]]), {})
                scores[names[k]] = max(scores.get(names[k], 0.0), float(cos[near[a], k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, found = b.column(at_text), {}
            for i, words, ptr, kinds in _words(text):
                if len(words):
                    t, row = terms.of(words), tc.rows_of(ptr)
                    for seg in kinds:
                        segments(t, seg, row, found, i)
            name, score = [None] * b.num_rows, [None] * b.num_rows
            for r, scores in found.items():
                inner = set().union(*(REFINES.get(k, ()) for k in scores))
                score[r], name[r] = min((-c, k) for k, c in scores.items() if k not in inner)
                score[r] = -score[r]
            for r in np.flatnonzero(pc.match_substring(text, "spdx-license-identifier:", ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
                if said := next(filter(None, (spdx(m[1]) for m in SPDX.finditer(text[r].as_py()))), None):
                    name[r], score[r] = said, 1.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "own_licence", "own_score"])

    return files.mapInArrow(run, files.select("*", F.lit(None).cast("string").alias("own_licence"), F.lit(None).cast("double").alias("own_score")).schema)


def directory(path: Column) -> Column:
    """All but the last segment; the empty string at the top."""
    return F.regexp_replace(F.regexp_replace(path, "/?[^/]*$", ""), "^/+|/+$", "")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """files (with own_licence, own_score) with licence, found ('own' or 'inherited'), given_by and levels_up."""
    prepare(files.sparkSession)
    here = files.withColumn("__dir", directory(F.col(path)))
    is_licence = F.regexp_extract(F.col(path), "([^/]*)$", 1).rlike(LICENCE_FILE)
    better = F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l"), F.col(path).alias("p")))
    given = here.where(is_licence & F.col("own_licence").isNotNull()).groupBy(F.col("__dir").alias("up")).agg(better.alias("best")).select("up", F.col("best.l").alias("l"), F.col("best.p").alias("p"))
    given = written(given, "given")
    parts = F.when(F.col("__dir") == "", F.array().cast("array<string>")).otherwise(F.split("__dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct((F.size("parts") - k).alias("levels"), F.array_join(F.slice("parts", F.lit(1), k), "/").alias("up")))
    dirs = here.where(F.col("own_licence").isNull() & F.col("__dir").isNotNull()).select("__dir").distinct().withColumn("parts", parts)
    ups = dirs.select("__dir", F.explode(above).alias("a")).select("__dir", "a.*")
    nearest = ups.join(given, "up").groupBy("__dir").agg(F.min(F.struct("levels", "l", "p")).alias("n")).select(F.col("__dir").alias("d"), "n")
    # A written table, so that the join's sides are plain shuffles and AQE can split a directory of very many files.
    h, g = here.alias("h"), written(nearest, "nearest").alias("g")
    own = F.col("h.own_licence").isNotNull()
    return h.join(g, ~own & (F.col("h.__dir") == F.col("g.d")), "left").select(
        *(F.col(f"h.`{c}`") for c in files.columns),
        F.coalesce("h.own_licence", "g.n.l").alias("licence"),
        F.when(own, "own").when(F.col("g.d").isNotNull(), "inherited").alias("found"),
        F.when(own, F.col(f"h.`{path}`")).otherwise(F.col("g.n.p")).alias("given_by"),
        F.when(~own, F.col("g.n.levels")).alias("levels_up"),
    )


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, cosine: float = COSINE) -> DataFrame:
    """files (path, text, ...) with what own_licences and inherit add."""
    return inherit(own_licences(files, templates, cosine))


def files_of(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): the driver's documents have no path, so a rule makes their sources into trees of files."""
    d = F.col("doc_id")
    root = F.coalesce("source", F.lit("none"))
    one, two = F.concat(F.lit("a"), F.floor(d / 100) % 10), F.concat(F.lit("b"), F.floor(d / 10) % 10)
    level = F.floor(d / 10) % 3
    licence = F.when(level == 0, F.concat_ws("/", root, F.concat(F.lit("LICENSE."), d))).when(level == 1, F.concat_ws("/", root, one, F.concat(F.lit("LICENSE."), d))).otherwise(F.concat_ws("/", root, one, two, F.concat(F.lit("COPYING."), d)))
    return docs.select("doc_id", F.when(d % 10 == 0, licence).otherwise(F.concat_ws("/", root, one, two, F.concat(d, F.lit(".txt")))).alias("path"), "text")


def brute_force(files: list[tuple[str | None, str | None]], templates: list[tuple[str, str]], cosine: float = COSINE) -> list[tuple]:
    """(own_licence, own_score, licence, levels_up) of each file, word by word; for tests."""
    import math
    from collections import Counter

    cut = lambda s: re.findall("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", s.lower())
    known = {w for _, t in templates for w in cut(t)} | set(DECIDING) | set("123456789")
    cache: dict[str, object] = {}

    def term(w: str):
        if w not in cache:
            cache[w] = w if w in known else int(next(_words(pa.array([w], pa.string())))[1][0] % np.uint64(BUCKETS))
        return cache[w]

    pieces = [[x for x in map(cut, (t or "").split("\n")) if x] + [x for x in map(cut, re.split(r"\n[ \t\r\x0b\x0c]*(?=\n)", t or "")) if x] for _, t in files]
    total, df = sum(1 for p in pieces if p), Counter(x for p in pieces for x in {term(w) for s in p for w in s})
    idf = lambda x: math.log((1 + total) / (1 + df[x])) + 1
    marks = lambda words: {w for w in words if w in DECIDING}
    want = [(name, Counter(cut(t))) for name, t in templates]
    norm = [math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items())) for _, c in want]
    own = []
    for p, (_, text) in zip(pieces, files, strict=True):
        found: dict[str, float] = {}
        for s in p:
            have = Counter(term(w) for w in s)
            length = math.sqrt(sum((n * idf(x)) ** 2 for x, n in have.items()))
            for (name, c), size in zip(want, norm, strict=True):
                cos = round(sum(n * idf(w) * have[w] * idf(w) for w, n in c.items() if w in have) / length / size, 9)
                if cos >= cosine and marks(c) == marks(have) and all(w in have for w in c if w in set("123456789")):
                    found[name] = max(cos, found.get(name, 0))
        found = {k: c for k, c in found.items() if not any(k in REFINES.get(x, ()) for x in found)}
        best = min(((-c, k) for k, c in found.items()), default=(None, None))
        said = [x for line in (text or "").replace("\r", "\n").split("\n") if "spdx-license-identifier:" in line.lower() for x in [spdx(re.split("spdx-license-identifier:", line, flags=re.I)[1])] if x]
        own.append((said[0], 1.0) if said else (best[1], None if best[0] is None else -best[0]))
    out = []
    for (path, _), (name, score) in zip(files, own, strict=True):
        licence, up = name, None
        if name is None and path is not None:
            parts = [x for x in path.split("/")[:-1]]
            for k in range(len(parts), -1, -1):
                there = [(-s, n, q) for (q, _), (n, s) in zip(files, own, strict=True) if n and q and q.split("/")[:-1] == parts[:k] and re.match(LICENCE_FILE, q.split("/")[-1])]
                if there:
                    licence, up = min(there)[1], len(parts) - k
                    break
        out.append((name, score, licence, up))
    return out
