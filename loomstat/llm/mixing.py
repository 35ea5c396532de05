"""Mixing sources to target weights by capped water-filling.

Sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share all words by weight. A
target stops at ``max_epochs`` times its source's size; what it cannot take goes to the others by weight,
until none is above. The targets are level * weight for the sources below their cap, and the level has a
closed form once sources are ordered by cap / weight, so two windows over the table of sources give it.

A source takes each document floor(target / size) times, and once more the documents with the lowest
seeded hashes, up to the target to within half a document. The cut is found in two steps, by sums of
4096 hash ranges and by the hashes of the one range it falls into, summed up before their shuffle. The
plan that comes of it has one row for each source, so that documents are not shuffled to learn their part.

Rows equal in doc_id and text share their hash and follow each other; where the cut falls among them, the
first so many of them are taken once more, by their number, which is found without a task that holds them
all. Null texts have size 0; a source without words has target 0 and takes nothing. An empty table gives
an empty mix. Other columns are kept by ``epochs`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, written

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = 17
#: Hexadecimal digits of the hash that make a range.
DIGITS = 3
#: Buckets in which equal rows at the cut are counted.
BUCKETS = 1024
WORDS = "[^\\x20\\x09-\\x0D]+"


def order_of(seed: int = SEED) -> Column:
    """The hash of doc_id and text that orders the documents of a source."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce("text", F.lit("")))))


def size_of() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long")


def targets(per_source: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    d: Column = F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0))
    return (
        per_source.withColumn("n", rank)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", d.cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))).cast("double"))
        # In this order, sources are capped up to the first whose cap is not below the level that those before leave.
        .withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "n", "level"))).over(everything)["level"])
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))
    )


def plan(rows: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each source of rows (source, size, h), as a written table.

    Every document is taken ``whole`` times; those with a hash below ``cut`` once more, and of the ``copies`` rows at
    the cut, of ``cut_size`` words each, the k-th one if ``before`` + (k - 1/2) * cut_size is not above ``rest``.
    """
    dealt = rows.select("source", "size", "h", F.conv(F.substring("h", 1, DIGITS), 16, 10).cast("int").alias("range"))
    per_range = written(dealt.groupBy("source", "range").agg(F.sum("size").alias("in_range")), "ranges")
    goal = targets(per_range.groupBy("source").agg(F.sum("in_range").alias("source_size")), max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = written(goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goal")
    upto = F.sum("in_range").over(Window.partitionBy("source").orderBy("range"))
    ranges = per_range.withColumn("below", upto - F.col("in_range")).alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    hit = (F.col("below") <= F.col("rest")) & (F.col("below") + F.col("in_range") > F.col("rest"))
    cuts = written(ranges.where(hit).select("r.source", "range", "below", "rest"), "cuts")
    near = dealt.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.range") == F.col("c.range")))
    near = near.groupBy("d.source", "d.range", "h").agg(F.count("*").alias("copies"), F.max("size").alias("cut_size"), F.max("below").alias("below"), F.max("rest").alias("rest"))
    words = F.col("copies") * F.col("cut_size")
    earlier = F.sum(words).over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("before", F.col("below") + F.coalesce(earlier, F.lit(0)))
    # The first hash whose rows are not all taken; without one, the range is, and the cut is at its end.
    open_ = F.col("before") + words - F.col("cut_size") / 2 > F.col("rest")
    first = near.groupBy("source").agg(F.min(F.when(open_, F.struct("h", "before", "copies", "cut_size"))).alias("at"), F.max("range").alias("range"))
    end = F.when(F.col("range") + 1 < 16**DIGITS, F.lpad(F.lower(F.hex(F.col("range") + 1)), DIGITS, "0")).otherwise(F.lit("g"))
    g, f = goal.alias("g"), first.alias("f")
    return written(g.join(f, F.col("g.source").eqNullSafe(F.col("f.source")), "left").select(
        "g.*", F.coalesce("f.at.h", end, F.lit("")).alias("cut"), F.coalesce("f.at.before", F.lit(0)).cast("long").alias("before"),
        F.coalesce("f.at.copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("f.at.cut_size", F.lit(0)).cast("long").alias("cut_size"),
    ), "plan")


def _assigned(rows: DataFrame, made: DataFrame, max_epochs: int) -> DataFrame:
    """rows (source, size, h, ...) with source_size, target and times."""
    columns, made = rows.columns, made.withColumnRenamed("source", "__source")
    both = rows.join(made, F.col("source").eqNullSafe(F.col("__source")))
    result = lambda more: [*columns, "source_size", "target", F.least(F.col("whole") + more.cast("int"), F.lit(max_epochs).cast("long")).alias("times")]
    taken = lambda k: F.col("before") + k * F.col("cut_size") - F.col("cut_size") / 2 <= F.col("rest")
    tied = (F.col("copies") > 1) & taken(F.lit(1))
    if made.where(tied).isEmpty():
        return both.select(*result(F.col("h") < F.col("cut")))
    at_cut = tied & (F.col("h") == F.col("cut"))
    # Equal rows at the cut are numbered bucket by bucket.
    few = written(both.where(at_cut).withColumn("__id", F.monotonically_increasing_id()), "tied").withColumn("__bucket", F.pmod(F.xxhash64("__id"), F.lit(BUCKETS)))
    sums = few.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    sums = written(sums.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), (F.sum("__n").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("__n")).alias("__k")), "buckets")
    k = F.col("__k") + F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__id"))
    numbered = few.join(sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).withColumn("__k", k)
    return both.where(~at_cut).select(*result(F.col("h") < F.col("cut"))).unionByName(numbered.select(*result(taken(F.col("__k")))))


def epochs(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs with __size, __source_size, __target and __times: how often the mix takes each row."""
    prepare(docs.sparkSession)
    rows = docs.select("source", size_of().alias("size"), order_of(seed).alias("h"))
    made = plan(written(rows, "sizes"), max_epochs, weights)
    named = docs.select(F.struct(*docs.columns).alias("__row"), "source", size_of().alias("size"), order_of(seed).alias("h"))
    more = [F.col(c).alias(f"__{c}") for c in ("size", "source_size", "target", "times")]
    return _assigned(named, made, max_epochs).select("__row.*", *more)


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): taken is the words that the mix has of a document, with repeats."""
    prepare(docs.sparkSession)
    rows = written(docs.select("doc_id", "source", size_of().alias("size"), order_of(seed).alias("h")), "sizes")
    return _assigned(rows, plan(rows, max_epochs, weights), max_epochs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


#: mix(documents) with the cut found by one window over each source.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':{SEED}:', md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
c AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], ((n - 1) % {len(WEIGHTS)} + 1)::INT)::BIGINT AS weight, source_size * {MAX_EPOCHS} AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
      FROM c WINDOW f AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM l WHERE cap >= level * weight ORDER BY cap / weight, n LIMIT 1) * weight) AS target FROM l),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS through FROM e)
SELECT doc_id, size, source_size, target,
       (size * least({MAX_EPOCHS}, whole + CASE WHEN through - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM t"""


def brute_force(rows: list[tuple], max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> list[tuple]:
    """What mix gives for rows (doc_id, text, source), by raising the level step by step and taking rows one by one; for tests."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, capped = {}, set()
    while names:
        left = sum(total.values()) - sum(target[s] for s in capped)
        target |= {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in names if s not in capped and target[s] > max_epochs * total[s]}
        if not over:
            break
        target |= {s: max_epochs * total[s] for s in over}
        capped |= over
        if len(capped) == len(names):
            break
    out = []
    for s in names:
        own = sorted(((md5(f"{'' if d is None else d}:{seed}:{md5(t or '')}"), d, size(t)) for d, t, x in rows if x == s), key=lambda r: r[0])
        whole = int(target[s] // total[s]) if total[s] else 0
        through, rest = 0, target[s] - whole * total[s]
        for _, d, n in own:
            through += n
            out.append((d, n, total[s], float(target[s]), n * min(max_epochs, whole + (through - n / 2 <= rest))))
    return out
