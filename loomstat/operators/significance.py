"""Which pairs are significant, and how p-values are distributed.

Everything here is one pass: thresholds, moments and the logarithmic histogram are partial aggregates.
Bins are 10**(-20 + 20 b / bins) wide open at the left, closed at the right, clipped at both ends; a value's
bin comes from its logarithm and is then moved to agree with the edges themselves, which are floating
numbers. Nulls are not counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import numbered, written

BINS = 10_000
DECADES = 20
THRESHOLDS = (0.05, 0.01, 0.001, 0.0005, 0.0001)
PERCENTS = (1, 5, 10, 15, 20)


def edges_of(permout: DataFrame, coords: DataFrame, threshold: float | None = 0.05) -> DataFrame:
    """Edges (i1, j1, k1, i2, j2, k2, pvalue, tstat) of the pairs below a threshold.

    Pairs are filtered before the joins; coords has a row for each voxel, so AQE broadcasts it if it is small.
    """
    rows = permout if threshold is None else permout.where(F.col("pvalue") < threshold)
    a, b = (coords.select(F.col("vox").alias(v), *(F.col(c).alias(f"{c}{k}") for c in "ijk")) for k, v in ((1, "i"), (2, "j")))
    rest = [c for c in rows.columns if c not in ("i", "j")]
    return rows.join(a, "i").join(b, "j").select("i1", "j1", "k1", "i2", "j2", "k2", *rest)


def check_count(pairs: DataFrame, voxels: int) -> None:
    """Raises unless there are voxels (voxels - 1) / 2 pairs."""
    if (n := pairs.count()) != voxels * (voxels - 1) // 2:
        raise ValueError(f"{n} pairs, but {voxels} voxels have {voxels * (voxels - 1) // 2}")


def summary(df: DataFrame, col: str = "pvalue") -> DataFrame:
    """Count, extremes, sums, mean and population deviation (0 for no rows)."""
    v = F.col(col).cast("double")
    n = F.count(v)
    var = F.greatest(F.lit(0.0), F.try_divide(F.sum(v * v), n) - F.pow(F.try_divide(F.sum(v), n), 2))
    return df.agg(n.alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_sq"), F.avg(v).alias("mean"), F.coalesce(F.sqrt(var), F.lit(0.0)).alias("std"))


def threshold_counts(df: DataFrame, col: str = "pvalue", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, n, percent) of the values below each threshold, from one aggregate."""
    one = df.agg(F.count(col).alias("all"), *(F.count_if(F.col(col) < t).alias(f"t{k}") for k, t in enumerate(thresholds)))
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("n")) for k, t in enumerate(thresholds)))
    return one.select("all", F.inline(pairs)).select("threshold", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("all")), F.lit(0.0)).alias("percent"))


def verdict(df: DataFrame, perms: int, col: str = "pvalue") -> DataFrame:
    """Zeros, ones and extremes, and whether all values lie in [1 / (P + 1), 1]."""
    low = 1.0 / (perms + 1)
    one = df.agg(F.count(col).alias("n"), F.count_if(F.col(col) == 0).alias("zeros"), F.count_if(F.col(col) == 1).alias("ones"), F.min(col).alias("min"), F.max(col).alias("max"))
    return one.withColumn("verdict", F.when((F.col("zeros") == 0) & (F.col("min") >= low * (1 - 1e-6)) & (F.col("max") <= 1), "pass").otherwise("fail"))


def edge(b: Column, bins: int = BINS) -> Column:
    return F.pow(F.lit(10.0), (b * float(DECADES)) / float(bins) - float(DECADES))


def log_bin(p: Column, bins: int = BINS) -> Column:
    """The bin of a p-value; NaN and null have none."""
    guess = F.ceil((F.log10(p) + float(DECADES)) * bins / float(DECADES)) - 1
    low = F.when(p > edge(guess + 1, bins), guess + 1).when(p <= edge(guess, bins), guess - 1).otherwise(guess)
    clipped = F.greatest(F.lit(0).cast("long"), F.least(F.lit(bins - 1).cast("long"), low))
    return F.when(p.isNull() | F.isnan(p), None).when(p <= 0, F.lit(0).cast("long")).otherwise(clipped)


def log_histogram(df: DataFrame, col: str = "pvalue", bins: int = BINS) -> DataFrame:
    """(bin, left, right, count) of the bins that have values."""
    b = df.select(log_bin(F.col(col).cast("double"), bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))
    return b.select("bin", edge(F.col("bin"), bins).alias("left"), edge(F.col("bin") + 1, bins).alias("right"), "count")


def merged(histograms: DataFrame) -> DataFrame:
    """One histogram of several."""
    return histograms.groupBy("bin", "left", "right").agg(F.sum("count").alias("count"))


def running(hist: DataFrame) -> DataFrame:
    """hist with center, density, cumulative and cumulative_pct. At most one row for each bin, so one window may hold all."""
    total = F.sum("count").over(Window.partitionBy())
    cum = F.sum("count").over(Window.orderBy("bin"))
    return hist.select("bin", F.sqrt(F.col("left") * F.col("right")).alias("center"), "left", "right", "count", (F.col("count") / (total * (F.col("right") - F.col("left")))).alias("density"), cum.alias("cumulative"), (100.0 * cum / total).alias("cumulative_pct"))


def histogram_percentiles(hist: DataFrame, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """(percent, value): right edge of the first bin up to which ceil(n * percent / 100) values lie."""
    r = hist.select("bin", "right", F.sum("count").over(Window.orderBy("bin")).alias("cum"), F.sum("count").over(Window.partitionBy()).alias("n"))
    one = r.agg(*(F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * float(p) / 100.0), F.col("right"))).alias(f"p{k}") for k, p in enumerate(percents)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(float(p)).alias("percent"), F.col(f"p{k}").alias("value")) for k, p in enumerate(percents)))))


def exact_percentiles(df: DataFrame, col: str, places: list[tuple[float, float]], bins: int = BINS) -> DataFrame:
    """(label, value): the value at rank floor(n * share), clamped, of (label, share) pairs.

    The histogram says which bin holds each rank. The distinct values of those bins are numbered by ranges with
    their counts, so neither ties nor a bin with most of the values meet in one task.
    """
    v = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").withColumn("bin", log_bin(F.col("v"), bins))
    hist = v.groupBy("bin").agg(F.count("*").alias("c"))
    cum = hist.select("bin", "c", F.sum("c").over(Window.orderBy("bin")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    want = F.array(*(F.struct(F.lit(float(a)).alias("label"), F.lit(float(s)).alias("share")) for a, s in places))
    ranks = cum.select("*", F.inline(want)).withColumn("rank", F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)).where("rank < upto AND rank >= upto - c")
    ranks = written(ranks.select("bin", "c", "label", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("in_bin")), "ranks")
    # Bins and labels: a row for each place that is asked for.
    picked = ranks.select("bin", "c").distinct().select("bin", (F.sum("c").over(Window.orderBy("bin")) - F.col("c")).alias("first"))
    at = ranks.join(picked, "bin").select("label", (F.col("first") + F.col("in_bin")).alias("at"))
    values = v.join(F.broadcast(picked.select("bin")), "bin", "left_semi").groupBy("v").agg(F.count("*").alias("times"))
    values = numbered(values, [F.col("v")], "k", "times")
    return values.join(F.broadcast(at), (F.col("at") >= F.col("k")) & (F.col("at") < F.col("k") + F.col("times"))).select("label", F.col("v").alias("value"))


def deciles(df: DataFrame, col: str = "pvalue") -> DataFrame:
    """(decile, value) for deciles 0 to 10."""
    return exact_percentiles(df, col, [(i, i / 10) for i in range(11)]).select(F.col("label").cast("int").alias("decile"), "value")


def top_tstat(edges: DataFrame, top_n: int | None = None, threshold: float | None = None) -> DataFrame:
    """The edges with the top_n largest tstat, all ties at the cut kept, or those with tstat >= threshold."""
    if (top_n is None) == (threshold is None):
        raise ValueError("give exactly one of top_n and threshold")
    if threshold is not None:
        return edges.where(F.col("tstat") >= threshold)
    # The N-th largest value by a top-k, which keeps N rows a task, then a filter: no global sort.
    cut = edges.select("tstat").orderBy(F.desc("tstat")).limit(top_n).agg(F.min("tstat").alias("cut"), F.count("*").alias("n")).first()
    return edges if cut["n"] < top_n else edges.where(F.col("tstat") >= F.lit(cut["cut"])) if not math.isnan(cut["cut"]) else edges.where(F.isnan("tstat"))
