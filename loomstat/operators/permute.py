"""Two-group permutation tests over all connections.

Permutation 0 is the observed labelling. The statistic of a connection is mean(A) - mean(B), an empty group
having mean 0, and p = (number of permutations >= 1 whose statistic is at least the observed one + 1) /
(P + 1), where P counts permutation 0; two-tailed, absolute values are compared.

``gemm`` keeps the values of a connection as an array ordered by subject and counts exceedances inside an
Arrow batch: a block of permutations at a time as a matrix product, so nothing of size connections times
permutations ever exists, and connections need no shuffle but the one that builds their arrays. The labels,
a bit for each permutation and subject, go to the tasks after a check of their size. ``sql`` is the same as
joins and sums, for a small number of permutations or engines without Python.

With whole numbers sums are exact, and with groups of one size for all permutations they are compared as
numbers scaled by it, so ties count as ties. A NaN compares as false, as it does in the reference; then
``nan="propagate"`` (the default) gives p NULL, and ``nan="reference"`` 1 / (P + 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import ship

#: Bytes of packed labels that may go to every task.
MOST_LABELS = 256 << 20
BLOCK = 1024
#: Connections worked on at a time.
ROWS = 64


def one_hot(perms: DataFrame, subjects: int) -> DataFrame:
    """(perm, subj, in_a) from (perm, a ARRAY); numbers outside 0..subjects-1 are ignored."""
    return perms.select("perm", F.explode(F.sequence(F.lit(0), F.lit(subjects - 1))).alias("subj"), "a").select("perm", "subj", F.array_contains("a", F.col("subj")).alias("in_a"))


def aligned(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vals): the values of a connection as an array ordered by subject."""
    return values.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("subj", "value"))).alias("s")).select(*keys, F.transform("s", lambda x: x["value"]).alias("vals"))


def group_difference(values: DataFrame, keys: list[str], in_a: Column) -> DataFrame:
    """(keys, tstat): mean of group A less mean of group B."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("value").cast("double"))), F.lit(0.0))
    return values.groupBy(*keys).agg((mean(in_a) - mean(~in_a)).alias("tstat"))


def _finish(p: Column, bad: Column, nan: str, perms: int) -> Column:
    return F.when(bad, F.lit(None).cast("double") if nan == "propagate" else F.lit(1.0 / (perms + 1))).otherwise(p)


def permutation_test(values: DataFrame, keys: list[str], perms: DataFrame, subjects: int, two_tailed: bool = False, method: str = "gemm", nan: str = "propagate") -> DataFrame:
    """(keys, pvalue, tstat) from values (keys, subj, value) and perms (perm, a ARRAY of subjects in group A)."""
    if method not in ("gemm", "sql") or nan not in ("propagate", "reference"):
        raise ValueError("method is gemm or sql, nan is propagate or reference")
    return (_gemm if method == "gemm" else _sql)(values, keys, perms, subjects, two_tailed, nan)


def _sql(values: DataFrame, keys: list[str], perms: DataFrame, subjects: int, two_tailed: bool, nan: str) -> DataFrame:
    labels = one_hot(perms, subjects)
    sums = values.join(labels, "subj").groupBy(*keys, "perm").agg(
        F.sum(F.when(F.col("in_a"), F.col("value"))).alias("sa"), F.sum(F.when(~F.col("in_a"), F.col("value"))).alias("sb"),
        F.count(F.when(F.col("in_a"), 1)).alias("na"), F.count(F.when(~F.col("in_a"), 1)).alias("nb"), F.max(F.isnan(F.col("value").cast("double"))).alias("bad"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a, b, na, nb = zero("sa"), zero("sb"), F.greatest("na", F.lit(1)), F.greatest("nb", F.lit(1))
    # nA * nB * statistic: whole for whole values, and of one scale if group sizes are.
    stat = a * nb - b * na
    t = a.cast("double") / na.cast("double") - b.cast("double") / nb.cast("double")
    same = perms.select(F.size("a").alias("n")).agg(F.count_distinct("n")).first()[0] <= 1
    by = stat if same else t
    s = sums.select(*keys, "perm", (F.abs(by) if two_tailed else by).alias("s"), t.alias("t"), "bad")
    own = Window.partitionBy(*keys)
    seen = F.max(F.when(F.col("perm") == 0, F.col("s"))).over(own)
    n = perms.count()
    counted = s.withColumn("at_least", ((F.col("perm") > 0) & (F.col("s") >= seen)).cast("int"))
    out = counted.groupBy(*keys).agg(F.sum("at_least").alias("n"), F.max(F.when(F.col("perm") == 0, F.col("t"))).alias("tstat"), F.max("bad").alias("bad"))
    p = (F.col("n") + 1).cast("double") / F.lit(float(n + 1))
    return out.select(*keys, _finish(p, F.col("bad"), nan, n).alias("pvalue"), "tstat")


def _gemm(values: DataFrame, keys: list[str], perms: DataFrame, subjects: int, two_tailed: bool, nan: str) -> DataFrame:
    ship(values.sparkSession)
    n = perms.count()
    if n * (-(-subjects // 8)) > MOST_LABELS:
        raise ValueError(f"{n} permutations of {subjects} subjects are more than {MOST_LABELS} bytes of labels; use method='sql'")
    rows = perms.orderBy("perm").select("a").toArrow().column("a").to_pylist()
    onehot = np.zeros((n, subjects), bool)
    for k, a in enumerate(rows):
        onehot[k, [s for s in a if 0 <= s < subjects]] = True
    packed = values.sparkSession.sparkContext.broadcast(np.packbits(onehot, axis=1))
    sizes = onehot.sum(1)
    same = bool((sizes == sizes[0]).all()) if n else True
    whole = dict(values.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vals = b.column(b.num_columns - 1)
            x = vals.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            # Doubles hold whole statistics up to 2**53, and have a fast product.
            small = not whole or float(np.abs(x).max(initial=0)) * max(1, subjects) ** 3 < 2**53
            x = x.astype(np.float64 if small else np.int64)
            total = x.sum(1, keepdims=True)
            count, seen, t = np.zeros(len(x), np.int64), np.zeros((len(x), 1), x.dtype), np.zeros(len(x))
            for s in range(0, n, BLOCK):
                lab = np.unpackbits(packed.value[s : s + BLOCK], axis=1, count=subjects)
                na = lab.sum(1).astype(np.int64)
                nb = subjects - na
                na, nb = (np.maximum(v, 1).astype(x.dtype) for v in (na, nb))
                lab = np.ascontiguousarray(lab.T.astype(x.dtype))
                for r in range(0, len(x), ROWS):  # what is worked on stays in the cache
                    a, all_ = x[r : r + ROWS] @ lab, total[r : r + ROWS]
                    if s == 0:
                        t[r : r + ROWS] = a[:, 0].astype(float) / na[0] - (all_[:, 0] - a[:, 0]).astype(float) / nb[0]
                    rest = all_ - a
                    if same:
                        a *= nb
                        rest *= na
                    else:
                        a, rest = a / na, rest / nb
                    a -= rest
                    if two_tailed:
                        np.abs(a, out=a)
                    if s == 0:
                        if not same:
                            seen = seen.astype(float)
                        seen[r : r + ROWS] = a[:, :1]
                    with np.errstate(invalid="ignore"):
                        count[r : r + ROWS] += np.count_nonzero(a >= seen[r : r + ROWS], axis=1) - (s == 0) * (a[:, 0] >= seen[r : r + ROWS, 0])
            p = (count + 1) / float(n + 1)
            bad = np.isnan(x).any(1) if not whole else np.zeros(len(x), bool)
            if nan == "propagate":
                p = pa.array(p, mask=bad)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], p if isinstance(p, pa.Array) else pa.array(p), pa.array(t)], [*keys, "pvalue", "tstat"])

    # The work is connections by permutations, so the few bytes of the former must not be put together in few tasks.
    table = aligned(values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys), keys)
    kinds = dict(table.dtypes)
    return table.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "pvalue double", "tstat double"]))


def random_permutations(spark, n_a: int, n_b: int, count: int, seed: int = 0) -> DataFrame:
    """(perm, a): distinct subsets of n_a of n_a + n_b subjects, sorted, drawn by hashes; permutation 0 is the first n_a."""
    total = n_a + n_b
    if count > comb(total, n_a):
        raise ValueError(f"there are only {comb(total, n_a)} subsets of {n_a} of {total}")
    first = spark.range(1).select(F.sequence(F.lit(0), F.lit(n_a - 1)).alias("a"), F.lit(-1).cast("long").alias("draw")) if n_a else spark.range(1).select(F.array().cast("array<int>").alias("a"), F.lit(-1).cast("long").alias("draw"))
    draws = max(2 * count, 64)
    while True:
        ranked = F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), F.col("id"), s).alias("h"), s.alias("s")))
        drawn = spark.range(draws).select(F.sort_array(F.transform(F.slice(F.sort_array(ranked), 1, max(n_a, 1)), lambda x: x["s"])).alias("a"), F.col("id").alias("draw")) if n_a else first
        unique = first.unionByName(drawn).groupBy("a").agg(F.min("draw").alias("draw"))
        if unique.count() >= count:
            break
        draws *= 4
    # The list goes to every task in any case, so its order may come from one.
    return unique.withColumn("perm", (F.row_number().over(Window.orderBy("draw")) - 1).cast("int")).where(F.col("perm") < count).select("perm", "a")
