import random
from collections import Counter

from pyspark.sql import functions as F

from loomstat.llm import mixing as op


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in op.mix(df, **how).collect())
    want = Counter((d, n, s, round(t, 6), k) for d, n, s, t, k in op.brute_force(rows, **how))
    assert got == want
    return df


def text(rnd, most=30):
    return " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, most)))


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    for sources in (["a"], ["a", "b"], ["a", "b", "c", None, "é", "Z"]):
        check(spark, [(i, text(rnd), sources[min(int(rnd.expovariate(1)), len(sources) - 1)]) for i in range(200)])
    check(spark, [(i, text(rnd), rnd.choice("ab")) for i in range(100)], max_epochs=1, weights=(1, 3), seed=4)


def test_sources_come_near_their_targets(spark):
    rnd = random.Random(2)
    rows = [(i, text(rnd, 60), rnd.choice("aaaaaaaabbc")) for i in range(2000)]
    df = check(spark, rows)
    per = op.mix(df).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 3 and all(abs(r.taken - r.target) <= 30 for r in per)
    assert op.mix(df).where("taken > 3 * size").count() == 0


def test_equal_rows_at_the_cut_are_taken_by_count(spark):
    same, rnd = "one two three", random.Random(3)
    rows = [(7, same, "a")] * 1000 + [(i, text(rnd), "b") for i in range(400)]
    df = check(spark, rows)
    taken = op.mix(df).where("doc_id = 7 AND source_size = 3000").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).first()
    assert abs(taken.n - taken.t) <= 3
    kept = op.epochs(df.withColumn("size", F.col("doc_id") + 1).withColumn("cut", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "source", "size", "cut", "__size", "__source_size", "__target", "__times"]
    assert Counter((r.doc_id, r["__size"] * r["__times"]) for r in kept.collect()) == Counter((r.doc_id, r.taken) for r in op.mix(df).collect())
    check(spark, [(None, same, None)] * 50 + [(1, same + " four", "x")] * 3)


def test_nulls_empty_and_long(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (None, "x y", "a"), (3, " \t\n", "none"), (4, None, "none"), (5, "w " * 50000, "long"), (6, "z", None), (6, "z", None), (6, "z", "a")]
    check(spark, rows)
    check(spark, [(1, "", "a"), (2, None, "b")])
    check(spark, [(1, "a", "a")])
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert op.mix(empty).count() == 0 and op.epochs(empty).count() == 0


def test_targets_are_water_filling(spark):
    rnd = random.Random(5)
    for _ in range(3):
        sizes = [(f"s{k}", rnd.choice([0, 1, 10, 1000, 100000])) for k in range(rnd.randint(1, 9))]
        got = {r.source: r.target for r in op.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        weight = {s: op.WEIGHTS[k % 3] for k, (s, _) in enumerate(sorted(sizes))}
        size = dict(sizes)
        assert abs(sum(got.values()) - sum(size.values())) < 1e-6 * max(1, sum(size.values()))
        level = [got[s] / weight[s] for s in got if got[s] < 3 * size[s] - 1e-9]
        assert not level or max(level) - min(level) < 1e-6 * max(level)
        assert all(got[s] <= 3 * size[s] + 1e-9 for s in got)
