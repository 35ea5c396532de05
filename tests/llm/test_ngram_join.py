import random

from loomstat.llm import ngram_join as op


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in op.jaccard_join(df, **how).drop("tk", "class_key").collect()), key=str)
    assert got == sorted(op.brute_force(rows), key=str)


def near_rows(rnd, groups=12):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 150))]
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


def test_matches_brute_force(spark):
    rows = near_rows(random.Random(5))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "a  b"), (2005, "a b c"), (None, rows[0][1]), (None, None), rows[3], rows[3]]
    check(spark, rows)


def test_blocks_and_deep_trees_lose_no_link(spark):
    check(spark, near_rows(random.Random(6), 6), small=3, block=4)


def test_empty_table_and_clashing_columns(spark):
    assert op.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", b"x", 1, 2)], "doc_id long, text string, sig binary, root int, tk int")
    assert op.jaccard_join(df).drop("tk", "class_key").collect() == [(1, 1, 0)]


def test_runs_for():
    assert op.runs_for(0.8) >= 4 and op.runs_for(1.0) == 1


def test_recall_of_pairs_at_the_threshold(spark):
    """400 pairs of 100 sequences each, 89 of them in common: a similarity of 0.802."""
    rnd = random.Random(12)
    words = lambda n: [f"{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(400):
        w = words(104)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:93] + words(11)))]
    out = op.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = sum(r.n_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in out)
    assert found >= 0.995 * len(rows)
