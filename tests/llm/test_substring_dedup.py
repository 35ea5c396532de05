import random

from loomstat.llm import substring_dedup as op


def check(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in op.digest(df).collect()), key=str)
    assert got == sorted(op.brute_force(rows), key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = words(60)
    rows = [(i, " ".join(words(rnd.randint(1, 90)) + (shared[rnd.randint(0, 10) :] if i % 3 == 0 else []) + words(20))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # exact copies
    rows += [(200, "a b " * 60), (201, "x " * 36), (202, "y " * 35), (203, "\t ".join(shared) + "\n"), (204, " ".join(shared[:34])), (205, " ".join(shared[:35]))]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, rows[0][1]), (None, None), (303, " ".join(shared) + " x"), rows[3], rows[3]]
    check(spark, rows)


def test_long_text_and_empty_table(spark):
    check(spark, [(1, " ".join(str(i) for i in range(50000))), (2, " ".join(str(i) for i in range(40000, 40100)))])
    assert op.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a " * 80, 5, "h", True)], "doc_id long, text string, n int, h string, mixed boolean")
    assert op.digest(df).first().n_removed == 80


def test_any_split_into_batches_gives_the_same(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = [words(70) for _ in range(4)]
    rows = []
    for i in range(80):
        s = rnd.choice(shared)
        a = rnd.randint(0, 30)
        rows.append((i, " ".join(words(rnd.randint(0, 40)) + (s[a : a + rnd.randint(30, 45)] if i % 2 else []) + words(10))))
    rows += [(500, rows[1][1]), (501, rows[3][1]), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(op.brute_force(rows), key=str)
    assert any(r[2] for r in want) and any(r[2] == 0 for r in want)
    for batches in (1, 2, 4):
        assert sorted((tuple(r) for r in op.digest(df, batches=batches).collect()), key=str) == want


def covered(rows, window=op.WINDOW):
    out = {}
    for r in rows:
        out.setdefault(r.kd, set()).update(range(r.first, r.first + r.n + window - 1))
    return out


def test_an_index_is_opened_again(spark, tmp_path):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = words(60)
    rows = [(i, " ".join(words(30) + (shared[i % 9 : i % 9 + 45] if i % 3 == 0 else []) + words(20))) for i in range(45)]
    df, path = spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/index"
    seen, first = {}, None
    for k in range(3):
        index = op.FingerprintIndex(spark, path, buckets=3)
        for kd, at in covered(index.add(df.where(f"doc_id div 15 = {k}"), df.where(f"doc_id div 15 < {k}") if k else None).collect()).items():
            seen.setdefault(kd, set()).update(at)
        index.save()
        index.close()
        first = first or {**seen}
    want = {d: n for d, _, n, _ in op.brute_force(rows) if n}
    assert {k: len(v) for k, v in seen.items()} == want
    assert not any(t.name.startswith("loomstat_run") for t in spark.catalog.listTables())
    assert len(op.FingerprintIndex(spark, path).about["runs"]["anchors"]) == 1  # compacted
    # A batch like nothing before it reads no older text: there is none to read here.
    index = op.FingerprintIndex(spark, path)
    assert index.add(spark.createDataFrame([(900, " ".join(f"n{i}" for i in range(80)))], "doc_id long, text string")).count() == 0
    index.close()


def test_runs_are_joined_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, " ".join(str((i % 3) * 1000 + k) for k in range(60))) for i in range(6)], "doc_id long, text string")
    index = op.FingerprintIndex(spark, buckets=2, max_runs=9)
    for i in range(2):
        index.add(df.where(f"doc_id div 3 = {i}"))
    assert {r.n for r in index.entries(op.ANCHORS).collect()} == {2}
    assert "Exchange" not in index.entries(op.ANCHORS)._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    index.close()


def test_a_hot_window_is_split(spark):
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    common = " ".join(f"c{i}" for i in range(40))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('a', id, ' b', id, ' {common} d', id, ' ', repeat(concat('x', id, ' '), 5)) AS text").repartition(8)
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        assert op.digest(docs).groupBy("n_removed").count().collect() == [(40, 3000)]
    finally:
        for k in names:
            spark.conf.unset(k)
