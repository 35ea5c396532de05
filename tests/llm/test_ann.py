import numpy as np
from pyspark.sql import functions as F

from loomstat.llm import ann as op


def make(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), [(i, np.float32(r).tolist()) for i, r in rows]


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    return np.mean([len({i for _, i in by[q]} & set(ids)) / len(ids) for q, ids in want.items()])


def test_recall_with_many_parts(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, (12, 16))
    df, rows = make(spark, centre[rng.integers(0, 12, 3000)] + rng.normal(0, 0.5, (3000, 16)))
    got = op.search(df, F.col("vec_id") % 20 == 0, part_sample=250, tile_rows=100, block_rows=100).collect()
    assert len(got) == 150 * 20
    assert recall(got, op.brute_force(rows, range(0, 3000, 20))) >= 0.9
    x = {i: np.array(v) for i, v in rows}
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 for r in got)


def test_small_table_is_exact(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = op.brute_force(rows, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in op.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def test_ties_bad_vectors_and_few_candidates(spark):
    one, two = [1.0, 0.0], [0.6, 0.8]
    rows = [(0, one), (5, two), (3, two), (4, two), (7, None), (8, [0.0, 0.0]), (9, [None, 1.0]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (12, []), (13, [1.0, 2.0, 3.0]), (None, one), (20, [0.0, 1.0]), (3, two), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("part", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id) for r in op.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 4), (0, 3, 5), (0, 4, 20), (20, 1, 3), (20, 2, 4), (20, 3, 5), (20, 4, 0)]
    assert op.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert op.search(df.where("vec_id = 7"), F.col("vec_id") % 20 == 0).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 8))
    x[::3] = x[0]
    df, rows = make(spark, x)
    got = op.search(df, F.col("vec_id") % 20 == 0, part_sample=100, tile_rows=50, block_rows=50).collect()
    same = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert [i for _, i in same] == [3 * k for k in range(1, 21)]


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (700, 4)) + 1, rng.normal(0, 1, (300, 4))])
    part = op.balanced_parts(x, op._nearest(x, 5), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1000 / 8 * 1.1)


def test_repeated_ids_leave_room_for_others(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (200, 6)).astype(np.float32)
    df, rows = make(spark, x)
    want = op.brute_force(rows, range(0, 200, 20))

    def found(t, **how):
        got = {}
        for r in op.search(t, F.col("vec_id") % 20 == 0, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        return got

    for copies in (df.unionByName(df), df.unionByName(df.where("vec_id = 7").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("n"))):
        assert found(copies) == want
    # One id with many near vectors, in tiles of all and of few rows.
    hot = [(7, [float(v) for v in (x[7] + rng.normal(0, 0.01, 6)).astype(np.float32)]) for _ in range(300)]
    many = df.unionByName(spark.createDataFrame(hot, "vec_id long, embedding array<float>"))
    both = np.array([v for _, v in rows] + [v for _, v in hot], np.float64)
    ids = np.array([i for i, _ in rows] + [7] * 300)
    for tile_rows in (4096, 40):
        for q, got in found(many, tile_rows=tile_rows, block_rows=tile_rows).items():
            s = both @ both[q]
            near = {i: s[ids == i].max() for i in range(200) if i != q}
            assert got == sorted(near, key=lambda i: (-near[i], i))[:20]
