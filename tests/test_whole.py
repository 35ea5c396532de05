import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat import catalog
from loomstat.operators import cluster, signals, spatial
from loomstat.operators.linkage import cut_height, cut_tree, linkage
from loomstat.plans import fixtures as X


def test_queries_read_whole_tables(spark, sf):
    n = X.edges(spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert catalog.queries()["hc1_complete"](spark, sf).count() == n
    assert catalog.queries()["pipeline_v1"](spark, sf).count() == n
    for name in catalog.oracle_sql():
        assert not any(x in catalog.oracle_sql()[name] for x in ("o_orderkey <", "edge_id < 3", "SAMPLE", "LIMIT")), name


def brute_hc1(x, flag, k):
    d = np.maximum(*(np.sqrt(((x[:, None, h] - x[None, :, h]) ** 2).sum(2)) for h in (slice(0, 3), slice(3, 6))))
    return cut_tree(linkage(d, flag), k)


@pytest.mark.parametrize("flag", ["complete", "average"])
def test_edges_of_one_place_count_by_their_number(spark, monkeypatch, flag):
    rng = np.random.default_rng(3)
    place = rng.normal(0, 9, (40, 6))
    x = place[np.r_[np.arange(40), rng.integers(0, 40, 60)]]
    e = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "edge_id long, i1 double, j1 double, k1 double, i2 double, j2 double, k2 double")
    for double in (20_000, 10):  # in single precision too
        monkeypatch.setattr(cluster, "DOUBLE", double)
        for k in (1, 5, 20):
            want, got = brute_hc1(x, flag, k), [r.bundle for r in cluster.hc1(e, flag, k).orderBy("edge_id").collect()]
            assert len({*zip(want.tolist(), got)}) == len({*got}) == len({*want.tolist()}) == k
    assert cluster.hc1(e, flag, 200).select("bundle").distinct().count() == 100


def test_more_edges_than_the_old_limit_are_clustered_exactly(spark):
    e = spark.range(9000).selectExpr("id AS edge_id", "id % 30 * 100 + id div 30 % 10 AS i1", "id div 300 AS j1", "0 AS k1", "0 AS i2", "0 AS j2", "0 AS k2")
    got = cluster.hc1(e, "complete", 30)
    assert got.groupBy("bundle").agg(F.min(F.col("edge_id") % 30).alias("a"), F.max(F.col("edge_id") % 30).alias("b"), F.count("*").alias("n")).where("a = b AND n = 300").count() == 30
    sampled = cluster.hc1(e, "complete", 30, max_exact=3000)
    assert sampled.count() == 9000 and sampled.select("bundle").distinct().count() == 30
    assert sampled.groupBy("bundle").agg(F.countDistinct(F.col("edge_id") % 30).alias("a")).where("a > 1").count() == 0


def test_many_bundles(spark, monkeypatch):
    monkeypatch.setattr(cluster, "DOUBLE", 100)
    e = spark.range(600).selectExpr("id AS edge_id", "cast(id div 2 AS int) AS bundle", "id div 2 % 3 * 1000 + id div 10 AS i1", "id % 2 AS j1", "0 AS k1", "id div 2 % 3 * 1000 + id div 10 AS i2", "1 AS j2", "2 AS k2")
    out, tree = cluster.hc2(e, "average", 3)
    assert tree.count() == 299 and out.groupBy("network").agg(F.countDistinct(F.col("bundle") % 3).alias("a"), F.count("*").alias("n")).where("a = 1 AND n = 200").count() == 3


def test_bundles_of_one_place_make_the_same_tree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    place = rng.normal(0, 9, (30, 6))
    at = np.r_[np.arange(30), rng.integers(0, 20, 50)]
    rows = [(k, int(k if k < 70 else 70), *map(float, place[p])) for k, p in enumerate(at)]
    e = spark.createDataFrame(rows, "edge_id long, bundle int, i1 double, j1 double, k1 double, i2 double, j2 double, k2 double")
    d = cluster._square(cluster.bundle_distances(e), list(range(71)))
    want = linkage(d, "average")
    monkeypatch.setattr(cluster, "COLLAPSED", 50)
    networks, tree = cluster.hc2(e, "average", 4)
    got = cluster.tree_of(tree)
    assert np.allclose(np.sort(got[:, 2]), np.sort(want[:, 2])) and got[-1, 3] == 71
    for h in (0.0, 3.0, 6.0, 10.0):
        assert cut_height(got, h).tolist() == cut_height(want, h).tolist()
    assert networks.count() == len(rows) and networks.select("network").distinct().count() == 4
    first = {}
    single = [first.setdefault(g, b) for b, g in enumerate(cut_height(linkage(d, "single"), 6.0).tolist())]
    assert [r.root for r in cluster.single_cut(e, 6.0).orderBy("bundle").collect()] == single


@pytest.mark.parametrize("digits", [None, 9])
def test_more_centroids_than_go_to_a_task_at_once(spark, monkeypatch, digits):
    rng = np.random.default_rng(8)
    x, at = rng.integers(0, 40, (700, 6)).astype(float), rng.integers(0, 40, (900, 6)) / 3
    x[:20], at[450:470] = at[:20], at[:20]  # ties
    cols = "i1 double, j1 double, k1 double, i2 double, j2 double, k2 double"
    edges = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(700, None, 1.0, 1.0, 1.0, 1.0, 1.0)], f"edge_id long, {cols}")
    centres = spark.createDataFrame([(i + 5, *map(float, r)) for i, r in enumerate(at)] + [(1, None, 1.0, 1.0, 1.0, 1.0, 1.0)], f"bundle int, {cols}")
    d = ((x[:, None] - at[None]) ** 2).sum(2)
    want = (d if digits is None else d.round(digits)).argmin(1) + 5
    for most in (500_000, 200):
        monkeypatch.setattr(spatial, "CENTRES", most)
        got = {r.edge_id: r.bundle for r in spatial.nearest_centroid(edges, centres, "bundle", digits).collect()}
        assert [got[i] for i in range(700)] == want.tolist() and got[700] == 5 and len(got) == 701
    assert spatial.nearest_centroid(edges, centres.limit(0), "bundle").count() == 0


def test_pairs_of_whole_bundles_are_not_shuffled(spark):
    rng = np.random.default_rng(9)
    size = np.r_[90, 31, rng.integers(1, 6, 60)]
    label, p = np.repeat(np.arange(len(size)), size), rng.integers(0, 50, (size.sum(), 6)).astype(float)
    e = spark.createDataFrame([(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(label, p, strict=True))], "edge_id long, bundle int, i1 double, j1 double, k1 double, i2 double, j2 double, k2 double")
    d = np.minimum(*(np.sqrt(((p[:, None, h] - p[None, :, h]) ** 2).sum(2)) for h in (slice(0, 3), slice(3, 6))))
    want = {(a, b): d[label == a][:, label == b].min() for a in range(len(size)) for b in range(a + 1, len(size))}
    for block in (20, 1000):  # the first two bundles are cut, or none
        rows = cluster.bundle_distances(e, block=block).collect()
        assert len(rows) == len(want) and {(r.a, r.b): r.dist for r in rows} == want
    plan = cluster.bundle_distances(e, block=1000)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan
    assert cluster.bundle_distances(e.limit(0)).count() == 0


@pytest.mark.parametrize("flag", ["single", "complete", "average"])
def test_a_tree_of_more_members_than_the_driver_holds(spark, monkeypatch, flag):
    rng = np.random.default_rng(11)
    size = np.r_[40, rng.integers(1, 4, 150)]
    of, weight = np.repeat(np.arange(151), size), rng.integers(1, 4, 151).astype(float)
    p = rng.normal(0, 1, (len(of), 6)) + rng.normal(0, 30, (151, 6))[of]
    rows = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(of, p, strict=True)], "member int, i1 double, j1 double, k1 double, i2 double, j2 double, k2 double")
    ends = [np.sqrt(((p[:, None, h] - p[None, :, h]) ** 2).sum(2)) for h in (slice(0, 3), slice(3, 6))]
    for least, n in ((True, 151), (False, len(of))):
        d = (np.minimum if least else np.maximum)(*ends)
        if least:
            d, r, w = np.array([[d[of == a][:, of == b].min() for b in range(n)] for a in range(n)]), rows, weight
        else:
            r, w = rows.withColumn("member", F.monotonically_increasing_id()).orderBy("member"), np.ones(n)
            r = spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(r.collect())], rows.schema)
        want = linkage(d, flag, w)
        monkeypatch.setattr(cluster, "HELD", 60)
        got = cluster.grown_tree(r, n, flag, w, least, block=80)
        assert np.allclose(got[:, 2:], want[:, 2:]) and (got[:, :2] == want[:, :2]).all()


def test_equal_distances_merge_many_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HELD", 60)
    squares, calls = [], cluster._on_tiles
    monkeypatch.setattr(cluster, "_on_tiles", lambda *a: squares.append(1) or calls(*a))
    rows = spark.range(300).selectExpr("cast(id AS int) AS member", "id AS i1", "0 AS j1", "0 AS k1", "id AS i2", "0 AS j2", "0 AS k2")
    z = cluster.grown_tree(rows, 300, "complete", block=100)
    assert len(z) == 299 and z[-1, 2] == 299 and z[-1, 3] == 300 and (np.diff(z[:, 2]) >= 0).all() and len(squares) < 20


def test_the_driver_holds_no_larger_matrix(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HELD", 50)
    held, square = [], cluster._square
    monkeypatch.setattr(cluster, "_square", lambda pairs, names: held.append(len(names)) or square(pairs, names))
    e = spark.range(600).selectExpr("id AS edge_id", "cast(id div 2 AS int) AS bundle", "id div 2 % 3 * 1000 + id div 10 AS i1", "id % 2 AS j1", "id AS k1", "id div 2 % 3 * 1000 + id div 10 AS i2", "1 AS j2", "2 AS k2")
    assert cluster.hc2(e, "average", 3)[0].groupBy("network").agg(F.countDistinct(F.col("bundle") % 3).alias("a"), F.count("*").alias("n")).where("a = 1 AND n = 200").count() == 3
    assert cluster.hc1(e, "complete", 3).select("bundle").distinct().count() == 3
    assert len(held) == 2 and max(held) <= 50


def test_leaves_of_large_bundles_find_the_least_distance():
    rng = np.random.default_rng(13)
    of = np.repeat([3, 5, 9, 12], [600, 500, 700, 400])
    p = rng.integers(0, 60, (len(of), 6)) / 7 + of[:, None] * np.array([9, 0, 0, 4, 4, 0])
    p[::50, 1] = np.nan
    left, right = np.flatnonzero(of < 9), np.flatnonzero(of >= 5)
    assert len(left) * len(right) > 16 * cluster.LEAF_ROWS**2 * 6
    own, names, got = cluster._minima(p, of, left, right)
    d = np.fmin(*(np.sqrt(((p[:, None, h] - p[None, :, h]) ** 2).sum(2)) for h in (slice(0, 3), slice(3, 6))))
    assert (got == np.array([[np.nanmin(d[of == a][:, of == b]) for b in names] for a in own])).all()


def test_signals_are_dealt_to_few_tiles():
    # Of 64 frames: 0.4 GB to be shuffled for 51,282 signals, 1.4 GB for 102,564.
    for n, most in ((51_282, 0.5e9), (102_564, 1.5e9)):
        assert n * signals.blocks(n, signals.block_size(n)) * 64 * 8 < most
    assert signals.block_size(10) == 512 and signals.block_size(10**6) == 4096


def joins(df):
    """Joins in a plan: each one, with its shuffles, is planned and reported again after every stage of the query."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize("bundles", [spatial.bundle_cc, spatial.bundle_strict])
def test_labels_of_bundles_are_read_and_not_made_again(spark, sf, bundles):
    e = catalog.written(X.edges(spark, sf))
    assert joins(bundles(e)) == 1


@pytest.mark.parametrize("fewer", [spatial.drop_small, spatial.prune_small_clusters])
def test_kept_edges_are_read_and_not_found_again(spark, sf, fewer):
    e = catalog.written(spatial.bundle_cc(X.edges(spark, sf)))
    assert joins(fewer(e, 3)) <= 2  # the new labels, and where the ranges begin


def test_rounds_of_a_large_tree_broadcast_nothing(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x, n = rng.integers(0, 50, (500, 6)) / 3 + rng.normal(0, 1e-3, (500, 6)), 500
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "member int, i1 double, j1 double, k1 double, i2 double, j2 double, k2 double")
    monkeypatch.setattr(cluster, "HELD", 60)
    asked = []
    monkeypatch.setattr(cluster.F, "broadcast", lambda df: asked.append(1) or df)
    got = cluster.grown_tree(rows, n, "complete", least=False, block=40)
    d = np.maximum(*(np.sqrt(((x[:, None, h] - x[None, :, h]) ** 2).sum(2)) for h in (slice(0, 3), slice(3, 6))))
    assert np.allclose(got[:, 2], linkage(d, "complete")[:, 2])
    for k in (2, 30, 200):
        assert cut_tree(got, k).tolist() == cut_tree(linkage(d, "complete"), k).tolist()
    assert not asked


def test_pairs_of_edges_come_from_few_copies(spark):
    e = X.lines(spark, "/root/testdata/sf0.001")
    n = e.count()
    blocks = -(-n // max(30, -(-n // 16)))
    pairs = spatial.tile_pairs(e, "edge_id", 30)
    shuffled = pairs.selectExpr("a.__x AS x", "a.__y AS y", "a.edge_id AS a", "b.edge_id AS b")
    assert shuffled.count() == n * (n - 1) // 2 == shuffled.select("a", "b").distinct().count()
    # Blocks of a 16th: a row is on the left of the tiles from its block on, on the right of those up to it.
    assert shuffled.select("x", "y").distinct().count() == blocks * (blocks + 1) // 2
    assert shuffled.where("a >= b OR x > y").count() == 0
    sides = shuffled.groupBy("a").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    assert sides.where("lo <> hi").count() == 0
