import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import columns as C
from loomstat.operators import cluster, graph, permute, signals, significance, spatial
from loomstat.operators.linkage import cut_height, cut_tree, linkage, nth_largest
from loomstat.plans import pipeline


def test_triangle_positions(spark):
    n = 248_633
    ks = [0, 1, n - 2, n - 1, n, 10**9, n * (n - 1) // 2 - 2, n * (n - 1) // 2 - 1]
    df = spark.createDataFrame([(k,) for k in ks], "k long")
    i, j = C.tri_inverse(F.col("k"), n)
    for r in df.select("k", i.alias("i"), j.alias("j")).withColumn("back", C.tri_index(F.col("i"), F.col("j"), n)).collect():
        assert r.back == r.k and 0 <= r.i < r.j < n
    pairs = spark.range(45).select(*(c.alias(x) for c, x in zip(C.tri_inverse(F.col("id"), 10), "ij", strict=True))).collect()
    assert [tuple(p) for p in pairs] == list(itertools.combinations(range(10), 2))


def test_lists_and_names():
    assert C.int_list("[2,7..4,3..9(2),$]", 11) == [2, 7, 6, 5, 4, 3, 5, 7, 9, 11]
    with pytest.raises(ValueError):
        C.int_list("[a]")
    assert C.second_name("x/y.z.csv") == "x/y.z_tstat.csv" and C.second_name("a.b/c") == "a.b/c_tstat"
    assert C.significant_name("dir/res.bin", 0.05) == "dir/res_significant_p05.csv"


@pytest.mark.parametrize("method", ["tile", "expr"])
def test_correlation(spark, method):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (37, 12))
    x[5] = 3.0
    x[9] = x[8] * 2 + 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vox long, ts array<double>").repartition(5)
    got = {(r.i, r.j): r.r for r in signals.correlate(df, method=method, block=8).collect()}
    with np.errstate(all="ignore"):
        want = np.corrcoef(x)
    assert len(got) == 37 * 36 // 2
    assert all(abs(got[i, j] - (0 if 5 in (i, j) else want[i, j])) < 1e-12 for i, j in got)
    nan = {(r.i, r.j) for r in signals.correlate(df, method=method, flat="nan", block=8).collect() if np.isnan(r.r)}
    assert nan == {k for k in got if 5 in k}
    some = {(r.i, r.j) for r in signals.correlate(df, method=method, above=0.3, block=8).collect()}
    assert some == {k for k, v in got.items() if v > 0.3}
    assert signals.correlate(df.limit(0), method=method).count() == 0
    assert signals.correlate(df.where("vox = 0"), method=method).count() == 0
    with pytest.raises(ValueError):
        signals.correlate(df, method="x")


def test_masks_and_matrices(spark):
    voxels = spark.createDataFrame([(i, j, k, t, float(i + 10 * j + 100 * k + 1000 * t)) for i in range(3) for j in range(2) for k in range(2) for t in range(3)], "i int, j int, k int, t int, value double")
    mask = voxels.where("t = 0").withColumn("value", F.when(F.col("i") == 1, 0.0).when(F.col("i") == 2, float("nan")).otherwise(2.0))
    got = signals.masked(voxels, mask).orderBy("vox").collect()
    assert [(r.i, r.j, r.k) for r in got] == [(i, j, k) for k in range(2) for j in range(2) for i in (0, 2)]
    assert got[1].ts == [2.0, 1002.0, 2002.0]
    assert signals.in_range(signals.masked(voxels, mask), (0, 2), (5, 6)).count() == 3
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 2, 1.0), (1, 2, 0.0)], "i long, j long, r double")
    assert signals.full_matrix(pairs, 3).count() == 9 and signals.suspicious(pairs).count() == 2
    other = pairs.withColumn("r", F.col("r") + F.when(F.col("j") == 2, 0.01).otherwise(0))
    assert signals.compare(pairs, other).count() == 2 and signals.compare(pairs, pairs.where("j = 1")).count() == 2
    significance.check_count(pairs, 3)
    with pytest.raises(ValueError):
        significance.check_count(pairs, 4)
    p = signals.planted(spark, 4, 20, (F.col("i") < 5) & (F.col("j") > 10), 2, seed=1)
    assert p.count() == 4 * 190 and p.where("subj < 2 AND i < 5 AND j > 10 AND value < 0.8").count() == 0


def brute_p(x, perms, two):
    out = []
    for v in x:
        stats = []
        for a in perms:
            inside = np.isin(np.arange(len(v)), a)
            mean = lambda w: w.mean() if len(w) else 0.0
            stats.append(mean(v[inside]) - mean(v[~inside]))
        s = np.abs(stats) if two else np.array(stats)
        out.append(((s[1:] >= s[0] - 1e-12).sum() + 1) / (len(perms) + 1))
    return out


@pytest.mark.parametrize("method", ["gemm", "sql"])
@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("ragged", [False, True])
def test_permutations(spark, method, two, ragged):
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (9, 8))
    perms = [sorted(rng.choice(8, rng.integers(0, 9) if ragged and k else 4, replace=False).tolist()) for k in range(40)]
    values = spark.createDataFrame([(c, s, int(x[c, s])) for c in range(9) for s in range(8)], "c int, subj int, value long").repartition(4)
    p = spark.createDataFrame([(k, a) for k, a in enumerate(perms)], "perm int, a array<int>")
    got = permute.permutation_test(values, ["c"], p, 8, two_tailed=two, method=method).orderBy("c").collect()
    assert np.allclose([r.pvalue for r in got], brute_p(x.astype(float), perms, two))
    assert max(r.pvalue for r in got) < 1


def test_permutations_of_nan(spark):
    values = spark.createDataFrame([(c, s, float("nan") if (c, s) == (0, 1) else float(s)) for c in range(2) for s in range(4)], "c int, subj int, value double")
    p = spark.createDataFrame([(0, [0, 1]), (1, [2, 3]), (2, [0, 9, -1, 3])], "perm int, a array<int>")
    for method in ("gemm", "sql"):
        r = permute.permutation_test(values, ["c"], p.where("perm < 2"), 4, method=method).orderBy("c").collect()
        assert r[0].pvalue is None and abs(r[1].pvalue - 2 / 3) < 1e-12
        r = permute.permutation_test(values, ["c"], p.where("perm < 2"), 4, method=method, nan="reference").orderBy("c").collect()
        assert abs(r[0].pvalue - 1 / 3) < 1e-12
    assert permute.one_hot(p, 4).where("perm = 2 AND in_a").count() == 2
    r = permute.random_permutations(spark, 3, 3, 20, seed=1).collect()
    assert len({tuple(x.a) for x in r}) == 20 and sorted(x.perm for x in r) == list(range(20)) and all(len(x.a) == 3 for x in r)
    with pytest.raises(ValueError):
        permute.random_permutations(spark, 3, 3, 21)


def test_histogram_edges(spark):
    bins = 400
    edges = [10 ** (b * 20.0 / bins - 20) for b in range(bins + 1)]
    p = [0.0, 1.0, 1e-30, 2.0, *edges, *np.nextafter(edges, 0), *np.nextafter(edges, 1)]
    df = spark.createDataFrame([(float(v),) for v in p] + [(None,), (float("nan"),)], "pvalue double")
    lo, hi = significance.edge(F.col("b"), bins), significance.edge(F.col("b") + 1, bins)
    b = df.withColumn("b", significance.log_bin(F.col("pvalue"), bins)).withColumns({"lo": lo, "hi": hi})
    assert b.where("b IS NULL").count() == 2
    assert b.where(f"NOT ((pvalue > lo OR b = 0) AND (pvalue <= hi OR b = {bins - 1}))").count() == 0
    h = significance.log_histogram(df, bins=bins)
    assert h.agg(F.sum("count")).first()[0] == len(p)
    assert significance.merged(h.unionByName(h)).agg(F.sum("count")).first()[0] == 2 * len(p)
    assert significance.running(h).orderBy(F.desc("bin")).first().cumulative_pct == 100


def test_summaries(spark):
    rng = np.random.default_rng(2)
    v = np.sort(rng.random(1013)).tolist()
    df = spark.createDataFrame([(x,) for x in v], "pvalue double").repartition(6)
    got = {r.decile: r.value for r in significance.deciles(df).collect()}
    assert got == {i: v[min(1012, int(1013 * (i / 10)))] for i in range(11)}
    s = significance.summary(df).first()
    assert abs(s["std"] - np.std(v)) < 1e-12 and s.n == 1013
    assert significance.summary(df.limit(0)).first()["std"] == 0
    assert significance.verdict(df.withColumn("pvalue", F.lit(0.0)), 10).first().verdict == "fail"
    assert significance.threshold_counts(df.limit(0)).first().percent == 0
    t = spark.createDataFrame([(i, float(x)) for i, x in enumerate([5, 3, 3, 3, 1])], "edge_id int, tstat double")
    assert significance.top_tstat(t, 2).count() == 4 and significance.top_tstat(t, 9).count() == 5 and significance.top_tstat(t, threshold=3).count() == 4
    for bad in ({}, {"top_n": 1, "threshold": 1}):
        with pytest.raises(ValueError):
            significance.top_tstat(t, **bad)
    n = spark.createDataFrame([(0.0,), (float("nan"),), (1.0,), (-1.0,)], "t double")
    assert n.where(C.positive_side(F.col("t"))).count() == 3 and n.where(C.negative_side(F.col("t"))).count() == 3


# Edges ---------------------------------------------------------------------------------------------------

ENDS = ["i1", "j1", "k1", "i2", "j2", "k2"]


def random_edges(n=60, seed=0, size=9):
    rnd = random.Random(seed)
    return [(e, *(rnd.randrange(size) for _ in range(6))) for e in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "edge_id long, " + ", ".join(f"{c} int" for c in ENDS)).repartition(3)


def near(a, b, d=1):
    return max(abs(x - y) for x, y in zip(a, b, strict=True)) <= d


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def partition(rows, label):
    out = {}
    for r in rows:
        out.setdefault(r[label], []).append(r.edge_id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("d", [1.0, 1.5])
def test_spatial_operators_match_brute_force(spark, d):
    rows = random_edges(size=14)
    df, n = frame(spark, rows), int(np.ceil(d))
    e = {r[0]: (r[1:4], r[4:7]) for r in rows}
    keep = {a for a in e if any(b != a and any(near(x, y, n) for x in e[a] for y in e[b]) for b in e)}
    assert {r.edge_id for r in spatial.filter_isolated(df, d).collect()} == keep
    touching = [(a, b) for a, b in itertools.combinations(e, 2) if any(near(x, y, n) for x in e[a] for y in e[b])]
    got = spatial.edge_components(df, d).collect()
    assert partition(got, "component") == groups(touching, list(e))
    first = {}
    for r in sorted(got, key=lambda r: r.edge_id):
        first.setdefault(r.component, len(first))
    assert all(k == v for k, v in first.items())
    voxels = sorted({v for ends in e.values() for v in ends})
    comp = {v: k for k, g in enumerate(groups([(a, b) for a, b in itertools.combinations(voxels, 2) if near(a, b, n)], voxels)) for v in g}
    want = {}
    for a, (x, y) in e.items():
        want.setdefault(("c", comp[x]) if comp[x] == comp[y] else ("e", a), []).append(a)
    bundled = spatial.bundle_cc(df, d)
    assert partition(bundled.collect(), "bundle") == sorted(map(sorted, want.values()))
    sizes = [r["count"] for r in bundled.groupBy("bundle").count().orderBy("bundle").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_strict_bundles_match_brute_force(spark):
    rows = random_edges(80, 3, 4)
    e = {r[0]: (r[1:4], r[4:7]) for r in rows}
    linked = [(a, b) for a, b in itertools.combinations(e, 2) if any(e[a][p] == e[b][q] and near(e[a][1 - p], e[b][1 - q]) for p in (0, 1) for q in (0, 1))]
    assert partition(spatial.bundle_strict(frame(spark, rows)).collect(), "bundle") == groups(linked, list(e))


def test_pruning_matches_brute_force(spark):
    rows = random_edges(120, 5, 12)
    e = {r[0]: (r[1:4], r[4:7]) for r in rows}
    label = {a: a % 3 for a in e}
    df = frame(spark, rows).withColumn("network", (F.col("edge_id") % 3).cast("int"))
    left = set(e)
    while True:
        bad = {a for a in left if not all(any(b != a and label[b] == label[a] and any(near(x, y) for y in e[b]) for b in left) for x in e[a])}
        if not bad:
            break
        left -= bad
    assert {r.edge_id for r in spatial.prune_isolated(df).collect()} == left
    drop = set()
    for g in range(3):
        mine = [a for a in e if label[a] == g]
        v = sorted({x for a in mine for x in e[a]})
        small = {x for c in groups([(p, q) for p, q in itertools.combinations(v, 2) if near(p, q)], v) if len(c) < 3 for x in c}
        drop |= {a for a in mine if set(e[a]) & small}
    assert {r.edge_id for r in spatial.prune_small_clusters(df).collect()} == set(e) - drop
    assert spatial.drop_small(df.where("edge_id < 4"), 2).count() == 2


def test_distances_match_brute_force(spark):
    rows = random_edges(50, 7)
    df = frame(spark, rows).withColumn("bundle", (F.col("edge_id") % 4).cast("int"))
    p = {r[0]: np.array(r[1:], float) for r in rows}
    d = {(a, b): (np.linalg.norm(p[a][:3] - p[b][:3]), np.linalg.norm(p[a][3:] - p[b][3:])) for a in p for b in p}
    for flag, f in (("max", max), ("min", min), ("mean", lambda v: sum(v) / 2)):
        got = cluster.edge_pairs(df, flag, block=9).collect()
        assert len(got) == 50 * 49 // 2 and all(abs(r.dist - f(d[r.a, r.b])) < 1e-9 for r in got)
    got = {(r.a, r.b): r.dist for r in cluster.bundle_distances(df, block=7).collect()}
    assert len(got) == 6 and all(abs(v - min(min(d[x, y]) for x in p for y in p if x % 4 == a and y % 4 == b)) < 1e-9 for (a, b), v in got.items())
    got = {r.bundle: r.maxmin for r in cluster.maxmin(df, block=7).collect()}
    assert all(abs(v - max(min(d[x, y]) for x in p for y in p if x % 4 == g and y % 4 == g)) < 1e-9 for g, v in got.items())
    got = {r.bundle: r.maxmin for r in cluster.maxmin(df, form="edges", block=7).collect()}
    assert all(abs(v - max(min(min(d[x, y]) for y in p if y % 4 == g and y != x) for x in p if x % 4 == g)) < 1e-9 for g, v in got.items())


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_matches_greedy(method):
    rng = np.random.default_rng(3)
    x = rng.random((25, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    z = linkage(d, method)
    f = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    sets = [[i] for i in range(25)]
    for h in z[:, 2]:
        best = min(((f(d[np.ix_(a, b)]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2)), key=lambda v: v[0])
        assert abs(best[0] - h) < 1e-12
        sets[best[1]] += sets.pop(best[2])
    assert [len(set(cut_tree(z, k))) for k in (1, 2, 7, 25, 99)] == [1, 2, 7, 25, 25]
    assert z[-1, 3] == 25 and nth_largest(z, 1) == z[-1, 2] and nth_largest(z, 99) == z[0, 2] and nth_largest(np.zeros((0, 4)), 5) == 0
    if method == "single":
        got = cut_height(z, 0.3)
        want = groups([(i, j) for i, j in itertools.combinations(range(25), 2) if d[i, j] <= 0.3], range(25))
        assert sorted(sorted(np.flatnonzero(got == c).tolist()) for c in set(got)) == want
    assert len(linkage(np.zeros((1, 1)), method)) == 0 and cut_tree(np.zeros((0, 4)), 3).tolist() == [0]


def test_clusters_and_pipelines(spark):
    from loomstat.plans import fixtures

    e = fixtures.edges(spark, "/root/testdata/sf0.01").where("edge_id < 300").cache()  # one region
    k = cluster.hc1(e, "complete", 20)
    assert 1 < k.select("bundle").distinct().count() <= 20 and k.count() == 300
    near_k = cluster.hc1(e, "complete", 20, max_exact=100)
    assert near_k.count() == 300 and near_k.select("bundle").distinct().count() <= 20
    told = []
    r = pipeline.process_v2(e, progress=lambda name, percent: told.append((name, percent)))
    assert [n for n, _ in told] == ["isolation", "bundles", "prune", "size", "clusters", "size_again", "networks"] and told[-1][1] == 100 and sorted(p for _, p in told) == [p for _, p in told]
    assert r.edges.count() < 300 and r.edges.select("network").distinct().count() <= 5 and r.tree.count() == r.edges.select("bundle").distinct().count() - 1
    two = cluster.recut(r.edges, r.tree, 2)
    assert two.select("network").distinct().count() == 2
    labels, height = cluster.dendrogram(r.edges, r.tree)
    assert labels.count() == r.tree.count() + 1 and height > 0
    with pytest.raises(ValueError, match="no edge is left"):
        pipeline.process_v2(e, threshold=99.0)
    import tempfile

    at = tempfile.mkdtemp()
    a = pipeline.cached(spark, at, {"d": 1}, lambda: r).edges.count()
    assert a == pipeline.cached(spark, at, {"d": 1}, lambda: 1 / 0).edges.count()
    masks = spatial.removed_by(e, r.steps).groupBy("removed_by").count().collect()
    assert sum(m["count"] for m in masks) == 300 and sum(m["count"] for m in masks if m.removed_by is None) == r.edges.count()


def test_components_in_rounds(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    nodes = [*range(300), *range(1000, 1041)]
    n, e = spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(pairs, "a long, b long")
    for local in (0, 10**6):
        out = {}
        for r in graph.components(n, e, local=local).collect():
            out.setdefault(r.root, []).append(r.node)
        assert sorted(map(sorted, out.values())) == groups(pairs, nodes) and all(k == min(v) for k, v in out.items())


def test_normalising_takes_time_in_proportion_to_frames(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (1, [5.0, 5.0, 5.0]), (2, [1.0, None, 2.0]), (3, []), (4, None), (None, [1.0]), (5, [1.0, float("nan")])], "vox long, ts array<double>")
    z = signals.normed(df)
    assert "aggregate(" not in z._jdf.queryExecution().optimizedPlan().toString()
    got = {r.vox: r for r in z.collect()}
    assert set(got) == {0, 1, 2, 3, 5} and got[1].flat and got[3].flat and not got[0].flat and not got[5].flat
    assert np.allclose(got[0].z, np.array([-4, -1, 5]) / 42**0.5) and np.isnan(got[2].z).all() and np.isnan(got[5].z).all()


def test_percentiles_of_ties(spark):
    rows = [1.0] * 500 + [0.5] * 300 + [-3.0, -2.0, -1.0, 0.0] * 50 + [0.001 * k for k in range(100)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in rows], "pvalue double").repartition(5)
    v = sorted(x for x in rows if x is not None and x == x)
    assert [(r.decile, r.value) for r in significance.deciles(df).orderBy("decile").collect()] == [(i, v[min(int(len(v) * (i / 10)), len(v) - 1)]) for i in range(11)]


def test_a_node_of_very_many_edges_is_split(spark):
    from loomstat.operators.graph import _with_least

    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60000).selectExpr("if(id % 3 = 0, -7, id) AS u", "id + 100000 AS v").repartition(8)
        out = _with_least(rows, rows.groupBy("u").agg(F.min("v").alias("m")))
        assert out.groupBy((F.col("u") == -7).alias("hot")).count().orderBy("hot").collect() == [(False, 40000), (True, 20000)]
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in names:
            spark.conf.unset(k)


def test_components_on_the_driver_of_any_type(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randrange(500), rnd.randrange(500)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)]
    e = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for p in pairs for x in p})
    want = {k: min(g) for g in groups(pairs, nodes) for k in g}
    kinds = {"long": lambda c: F.col(c), "string": lambda c: F.lpad(F.col(c).cast("string"), 5, "0"), "struct": lambda c: F.struct(F.col(c).cast("int").alias("i"), (F.col(c) % 3).cast("double").alias("j")), "words": lambda c: F.struct(F.lpad(F.col(c).cast("string"), 5, "0").alias("w"))}
    n = spark.createDataFrame([(x,) for x in nodes], "a long")
    for name, key in kinds.items():
        own = n.select(F.col("a").alias("id"), key("a").alias("node"))
        for local in (0, 10**6):
            got = graph.components(own.select("node"), e.select(key("a").alias("a"), key("b").alias("b")), local=local)
            back = {r.id: r.r for r in got.join(own, "node").select("id", F.col("root").alias("rt")).join(own.select(F.col("id").alias("r"), F.col("node").alias("rt")), "rt").collect()}
            assert back == want, (name, local)


def test_neighbours_over_borders_of_blocks_in_few_rows(spark, monkeypatch):
    # Pairs of edges that touch over a face, an edge or a corner of a block, at both signs, and lone ones.
    rows, keep = [], set()
    for n, (a, b) in enumerate([((15, 5, 5), (16, 5, 5)), ((-1, -1, 5), (0, 0, 5)), ((31, 31, 31), (32, 32, 32)), ((-17, 0, -16), (-16, -1, -17)), ((40, 40, 40), (42, 40, 40))]):
        rows += [(2 * n, *a, 5000 + 9 * n, 0, 0), (2 * n + 1, *b, 6000 + 9 * n, 0, 0)]
        keep |= {2 * n, 2 * n + 1} if n < 4 else set()
    many = [(100 + e, 1000 + 5 * (e % 50), 5 * (e // 50 % 50), 5 * (e // 2500), 3000 + 5 * (e % 50), 5 * (e // 50 % 50), 5 * (e // 2500)) for e in range(20_000)]
    df = frame(spark, [*rows, *many, (50, None, 1, 1, None, 1, 1)])
    assert {r.edge_id for r in spatial.filter_isolated(df).collect()} == keep
    ends = spatial.endpoints(df)
    dealt, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: dealt.append(self.count()) or real(self, *a, **b))
    spatial.filter_isolated(df)
    assert len(dealt) == 1 and dealt[0] < 2 * 40_020  # not 27 for each voxel
    monkeypatch.undo()
    label = df.withColumn("network", F.when(F.col("edge_id") != 3, F.expr("cast(edge_id div 4 AS int)")))
    assert {r.edge_id for r in spatial.prune_isolated(label).collect()} == set()
    touch = spatial._adjacent(ends.dropna().select("i", "j", "k").distinct(), 1.0, [])
    assert touch.count() == 4


def test_the_driver_joins_no_more_edges_than_it_may(spark, monkeypatch):
    seen, real = [], graph._local

    def counted(edges):
        seen.append(edges.count())
        return real(edges)

    monkeypatch.setattr(graph, "_local", counted)
    monkeypatch.setattr(graph, "PIECE", 20_000, raising=False)
    # 30 chains of 5,001 nodes in mixed order.
    e = spark.range(150_000).selectExpr("(id div 5000) * 10000 + id * 7919 % 5000 AS a").selectExpr("a", "a + 1 AS b").repartition(7)
    n = e.selectExpr("a AS node").union(e.selectExpr("b")).distinct()
    out = graph.components(n, e)
    assert out.groupBy("root").count().orderBy("root").collect() == [(k * 10000, 5001) for k in range(30)]
    assert seen and max(seen) <= 100_000


def test_maxmin_pairs_edges_of_a_bundle_alone(spark, monkeypatch):
    rows = random_edges(300, 8, 30)
    df = frame(spark, rows).withColumn("bundle", F.expr("cast(if(edge_id < 40, 7, 100 + edge_id div 2) AS int)"))
    at = {}
    for r in rows:
        at.setdefault(7 if r[0] < 40 else 100 + r[0] // 2, []).append((np.array(r[1:4]), np.array(r[4:7])))
    at = {k: v for k, v in at.items() if k != 120} | {120: at[120][:1]}
    df = df.where("edge_id <> 41")
    gap = lambda a, b: min(float(np.linalg.norm(x - y)) for x, y in zip(a, b, strict=True))
    want = {k: max(gap(a, b) for a in v for b in v) for k, v in at.items()}
    nearest = {k: max(min(gap(a, b) for b in v if b is not a) for a in v) for k, v in at.items() if len(v) > 1}
    dealt, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: dealt.append(self.count()) or real(self, *a, **b))
    for form, right in (("pairs", want), ("edges", nearest)):
        got = {r.bundle: r.maxmin for r in cluster.maxmin(df, form=form, block=11).collect()}
        assert got.keys() == right.keys() and all(abs(got[k] - right[k]) < 1e-9 for k in got)
    assert dealt == [40 * 4 + 258] * 2  # the large bundle in 4 blocks; no edge meets those of other bundles
