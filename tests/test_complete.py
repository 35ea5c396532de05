import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import cluster, complete
from loomstat.operators.linkage import cut_tree, linkage
from loomstat.plans import pipeline

SCHEMA = "edge_id long, i1 double, j1 double, k1 double, i2 double, j2 double, k2 double"


def labels(e, k):
    return [r.bundle for r in cluster.hc1(e, "complete", k).orderBy("edge_id").collect()]


@pytest.mark.parametrize("grid", [True, False])
def test_bundles_do_not_depend_on_how_many_clusters_the_driver_holds(spark, monkeypatch, grid):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 6, (300, 6)).astype(float) if grid else rng.normal(0, 9, (300, 6))  # on a grid, with very many equal distances
    e = cluster.written(spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], SCHEMA))
    want = {k: labels(e, k) for k in (4, 60)}
    d = np.maximum(*(np.sqrt(((x[:, None, h] - x[None, :, h]) ** 2).sum(2)) for h in (slice(0, 3), slice(3, 6))))
    monkeypatch.setattr(cluster, "HELD", 40)
    monkeypatch.setattr(complete, "CELL", 100)
    for k in want:
        assert labels(e, k) == want[k]
        if not grid:
            brute = cut_tree(linkage(d, "complete"), k).tolist()
            assert len({*zip(brute, want[k], strict=True)}) == len({*brute}) == len({*want[k]}) == k


def far_one(spark):
    """60,000 places near to each other but the one that came last by the hash that samples of 50,000 were drawn by."""
    ids = spark.range(60_000)
    far = ids.orderBy(F.desc(F.xxhash64("id", F.lit(42)))).first()[0]
    return far, ids.selectExpr("id AS edge_id", f"id % 40 + if(id = {far}, 100000, 0) AS i1", "id div 40 % 40 AS j1", "id div 1600 AS k1", "id % 40 AS i2", "0 AS j2", "0 AS k2")


def test_more_than_50_000_places_are_clustered_exactly(spark):
    far, e = far_one(spark)
    got = cluster.hc1(e, "complete", 2)
    assert got.where("bundle = 1").select("edge_id").collect() == [(far,)] and got.count() == 60_000


def test_an_end_keeps_the_points_that_are_farthest_from_any_place():
    rng = np.random.default_rng(1)
    for p in (rng.integers(0, 7, (400, 3)).astype(float), rng.normal(0, 1, (400, 3)), np.ones((5, 3))):
        of = rng.integers(0, 3, len(p))
        rows = complete._outer(of, p)
        assert (np.diff(of[rows]) >= 0).all() and len({*rows.tolist()}) == len(rows)
        q = rng.normal(0, 20, (200, 3))
        d = ((q[:, None] - p[None]) ** 2).sum(2)
        for c in np.unique(of):
            assert np.allclose(d[:, of == c].max(1), d[:, rows[of[rows] == c]].max(1), rtol=1e-12)
    p = np.stack(np.meshgrid(*[np.arange(9.0)] * 3), -1).reshape(-1, 3)
    assert len(complete._outer(np.zeros(729, int), p)) == 8


def test_the_first_pipeline_clusters_all_places(spark):
    far, e = far_one(spark)
    got = pipeline.process_v1(e, bundles=2, networks=2).edges
    assert got.groupBy("bundle", "network").count().orderBy("bundle").collect() == [(0, 0, 59_999), (1, 1, 1)] and got.where("bundle = 1").first().edge_id == far


def test_copies_of_edges_for_the_tiles_of_bundles_are_small():
    rng = np.random.default_rng(4)
    x = np.stack([np.sort(rng.integers(0, 400, 20_000)), *rng.integers(0, 40, (6, 20_000))]).astype(float)
    assert (cluster._unpack(cluster._pack(x)) == x).all() and len(cluster._pack(x)) < 12 * 20_000
    for other in (x + 0.5, np.where(x == 3, np.nan, x), x * 1e9, x[:, :1], -x):
        assert np.array_equal(cluster._unpack(cluster._pack(other)), other, equal_nan=True)
