"""Every query of the engine on the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import distributions as D
from .operators import cluster, permute, signals, significance, spatial, view
from .plans import fixtures as X
from .plans import pipeline
from .tables import written

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


_r6 = lambda c="r": F.round(c, 6)
_CORR = "SELECT a.vox AS i, b.vox AS j, corr(a.x, b.x) AS r FROM points a JOIN points b ON a.t = b.t AND a.vox < b.vox GROUP BY ALL"
_ENDS6 = ["i1", "j1", "k1", "i2", "j2", "k2"]

# Correlation ---------------------------------------------------------------------------------------------


@query(X.with_("points") + f"SELECT i, j, round(r, 6) AS r FROM ({_CORR})")
def corr_pairs(spark, sf):
    return signals.correlate(X.signals(spark, sf), method="expr").select("i", "j", _r6().alias("r"))


@query(X.with_("points") + f"SELECT i, j, round(r, 6) AS r FROM ({_CORR})")
def corr_tile(spark, sf):
    return signals.correlate(X.signals(spark, sf)).select("i", "j", _r6().alias("r"))


@query(X.with_("points") + f"SELECT i, j, round(1 - r, 6) AS distance FROM ({_CORR})")
def corr_distance(spark, sf):
    return signals.correlation_distance(X.signals(spark, sf)).select("i", "j", _r6("distance").alias("distance"))


@query(X.with_("points", "coords") + f"""SELECT a.i AS i1, a.j AS j1, a.k AS k1, b.i AS i2, b.j AS j2, b.k AS k2, round(r, 6) AS r
    FROM ({_CORR}) p JOIN coords a ON a.vox = p.i JOIN coords b ON b.vox = p.j WHERE r > 0.4""")
def corr_threshold_edges(spark, sf):
    pairs = signals.correlate(X.signals(spark, sf), above=0.4)
    return significance.edges_of(pairs, X.coords(spark, sf), None).withColumn("r", _r6())


@query(X.with_("coords") + """, m AS (SELECT vec_id, row_number() OVER (ORDER BY k, j, i) - 1 AS vox, embedding FROM embeddings JOIN coords ON coords.vox = vec_id WHERE label < 5),
    p AS (SELECT vox, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS t FROM m)
    SELECT a.vox AS i, b.vox AS j, round(corr(a.x, b.x), 6) AS r FROM p a JOIN p b ON a.t = b.t AND a.vox < b.vox GROUP BY ALL""")
def masked_corr(spark, sf):
    s = X.signals(spark, sf).join(X.coords(spark, sf), "vox")
    voxels = s.select("i", "j", "k", F.posexplode("ts").alias("t", "value"))
    mask = s.select("i", "j", "k", (F.col("label") < 5).cast("double").alias("value"))
    return signals.correlate(written(signals.masked(voxels, mask), "signals")).select("i", "j", _r6().alias("r"))


@query("WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), n AS (SELECT count(*) AS n FROM embeddings) "
       "SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS k FROM p")
def tri_index(spark, sf):
    e = X.read(spark, sf, "embeddings").select(F.col("vec_id").alias("i"))
    n = e.count()
    return e.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(n).cast("long"))).alias("j")).where(F.col("j") < n).select("i", "j", C.tri_index(F.col("i"), F.col("j"), n).alias("k"))


@query("WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, i, j FROM p")
def tri_inverse(spark, sf):
    n = X.read(spark, sf, "embeddings").count()
    i, j = C.tri_inverse(F.col("id"), n)
    return spark.range(n * (n - 1) // 2).select(F.col("id").alias("k"), i.alias("i"), j.alias("j"))


@query(X.with_("points") + f"""SELECT i, j, round(r, 6) AS r FROM (SELECT i, j, r FROM ({_CORR}) UNION ALL SELECT j, i, r FROM ({_CORR}) UNION ALL SELECT DISTINCT vox, vox, 1.0 FROM points)""")
def tri_full_matrix(spark, sf):
    s = X.signals(spark, sf)
    return signals.full_matrix(signals.correlate(s), s.count()).withColumn("r", _r6())


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT unnest(range((n + 63) // 64)) AS b, n FROM n)
    SELECT x.b AS bx, y.b AS by, x.b * 64 AS i0, least(x.n, (x.b + 1) * 64) AS i1, y.b * 64 AS j0, least(x.n, (y.b + 1) * 64) AS j1 FROM b x JOIN b y ON x.b <= y.b""")
def block_bounds(spark, sf):
    return signals.block_bounds(spark, X.read(spark, sf, "embeddings").count(), 64)


@query("""WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT unnest(range(7)) AS p, n FROM n)
    SELECT p::INT AS part, p * (n // 7) AS first, CASE WHEN p = 6 THEN n ELSE (p + 1) * (n // 7) END AS last FROM p""")
def part_bounds(spark, sf):
    return signals.part_bounds(spark, X.read(spark, sf, "orders").count(), 7)


@query("SELECT 0::BIGINT AS differing")
def matrix_compare(spark, sf):
    s = X.signals(spark, sf)
    a, b = signals.correlate(s), signals.correlate(s, method="expr")
    return signals.compare(a, b, 1e-9).agg(F.count("*").alias("differing"))


# A signal without variance, and two that are equal.
@query(X.with_("points", more={
    "p": "SELECT vox, t, CASE vox WHEN 0 THEN 1 ELSE x END AS x FROM points WHERE vox <> 1 UNION ALL SELECT 1, t, x FROM points WHERE vox = 2",
    "c": "SELECT a.vox AS i, b.vox AS j, CASE WHEN stddev_pop(a.x) = 0 OR stddev_pop(b.x) = 0 THEN 0 ELSE round(corr(a.x, b.x), 6) END AS r FROM p a JOIN p b ON a.t = b.t AND a.vox < b.vox GROUP BY ALL",
}) + "SELECT i, j, r FROM c WHERE abs(r) >= 1 OR r = 0")
def corr_suspicious(spark, sf):
    s = X.signals(spark, sf).select("vox", "ts")
    flat = F.when(F.col("vox") == 0, F.transform("ts", lambda _: F.lit(1.0))).otherwise(F.col("ts"))
    planted = s.where("vox <> 1").withColumn("ts", flat).unionByName(s.where("vox = 2").withColumn("vox", F.lit(1).cast("long")))
    return signals.suspicious(signals.correlate(planted).withColumn("r", _r6()))


# Permutation tests ---------------------------------------------------------------------------------------

_STAT = "SELECT event_type, h, perm, sum(CASE WHEN in_a THEN value ELSE 0 END) * 10 - sum(CASE WHEN in_a THEN 0 ELSE value END) * 10 AS s FROM conn JOIN perms USING (subj) GROUP BY ALL"
_PVALUE = "SELECT event_type, h, round((sum(CASE WHEN perm > 0 AND {f}(s) >= {f}(seen) THEN 1 ELSE 0 END) + 1)::DOUBLE / 201::DOUBLE, 9) AS pvalue, round(any_value(seen)::DOUBLE / 100, 6) AS tstat FROM stat JOIN (SELECT event_type, h, s AS seen FROM stat WHERE perm = 0) USING (event_type, h) GROUP BY ALL"
_KEYS = ["event_type", "h"]


def _perm(spark, sf, **how):
    out = permute.permutation_test(X.connections(spark, sf), _KEYS, X.permutations(spark), X.SUBJECTS, **how)
    return out.select(*_KEYS, F.round("pvalue", 9).alias("pvalue"), F.round("tstat", 6).alias("tstat"))


@query(X.with_("conn") + "SELECT event_type, h, round(sum(CASE WHEN subj < 10 THEN value ELSE 0 END)::DOUBLE / 10 - sum(CASE WHEN subj >= 10 THEN value ELSE 0 END)::DOUBLE / 10, 6) AS tstat FROM conn GROUP BY ALL")
def perm_tstat(spark, sf):
    return permute.group_difference(X.connections(spark, sf), _KEYS, F.col("subj") < 10).withColumn("tstat", F.round("tstat", 6))


@query(X.with_("conn", "perms", more={"stat": _STAT}) + _PVALUE.format(f=""))
def perm_pvalue_one(spark, sf):
    return _perm(spark, sf, method="sql")


@query(X.with_("conn", "perms", more={"stat": _STAT}) + _PVALUE.format(f="abs"))
def perm_pvalue_two(spark, sf):
    return _perm(spark, sf, method="sql", two_tailed=True)


@query(X.with_("conn", "perms", more={"stat": _STAT}) + _PVALUE.format(f=""))
def perm_pvalue_gemm(spark, sf):
    return _perm(spark, sf)


@query(X.with_("conn", "perms", more={"stat": _STAT}) + _PVALUE.format(f="abs"))
def perm_pvalue_gemm_two(spark, sf):
    return _perm(spark, sf, two_tailed=True)


@query(X.with_("perms") + "SELECT a, min(perm) AS perm FROM (SELECT perm, array_to_string(list(subj ORDER BY subj), ',') AS a FROM perms WHERE in_a GROUP BY perm) GROUP BY a")
def perm_unique(spark, sf):
    return X.permutations(spark).select("perm", F.array_join("a", ",").alias("a")).groupBy("a").agg(F.min("perm").alias("perm"))


# What must hold of random permutations: as many as asked, all different, each half of the subjects, in order.
@query("SELECT 500::BIGINT AS n, 500::BIGINT AS n_distinct, 10 AS least, 10 AS most, 0 AS first, 19 AS last, 500::BIGINT AS sorted, 0::BIGINT AS repeated")
def perm_random(spark, sf):
    p = permute.random_permutations(spark, 10, 10, 500, seed=3)
    size, whole = F.size("a"), F.col("a").cast("array<int>")
    return p.agg(
        F.count("*").alias("n"), F.countDistinct("a").alias("n_distinct"), F.min(size).alias("least"), F.max(size).alias("most"), F.min(F.array_min(whole)).alias("first"), F.max(F.array_max(whole)).alias("last"),
        F.sum((F.sort_array("a") == F.col("a")).cast("long")).alias("sorted"), F.sum((F.size(F.array_distinct("a")) < size).cast("long")).alias("repeated"),
    )


@query(X.with_("conn") + "SELECT event_type, h, array_to_string(list(value ORDER BY subj), ',') AS vals FROM conn GROUP BY ALL")
def subject_alignment(spark, sf):
    return permute.aligned(X.connections(spark, sf), _KEYS).select(*_KEYS, F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals"))


# Significance --------------------------------------------------------------------------------------------


@query(X.with_("edges") + "SELECT count(*) AS n, round(min(pvalue), 9) AS min, round(max(pvalue), 9) AS max, round(sum(pvalue), 4) AS sum, round(sum(pvalue * pvalue), 4) AS sum_sq, round(avg(pvalue), 9) AS mean, round(stddev_pop(pvalue), 6) AS std FROM edges")
def pval_summary(spark, sf):
    s = significance.summary(X.edges(spark, sf))
    return s.select("n", *(F.round(c, d).alias(c) for c, d in (("min", 9), ("max", 9), ("sum", 4), ("sum_sq", 4), ("mean", 9), ("std", 6))))


@query(X.with_("edges") + "SELECT t AS threshold, count(*) FILTER (WHERE pvalue < t) AS n, round(100.0 * count(*) FILTER (WHERE pvalue < t) / count(*), 6) AS percent FROM edges CROSS JOIN (SELECT unnest([0.05, 0.01, 0.001, 0.0005, 0.0001])::DOUBLE AS t) GROUP BY t")
def pval_thresholds(spark, sf):
    return significance.threshold_counts(X.edges(spark, sf)).withColumn("percent", F.round("percent", 6))


@query(X.with_("edges") + """, r AS (SELECT pvalue, row_number() OVER (ORDER BY pvalue) - 1 AS k, count(*) OVER () AS n FROM edges)
    SELECT d::INT AS decile, round(pvalue, 9) AS value FROM r JOIN (SELECT unnest(range(11)) AS d) ON k = least(n - 1, floor(n * (d / 10))::BIGINT)""")
def pval_deciles(spark, sf):
    return significance.deciles(X.edges(spark, sf)).withColumn("value", F.round("value", 9))


@query(X.with_("edges") + "SELECT count(*) AS n, count(*) FILTER (WHERE pvalue = 0) AS zeros, count(*) FILTER (WHERE pvalue = 1) AS ones, round(min(pvalue), 9) AS min, round(max(pvalue), 9) AS max, CASE WHEN count(*) FILTER (WHERE pvalue = 0) = 0 AND min(pvalue) >= 1 / 1002 * (1 - 1e-6) AND max(pvalue) <= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM edges")
def pval_verdict(spark, sf):
    return significance.verdict(X.edges(spark, sf), 1001).withColumns({c: F.round(c, 9) for c in ("min", "max")})


_HIST = """, b AS (SELECT b, pow(10.0, b * 20.0 / 400 - 20) AS l, pow(10.0, (b + 1) * 20.0 / 400 - 20) AS r FROM (SELECT unnest(range(400)) AS b)),
    v AS (SELECT pvalue, count(*) AS n FROM edges GROUP BY pvalue),
    hist AS (SELECT b AS bin, l AS left_, r AS right_, sum(n)::BIGINT AS count FROM v JOIN b ON (pvalue > l OR b = 0) AND (pvalue <= r OR b = 399) GROUP BY ALL)
"""


def _hist(spark, sf):
    return significance.log_histogram(X.edges(spark, sf), bins=400)


@query(X.with_("edges") + _HIST + 'SELECT bin, round(left_, 12) AS "left", round(right_, 12) AS "right", count FROM hist')
def pval_log_hist(spark, sf):
    return _hist(spark, sf).withColumns({c: F.round(c, 12) for c in ("left", "right")})


@query(X.with_("edges") + _HIST + "SELECT p AS percent, round(min(right_), 9) AS value FROM (SELECT *, sum(count) OVER (ORDER BY bin) AS cum, sum(count) OVER () AS n FROM hist) JOIN (SELECT unnest([1, 5, 10, 15, 20])::DOUBLE AS p) ON cum >= ceil(n * p / 100) GROUP BY p")
def pval_hist_percentiles(spark, sf):
    return significance.histogram_percentiles(_hist(spark, sf)).withColumn("value", F.round("value", 9))


@query(X.with_("edges") + _HIST + "SELECT bin, count, round(count / (sum(count) OVER () * (right_ - left_)), 6) AS density, (sum(count) OVER (ORDER BY bin))::BIGINT AS cumulative, round(100.0 * sum(count) OVER (ORDER BY bin) / sum(count) OVER (), 6) AS cumulative_pct FROM hist")
def pval_hist_cum(spark, sf):
    return significance.running(_hist(spark, sf)).select("bin", "count", F.round("density", 6).alias("density"), "cumulative", F.round("cumulative_pct", 6).alias("cumulative_pct"))


_P9 = "round(pvalue, 9) AS pvalue, tstat"


@query(X.with_("edges") + f"SELECT edge_id, i1, j1, k1, i2, j2, k2, {_P9} FROM edges WHERE pvalue < 0.05")
def significant_edges(spark, sf):
    return X.edges(spark, sf).where(C.below(F.col("pvalue"), 0.05)).withColumn("pvalue", F.round("pvalue", 9))


@query(X.with_("edges") + "SELECT edge_id, tstat FROM edges WHERE tstat > 0 OR tstat = 0")
def split_pos(spark, sf):
    return X.edges(spark, sf).where(C.positive_side(F.col("tstat"))).select("edge_id", "tstat")


@query(X.with_("edges") + "SELECT edge_id, tstat FROM edges WHERE tstat < 0 OR tstat = 0")
def split_neg(spark, sf):
    return X.edges(spark, sf).where(C.negative_side(F.col("tstat"))).select("edge_id", "tstat")


@query(X.with_("edges") + "SELECT edge_id, tstat FROM (SELECT *, rank() OVER (ORDER BY tstat DESC) AS k FROM edges) WHERE k <= 100")
def top_tstat(spark, sf):
    return significance.top_tstat(X.edges(spark, sf), 100).select("edge_id", "tstat")


@query(X.with_("edges") + "SELECT edge_id, tstat FROM edges WHERE tstat >= 0.9")
def tstat_ge(spark, sf):
    return significance.top_tstat(X.edges(spark, sf), threshold=0.9).select("edge_id", "tstat")


@query(X.with_("edges") + "SELECT edge_id, printf('%.6f', pvalue) AS p, printf('%.6f', tstat) AS t FROM edges")
def decimal_format(spark, sf):
    return X.edges(spark, sf).select("edge_id", C.decimals(F.col("pvalue")).alias("p"), C.decimals(F.col("tstat")).alias("t"))


@query(X.with_("edges") + "SELECT edge_id, CASE WHEN tstat > 0.01 THEN 1 ELSE 0 END AS above FROM edges")
def binarise(spark, sf):
    return X.edges(spark, sf).select("edge_id", F.when(F.col("tstat") > 0.01, 1).otherwise(0).alias("above"))


@query(X.with_("edges") + "SELECT round(avg(CASE WHEN i1 < 20 AND j1 < 20 THEN tstat END), 9) AS inside, round(avg(CASE WHEN NOT (i1 < 20 AND j1 < 20) THEN tstat END), 9) AS outside FROM edges")
def block_mean(spark, sf):
    inside = (F.col("i1") < 20) & (F.col("j1") < 20)
    return X.edges(spark, sf).agg(F.round(F.avg(F.when(inside, F.col("tstat"))), 9).alias("inside"), F.round(F.avg(F.when(~inside, F.col("tstat"))), 9).alias("outside"))


# Edges, bundles, pruning ---------------------------------------------------------------------------------


@query(X.with_("edges") + "SELECT edge_id, 1 AS side, i1 AS i, j1 AS j, k1 AS k FROM edges UNION ALL SELECT edge_id, 2, i2, j2, k2 FROM edges")
def edge_endpoints(spark, sf):
    return spatial.endpoints(X.edges(spark, sf))


@query(X.with_("edges") + "SELECT i1 AS i, j1 AS j, k1 AS k FROM edges UNION SELECT i2, j2, k2 FROM edges")
def distinct_voxels(spark, sf):
    return spatial.voxels(X.edges(spark, sf))


@query(X.with_("iso") + "SELECT edge_id FROM iso")
def isolation_filter(spark, sf):
    return spatial.filter_isolated(X.edges(spark, sf)).select("edge_id")


def _iso(spark, sf):
    return written(spatial.filter_isolated(X.edges(spark, sf)), "iso")


@query(X.with_("comp") + "SELECT i, j, k, (root // 1000000)::INT AS ri, (root // 1000 % 1000)::INT AS rj, (root % 1000)::INT AS rk FROM comp JOIN vox USING (v)")
def voxel_components(spark, sf):
    return spatial.voxel_components(_iso(spark, sf)).select("i", "j", "k", F.col("root.i").alias("ri"), F.col("root.j").alias("rj"), F.col("root.k").alias("rk"))


@query(X.with_("iso", "ends") + """, near AS (SELECT DISTINCT x.edge_id AS a, y.edge_id AS b FROM ends x JOIN ends y ON x.g = y.g AND x.edge_id <> y.edge_id AND greatest(abs(x.i - y.i), abs(x.j - y.j), abs(x.k - y.k)) <= 1),
    walk AS (SELECT edge_id AS e, edge_id AS root FROM iso UNION SELECT near.b, walk.root FROM walk JOIN near ON walk.e = near.a),
    least AS (SELECT e, min(root) AS root FROM walk GROUP BY e)
    SELECT e AS edge_id, dense_rank() OVER (ORDER BY root) - 1 AS component FROM least""")
def edge_components(spark, sf):
    return spatial.edge_components(_iso(spark, sf))


@query(X.with_("bundles") + "SELECT edge_id, bundle FROM bundles")
def bundle_cc(spark, sf):
    return spatial.bundle_cc(_iso(spark, sf)).select("edge_id", "bundle")


@query(X.with_("iso") + """, o AS (SELECT edge_id, i1 AS si, j1 AS sj, k1 AS sk, i2 AS i, j2 AS j, k2 AS k FROM iso UNION ALL SELECT edge_id, i2, j2, k2, i1, j1, k1 FROM iso),
    near AS (SELECT DISTINCT x.edge_id AS a, y.edge_id AS b FROM o x JOIN o y ON x.edge_id <> y.edge_id AND x.si = y.si AND x.sj = y.sj AND x.sk = y.sk AND greatest(abs(x.i - y.i), abs(x.j - y.j), abs(x.k - y.k)) <= 1),
    walk AS (SELECT edge_id AS e, edge_id AS root FROM iso UNION SELECT near.b, walk.root FROM walk JOIN near ON walk.e = near.a),
    least AS (SELECT e, min(root) AS root FROM walk GROUP BY e)
    SELECT e AS edge_id, (dense_rank() OVER (ORDER BY n DESC, root) - 1)::INT AS bundle FROM (SELECT e, root, count(*) OVER (PARTITION BY root) AS n FROM least)""")
def bundle_strict(spark, sf):
    return spatial.bundle_strict(_iso(spark, sf)).select("edge_id", "bundle")


def _large(spark, sf):
    """Bundles of three edges or more."""
    return written(spatial.drop_small(spatial.bundle_cc(_iso(spark, sf)), 3), "large")


@query(X.with_("large") + "SELECT edge_id, bundle FROM large")
def drop_small(spark, sf):
    return _large(spark, sf).select("edge_id", "bundle")


@query(X.with_("edges") + "SELECT edge_id, (dense_rank() OVER (ORDER BY n DESC, g) - 1)::INT AS g FROM (SELECT edge_id, i1 AS g, count(*) OVER (PARTITION BY i1) AS n FROM edges)")
def relabel_by_size(spark, sf):
    return spatial.relabel(X.edges(spark, sf).select("edge_id", F.col("i1").alias("g")), "g")


def _prune_sql(rounds: int = 8) -> str:
    more = {"r0": "SELECT * FROM bundled"}
    for k in range(rounds):
        more[f"e{k}"] = f"SELECT edge_id, bundle, 1 AS side, i1 AS i, j1 AS j, k1 AS k FROM r{k} UNION ALL SELECT edge_id, bundle, 2, i2, j2, k2 FROM r{k}"
        more[f"r{k + 1}"] = f"SELECT * FROM r{k} WHERE edge_id IN (SELECT x.edge_id FROM e{k} x WHERE EXISTS (SELECT 1 FROM e{k} y WHERE y.bundle = x.bundle AND y.edge_id <> x.edge_id AND greatest(abs(x.i - y.i), abs(x.j - y.j), abs(x.k - y.k)) <= 1) GROUP BY x.edge_id HAVING count(*) = 2)"
    return X.with_("bundled", more=more)


@query(_prune_sql() + "SELECT edge_id, (dense_rank() OVER (ORDER BY n DESC, bundle) - 1)::INT AS bundle FROM (SELECT *, count(*) OVER (PARTITION BY bundle) AS n FROM r8)")
def prune_isolated_fixpoint(spark, sf):
    return spatial.prune_isolated(spatial.bundle_cc(_iso(spark, sf))).select("edge_id", "bundle")


@query(X.with_("bundled", more={
    "gv": "SELECT DISTINCT bundle, i, j, k, i::BIGINT * 1000000 + j * 1000 + k AS v FROM (SELECT bundle, i1 AS i, j1 AS j, k1 AS k FROM bundled UNION ALL SELECT bundle, i2, j2, k2 FROM bundled)",
    "ga": "SELECT a.bundle, a.v AS a, b.v AS b FROM gv a JOIN gv b ON a.bundle = b.bundle AND a.v <> b.v AND greatest(abs(a.i - b.i), abs(a.j - b.j), abs(a.k - b.k)) <= 1",
    "gr": "SELECT bundle, v, v AS root FROM gv UNION SELECT ga.bundle, ga.b, gr.root FROM gr JOIN ga ON gr.bundle = ga.bundle AND gr.v = ga.a",
    "gc": "SELECT bundle, v, min(root) AS root FROM gr GROUP BY ALL",
    "small": "SELECT bundle, v FROM (SELECT *, count(*) OVER (PARTITION BY bundle, root) AS n FROM gc) WHERE n < 3",
    "left_": "SELECT * FROM bundled b WHERE NOT EXISTS (SELECT 1 FROM small s WHERE s.bundle = b.bundle AND s.v IN (i1::BIGINT * 1000000 + j1 * 1000 + k1, i2::BIGINT * 1000000 + j2 * 1000 + k2))",
}) + "SELECT edge_id, (dense_rank() OVER (ORDER BY n DESC, bundle) - 1)::INT AS bundle FROM (SELECT *, count(*) OVER (PARTITION BY bundle) AS n FROM left_)")
def prune_endpoint_clusters(spark, sf):
    return spatial.prune_small_clusters(spatial.bundle_cc(_iso(spark, sf))).select("edge_id", "bundle")


_D12 = "sqrt(pow(a.i1 - b.i1, 2) + pow(a.j1 - b.j1, 2) + pow(a.k1 - b.k1, 2)) AS d1, sqrt(pow(a.i2 - b.i2, 2) + pow(a.j2 - b.j2, 2) + pow(a.k2 - b.k2, 2)) AS d2"


def _edge_dist(flag: str, expr: str) -> None:
    def run(spark, sf):
        return cluster.edge_pairs(X.lines(spark, sf), flag).withColumn("dist", F.round("dist", 6))

    run.__name__ = f"edge_dist_{flag}"
    query(X.with_("lines") + f"SELECT a, b, round({expr}, 6) AS dist FROM (SELECT a.edge_id AS a, b.edge_id AS b, {_D12} FROM lines a JOIN lines b ON a.edge_id < b.edge_id)")(run)


for _flag, _expr in (("max", "greatest(d1, d2)"), ("min", "least(d1, d2)"), ("mean", "(d1 + d2) / 2")):
    _edge_dist(_flag, _expr)


@query(X.with_("large") + f"SELECT a, b, round(min(least(d1, d2)), 6) AS dist FROM (SELECT a.bundle AS a, b.bundle AS b, {_D12} FROM large a JOIN large b ON a.bundle < b.bundle) GROUP BY ALL")
def bundle_min_dist(spark, sf):
    return cluster.bundle_distances(_large(spark, sf)).withColumn("dist", F.round("dist", 6))


@query(X.with_("bundled") + f"SELECT bundle, round(max(least(d1, d2)), 6) AS maxmin FROM (SELECT a.bundle AS bundle, {_D12} FROM bundled a JOIN bundled b ON a.bundle = b.bundle) GROUP BY ALL")
def bundle_maxmin(spark, sf):
    return cluster.maxmin(spatial.bundle_cc(_iso(spark, sf))).withColumn("maxmin", F.round("maxmin", 6))


@query(X.with_("bundled") + f"SELECT bundle, round(max(d), 6) AS maxmin FROM (SELECT bundle, e, min(least(d1, d2)) AS d FROM (SELECT a.bundle AS bundle, a.edge_id AS e, {_D12} FROM bundled a JOIN bundled b ON a.bundle = b.bundle AND a.edge_id <> b.edge_id) GROUP BY ALL) GROUP BY ALL")
def bundle_maxmin_edges(spark, sf):
    return cluster.maxmin(spatial.bundle_cc(_iso(spark, sf)), form="edges").withColumn("maxmin", F.round("maxmin", 6))


@query(X.with_("bundled") + "SELECT bundle, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _ENDS6) + " FROM bundled GROUP BY bundle")
def bundle_centroid(spark, sf):
    return spatial.centroids(spatial.bundle_cc(_iso(spark, sf)), "bundle").select("bundle", *(F.round(c, 6).alias(c) for c in _ENDS6))


@query(X.with_("large", "edges", more={"c": "SELECT bundle, " + ", ".join(f"avg({c}) AS {c}" for c in _ENDS6) + " FROM large GROUP BY bundle"})
       + "SELECT e.edge_id, arg_min(c.bundle, {'d': round(" + " + ".join(f"pow(e.{c} - c.{c}, 2)" for c in _ENDS6) + ", 9), 'b': c.bundle}) AS bundle FROM edges e CROSS JOIN c GROUP BY e.edge_id")
def nearest_centroid(spark, sf):
    return spatial.nearest_centroid(X.edges(spark, sf), spatial.centroids(_large(spark, sf), "bundle"), "bundle", digits=9)


@query(X.with_("edges") + "SELECT edge_id, round((i1 + i2) / 2 + 0.1 * 0.5 * l, 6) AS x, round((j1 + j2) / 2 - 0.1 * 0.25 * l, 6) AS y FROM (SELECT *, sqrt(pow(i1 - i2, 2) + pow(j1 - j2, 2) + pow(k1 - k2, 2)) AS l FROM edges)")
def spline_mid(spark, sf):
    e = X.edges(spark, sf)
    length = C.euclid([F.col(f"{c}1") for c in "ijk"], [F.col(f"{c}2") for c in "ijk"])
    mid = lambda a, by: F.round(C.spline_mid(F.col(f"{a}1"), F.col(f"{a}2"), F.lit(by), length), 6)
    return e.select("edge_id", mid("i", 0.5).alias("x"), mid("j", -0.25).alias("y"))


@query(X.with_("large", more={
    "bd": f"SELECT a, b, min(least(d1, d2)) AS d FROM (SELECT a.bundle AS a, b.bundle AS b, {_D12} FROM large a JOIN large b ON a.bundle <> b.bundle) GROUP BY ALL",
    "bw": "SELECT DISTINCT bundle AS e, bundle AS root FROM large UNION SELECT bd.b, bw.root FROM bw JOIN bd ON bw.e = bd.a AND bd.d <= 4",
}) + "SELECT e AS bundle, min(root) AS root FROM bw GROUP BY e")
def single_linkage_cut_h(spark, sf):
    return cluster.single_cut(_large(spark, sf), 4.0)


@query()
def hc1_complete(spark, sf):
    return cluster.hc1(X.edges(spark, sf), "complete", 44).select("edge_id", "bundle")


@query()
def hc2_average(spark, sf):
    return cluster.hc2(_large(spark, sf))[0].select("edge_id", "bundle", "network")


@query()
def recut(spark, sf):
    edges, tree = cluster.hc2(_large(spark, sf))
    return cluster.recut(edges, tree, 9).select("edge_id", "network")


@query()
def pipeline_v1(spark, sf):
    return pipeline.process_v1(X.edges(spark, sf), bundles=400).edges.select("edge_id", "bundle", "network")


@query()
def pipeline_v2(spark, sf):
    return pipeline.process_v2(X.edges(spark, sf)).edges.select("edge_id", "bundle", "network")


@query(_prune_sql().replace("bundled AS (SELECT iso.*", "bundled AS (SELECT iso.*") + "SELECT edge_id, CASE WHEN edge_id NOT IN (SELECT edge_id FROM iso) THEN 'isolation' WHEN edge_id NOT IN (SELECT edge_id FROM r8) THEN 'prune' END AS removed_by FROM edges")
def mask_chain(spark, sf):
    e = X.edges(spark, sf)
    iso = _iso(spark, sf)
    return spatial.removed_by(e, [("isolation", iso), ("prune", spatial.prune_isolated(spatial.bundle_cc(iso)))])


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_rollup(spark, sf):
    from .sources import sinks

    return sinks.status_rollup(X.read(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"))


@query(X.with_("bundled") + "SELECT edge_id, bundle FROM bundled WHERE bundle IN (0, 2)")
def select_labels(spark, sf):
    chosen = spark.createDataFrame([(0, None), (2, 2)], "network int, bundle int")
    return spatial.select_labels(spatial.bundle_cc(_iso(spark, sf)), chosen).select("edge_id", "bundle")


def _labelled(spark, sf):
    """Bundles of three edges or more, in five networks by number."""
    return _large(spark, sf).withColumn("network", F.col("bundle") % 5)


@query(X.with_("large") + "SELECT (bundle % 5)::INT AS network, bundle, count(*) AS n FROM large GROUP BY ALL")
def tree_model(spark, sf):
    return view.tree_model(_labelled(spark, sf))


_CHOSEN = "SELECT DISTINCT (bundle % 5)::INT AS network, CASE WHEN bundle % 5 = 3 AND bundle > 10 THEN NULL ELSE bundle END AS bundle FROM large WHERE bundle % 7 < 2"


@query(X.with_("large", more={"chosen": _CHOSEN}) + "SELECT network, CASE WHEN count(*) > count(bundle) THEN 'All' ELSE array_to_string(list(bundle ORDER BY bundle), ', ') END AS bundles FROM chosen GROUP BY network")
def selection_summary(spark, sf):
    chosen = _labelled(spark, sf).where("bundle % 7 < 2").selectExpr("network", "if(bundle % 5 = 3 AND bundle > 10, NULL, bundle) AS bundle").distinct()
    return view.selection_summary(chosen)


@query(X.with_("large") + "SELECT DISTINCT (bundle % 5)::INT AS network, bundle, CASE WHEN bundle % 4 = 0 THEN 'own ' || bundle WHEN bundle % 5 < 2 THEN 'net ' || (bundle % 5) ELSE 'palette ' || (bundle % 39) END AS colour FROM large")
def colours(spark, sf):
    e = _labelled(spark, sf)
    own = e.where("bundle % 4 = 0").selectExpr("network", "bundle", "concat('own ', bundle) AS colour")
    return view.colours(e, own, e.where("network < 2").selectExpr("network", "concat('net ', network) AS colour"))


# Distributions -------------------------------------------------------------------------------------------


def _dist(name: str, table: str, col: str, key: list[str], p: tuple, sql_p: str, sql_q: str) -> None:
    def run(spark, sf):
        x = F.col(col)
        return X.read(spark, sf, table).groupBy(*key, col).count().select(*key, F.round(D.stat2cdf(x, name, *p), 9).alias("p"), F.round(D.stat2rcdf(x, name, *p), 9).alias("q"))

    run.__name__ = f"dist_{name.lower()}"
    query(f"WITH v AS (SELECT DISTINCT {', '.join(key)}, {col} AS x FROM {table}) SELECT {', '.join(key)}, round({sql_p}, 9) AS p, round({sql_q}, 9) AS q FROM v")(run)


_y = lambda a, b: f"((x - {a}) / {b})"
_dist("LOGISTIC", "lineitem", "l_quantity", ["l_orderkey"], (25, 6, 0), f"1 / (1 + exp(-{_y(25, 6)}))", f"1 / (1 + exp({_y(25, 6)}))")
_dist("LAPLACE", "lineitem", "l_quantity", ["l_orderkey"], (25, 6, 0), f"CASE WHEN x >= 25 THEN 1 - 0.5 * exp(-{_y(25, 6)}) ELSE 0.5 * exp({_y(25, 6)}) END", f"CASE WHEN x >= 25 THEN 0.5 * exp(-{_y(25, 6)}) ELSE 1 - 0.5 * exp({_y(25, 6)}) END")
_dist("UNIFORM", "lineitem", "l_quantity", ["l_orderkey"], (5, 40, 0), f"greatest(0, least(1, {_y(5, 35)}))", f"1 - {_y(5, 35)}")
_dist("WEIBULL", "lineitem", "l_quantity", ["l_orderkey"], (2, 20, 1.5), f"CASE WHEN x > 2 THEN 1 - exp(-pow({_y(2, 20)}, 1.5)) ELSE 0 END", f"CASE WHEN x > 2 THEN exp(-pow({_y(2, 20)}, 1.5)) ELSE 1 END")
_dist("EXTVAL", "lineitem", "l_quantity", ["l_orderkey"], (20, 8, 0), f"CASE WHEN {_y(20, 8)} > -5 THEN exp(-exp(-{_y(20, 8)})) ELSE 0 END", f"CASE WHEN {_y(20, 8)} > -5 THEN 1 - exp(-exp(-{_y(20, 8)})) ELSE 1 END")
_dist("PVAL", "lineitem", "l_discount", ["l_orderkey"], (0, 0, 0), "1 - x", "x")
_dist("LOGPVAL", "lineitem", "l_tax", ["l_orderkey"], (0, 0, 0), "1 - exp(-abs(x))", "exp(-abs(x))")
_dist("LOG10PVAL", "lineitem", "l_tax", ["l_orderkey"], (0, 0, 0), "1 - pow(10.0, -abs(x))", "pow(10.0, -abs(x))")


# Weights of Simpson's rule over (0, 1); densities are integrated from 0 to x in the square root of the value, which is smooth at 0.
_GRID = "g AS (SELECT n / 2000.0::DOUBLE AS u, CASE WHEN n = 0 OR n = 2000 THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END / 6000.0::DOUBLE AS w FROM (SELECT unnest(range(2001)) AS n)), j AS (SELECT unnest(range(60)) AS j)"
_UPTO = "SELECT v, x, CASE WHEN x > 0 THEN sum(w * 2 * x * u * ({f})) ELSE 0 END AS p FROM (SELECT *, {y} * u * u AS t FROM v CROSS JOIN g) WHERE u > 0 GROUP BY v, x"
_ABOUT = "SELECT v, x, 0.5 + sum(w * {y} * ({f})) AS p FROM (SELECT *, {y} * u AS t FROM v CROSS JOIN g) GROUP BY v, x"


def _density(f: str, y: str = "x") -> str:
    return _UPTO.replace("2 * x * u", f"2 * {y} * u").format(f=f, y=y)


def _numeric(name: str, p: tuple, x: str, sql: str | None = None) -> None:
    """Tails, and the z-score of a value: where there is SQL, as the normal tail at the z-score, which has to be p."""

    def run(spark, sf):
        v = X.read(spark, sf, "lineitem").select(F.col("l_quantity").alias("v")).distinct().select("v", F.expr(x).alias("x"))
        c = F.col("x")
        out = v.select("v", "x", *(f(c, name, *p).alias(n) for n, f in (("p", D.stat2cdf), ("q", D.stat2rcdf), ("z", D.stat2zscore))))
        if sql:
            out = out.withColumn("pz", D.stat2cdf(F.col("z"), "ZSCORE")).drop("z")
        return out.select("v", "x", *(F.round(n, 9).alias(n) for n in out.columns[2:]))

    run.__name__ = f"dist_{name.lower()}"
    query(sql and f"WITH v AS (SELECT DISTINCT l_quantity AS v, {x.replace(' / ', ' / 1.0::DOUBLE / ')} AS x FROM lineitem), {_GRID}, p AS ({sql}) SELECT v, x, round(p, 9) AS p, round(1 - p, 9) AS q, round(p, 9) AS pz FROM p")(run)


_PHI = _ABOUT.format(f="exp(-t * t / 2) / sqrt(2 * pi())", y="{y}")
_numeric("CORREL", (10, 0, 0), "v / 51 - 0.5", _density("630 * pow(t, 4) * pow(1 - t, 4)", "((x + 1) / 2)").replace("x > 0", "x > -1"))
_numeric("TTEST", (7, 0, 0), "v / 10 - 2.5", _ABOUT.format(f="gamma(4) / sqrt(7 * pi()) / gamma(3.5) * pow(1 + t * t / 7, -4)", y="x"))
_numeric("FTEST", (3, 9, 0), "v / 10", _density("gamma(6) / gamma(1.5) / gamma(4.5) * pow(1 / 3.0::DOUBLE, 1.5) * sqrt(t) * pow(1 + t / 3, -6)"))
_numeric("ZSCORE", (0, 0, 0), "v / 10 - 2.5", _PHI.format(y="x"))
_numeric("CHISQ", (4, 0, 0), "v / 4", _density("t * exp(-t / 2) / 4"))
_numeric("BETA", (2, 5, 0), "v / 51", _density("30 * t * pow(1 - t, 4)"))
_numeric("BINOM", (50, 0.4, 0), "v", "SELECT v, x, sum(exp(lgamma(51) - lgamma(j + 1) - lgamma(51 - j) + j * ln(0.4::DOUBLE) + (50 - j) * ln(0.6::DOUBLE))) AS p FROM v JOIN j ON j <= x AND j <= 50 GROUP BY v, x")
_numeric("GAMMA", (2.5, 1.5, 0), "v / 10", _density("pow(1.5, 2.5) / gamma(2.5) * pow(t, 1.5) * exp(-1.5 * t)"))
_numeric("POISSON", (20, 0, 0), "v", "SELECT v, x, sum(exp(j * ln(20) - 20 - lgamma(j + 1))) AS p FROM v JOIN j ON j <= x GROUP BY v, x")
_numeric("NORMAL", (25, 9, 0), "v", _PHI.format(y="((x - 25) / 9)"))
_numeric("FTEST_NONC", (3, 9, 2), "v / 10", _density("SELECTED", "(3 * x / (3 * x + 9))").replace("CROSS JOIN g)", "CROSS JOIN g CROSS JOIN j WHERE j < 40)").replace("SELECTED", "exp(-1 - lgamma(j + 1) + lgamma(6 + j) - lgamma(1.5 + j) - lgamma(4.5)) * pow(t, 0.5 + j) * pow(1 - t, 3.5)"))
_numeric("CHISQ_NONC", (4, 3, 0), "v / 3", _density("exp(-1.5 + j * ln(1.5) - lgamma(j + 1) - t / 2 - (2 + j) * ln(2) - lgamma(2 + j)) * pow(t, 1 + j)").replace("CROSS JOIN g)", "CROSS JOIN g CROSS JOIN j)"))
_numeric("TTEST_NONC", (8, 1.2, 0), "v / 10 - 2")
_numeric("CHI", (3, 0, 0), "v / 12", _density("sqrt(2 / pi()) * t * t * exp(-t * t / 2)"))
_numeric("INVGAUSS", (2, 3, 0), "v / 10", _density("sqrt(3 / (2 * pi() * t * t * t)) * exp(-3 * (t - 2) * (t - 2) / (8 * t))"))

# Images --------------------------------------------------------------------------------------------------

_AFFINE = [[-3.0, 0.0, 0.0, 90.0], [0.0, 3.0, 0.0, -126.0], [0.0, 0.0, 3.0, -72.0]]


@query(X.with_("coords") + "SELECT vox, -3.0::DOUBLE * i + 90 AS x, 3.0::DOUBLE * j - 126 AS y, 3.0::DOUBLE * k - 72 AS z FROM coords")
def affine_vox_to_mm(spark, sf):
    x, y, z = C.affine(_AFFINE, F.col("i"), F.col("j"), F.col("k"))
    return X.coords(spark, sf).select("vox", x.alias("x"), y.alias("y"), z.alias("z"))


@query(X.with_("coords") + "SELECT vox, round(-(x - 90) / 3, 9) + 0 AS i, round((y + 126) / 3, 9) AS j, round((z + 72) / 3, 9) AS k FROM coords")
def affine_mm_to_vox(spark, sf):
    from .functions.geometry import inverse4

    i, j, k = C.affine(inverse4(_AFFINE), F.col("x"), F.col("y"), F.col("z"))
    return X.coords(spark, sf).select("vox", (F.round(i, 9) + 0.0).alias("i"), F.round(j, 9).alias("j"), F.round(k, 9).alias("k"))


@query(X.with_("cube") + "SELECT i, j, k, t, raw * 0.25::DOUBLE + 128 AS value FROM cube")
def scale_intensity(spark, sf):
    return X.cube(spark).select("i", "j", "k", "t", C.scaled(F.col("raw"), 0.25, 128).alias("value"))


@query(X.with_("cube") + "SELECT pos::INT AS pos, i, j, k, raw FROM cube JOIN (SELECT unnest([2, 0, 5, 5]) AS brick, generate_subscripts([2, 0, 5, 5], 1) - 1 AS pos) ON t = brick")
def brick_list(spark, sf):
    from .sources.image import bricks

    return bricks(X.cube(spark), [2, 0, 5, 5]).select("pos", "i", "j", "k", "raw")


@query(X.with_("cube") + "SELECT t, raw FROM cube WHERE i = 3 AND j = 3 AND k = 3")
def collapsed_image(spark, sf):
    from .sources.image import collapsed

    return collapsed(X.cube(spark), {"i": 3, "j": 3, "k": 3}).select("t", "raw")


@query(X.with_("cube") + "SELECT i, j, k, t, raw FROM cube WHERE i BETWEEN 5 AND 9 AND j BETWEEN 4 AND 8 AND k BETWEEN 2 AND 6")
def subregion(spark, sf):
    from .sources.image import region

    return region(X.cube(spark), {"i": (5, 5), "j": (4, 5), "k": (2, 5), "t": (0, 7)})


@query(X.with_("cube") + "SELECT i, j, k, array_to_string(list(raw ORDER BY t), ',') AS ts FROM cube WHERE j = 4 AND k = 2 GROUP BY ALL")
def row_series(spark, sf):
    from .sources.image import collapsed, series

    return series(collapsed(X.cube(spark), {"j": 4, "k": 2}), "raw").select("i", "j", "k", F.array_join(F.col("ts").cast("array<string>"), ",").alias("ts"))


@query(X.with_("cube") + "SELECT i, j, k, array_to_string(list(raw ORDER BY t), ',') AS ts FROM cube WHERE k = 4 GROUP BY ALL")
def slice_series(spark, sf):
    from .sources.image import collapsed, series

    return series(collapsed(X.cube(spark), {"k": 4}), "raw").select("i", "j", "k", F.array_join(F.col("ts").cast("array<string>"), ",").alias("ts"))


@query(X.with_("cube") + "SELECT i, j, k, array_to_string(list(raw ORDER BY t), ',') AS ts FROM cube WHERE i = 19 AND j = 3 AND k = 5 GROUP BY ALL")
def time_series(spark, sf):
    from .sources.image import collapsed, series

    return series(collapsed(X.cube(spark), {"i": 19, "j": 3, "k": 5}), "raw").select("i", "j", "k", F.array_join(F.col("ts").cast("array<string>"), ",").alias("ts"))


@query("SELECT * FROM (VALUES ('descrip', 'a', 'b'), ('qoffset_x', '0.0', '-17.325'), ('slice_start', '0', '1')) t(field, \"left\", \"right\")")
def header_diff(spark, sf):
    from .functions import header

    a = header.new_header(spark, [23, 17, 11, 7], 8, descrip="a")
    return header.diff(a, header.modify(a, {"descrip": "b", "qoffset_x": -17.325, "slice_start": 1}))


@query("SELECT 'b' AS descrip, 2.5 :: DOUBLE AS scl_slope, 4 AS ndim")
def header_mod(spark, sf):
    from .functions import header

    return header.modify(header.new_header(spark, [23, 17, 11, 7], 8), {"descrip": "b", "scl_slope": 2.5}).select("descrip", "scl_slope", "ndim")


# Files and streams ---------------------------------------------------------------------------------------


@query(X.with_("points") + f"SELECT i, j, round(r::FLOAT::DOUBLE, 5) AS r FROM ({_CORR})")
def triangle_round_trip(spark, sf):
    from .sources import triangle
    from .tables import shared_dir

    s = X.signals(spark, sf)
    pairs, n = signals.correlate(s), s.count()
    path = f"{shared_dir(spark)}/tri-{__import__('uuid').uuid4().hex}.bin"
    triangle.write_binary(pairs, path, n)
    triangle.register(spark)
    return spark.read.format("triangle").load(path).select("i", "j", F.round("value", 5).alias("r"))


def _fresh(spark, name: str) -> str:
    from .tables import fresh_path

    return fresh_path(spark, name)


@query(X.with_("points") + f"SELECT i, j, round(r::FLOAT::DOUBLE, 5) AS r FROM ({_CORR})")
def triangle_parts(spark, sf):
    """Written by tasks as a folder, read back as ranges."""
    from .sources import triangle

    s = X.signals(spark, sf)
    path = _fresh(spark, "triangle")
    triangle.write_runs(signals.correlation_runs(s), path, s.count(), part=10_000)
    triangle.register(spark)
    return spark.read.format("triangle").option("rows", 30_000).load(path).select("i", "j", F.round("value", 5).alias("r"))


@query(X.with_("points") + f"SELECT i, j, round(r, 6) AS r FROM ({_CORR})")
def triangle_text(spark, sf):
    from .sources import triangle

    path = _fresh(spark, "text")
    triangle.write_text_runs(signals.correlation_runs(X.signals(spark, sf), step=1 << 40), path)
    return triangle.read_text(spark, path).select("i", "j", _r6("value").alias("r"))


@query(X.with_("points") + f"SELECT (i // 64)::INT AS bx, (j // 64)::INT AS by, count(*) AS n, round(sum(r), 4) AS total FROM ({_CORR}) GROUP BY ALL")
def blocks_file(spark, sf):
    from .sources import sinks

    path = _fresh(spark, "blocks")
    sinks.write_block_runs(signals.correlation_runs(X.signals(spark, sf), step=64), path, 64)
    return spark.read.parquet(path).groupBy("bx", "by").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("total"))


@query(X.with_("edges") + "SELECT i1, j1, k1, i2, j2, k2, printf('%.6f', pvalue)::DOUBLE AS pvalue, printf('%.6f', tstat)::DOUBLE AS tstat FROM edges WHERE pvalue < 0.05")
def edges_csv(spark, sf):
    from .sources import sinks, text

    path = _fresh(spark, "edges")
    sinks.write_edges(X.edges(spark, sf).where(C.below(F.col("pvalue"), 0.05)), path)
    return text.read_edges(spark, path).drop("edge_id")


@query(X.with_("perms") + "SELECT perm, array_to_string(list(subj ORDER BY subj), ',') AS a FROM perms WHERE in_a GROUP BY perm")
def permutations_file(spark, sf):
    from .sources import text

    path = _fresh(spark, "perms")
    text.write_permutations(X.permutations(spark), path)
    return text.read_permutations(spark, path, X.SUBJECTS).select("perm", F.array_join(F.col("a").cast("array<string>"), ",").alias("a"))


@query(X.with_("coords") + "SELECT vox, i, j, k FROM coords")
def coordinates_file(spark, sf):
    from .sources import text

    path = _fresh(spark, "coords")
    X.coords(spark, sf).repartitionByRange(1, "vox").sortWithinPartitions("vox").select(F.concat_ws(" ", "i", "j", "k", "x").alias("value")).write.text(path)
    return text.read_coordinates(spark, path)


def _image(spark, name: str) -> str:
    """The cube as an image file whose values are scaled by 0.25 and 128."""
    from .functions import header
    from .sources import image

    folder = _fresh(spark, "image")
    fs, p = image.file_system(folder)
    fs.create_dir(p)
    voxels = X.cube(spark).select("i", "j", "k", "t", C.scaled(F.col("raw"), 0.25, 128).alias("value"))
    image.write_image(voxels, header.new_header(spark, [23, 17, 11, 7], 8, scl_slope=0.25, scl_inter=128.0, descrip="cube"), f"{folder}/{name}")
    image.register(spark)
    return f"{folder}/{name}"


@query(X.with_("cube") + "SELECT i, j, k, t, raw * 0.25::DOUBLE + 128 AS value FROM cube")
def image_file(spark, sf):
    return spark.read.format("image_volumes").load(_image(spark, "cube.nii.gz")).drop("path")


@query(X.with_("cube") + "SELECT i, j, k, t, raw::DOUBLE AS value FROM cube")
def image_pair_raw(spark, sf):
    return spark.read.format("image_volumes").option("raw", "true").load(_image(spark, "cube.hdr")).drop("path")


@query(X.with_("cube") + "SELECT i, j, k, t, raw * 0.25::DOUBLE + 128 AS value FROM cube WHERE t BETWEEN 2 AND 4 AND k IN (1, 2) AND i < 3")
def image_file_part(spark, sf):
    return spark.read.format("image_volumes").options(t="2..4", k="1..2", i="0..2").load(_image(spark, "cube.nii")).drop("path")


@query(X.with_("cube") + "SELECT i, j, k, t, raw * 0.25::DOUBLE + 128 AS value FROM cube")
def image_ascii(spark, sf):
    return spark.read.format("image_volumes").load(_image(spark, "cube.nia")).drop("path")


@query("SELECT 4 AS ndim, '23 17 11 7' AS dim, 8 AS datatype, 0.25::DOUBLE AS scl_slope, 128.0::DOUBLE AS scl_inter, 'cube' AS descrip")
def image_header(spark, sf):
    from .sources import image

    h = image.headers(spark, _image(spark, "cube.nii"))
    return h.select("ndim", F.array_join(F.slice("dim", 1, 4).cast("array<string>"), " ").alias("dim"), "datatype", "scl_slope", "scl_inter", "descrip")


@query(X.with_("conn", more={"stat": "SELECT event_type, h, sum(value) AS total FROM conn GROUP BY ALL"}) + "SELECT event_type, h, total::BIGINT AS total FROM stat")
def resume_parts(spark, sf):
    from .sources import sinks
    from .tables import shared_dir

    parts = X.connections(spark, sf).groupBy("event_type", "h").agg(F.sum("value").alias("total")).withColumn("part", F.pmod(F.crc32("event_type"), F.lit(4)).cast("int"))
    path = f"{shared_dir(spark)}/parts-{__import__('uuid').uuid4().hex}"
    sinks.append_parts(parts.where("part < 2"), path)
    sinks.append_parts(parts, path)
    return spark.read.parquet(path).select("event_type", "h", "total")


@query(X.with_("edges") + _HIST + "SELECT bin, count FROM hist")
def streaming_histogram(spark, sf):
    from .streaming.histogram import histogram_of_stream

    return histogram_of_stream(written(X.edges(spark, sf).select("pvalue"), "stream"), bins=400).select("bin", "count")

