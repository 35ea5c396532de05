"""Inputs of the registered queries, made from the driver's tables by rules, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders of a region, and how far regions lie apart along i; so edges do not run together however many orders there are.
REGION, APART = 300, 200
PERMS = 200
SUBJECTS = 20


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("vox"), F.col("embedding").cast("array<double>").alias("ts"), "label")


def coords(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id")
    e = e.selectExpr("vec_id AS vox", "cast(vec_id % 8 AS int) AS i", "cast(vec_id div 8 % 8 AS int) AS j", "cast(vec_id div 64 AS int) AS k")
    return e.selectExpr("*", "3D * i - 90 AS x", "3D * j - 126 AS y", "3D * k - 72 AS z")


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, h, subj, value) over the full grid, values whole, with a planted effect."""
    e = read(spark, sf, "events").selectExpr("event_type", "hour(ts) AS h", "cast(user_id % 20 AS int) AS subj", "cast(round(value * 100) AS bigint) AS v")
    sums = e.groupBy("event_type", "h", "subj").agg(F.sum("v").alias("v"))
    types = e.select("event_type").distinct()
    grid = types.select("event_type", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")).select("event_type", "h", F.explode(F.sequence(F.lit(0), F.lit(SUBJECTS - 1))).alias("subj"))
    effect = F.when((F.col("event_type") == "click") & (F.col("h") < 6) & (F.col("subj") < 10), 100000).otherwise(0)
    return grid.join(sums, ["event_type", "h", "subj"], "left").select("event_type", "h", "subj", (F.coalesce("v", F.lit(0)) + effect).cast("bigint").alias("value"))


def permutations(spark: SparkSession, n: int = PERMS) -> DataFrame:
    """(perm, a): permutation 0 is subjects 0 to 9; the others the ten with the lowest keys."""
    key = lambda s: ((F.col("perm") + 1) * (s + 3) * 7919 + F.col("perm") * F.col("perm") * 31 + s * s * (F.col("perm") + 7) * 17) % 10007
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(SUBJECTS - 1)), lambda s: F.struct(key(s).alias("k"), s.alias("s"))))
    drawn = F.sort_array(F.transform(F.slice(ranked, 1, 10), lambda x: x["s"]))
    return spark.range(n).select(F.col("id").cast("int").alias("perm")).select("perm", F.when(F.col("perm") == 0, F.sequence(F.lit(0), F.lit(9))).otherwise(drawn).alias("a"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """An edge for each order; 300 orders make a region of their own, with short and long edges in it."""
    o = read(spark, sf, "orders").selectExpr(
        "o_orderkey AS k", "cast(o_custkey % 40 AS int) AS a", "cast(o_custkey div 40 % 40 AS int) AS b", "cast(o_orderkey % 3 AS int) AS c", f"cast(o_orderkey div {REGION} * {APART} AS int) AS o", "o_totalprice AS t"
    )
    return o.selectExpr(
        "k AS edge_id", "o + a AS i1", "b AS j1", "c AS k1",
        "o + cast(if(k % 2 = 0, a + k % 3, (a * 7 + 11) % 40 + 60) AS int) AS i2", "cast(if(k % 2 = 0, b + k div 3 % 3, (b * 5 + 3) % 40) AS int) AS j2", "c AS k2",
        "cast((k * 37) % 1001 + 1 AS double) / 1002D AS pvalue", "cast(cast(round(t * 100) AS bigint) % 20001 - 10000 AS double) / 10000D AS tstat",
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """An edge for each vector, few enough for all pairs of them."""
    return read(spark, sf, "embeddings").selectExpr("vec_id AS edge_id", "cast(vec_id % 8 AS int) AS i1", "cast(vec_id div 8 % 8 AS int) AS j1", "cast(vec_id div 64 AS int) AS k1", "cast(vec_id * 7 % 11 AS int) AS i2", "cast(vec_id * 5 % 13 AS int) AS j2", "cast(vec_id % 3 AS int) AS k2")


def cube(spark: SparkSession) -> DataFrame:
    """(i, j, k, t, raw) of an image of 23 x 17 x 11 x 7."""
    return spark.range(23 * 17 * 11 * 7).selectExpr("cast(id % 23 AS int) AS i", "cast(id div 23 % 17 AS int) AS j", "cast(id div 391 % 11 AS int) AS k", "cast(id div 4301 AS int) AS t", "cast(id AS int) AS raw")


SQL = {
    "signals": "SELECT vec_id AS vox, embedding, label FROM embeddings",
    "points": "SELECT vec_id AS vox, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS t FROM embeddings",
    "coords": "SELECT *, 3.0::DOUBLE * i - 90 AS x, 3.0::DOUBLE * j - 126 AS y, 3.0::DOUBLE * k - 72 AS z FROM (SELECT vec_id AS vox, (vec_id % 8)::INT AS i, (vec_id // 8 % 8)::INT AS j, (vec_id // 64)::INT AS k FROM embeddings)",
    "conn": """SELECT event_type, h, subj, coalesce(v, 0)::BIGINT + CASE WHEN event_type = 'click' AND h < 6 AND subj < 10 THEN 100000 ELSE 0 END AS value
        FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(24))::INT AS h) CROSS JOIN (SELECT unnest(range(20))::INT AS subj)
        LEFT JOIN (SELECT event_type, hour(ts)::INT AS h, (user_id % 20)::INT AS subj, sum(round(value * 100)::BIGINT) AS v FROM events GROUP BY ALL) USING (event_type, h, subj)""",
    "perms": f"""SELECT p::INT AS perm, s::INT AS subj, CASE WHEN p = 0 THEN s < 10 ELSE row_number() OVER (PARTITION BY p ORDER BY ((p + 1) * (s + 3) * 7919 + p * p * 31 + s * s * (p + 7) * 17) % 10007, s) <= 10 END AS in_a
        FROM (SELECT unnest(range({PERMS})) AS p) CROSS JOIN (SELECT unnest(range({SUBJECTS})) AS s)""",
    "edges": f"""SELECT k AS edge_id, o + a AS i1, b AS j1, c AS k1, o + (CASE WHEN k % 2 = 0 THEN a + k % 3 ELSE (a * 7 + 11) % 40 + 60 END)::INT AS i2,
        (CASE WHEN k % 2 = 0 THEN b + k // 3 % 3 ELSE (b * 5 + 3) % 40 END)::INT AS j2, c AS k2, ((k * 37) % 1001 + 1)::DOUBLE / 1002::DOUBLE AS pvalue,
        (round(t * 100)::BIGINT % 20001 - 10000)::DOUBLE / 10000::DOUBLE AS tstat
        FROM (SELECT o_orderkey AS k, (o_custkey % 40)::INT AS a, (o_custkey // 40 % 40)::INT AS b, (o_orderkey % 3)::INT AS c, (o_orderkey // {REGION} * {APART})::INT AS o, o_totalprice AS t FROM orders)""",
    "lines": "SELECT vec_id AS edge_id, (vec_id % 8)::INT AS i1, (vec_id // 8 % 8)::INT AS j1, (vec_id // 64)::INT AS k1, (vec_id * 7 % 11)::INT AS i2, (vec_id * 5 % 13)::INT AS j2, (vec_id % 3)::INT AS k2 FROM embeddings",
    "cube": "SELECT (n % 23)::INT AS i, (n // 23 % 17)::INT AS j, (n // 391 % 11)::INT AS k, (n // 4301)::INT AS t, n::INT AS raw FROM (SELECT unnest(range(30107)) AS n)",
    # g is the region: no end is near one of another.
    "ends": f"SELECT edge_id, 1 AS side, i1 AS i, j1 AS j, k1 AS k, i1 // {APART} AS g FROM iso UNION ALL SELECT edge_id, 2, i2, j2, k2, i2 // {APART} FROM iso",
    "allends": f"SELECT edge_id, 1 AS side, i1 AS i, j1 AS j, k1 AS k, i1 // {APART} AS g FROM edges UNION ALL SELECT edge_id, 2, i2, j2, k2, i2 // {APART} FROM edges",
    "iso": "SELECT * FROM edges WHERE edge_id IN (SELECT x.edge_id FROM allends x JOIN allends y ON x.g = y.g AND x.edge_id <> y.edge_id AND greatest(abs(x.i - y.i), abs(x.j - y.j), abs(x.k - y.k)) <= 1)",
    "vox": "SELECT DISTINCT i::BIGINT * 1000000 + j * 1000 + k AS v, i, j, k, g FROM ends",
    "adj": "SELECT a.v AS a, b.v AS b FROM vox a JOIN vox b ON a.g = b.g AND a.v <> b.v AND greatest(abs(a.i - b.i), abs(a.j - b.j), abs(a.k - b.k)) <= 1",
    "reach": "SELECT v, v AS root FROM vox UNION SELECT adj.b, reach.root FROM reach JOIN adj ON reach.v = adj.a",
    "comp": "SELECT v, min(root) AS root FROM reach GROUP BY v",
    "tagged": """SELECT e.edge_id, CASE WHEN x.root = y.root THEN x.root END AS root, CASE WHEN x.root <> y.root THEN e.edge_id END AS alone
        FROM iso e JOIN comp x ON x.v = i1::BIGINT * 1000000 + j1 * 1000 + k1 JOIN comp y ON y.v = i2::BIGINT * 1000000 + j2 * 1000 + k2""",
    "bundles": """SELECT edge_id, (dense_rank() OVER (ORDER BY n DESC, first) - 1)::INT AS bundle
        FROM (SELECT edge_id, count(*) OVER w AS n, min(edge_id) OVER w AS first FROM tagged WINDOW w AS (PARTITION BY root, alone))""",
    "bundled": "SELECT iso.*, bundle FROM iso JOIN bundles USING (edge_id)",
    "large": "SELECT * EXCLUDE (bundle, n), (dense_rank() OVER (ORDER BY n DESC, bundle) - 1)::INT AS bundle FROM (SELECT *, count(*) OVER (PARTITION BY bundle) AS n FROM bundled) WHERE n >= 3",
}
NEEDS = {
    "allends": ["edges"], "iso": ["edges", "allends"], "ends": ["iso"], "vox": ["ends"], "adj": ["vox"], "reach": ["vox", "adj"],
    "comp": ["reach"], "tagged": ["iso", "comp"], "bundles": ["tagged"], "bundled": ["iso", "bundles"], "large": ["bundled"],
}


def with_(*names: str, more: dict[str, str] | None = None) -> str:
    """A WITH clause that has names and all that they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
