from datetime import date

from pyspark.sql import functions as F

from loomstat.llm import url_filter as op

D = lambda m, d=1: date(2024, m, d)
LOG = [
    ("domain", "Bad.example", "add", D(2)), ("domain", "bad.example", "remove", D(5)), ("domain", "bad.example", "add", D(8)),
    ("domain", "sub.bad.example", "add", D(4)), ("prefix", "ok.example/x", "add", D(3)), ("prefix", "ok.example/x", "add", D(4)),
    ("domain", "tie.example", "add", D(3)), ("domain", "tie.example", "remove", D(3)), ("domain", "1.2.3.4", "add", D(1)),
    ("prefix", "Case.example/Foo", "add", D(1)), ("prefix", "slash.example/a/", "add", D(1)), ("prefix", "https://u@full.example:80/P//q/?x#y", "add", D(1)),
    ("prefix", "root.example/", "add", D(1)), ("domain", "*.star.example.", "add", D(1)), ("domain", " .dot.example/ ", "add", D(1)), ("domain", "[::1]", "add", D(1)),
    ("domain", "path.example/x", "add", D(1)), ("other", "kind.example", "add", D(1)), ("prefix", "/x", "add", D(1)), ("prefix", "slash.example//a", "remove", D(9)),
    (None, "z.example", "add", D(1)), ("domain", None, "add", D(1)), ("domain", "z.example", None, D(1)), ("domain", "z.example", "add", None),
]
#: By hand: the pattern that an entry of LOG stands for, and hosts and paths (as segments) that it covers.
MEANT = {
    "Bad.example": ("bad.example", "bad.example", None), "bad.example": ("bad.example", "bad.example", None), "sub.bad.example": ("sub.bad.example", "sub.bad.example", None),
    "ok.example/x": ("ok.example/x", "ok.example", ["x"]), "tie.example": ("tie.example", "tie.example", None), "1.2.3.4": ("1.2.3.4", "1.2.3.4", None),
    "Case.example/Foo": ("case.example/Foo", "case.example", ["Foo"]), "slash.example/a/": ("slash.example/a", "slash.example", ["a"]), "slash.example//a": ("slash.example/a", "slash.example", ["a"]),
    "https://u@full.example:80/P//q/?x#y": ("full.example/P/q", "full.example", ["P", "q"]), "root.example/": ("root.example/", "root.example", []),
    "*.star.example.": ("star.example", "star.example", None), " .dot.example/ ": ("dot.example", "dot.example", None), "[::1]": ("[::1]", "[::1]", None),
}
#: Also by hand: the host and the segments of each URL.
URLS = {
    "http://bad.example": ("bad.example", []), "HTTPS://u:p@A.SUB.BAD.example.:80/p?q#f": ("a.sub.bad.example", ["p"]), "http://ok.example/x": ("ok.example", ["x"]), "http://ok.example/xy": ("ok.example", ["xy"]),
    "http://ok.example/x/y/?a": ("ok.example", ["x", "y"]), "//ok.example//x//z": ("ok.example", ["x", "z"]), "http://tie.example/": ("tie.example", []), "http://1.2.3.4/a": ("1.2.3.4", ["a"]),
    "http://9.1.2.3.4/": ("9.1.2.3.4", []), "http://z.example": ("z.example", []), "nonsense": None, "": None, "http://notbad.example/": ("notbad.example", []),
    "https://ex.CASE.example/Foo/x": ("ex.case.example", ["Foo", "x"]), "https://CASE.example/Foo/x": ("case.example", ["Foo", "x"]), "https://case.example/foo/x": ("case.example", ["foo", "x"]),
    "http://slash.example/a/b": ("slash.example", ["a", "b"]), "http://slash.example/a": ("slash.example", ["a"]), "http://slash.example/ab": ("slash.example", ["ab"]), "http://full.example/P/q/r": ("full.example", ["P", "q", "r"]),
    "http://root.example": ("root.example", []), "http://root.example/a": ("root.example", ["a"]), "http://www.root.example/a": ("www.root.example", ["a"]), "http://a.star.example": ("a.star.example", []),
    "http://dot.example:8080/": ("dot.example", []), "http://[::1]:80/a": ("[::1]", ["a"]), "http://path.example/x": ("path.example", ["x"]), "http://kind.example": ("kind.example", []), "http://x/x": ("x", ["x"]),
}


def brute(url, t):
    if URLS.get(url) is None or t is None:
        return 0, None, None
    host, path = URLS[url]
    hits = []
    for kind, (pattern, own, segments) in {(k, MEANT[p]) if MEANT[p][2] is None else (k, (MEANT[p][0], MEANT[p][1], tuple(MEANT[p][2]))) for k, p, a, d in LOG if None not in (k, p, a, d) and p in MEANT}:
        covers = host == own or (host.endswith("." + own) and own != "1.2.3.4") if segments is None else host == own and tuple(path[: len(segments)]) == segments
        log = sorted((d, a) for k, p, a, d in LOG if None not in (k, p, a, d) and p in MEANT and k == kind and MEANT[p][0] == pattern and d <= t)
        if covers and log and log[-1][1] == "add":
            since = log[-1][0]
            for d, a in reversed(log):
                if a == "remove":
                    break
                since = d
            hits.append((len(pattern), pattern, since))
    best = max(hits, default=(0, None, None))
    return len(hits), best[1], best[2]


def test_matches_brute_force(spark):
    rows = [(u, t, "k") for u in [*URLS, None] for t in (D(1), D(2), D(3), D(4, 30), D(5), D(7, 31), D(9), None)]
    rows += rows[:5]
    captures = spark.createDataFrame(rows, "url string, fetched date, kind string").withColumn("pattern", F.lit(1)).withColumn("n", F.lit(2)).withColumn("u", F.lit("u"))
    entries = spark.createDataFrame(LOG, "kind string, pattern string, action string, at date").withColumn("url", F.lit("x"))
    got = op.evaluate(captures, entries)
    assert got.columns == [*captures.columns, "blocked", "n_active", "rule_kind", "rule", "rule_since"]
    assert sorted(((r.url, r.fetched, r.n_active, r.rule, r.rule_since) for r in got.collect()), key=str) == sorted(((u, t, *brute(u, t)) for u, t, _ in rows), key=str)
    assert got.where("blocked <> (n_active > 0)").count() == 0


def test_empty_tables_and_native_plan(spark, sf):
    captures = spark.createDataFrame([("http://a.b/c", D(1))], "url string, fetched date")
    entries = spark.createDataFrame([], "kind string, pattern string, action string, at date")
    assert op.evaluate(captures, entries).first().blocked is False
    assert op.evaluate(captures.limit(0), entries).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = op.evaluate(op.captures_of(pages), op.demo_list(pages))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("== Physical Plan ==")[1]


def test_a_hot_key_is_split(spark):
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        urls = F.when(F.col("id") % 3 == 0, "http://one.hot/x").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".hot/"), "id"))
        captures = spark.range(60000).select("id", urls.alias("url"), F.lit(D(4)).alias("fetched"))
        entries = spark.createDataFrame([("domain", "hot", "add", D(1)), ("domain", "one.hot", "add", D(2))], "kind string, pattern string, action string, at date")
        out = op.evaluate(captures.repartition(8), entries)
        assert {tuple(r) for r in out.groupBy("n_active", "rule").count().collect()} == {(2, "one.hot", 20000), (1, "hot", 40000)}
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in names:
            spark.conf.unset(k)
