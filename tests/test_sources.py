import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat import catalog
from loomstat.functions import geometry as G
from loomstat.functions import header as H
from loomstat.operators import signals
from loomstat.sources import image, sinks, text, triangle
from loomstat.streaming import histogram

DIMS = [5, 4, 3, 6]


def cube(spark, slope=0.25, inter=128.0):
    n = int(np.prod(DIMS))
    return spark.range(n).selectExpr("cast(id % 5 AS int) AS i", "cast(id div 5 % 4 AS int) AS j", "cast(id div 20 % 3 AS int) AS k", "cast(id div 60 AS int) AS t", f"id * {slope}D + {inter}D AS value")


def read(spark, path, **options):
    image.register(spark)
    return spark.read.format("image_volumes").options(**options).load(str(path))


@pytest.mark.parametrize("name", ["a.nii", "a.nii.gz", "a.hdr", "a.img.gz", "a.nia"])
@pytest.mark.parametrize("order", ["<", ">"])
def test_images_come_back(spark, tmp_path, name, order):
    if name == "a.nia" and order == ">":
        return
    head = H.new_header(spark, DIMS, 8, scl_slope=0.25, scl_inter=128.0, descrip="it's", qform_code=1, pixdim=[2.0, 2.0, 3.0, 1.0, 1.0, 1.0, 1.0])
    head = H.add_extension(head, 6, "a comment") if name != "a.nia" else head
    path = tmp_path / name
    image.write_image(cube(spark), head, str(path), order)
    path = str(path).replace(".img.gz", ".hdr.gz")
    back = read(spark, path)
    assert back.drop("path").exceptAll(cube(spark)).count() == 0 and back.count() == 360
    assert read(spark, path, raw="true").agg(F.max("value")).first()[0] == 359
    h = image.headers(spark, path).first()
    assert h.dim == [5, 4, 3, 6, 1, 1, 1] and h.ndim == 4 and h.datatype == 8 and h.descrip == "it's" and h.scl_slope == 0.25 and h.pixdim[:3] == [2.0, 2.0, 3.0]
    if name != "a.nia":
        assert bytes(h.extensions[0].data).rstrip(b"\0") == b"a comment" and h.extensions[0].ecode == 6


def test_parts_of_images(spark, tmp_path):
    path = str(tmp_path / "a.nii")
    image.write_image(cube(spark), H.new_header(spark, DIMS, 16, scl_slope=0.0), path)
    df = read(spark, path)
    some = read(spark, path, t="4", k="1..2", i="0..2")
    want = cube(spark).where("t = 4 AND k >= 1 AND i < 3")
    assert some.drop("path").exceptAll(want).count() == 0 and some.count() == want.count()
    assert df.where("t = 4").count() == 60 and df.count() == 360
    assert some.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 6
    assert image.bricks(df, "[5,0..1,$]", 6).groupBy("pos", "t").count().orderBy("pos").collect() == [(0, 5, 60), (1, 0, 60), (2, 1, 60), (3, 5, 60)]
    assert image.collapsed(df, {"i": 3, "j": 3, "k": -1}).count() == 18
    assert image.region(df, {"i": (1, 2), "j": (0, 3), "t": (2, 2)}).count() == 2 * 3 * 3 * 2
    assert image.series(image.collapsed(df, {"i": 1, "j": 1, "k": 1})).first().ts == [(26 + 60 * t) * 0.25 + 128 for t in range(6)]
    assert image.not_empty(df.withColumn("value", F.lit(0.0))).count() == 0 and image.not_empty(df).count() == 360


def test_values_that_are_not_finite_and_types(spark, tmp_path):
    bad = cube(spark).withColumn("value", F.when(F.col("t") == 0, float("nan")).when(F.col("t") == 1, float("inf")).otherwise(F.col("value")))
    path = str(tmp_path / "a.nii")
    image.write_image(bad, H.new_header(spark, DIMS, 64), path)
    assert read(spark, path).where("t < 2 AND value <> 0").count() == 0
    for code in image.NUMPY:
        image.write_image(cube(spark, 0.1, 3).withColumn("value", F.floor("value").cast("double")), H.new_header(spark, DIMS, code), path)
        assert read(spark, path).agg(F.sum("value")).first() == cube(spark, 0.1, 3).agg(F.sum(F.floor("value").cast("double"))).first()
    with pytest.raises(ValueError):
        image.write_image(cube(spark), H.new_header(spark, DIMS, 128), path)
    image.write_image(cube(spark).where("t = 3 AND i = 2"), H.new_header(spark, DIMS, 8), path)
    assert read(spark, path).where("value <> 0").count() == 12


def test_headers(spark):
    a = H.new_header(spark, DIMS, 8, descrip="a")
    b = H.modify(a, {"descrip": "b", "qoffset_x": -17.325, "dim": [9, 9, 9, 1, 1, 1, 1]})
    assert {r.field for r in H.diff(a, b).collect()} == {"descrip", "qoffset_x", "dim"} and H.diff(a, b, ["ndim"]).count() == 0
    assert H.check(a).first().problems == []
    wrong = H.modify(H.add_extension(a, 3, b"x"), {"ndim": 9, "datatype": 5, "vox_offset": 10, "magic": "x"})
    assert len(H.check(wrong).first().problems) >= 4
    e = H.add_extension(H.add_extension(a, 4, "<x/>"), 6, "c")
    assert [r.ecode for r in H.remove_extension(e, 0).first().extensions] == [6] and H.strip(e).first().extensions == [] and H.strip(e).first().descrip == ""
    with pytest.raises(ValueError):
        H.modify(a, {"nothing": 1})
    with pytest.raises(ValueError):
        H.new_header(spark, [0], 8)
    named = a.select(H.label(F.col("datatype"), H.TYPES).alias("t"), H.label(F.lit(99), H.UNITS).alias("u"), H.is_int_type(F.col("datatype")).alias("i")).first()
    assert tuple(named) == ("INT32", "Unknown", True)
    assert H.from_xml_text(H.to_xml_text("a<'&\">")) == "a<'&\">"


def test_geometry():
    rng = np.random.default_rng(0)
    for qfac in (1, -1):
        m = G.from_quaternion(0.1, -0.3, 0.5, (1, 2, 3), (2, 3, 4), qfac)
        q = G.to_quaternion(m)
        assert np.allclose([q["b"], q["c"], q["d"], q["dx"], q["dy"], q["dz"], q["qfac"], q["z"]], [0.1, -0.3, 0.5, 2, 3, 4, qfac, 3])
        assert np.allclose(G.compose(m, G.inverse4(m)), np.eye(4))
    p = np.array(G.polar(rng.normal(0, 1, (3, 3)).tolist()))
    assert np.allclose(p @ p.T, np.eye(3))
    assert G.orientation([[-2, 0, 0, 0], [0, 0, 3, 0], [0, 1, 0, 0], [0, 0, 0, 1]]) == "LSA"
    assert G.inverse4([[0] * 4] * 3) == np.zeros((4, 4)).tolist()


def pairs_of(spark, n, seed=0):
    v = np.random.default_rng(seed).uniform(-1, 1, n * (n - 1) // 2).astype(np.float32)
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in zip(itertools.combinations(range(n), 2), v, strict=True)], "i long, j long, r double"), v


def test_triangles(spark, tmp_path):
    pairs, v = pairs_of(spark, 40)
    path = str(tmp_path / "t.bin")
    triangle.write_binary(pairs.repartition(5), path, 40)
    triangle.register(spark)
    back = spark.read.format("triangle").option("rows", 100).load(path)
    assert back.rdd.getNumPartitions() == 8
    assert back.select("i", "j", F.col("value").alias("r")).exceptAll(pairs).count() == 0 and back.count() == len(v)
    part = spark.read.format("triangle").option("first", 123).option("last", 130).load(path).orderBy("k").collect()
    assert [r.k for r in part] == list(range(123, 130)) and np.allclose([r.value for r in part], v[123:130])
    assert triangle.sniff(path) == triangle.Head("correlation", 40, 780)
    folder = str(tmp_path / "parts")
    triangle.write_parts(pairs.repartition(5), folder, 40, "result", part=77)
    assert triangle.sniff(folder) == triangle.Head("result", 40, 780, 77)
    assert triangle.read(spark, folder, "result").select("i", "j", F.col("value").alias("r")).exceptAll(pairs).count() == 0
    part = spark.read.format("triangle").option("first", 70).option("last", 400).load(folder).orderBy("k").collect()
    assert [r.k for r in part] == list(range(70, 400)) and np.allclose([r.value for r in part], v[70:400])
    for bad in (pairs.where("i > 0"), pairs.union(pairs.limit(1))):
        with pytest.raises(ValueError, match="pairs"):
            triangle.write_parts(bad, str(tmp_path / f"bad{bad.count()}"), 40)
    with pytest.raises(ValueError, match="not a result"):
        triangle.read(spark, path, "result")
    with pytest.raises(ValueError, match="pairs"):
        triangle.write_binary(pairs.where("i > 0"), str(tmp_path / "u.bin"), 40)
    with pytest.raises(ValueError):
        triangle.voxels_of(7)
    out = str(tmp_path / "text")
    triangle.write_text(pairs.repartition(3), out)
    t = triangle.read_text(spark, out)
    assert t.count() == 780 and signals.compare(t, pairs.withColumnRenamed("r", "value"), 1e-6, "value").count() == 0
    (tmp_path / "stream.txt").write_text(" ".join(f"{x:.6f}" for x in v[:300]) + "\n\n" + "\n".join(f" {x:.6f} " for x in v[300:]))
    t = triangle.read_text(spark, str(tmp_path / "stream.txt"))
    assert signals.compare(t, pairs.withColumnRenamed("r", "value"), 1e-6, "value").count() == 0
    assert triangle.read_text(spark, str(tmp_path / "stream.txt"), 40, 10, 12).count() == 2
    both = triangle.read_subjects(spark, [path, str(tmp_path / "stream.txt")])
    assert both.groupBy("subj").count().orderBy("subj").collect() == [(0, 780), (1, 780)]


def test_text_of_many_files(spark, tmp_path):
    v = np.random.default_rng(5).uniform(-1, 1, 40 * 39 // 2).round(6)
    ends = [3, 10, 200, 260, 780]  # the largest file is neither the first nor the second
    for f, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        (tmp_path / f"part-{f:05d}.txt").write_text("".join(f"{x:.6f}\n" for x in v[a:b]))
    got = triangle.read_text(spark, str(tmp_path)).orderBy("k").toPandas()
    assert list(got.k) == list(range(780)) and list(got.value) == list(v)
    assert [(r.i, r.j) for r in got.itertuples()] == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def test_text_tables(spark, tmp_path):
    perms = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 2, 11])], "perm int, a array<int>")
    text.write_permutations(perms, str(tmp_path / "perms"))
    assert next(p for p in (tmp_path / "perms").glob("part*")).read_text() == "   0    1    2\n   1    2   11\n"
    assert [r.a for r in text.read_permutations(spark, str(tmp_path / "perms"), 11).orderBy("perm").collect()] == [[0, 1, 2], [1, 2]]
    (tmp_path / "c.txt").write_text("1 2 3 9\n4 5 6 9\n\n7 8 9 9\n")
    assert [tuple(r) for r in text.read_coordinates(spark, str(tmp_path / "c.txt")).orderBy("vox").collect()] == [(0, 1, 2, 3), (1, 4, 5, 6), (2, 7, 8, 9)]
    (tmp_path / "d.txt").write_text("0 1 2 3 -1.5 2 3\n")
    assert tuple(text.read_coordinates(spark, str(tmp_path / "d.txt"), indexed=True).first()) == (0, 1, 2, 3, -1.5, 2.0, 3.0)
    (tmp_path / "s.txt").write_text("b\na\n")
    assert text.read_subjects(spark, str(tmp_path / "s.txt")) == ["b", "a"]
    edges = spark.createDataFrame([(0, 1, 2, 3, 4, 5, 6, 0.0234515, -0.5), (1, 1, 2, 3, 4, 5, 7, 0.5, 0.0)], "edge_id long, i1 int, j1 int, k1 int, i2 int, j2 int, k2 int, pvalue double, tstat double")
    sinks.write_edges(edges, str(tmp_path / "e"))
    back = text.read_edges(spark, str(tmp_path / "e")).orderBy("edge_id").collect()
    assert back[0].pvalue in (0.023452, 0.023451) and back[1].k2 == 7
    sinks.write_split(edges, str(tmp_path / "p"), str(tmp_path / "n"))
    assert text.read_edges(spark, str(tmp_path / "p")).count() == 1 and text.read_edges(spark, str(tmp_path / "n")).count() == 2
    (tmp_path / "seven.csv").write_text("i1,j1,k1,i2,j2,k2,pvalue\n1,2,3,4,5,6,0.1\n")
    assert text.read_edges(spark, str(tmp_path / "seven.csv")).first().tstat is None
    dump = spark.createDataFrame([(1, 1, 1, 0.5), (2, 2, 2, -1.0)], "i int, j int, k int, value double")
    assert text.seed_edges([dump, dump], [(0, 0, 0), (9, 9, 9)]).count() == 2
    (tmp_path / "in").mkdir(), (tmp_path / "out").mkdir()
    for n in ("Sub1.nii", "SUB2.nii.gz", "x.nii"):
        (tmp_path / "in" / n).write_text("")
    (tmp_path / "out" / "sub1.bin").write_text("")
    assert sorted(r.output for r in text.missing_outputs(spark, str(tmp_path / "in"), str(tmp_path / "out"), ".bin").collect()) == ["sub2.bin", "x.bin"]


def test_parts_and_histograms(spark, tmp_path):
    rows = spark.range(100).selectExpr("cast(id % 5 AS int) AS part", "id", "(id + 1) / 100D AS pvalue")
    path = str(tmp_path / "parts")
    assert sinks.append_parts(rows.where("part < 2"), path) == 40 and sinks.append_parts(rows, path) == 60 and sinks.append_parts(rows, path) == 0
    assert spark.read.parquet(path).count() == 100
    from loomstat.operators import significance

    h = significance.log_histogram(rows, bins=200)
    sinks.write_histogram(h, str(tmp_path / "h"), {"values": 100})
    lines = next((tmp_path / "h").glob("part*")).read_text().splitlines()
    assert lines[0] == "# values: 100" and lines[1].startswith("bin_center,") and lines[-1].endswith(",100,100.0")
    again = histogram.histogram_of_stream(rows.select("pvalue"), bins=200)
    assert again.exceptAll(h).count() == 0 and again.count() == h.count()


def test_blocks_and_trees(spark, tmp_path):
    from loomstat.operators import cluster

    pairs, _ = pairs_of(spark, 10)
    sinks.write_blocks(pairs, str(tmp_path / "b"), 4)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == 45 and back.where("bx = 0 AND by = 2").count() == 8 and back.where("bx > by").count() == 0
    tree = cluster.linkage_table(spark, np.array([[0, 1, 0.5, 2], [2, 3, 1.5, 3]]))
    cluster.write_npy(tree, str(tmp_path / "z.npy"))
    assert np.load(tmp_path / "z.npy").shape == (2, 4) and cluster.read_npy(spark, str(tmp_path / "z.npy")).collect() == tree.collect()
    runs = spark.createDataFrame([("a",), ("a",), ("b",)], "status string")
    assert sorted(map(tuple, sinks.status_rollup(runs).collect())) == [("a", 2), ("b", 1)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "pvalue double"
    for n in (10, 25):
        spark.range(n).selectExpr("(id + 1) / 100D AS pvalue").write.mode("append").parquet(source)
        histogram.start(histogram.histogram_stream(histogram.parts_stream(spark, source, schema), bins=50), out, ck).awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("count")).first()[0] == 35
    events = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    q = histogram.late_windows(histogram.parts_stream(spark, str(tmp_path / "ev"), events.schema), "ts", "1 minute", "5 minutes", "kind").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]


def test_a_folder_of_parts_is_written_from_runs(spark, sf, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    ts = [[1.0] * 9 if v == 7 else rng.normal(size=9).tolist() for v in range(40)]
    s = spark.createDataFrame(list(enumerate(ts)), "vox long, ts array<double>").repartition(3)
    runs = signals.correlation_runs(s, block=16)
    assert runs.count() <= 3 * 40
    triangle.write_runs(runs, str(tmp_path / "runs"), 40, part=77)
    triangle.write_parts(signals.correlate(s, block=16), str(tmp_path / "pairs"), 40, part=77)
    rows = [triangle.read(spark, str(tmp_path / x)).orderBy("k").collect() for x in ("runs", "pairs")]
    assert rows[0] == rows[1] and len(rows[0]) == 780
    for bad in (s.where("vox != 5"), s.union(s.where("vox = 5"))):
        with pytest.raises(ValueError):
            triangle.write_runs(signals.correlation_runs(bad, 40, block=16), str(tmp_path / f"bad{bad.count()}"), 40)
    monkeypatch.setattr(triangle, "_positions", None)  # a row for each pair
    assert catalog.queries()["triangle_parts"](spark, sf).count() == 499 * 250


def test_blocks_are_written_from_runs(spark, sf, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    s = spark.createDataFrame([(v, [1.0] * 9 if v == 7 else rng.normal(size=9).tolist()) for v in range(40) if v != 12], "vox long, ts array<double>").repartition(3)
    sinks.write_block_runs(signals.correlation_runs(s, block=15, step=8), str(tmp_path / "runs"), 8)
    sinks.write_blocks(signals.correlate(s, block=15), str(tmp_path / "pairs"), 8)
    key = lambda r: (r.bx, r.by, r.i, r.j)
    rows = [sorted(spark.read.parquet(str(tmp_path / x)).select("bx", "by", "i", "j", "r").collect(), key=key) for x in ("runs", "pairs")]
    assert [key(r) for r in rows[0]] == [key(r) for r in rows[1]] and len(rows[0]) == 39 * 38 // 2
    assert np.allclose([r.r for r in rows[0]], [r.r for r in rows[1]], rtol=0, atol=1e-14)
    monkeypatch.setattr(signals, "correlate", None)  # a row for each pair
    assert catalog.queries()["blocks_file"](spark, sf).count() == 36


def test_text_of_runs_is_that_of_pairs(spark, tmp_path):
    from loomstat.plans import fixtures

    s = fixtures.signals(spark, "/root/testdata/sf0.001").where("vox < 90")
    triangle.write_text(signals.correlate(s), f"{tmp_path}/pairs")
    triangle.write_text_runs(signals.correlation_runs(s, block=20, step=1 << 40), f"{tmp_path}/runs")
    one, two = ([r.value for p in sorted((tmp_path / d).glob("part-*")) for r in spark.read.text(str(p)).collect()] for d in ("pairs", "runs"))
    assert one == two and len(one) == 89
