"""Text tables: permutations, coordinates, edges, lists of subjects and of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import numbered

EDGE_SCHEMA = "i1 int, j1 int, k1 int, i2 int, j2 int, k2 int, pvalue double, tstat double"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, tokens): the lines that are not blank, numbered in order."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("tokens")).where(F.size("tokens") > 0)
    return numbered(rows, [F.col("f"), F.col("m")], "n").select("n", "tokens")


def read_permutations(spark: SparkSession, path: str, subjects: int) -> DataFrame:
    """(perm, a): a line is the subjects of group A; numbers out of range are left out."""
    a = F.filter(F.transform("tokens", lambda x: x.cast("int")), lambda s: (s >= 0) & (s < subjects))
    return _lines(spark, path).select(F.col("n").cast("int").alias("perm"), F.array_sort(a).alias("a"))


def write_permutations(perms: DataFrame, path: str) -> None:
    """Lines of numbers, each four wide."""
    text = perms.select("perm", F.array_join(F.transform("a", lambda s: F.format_string("%4d", s)), " ").alias("value"))
    text.repartitionByRange(1, "perm").sortWithinPartitions("perm").select("value").write.text(path)


def read_coordinates(spark: SparkSession, path: str, indexed: bool = False) -> DataFrame:
    """(vox, i, j, k): the line's number is the voxel's; with indexed, lines are idx i j k x y z."""
    rows, at = _lines(spark, path), lambda k: F.col("tokens")[k]
    if indexed:
        return rows.select(F.col("n").alias("vox"), *(at(k + 1).cast("double").cast("int").alias(c) for k, c in enumerate("ijk")), *(at(k + 4).cast("double").alias(c) for k, c in enumerate("xyz")))
    return rows.select(F.col("n").alias("vox"), *(at(k).cast("double").cast("int").alias(c) for k, c in enumerate("ijk")))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a CSV with or without tstat, with an edge_id by their order."""
    columns = spark.read.option("header", "true").csv(path).columns
    fields = dict(f.split(" ") for f in EDGE_SCHEMA.split(", "))
    extra = {"bundle": "int", "network": "int"}
    schema = ", ".join(f"`{c}` {(fields | extra).get(c, 'double')}" for c in columns)
    rows = spark.read.option("header", "true").schema(schema).csv(path).withColumn("__m", F.monotonically_increasing_id())
    out = numbered(rows, [F.col("__m")], "edge_id").drop("__m")
    return out if "tstat" in columns else out.withColumn("tstat", F.lit(None).cast("double"))


def read_subjects(spark: SparkSession, path: str) -> list[str]:
    """Paths of the subjects, in the order of the list."""
    return [r.tokens[0] for r in _lines(spark, path).orderBy("n").collect()]


def missing_outputs(spark: SparkSession, inputs: str, outputs: str, ending: str) -> DataFrame:
    """(path, output): files of a folder for which there is no file of the same lower-cased stem in another one."""
    from .image import list_files

    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(\.nii)?(\.gz)?$", 1))
    have = spark.createDataFrame([(n,) for n in _names(spark, outputs)], "output string")
    want = spark.createDataFrame([(p,) for p in list_files(inputs, ("",))], "path string").withColumn("output", F.concat(stem, F.lit(ending)))
    return want.join(have, "output", "left_anti").select("path", "output")


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, empty ones too; none if there is no folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def seed_edges(tables: list[DataFrame], seeds: list[tuple[int, int, int]], value: str = "value") -> DataFrame:
    """Edges from a seed voxel to every voxel of its table with a value above 0, all seeds together."""
    out = None
    for t, (i, j, k) in zip(tables, seeds, strict=True):
        one = t.where(F.col(value) > 0).select(F.lit(i).alias("i1"), F.lit(j).alias("j1"), F.lit(k).alias("k1"), F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("k").alias("k2"), F.col(value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
