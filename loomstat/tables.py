"""Tables written to the folder that the executors share, to cut lineage where a plan is used again and again."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once for each context, so that it need not be installed there."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_loomstat_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="loomstat-code-")) / "loomstat.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._loomstat_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets a folder of this machine; on a cluster that would not be seen by all, so it raises."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomstat-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Deletes on exit the tables that were written inside; results that read them have to be used before."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            delete_path(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors and is read by columns."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for t in tables:
        delete_path(t.sparkSession, t._written_to)


def plain_unions(spark: SparkSession) -> None:
    """Keeps unions from claiming a partitioning, which Spark 4.1 gets wrong when AQE has coalesced one side."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def numbered(df: DataFrame, order: list, name: str, weight: str | None = None) -> DataFrame:
    """df with a column name: how many rows (or how much of the column weight) stand before each row by the values of Columns, ascending.

    Rows are dealt by ranges and counted in each; only the counts, one for each range, meet in one place.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark = df.sparkSession
    keys = [f"__k{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order, strict=True)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = written(rows.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("__p").agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    base = counts.select("__p", (F.sum("c").over(Window.orderBy("__p")) - F.col("c")).alias("__b"))
    here = Window.partitionBy("__p").orderBy(*keys)
    place = F.sum(weight).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(here) - 1
    return rows.withColumn("__n", place).join(F.broadcast(base), "__p").withColumn(name, (F.col("__b") + F.col("__n")).cast("long")).drop(*keys, "__p", "__n", "__b")
