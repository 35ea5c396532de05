"""Session helpers: the shared folder, written tables that cut lineage, Arrow batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import forest
from ..tables import delete_path, discard, fresh_path, scope, shared_dir, ship, written

__all__ = ["components", "delete_path", "discard", "fresh_path", "prepare", "scope", "shared_dir", "shuffle_parts", "table", "written"]

#: Rows of a batch that goes to Python; bounds a worker's memory when texts are long.
ARROW_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Gives the package to the executors; lowers the session's Arrow batch size to ARROW_ROWS and leaves smaller settings alone; keeps unions
    from claiming a partitioning, which Spark 4.1 gets wrong when AQE has coalesced one side."""
    ship(spark)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node of its component.

    Rounds of large and small stars over tables in the shared folder, so no task and no driver holds a
    component. Nodes without an edge are absent; nulls are ignored.
    """
    prepare(edges.sparkSession)
    cur = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    roots = written(forest(cur, max_rounds), "roots")
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
