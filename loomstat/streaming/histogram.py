"""Results that arrive in parts: a p-value histogram and thresholds kept by Structured Streaming.

A source of Parquet parts is read as a stream; each micro-batch merges into the running counts, whose state
is one row for each bin. Restarted on its checkpoint, a stream goes on with the parts that it has not seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.significance import BINS, edge, log_bin
from ..tables import shared_dir


def parts_stream(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def histogram_stream(stream: DataFrame, col: str = "pvalue", bins: int = BINS) -> DataFrame:
    """(bin, left, right, count) over all that has arrived."""
    b = stream.select(log_bin(F.col(col).cast("double"), bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))
    return b.select("bin", edge(F.col("bin"), bins).alias("left"), edge(F.col("bin") + 1, bins).alias("right"), "count")


def start(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest counts as a table at path, replaced by each micro-batch."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return out.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def histogram_of_stream(parts: DataFrame, col: str = "pvalue", bins: int = BINS) -> DataFrame:
    """The histogram of a table, by a stream over its files."""
    spark = parts.sparkSession
    source = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    parts.write.parquet(source)
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    start(histogram_stream(parts_stream(spark, source, parts.schema), col, bins), f"{to}/out", f"{to}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{to}/out")


def late_windows(stream: DataFrame, time: str, width: str, delay: str, *by: str) -> DataFrame:
    """Counts in windows of event time; rows later than delay are dropped, as streams must forget."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select("window.start", "window.end", *by, "n")


