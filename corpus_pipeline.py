"""From documents to token ids: five operators of loomstat.llm, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one. All but the last return the columns of docs and keep rows as they are;
they differ in which rows stay, and mixing repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import decontaminate, mixing, ngram_join, quality, token_output
from loomstat.llm.shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes; it learns from the labels of docs that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    # Where there is nothing to learn from, nothing is rejected.
    return (quality.classify(docs, model).where("predicted = 1") if model else docs).select(*docs.columns)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest doc_id, with the smallest text hash. Documents without links stay."""
    found = ngram_join.jaccard_join(docs).where("n_links > 0").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__kd"), F.col("tk").alias("__tk"), "class_key")
    found = written(found.distinct(), "classes")
    first = found.groupBy("class_key").agg(F.min(F.struct("__kd", "__tk")).alias("k")).select("k.*", F.lit(True).alias("__keep"))
    linked = found.select("__kd", "__tk").join(first, ["__kd", "__tk"], "left").select("__kd", "__tk", F.coalesce("__keep", F.lit(False)).alias("__keep"))
    keyed = docs.withColumns({"__kd": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__tk": F.xxhash64("text")})
    rows = keyed.join(linked, ["__kd", "__tk"], "left")
    # Rows of one id and text are copies of each other; of those that are first in their class one stays.
    once = rows.where("__keep IS NULL").select(*docs.columns)
    return once.unionByName(rows.where("__keep").dropDuplicates(["__kd", "__tk"]).select(*docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"), short=True).where(F.size("hits") == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words weigh nothing and stay as they are."""
    times = F.when(F.col("__size") > 0, F.col("__times")).otherwise(1)
    rows = mixing.epochs(docs).withColumn("__times", times).where("__times > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "__times")).alias("__n")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files that hold the ids of docs."""
    return token_output.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("ngram_join", ngram_stage),
    ("decontaminate", benchmark_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A trained classifier, latent retrieval and a tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
