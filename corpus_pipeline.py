"""A corpus pipeline of the library's text operators: what is toxic goes, near copies go, repeated bytes go, benchmark
passages go, and the rest is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last keep the columns of the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, minhash, packing, suffixes, toxicity
from tapeloom.llm.queries import ship, tokenizer
from tapeloom.runtime import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The classifier learns from the labels of ``sf_dir`` and the texts of the input;
    where no label of both kinds is left, nothing goes."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.fit(docs, toxicity.sample_of(labels, "toxic", toxicity.fold() != 1))
    return toxicity.clean_rows(docs, weights)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays; texts without words stay."""
    ship(spark)
    return minhash.clean_rows(docs)


def repeated_bytes_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once leave all their places, whole characters only; no row goes."""
    ship(spark)
    carried = {c: F.col(c) for c in ("lang", "source")}
    kept = suffixes.deduplicated(docs, bytewise=False, **carried).withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    ship(spark)
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of what is left with its sequence and place."""
    ship(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_copies_stage),
    ("suffix_array_dedup", repeated_bytes_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has neither the classifier nor signatures, suffix runs or tokenizers; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``; every stage's rows are landed in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tapeloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
