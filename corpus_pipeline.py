"""A training corpus from raw documents: toxic ones go, near copies go, benchmark items go, sources are
mixed to their weights, and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.llm.decontam import drop_contaminated
from meshquill.llm.langid import crc_of_id
from meshquill.llm.mixing import mix_sources, mixed_documents
from meshquill.llm.near_dedup import near_duplicates
from meshquill.llm.shared import materialise
from meshquill.llm.token_output import read_tokens, write_tokens
from meshquill.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the threshold, as they are. Null and empty texts score lowest and stay, repeated rows
    go or stay together, ids are read only to find labels; without labels of both classes all rows stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_of_id() % 3 != 1)
    return drop_toxic(docs, fit_toxicity(docs, labels), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, rows that repeat a doc_id and its text once (other texts of it stay). Rows with a null
    id, and texts without words, are linked with nothing and stay; empty docs stay empty."""
    found = materialise(near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"), "near-copies")
    single = docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("kept").select("doc_id")
    if repeated.isEmpty():
        return single
    return single.unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item. Null texts stay, null ids are no matter, repeated rows go or
    stay together; an empty benchmark or empty docs change nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: those of which it takes no word, null and empty texts among them, go. A null
    source is a source of its own; rows without an id, and repeated ones, are documents of their own."""
    return mixed_documents(docs, mix_sources(docs)[1])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row of docs, in order of doc_id; null and empty texts are an end id alone."""
    return read_tokens(spark, write_tokens(docs)).drop("ids")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Neither a kernel machine nor a tokenizer can be written in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
