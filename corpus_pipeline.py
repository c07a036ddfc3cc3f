"""The corpus pipeline over `documents`: each stage is one operator of `llm`, written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import lines, mixing, packing, queries, simhash
from llm.common import checkpointed, shared_folder

#: `op4_line_classes` takes one edit, as its SQL says; the stage also finds lines with a replaced word.
LINE_EDITS = 2
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _page_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("data"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null or empty text is judged like any other, a row without `doc_id` goes by its text's score."""
    scored = queries.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = scored.groupBy("page_id").agg(F.max("predicted").alias("predicted")).where("predicted = 0")
    keep = docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["page_id"]), "left_anti")
    return keep.select(*DOCUMENT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first line of each class stays, of all documents; `n_chars` follows the text.  No document goes."""
    rows = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("data"), "lang", "source", F.col("n_chars").alias("before"))
    left = lines.without_repeated_lines(rows, lines.line_classes(_page_texts(docs), max_edits=LINE_EDITS))
    length = F.coalesce(F.length("data").cast("long"), F.col("before"))
    return left.select(F.col("page_id").alias("doc_id"), F.col("data").alias("text"), "lang", "source", length.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest `doc_id`."""
    groups = simhash.near_duplicates(_page_texts(docs))
    gone = groups.where("page_id <> component_id").select(F.col("page_id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's blocks have it: at least once, as no token budget is set."""
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("host"), mixing.tokens_of("text").alias("tokens"))
    mixed = mixing.mix(pages, target_entropy=queries.MIX_ENTROPY, max_repetition=queries.MIX_REPETITION)
    times = checkpointed(mixed.groupBy("page_id", "host").agg(F.count_distinct("block").alias("times")))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times["page_id"]) & docs["source"].eqNullSafe(times["host"]))
    return joined.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*(docs[c] for c in DOCUMENT))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece of every document."""
    return packing.packed_pieces(_page_texts(docs), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("page_id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", best_fit_packing),
]

#: The classifier's scores and the tokenizer's ids cannot be written in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the folder that the cluster shares."""
    label = sf_dir.replace(":", "").strip("/").replace("/", "_")
    folder = f"{shared_folder(spark)}/corpus_pipeline/{spark.sparkContext.applicationId}/{label}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
