"""Training-data pipeline: language, near copies, benchmark leaks, secrets, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last
returns where each piece of each document stands in the packed sequences. Stages read their
predecessor's Parquet, so a lost executor costs the tasks of one stage.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislegraph.llm.language import UNKNOWN, predict, train
from aislegraph.llm.leaks import flag_documents
from aislegraph.llm.near_copies import near_copies
from aislegraph.llm.packing import pack_documents
from aislegraph.llm.secret_scan import redact_secrets
from aislegraph.llm.token_files import shared_folder


#: Bytes of a batch on its way to or from a Python worker: both ends hold several at once, and the memory
#: of one stage is still there in the next.
BATCH_BYTES = 4 << 20


def bounded_batches(stage):
    """The stage with batches by bytes, whatever the number of rows; longer single rows go alone."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no n-gram of a known language, go; when no row has a
    language to learn from, only those without letters."""
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = predict(docs, model)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select(docs.columns)


@bounded_batches
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; rows
    without doc_id stay, and so do rows that share a doc_id but not their words."""
    judged = near_copies(docs)
    left = docs.join(judged.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return left
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.sha2(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "), 256)
    known = left.where("doc_id IS NOT NULL").withColumn("_words", words).dropDuplicates(["doc_id", "_words"])
    return known.drop("_words").unionByName(left.where("doc_id IS NULL"))


@bounded_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none."""
    flagged = flag_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return flagged.where(~F.col("contaminated")).select(docs.columns)


@bounded_batches
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts as they are."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@bounded_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece in sequences of 2,048 tokens; a null or empty text is its end id alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_copies", deduplicate), ("benchmark_leaks", decontaminate), ("secret_scan", redact), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
