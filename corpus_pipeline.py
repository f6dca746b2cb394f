"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, folder) and works on what the one before it kept, written as Parquet and read
again. Stages return the columns of documents; the last one returns the digests of the token ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import byte_bpe, toxicity
from seamline.llm.decontaminate import drop_contaminated
from seamline.llm.line_dedup import dedup_lines
from seamline.llm.ngram_join import first_of_components
from seamline.session import bound_batches, shared_folder, ship_package

#: Documents that score as high are dropped.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit; the labels of the folder are learnt from, never looked up."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs, model)
    kept = scored.where(F.col("score") < TOXIC).drop("score")
    return kept.withColumnRenamed("__score", "score").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with lines that others hold taken out; n_chars follows the text."""
    kept = dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, with the smallest id; rows are judged one by one, see ``first_of_components``."""
    return first_of_components(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded=True)
    return byte_bpe.digested(coded)


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _shipped(drop_toxic)),
    ("line_dedup", _shipped(drop_lines)),
    ("ngram_join", _shipped(drop_near_copies)),
    ("decontamination", _shipped(drop_benchmark)),
    ("byte_bpe", _shipped(token_ids)),
]

#: The classifier and the components over whole tables have no short SQL; tests compare stages by brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of a stage that the next stage no longer needs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _removed(spark, last)
        last = path
    return docs
