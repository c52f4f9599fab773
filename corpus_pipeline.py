"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formscribe.llm import decontaminate, mixing, near, quality, token_files
from formscribe.llm.queries import tokenizer_path
from formscribe.plans.views import load
from formscribe.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good, judged on the labels of the folder."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near.keep_one_per_class(docs, near.jaccard_join(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, decontaminate.find_leaks(docs, load(spark, sf_dir, "benchmark")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and epoch that takes it, whole, shard by shard in the order that the mix gives."""
    return mixing.mixed_rows(docs, whole=True)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows; per row its id, start, number of ids and checksum, read back from the files."""
    out_dir = scratch_path(spark, "token-files")
    return token_files.read_token_files(token_files.write_token_files(docs, tokenizer_path(), out_dir), out_dir)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token output", token_output),
]

#: No SQL: the classifier, the random mix and the tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
