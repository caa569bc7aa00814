"""The corpus pipeline: language identification, near-duplicates, repeated passages, secrets, packing.

Every stage takes all documents that the one before kept and returns them in the columns of ``documents``; the last
returns packed pieces with their token ids. Stages are written to the shared folder in between.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm import common, langid, minhash, packing, secrets, suffix_dedup
from dokuma.llm.common import written

#: A best language below this is no language; four languages cannot score below 0.25.
LEAST_LANGUAGE_SCORE = 0.3
#: Passages of over 50 words that two documents share are repeats, however few bytes they have.
PASSAGE_WORDS = 51


#: Scratch tables of the stage that ran last.
_left: list[str] = []


def clearing(stage: Callable) -> Callable:
    """The stage, deleting what the one before it wrote on its way: a stage begins when its predecessor's rows are
    written, so nothing reads those tables any more (unless its input does)."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        for path in [p for p in _left if not any(p in f for f in read)]:
            if path in common._MADE:
                common._delete(spark, path)
        before = common.scratch_so_far()
        out = stage(spark, docs, sf_dir)
        _left[:] = common._MADE[before:]
        return out

    return run_stage


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@clearing
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.fit(docs, F.lit(True)), LEAST_LANGUAGE_SCORE)


@clearing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, shingle=5, num=80, den=100)


@clearing
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(suffix_dedup.without_repeats(docs, words=PASSAGE_WORDS))


@clearing
def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(secrets.redact(docs))


@clearing
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers keep their caches from stage to stage, so this one is held smaller than a query of its own would.
    return packing.pack_documents(docs, packing.default_tokenizer(), cache=80_000)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secret_spans), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
