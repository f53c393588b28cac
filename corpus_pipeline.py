"""The corpus pipeline: language, near duplicates, repeated strings, benchmark passages, mixing.

Each stage takes what the one before kept, and its decisions take effect. All but the last return the columns of
``documents``; the last returns the placings of the mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from tidemark.llm.shared import shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows have; without letters (null and empty texts too), or undecided, they go.

    Each row is judged by its own whole text, repeated rows and ids alike; other columns are kept whatever their names; without labelled rows nothing has a language.
    """
    return language_id.keep_known(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8).

    Rows are judged each by its own text: of rows that repeat an id, those that resemble nothing stay, and of rows repeated whole one does. Null ids come
    after all others; texts without words stay; ties go to one row of the smallest id.
    """
    return jaccard_join.drop_near_duplicates(docs, k=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 150 bytes (some 25 words) that stand in earlier ones, those with a smaller id.

    Texts are cut, other columns stay; a document of which nothing is left goes. Null and empty texts have no strings; rows of one id do not judge each other.
    """
    return suffix_dedup.drop_repeats(docs, length=150)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of the benchmark; each row is judged by its own text, null and empty ones hold none, and an empty benchmark takes none."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and no source more than four times over; null sources are one source, repeated rows are placed each."""
    return mixing.mix(docs, most_repeats=4.0)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeated_strings", without_repeats),
    ("decontamination", without_benchmark),
    ("mixture", mixture),
]

#: The first stage learns its model from the rows, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
