"""A corpus pipeline over ``documents``: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_bytes
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import keep_first_of_groups
from tidemark.llm.queries import RANK_FILE
from tidemark.llm.shared import stored
from tidemark.llm.toxicity import keep_clean, learn_toxicity, training_labels

#: Every stage in SQL is out of reach: the first learns a classifier. The stages after it are tested against brute force, each on its own input.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    labels = training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_clean(docs, learn_toxicity(docs, labels), threshold=0.3)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 20 words and more go from the texts; rows of which nothing is left go as well."""
    cut = dedup_lines(docs, least_words=20, drop_emptied=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity 0.8 or more."""
    return keep_first_of_groups(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to twice; no document is left out. Copies lie next to each other: columns are those of
    documents, so the order of the mixture is not kept here."""
    return mix_sources(docs, max_passes=2.0, seed=17).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to, per row."""
    return encode_bytes(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each reading what the one before it wrote to the shared folder.

    Null and empty texts pass every stage (0 tokens at the end); null ids take no part in line dedup and near
    duplicates and stay; repeated rows of an id and text stay or go together, but for near duplicates of another
    id; null sources are a source; further columns pass through unchanged. An empty table gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
