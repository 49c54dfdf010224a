"""From raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) whose result is stored as Parquet and
read again as the next one's documents. All but the last return the columns
that documents have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import exact_dedup, mixing, near_dedup, packing, quality
from runlens.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely to be the best one, by a model fitted on the labels."""
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.train(docs, ratings, quality.GOOD)
    return quality.keep_good(docs, model, quality.GOOD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8 or more."""
    return near_dedup.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source has its share, in random order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 ids."""
    names = {"id": "doc_id", "crc": "ids_crc32", "tokens": "doc_tokens", "sequence": "sequence_id"}
    return packing.pack(docs).withColumnsRenamed(names)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the vocabulary can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
