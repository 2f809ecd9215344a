"""A training-data pipeline over documents: each stage takes (spark, docs, sf_dir) and returns the next one's docs.

Each stage works on every row that the one before it kept; all but the last return the columns of docs,
whatever their names. Nulls count as empty texts; empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxelry.llm import exact_dedup, mixing, near, packing, toxicity
from voxelry.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it is fitted on the labelled rows of the whole table.

    A row is judged by its text alone, so repeated rows go or stay together, and empty texts stay.
    """
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, up to white space, the one with the smallest id stays; empty texts are copies of each other."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies link, the one with the smallest id stays.

    Near copies share five-word shingles at Jaccard 0.8 or more; SimHash fingerprints discard pairs and
    the sets decide. Fingerprints within op8's two bits miss nearly all of these.
    """
    return near.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, at most twice; sources come near their targets."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a document that the mix repeats is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The toxicity stage is a fitted model, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None
