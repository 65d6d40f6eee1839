"""From raw documents to packed bins: five stages, each a written table the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parley.llm import mixing, near_texts, packing, quality, secrets
from parley.llm.common import prepare
from parley.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts share four fifths of their five-word shingles."""
    return near_texts.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts, and ``n_chars`` of the text as it now is."""
    return secrets.recount(secrets.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document; copies lie in different bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
    ("source_mix", source_mix), ("packed_bins", packed_bins),
]

#: Fingerprints are XXH64 majorities and bins a sequential choice, which SQL cannot express;
#: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    prepare(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return docs
