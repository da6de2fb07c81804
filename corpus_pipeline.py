"""Corpus preparation: stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; documents that a stage rejects
are gone. The last returns doc_id, n_tokens, ids, starts (source bytes at which pieces begin, and the end) and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegraph.llm.common import table, written
from clausegraph.llm.decontaminate import uncontaminated
from clausegraph.llm.exact import exact_dedup
from clausegraph.llm.pieces import encode_ids
from clausegraph.llm.quality import quality_filter
from clausegraph.llm.queries import tokenizer_path
from clausegraph.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_ids(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact dedup", exact), ("near-dedup", near), ("decontamination", decontamination), ("tokens", tokens)]

#: Not expressible: a fitted classifier, fingerprints and a tokenizer. tests/llm holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
