"""A pipeline over ``documents``: toxicity, n-gram Jaccard join, benchmark decontamination, pseudonyms, byte-level BPE.

Each stage gets all rows that its predecessor kept, and all but the last return them with the columns of ``documents``.
A null or empty text passes every filter. The stages' own rules for repeated rows and null ids are in their docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denovospark.llm.bpe_tree import digest_bpe
from denovospark.llm.common import materialize, table
from denovospark.llm.decontamination import find_leaks
from denovospark.llm.ngram_join import ngram_components
from denovospark.llm.pii import pseudonymise
from denovospark.llm.queries import pseudonym_key
from denovospark.llm.toxicity import without_toxic


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Written first, so that Spark knows the size of the ids and broadcasts them only within its threshold."""
    return docs.join(materialize(ids.distinct(), "pipeline-dropped"), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by n-gram similarity the document with the least id stays. Rows without an id stay.

    Of rows with equal ids and texts one stays, the least by all columns; rows of one id with different texts all stay.
    """
    groups = materialize(ngram_components(docs), "pipeline-groups")
    kept = _without(docs, groups.filter("doc_id <> component_id").select("doc_id"))
    several = materialize(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-several")
    if several.isEmpty():
        return kept
    # the struct begins with what rows have to share, so its least is taken before the shuffle
    again = kept.join(several, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_hash"), F.md5("text").alias("_digest")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return kept.join(several, "doc_id", "left_anti").unionByName(again.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values in the texts become pseudonyms. n_chars stays what it was: values keep their length but for addresses."""
    return pseudonymise(docs, pseudonym_key(spark))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    return digest_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("encoding", encoding),
]
#: The first stage can't be expressed in SQL; the tests hold the pipeline against planted cases, and its operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
