"""From raw documents to a training mix: toxic documents go, then copies, then near copies, then passages of the
benchmark; what is left is mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafgraph.llm import decontam, exact_dedup, mixing, near_dedup, toxicity
from leafgraph.llm.queries import MIX, table
from leafgraph.session import written


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects. Null and empty texts are scored as texts without words;
    rows repeated stay or go together; columns of any name stay as they are. An empty table gives no rows."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, blanks aside; null counts as empty. Of the rows of one doc_id one stays."""
    return exact_dedup.unique_documents(docs, exact_dedup.DigestIndex(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: stages on word shingles take five words. Texts without words stay."""
    return near_dedup.unique_documents(docs, words=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the benchmark's passages, and without the documents that are mostly such passages. Null and empty texts stay."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicated by source and shuffled; adds copy and shuffle_key (in place of columns of that name). A null source counts
    among those without a weight of their own."""
    return mixing.mixed(docs, MIX, seed=1)


STAGES = [
    ("toxicity", clean_language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("mixing", mix),
]

#: SQL can't express the network of the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
