"""From raw documents to packed sequences: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each result to the
shared folder and reads it again, so no stage computes another's work twice and a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.llm import line_dedup, near_dedup, packing, pii, quality
from inkfathom.llm.common import documents, table

#: Per cent of common shingles from which documents are near-duplicates.
SIMILAR = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_only(docs.select(*COLUMNS), rules)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has."""
    return _documents(line_dedup.dedup(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest doc_id."""
    return near_dedup.first_rows(docs.select(*COLUMNS), SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data and what discloses it masked."""
    return _documents(pii.sanitise(docs.select(*COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_deduplication), ("near dedup", near_duplicates), ("pii", personal_data), ("packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned rules, tokenizer ids and components can't be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None
