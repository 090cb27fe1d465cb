"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

Quality rules drop rejected documents; of each group of near copies (five-word shingles, 0.8) one
stays; repeated passages are cut; benchmark passages are cut; the rest is encoded. All stages but
the last return the columns of documents, whatever others there are and whatever they are called.

Defined results: null and empty texts fail the base rule, so the first stage drops them; the later
ones, given such texts, keep them. Of rows that are equal in all columns the second stage keeps
one; to the third, rows that repeat a doc_id, or have none, count as later than all others and are
cut like them. A null doc_id stays.
Documents of which the third stage leaves no word go, as do those of which more than half of the
words are benchmark passages. Empty tables give empty tables; without labels only the base rule
rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calibrant.llm import decontaminate, near_dedup, quality_rules, sentencepiece_codec, substring_dedup
from calibrant.session import table

STAGES = [
    ("quality_rules", quality_rules.filter_stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

#: Learned rules and encodings have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
