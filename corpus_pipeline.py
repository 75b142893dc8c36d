"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Language ID drops what no language explains, near-dedup keeps one document of each group, substring dedup
cuts passages that earlier documents hold, mixing fits the sources to their token budgets, and packing gives
the bins of training sequences. SQL can't express the first, second, fourth and fifth stage, so ORACLE_SQL is
None and tests/llm/test_pipeline.py holds the stages against brute-force versions.

Every stage takes an empty table, texts of any length and columns of any further names, which all but the last carry on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwell.llm import langid, mixing, packing, simhash, substring
from braidwell.llm.common import Scratch, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text some language explains. Null, empty and wordless texts go, whatever their doc_id; repeated rows stay or go
    alike; ties between languages don't matter here; a table without labelled rows loses only what has no letter. Texts of any
    length are judged whole."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id. Rows with a null doc_id and texts without a
    word are in no group and stay; rows that share a doc_id stay or go together."""
    return simhash.keep_one(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and passages that documents of smaller doc_id hold, or that they held themselves before. Rows
    with a null doc_id or text stay as they are; a document of which nothing remains goes; n_chars, where there is one,
    follows the text."""
    return substring.cleaned(spark, docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that each source gives its share of the tokens. Rows with a null doc_id or source and texts without
    a token aren't chosen; rows that share a doc_id are chosen together; ties of the seeded hash go by doc_id."""
    return mixing.mixed(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each bin. Texts without a token are in none; rows with a null doc_id are packed with a null one, repeated
    rows one by one; equal lengths go by doc_id."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
