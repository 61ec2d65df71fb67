"""From raw documents to packed training sequences, stage by stage.

Every stage is written as Parquet in the shared folder and read again as the
next one's documents, so a lost executor costs no more than its own tasks and
each plan stays small.

Defined results: null, empty and white texts pass the dedup and benchmark stages as they are (the quality rules
refuse texts of fewer than 20 words); repeated rows and rows that share an id follow the rules of the stage's operator;
texts of any length are read whole; ties are settled by the smallest doc_id; an empty table gives an empty
result with the same columns; further columns of the documents pass all stages but the last unchanged,
whatever their names (but names that begin with ``__``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lendspark.llm import decontaminate as _decontaminate
from lendspark.llm import minhash, packing, passage_dedup, quality_rules, unit_dedup
from lendspark.llm.scratch import stage
from lendspark.session import read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, read_table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of sentences that earlier places have, and without what is left of repeated passages.

    Sentences do nearly all of it; a passage of which no sentence is whole goes by its word windows.
    """
    return passage_dedup.keep_first_passages(stage(unit_dedup.keep_first_units(docs, "sentence")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return _decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_documents),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", sequences),
]

# SQL cannot express the boosted trees, the similarity components or the packing rule
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again but the last."""
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
