"""A corpus pipeline in stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm.best_fit_pack import pack_documents
from skeinwork.llm.common import recorded, remove, stored, table
from skeinwork.llm.exact_dedup import deduplicate
from skeinwork.llm.ngram_join import without_near_copies
from skeinwork.llm.queries import tokenizer_path
from skeinwork.llm.source_mix import mixed_documents
from skeinwork.llm.toxicity import fit_toxicity, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(f: Stage) -> Stage:
    """f, which first removes the tables that the stage before needed for its result.

    That result has been written by then, as it is what this stage reads; tables of a result
    that hasn't been are kept.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        if not any(path.rstrip("/").rsplit("/", 1)[-1] in file for path in _left for file in read):
            remove(spark, _left)
            _left.clear()
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, doesn't find toxic."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest doc_id."""
    return deduplicate(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id."""
    return without_near_copies(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a row is there once for each time."""
    return mixed_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and their places in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact-dedup", drop_copies), ("near-copies", drop_near_copies), ("mix", mix), ("pack", pack)]

#: The stages use trained weights, hashes and a tokenizer, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stored(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
