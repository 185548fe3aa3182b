"""The corpus pipeline: documents without toxic texts, near copies, repeated passages and
benchmark passages, packed into training windows.

Each stage takes the documents that the one before kept and returns them in the same
columns; the last returns the packed pieces. A stage keeps nulls, empty texts and
repeated rows as its operator defines; an empty table passes through.

A stage's documents are the written output of the one before, so the tables that the
earlier stage had staged for itself are deleted when the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm import decontamination, packing, setsketch, substring_dedup, toxicity
from streakline.llm.common import delete_staged, noting_staged, restored, stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def tidy(function: Stage) -> Stage:
    """``function`` after the tables that the last such stage had staged are deleted."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        delete_staged(spark, _left)
        _left.clear()
        with noting_staged() as paths:
            found = function(spark, docs, folder)
        _left[:] = paths
        return found

    return run_stage


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return toxicity.clean_documents(docs, table(spark, folder, "labels"))


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id."""
    return setsketch.near_duplicates(docs, docs.columns)


@tidy
def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the words of passages that recur; texts that lose no word
    stay as they are."""
    cut = substring_dedup.cut_passages(docs, docs.columns)
    changed = F.col("n_removed") > 0
    left = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    kept = {c: F.col(f"kept_{i}") for i, c in enumerate(docs.columns)}
    return cut.select(
        *[(F.when(changed, left[c]).otherwise(k) if c in left else k).alias(c) for c, k in kept.items()]
    )


@tidy
def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    judged = decontamination.decontaminate(docs, table(spark, folder, "benchmark"), docs.columns)
    return judged.where("n_hit = 0").select(*restored(docs.columns))


@tidy
def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their place in the training windows."""
    return packing.packed_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL expresses neither the learned lexicon nor the packing; tests/llm compares the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
