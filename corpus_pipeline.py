"""A training-data pipeline over ``documents``: toxic documents go, one document of each group of near
duplicates stays, repeated passages go, and what is left is packed into sequences.

Every stage reads what the one before it wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdgraph.llm import ngramjoin, packing, substring, toxicity
from holdgraph.llm.session import table, with_small_batches, written


@with_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels' training folds and keeps the documents that score below 0.5."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@with_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of Jaccard similarity connect, one row stays: the one with the smallest id (null
    first), of rows that share it the one with the smallest checksum. Null and repeated ids link nothing."""
    return ngramjoin.one_of_each_component(docs)


@with_small_batches
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeats of 20 words and more go from all but the first document that holds them."""
    out = substring.remove_repeats(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns))


@with_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]

#: A trained score decides what stays, which SQL can't express; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
