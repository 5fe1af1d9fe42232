"""From raw documents to a training order, in five stages; every stage's result is written to the
shared folder and read back, so a lost executor costs no more than one stage's tasks.

All stages take documents with further columns of any name and return the columns they got (the last
one its own).  Null text counts as empty, texts are taken whole whatever their length, null ids are
ids like others, and an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from piste.llm import mixing, ngram_join, pii, quality, tiling
from piste.llm.common import staged, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  Empty texts have the score of no
    features; equal texts, and repeated rows, go or stay together."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return docs.where(quality.scorer(docs, model) >= 0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id; of repeated rows one.
    Documents without words stay."""
    return ngram_join.representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, reordered or not.  Empty texts stay; repeated rows go or
    stay together."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind.  No row goes; null text stays null."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that training takes, in training order: position, doc_id, source, epoch, words.
    Empty texts are never taken; a null source is a source; repeated rows are each a document."""
    return mixing.in_order(mixing.plan(docs))


STAGES = [("quality", good), ("near duplicates", distinct), ("benchmark", uncontaminated), ("personal data", anonymous), ("mixing", mixed)]

#: Trained models decide the rows, which SQL cannot express; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
