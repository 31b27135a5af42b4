"""The corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go,
the rest is mixed to target weights and put into shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return whole rows with
the columns of documents, whatever they are; the last returns the place of each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontaminate, minhash, mixing, queries, sharding, toxicity
from logloom.llm.common import col, stored

#: Share of the tokens that the mixture takes; every document once at most.
SHARE, EPOCHS = 0.6, 1


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing, and the new name of each column."""
    names = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(col(c).alias(n) for c, n in names.items())), names


def _restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(col(n).alias(c) for c, n in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    lexicon = toxicity.learn(docs, queries.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(lexicon)(col("text").cast("string")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of the benchmark's windows go."""
    rows, names = _renamed(docs)
    found = decontaminate.decontaminate(rows, queries.table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"])
    return _restored(found.where("not contaminated"), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes."""
    rows, names = _renamed(docs)
    levels = queries.mix_levels(names["lang"], names["source"])
    mixed = mixing.mix_sources(rows, levels, SHARE, EPOCHS, queries.MIX_SEED, names["doc_id"], names["text"])
    return _restored(mixed.where("n_epochs > 0"), names)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.shard_documents(docs.select("doc_id", "text", "lang", "source")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Learned scores and near copies are beyond SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
