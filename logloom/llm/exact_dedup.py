"""Exact duplicates by skew-safe combining.

Three stages, each an aggregation whose key holds the whole normalised text, so
that texts with equal digests are told apart by content everywhere:

1. *local*: Spark's partial aggregation folds the copies inside each task;
2. *salted*: what is left meets by (digest, salt), where the salt is that of the
   task, so a group of any size is spread over ``salts`` reducers;
3. *global*: at most one winner for each salt meets by digest.

A group then sends one row a task into stage 2 and ``salts`` rows into stage 3,
however many copies it has. The way back to the documents is a join on the
digests, whose hot keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, rest

#: The white space that does not count when texts are compared.
BLANKS = " \t\n\x0b\f\r"
SALTS = 16


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _winner(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("rank").alias("rank"), F.sum("n").cast("bigint").alias("n")
    )


def winners(docs: DataFrame, doc_id: str, text: str, salts: int, digest) -> DataFrame:
    """One row for each different text: its digests, the document that stays, the number of copies."""
    rows = pick(docs, doc=doc_id, raw=text).select(
        "doc", normalised(F.col("raw")).alias("norm"),
        F.length(F.coalesce(F.col("raw"), F.lit(""))).alias("points"),
    )
    # the smallest rank wins: most code points, then the smallest id of whatever type, ids before null
    rank = F.struct((-F.col("points")).alias("minus"), F.col("doc").isNull().alias("none"), "doc")
    rows = rows.select(
        "norm", digest(F.col("norm")).alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        rank.alias("rank"), F.lit(1).cast("bigint").alias("n"),
    )
    salted = _winner(rows, "digest", "salt", "norm")
    whole = _winner(salted, "digest", "norm")
    return whole.select(
        "digest", F.sha2("norm", 256).alias("sha"), F.col("rank.doc").alias("keep_id"),
        (-F.col("rank.minus")).alias("points"), F.col("n").alias("group_size"),
    )


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest=None
) -> DataFrame:
    """Every document with the document that stays for its text.

    Texts are equal when they are identical after all blanks are deleted; a null
    text is an empty one. Of equal texts the row with the most code points
    stays, then the smallest id, which may be of any type that has an order; a null id comes after all others. Result:
    the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and the other columns of ``docs`` that
    do not clash with these names. Rows that agree in id and text are copies of each
    other and all say the same, so an id that stays may be there
    several times. An empty table gives an empty result. ``digest`` maps the
    normalised text to a grouping key; a weak one costs time, not correctness.
    """
    digest = digest or (lambda norm: F.sha2(norm, 256))
    out = ["keep_id", "group_size", "kept", "text_sha256"]
    extra = rest(docs, [doc_id, *out])
    found = winners(docs, doc_id, text, salts, digest)
    side = docs.select(
        F.col(f"`{doc_id}`").alias("_doc"),
        F.sha2(normalised(F.col(f"`{text}`")), 256).alias("_sha"),
        F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_points"),
        *(F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    joined = side.join(found, side["_sha"] == found["sha"])
    return joined.select(
        F.col("_doc").alias(doc_id), "keep_id", "group_size",
        (F.col("_doc").eqNullSafe(F.col("keep_id")) & (F.col("_points") == F.col("points"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )
