"""Sharding by balanced label propagation.

Documents with equal texts are linked; a cut edge is a pair of linked documents on
different shards. The label of a document is a shard. Documents of one text with
the same hash salt move together, as a *unit*; so a large group is a bounded number of rows in the
iteration, which grows with the table alone, and a giant group can still be split.

Each round joins the units with the labels of their group, as weights by shard, and
lets every unit ask for a shard that holds more of its group and still has
room. Requests are granted in hash order as long as the quota of the shard holds, a little above its even share, which
linked documents never exceed. Rounds end when nothing moves. They do end: of the shards of a group that gain in a round,
the heaviest loses nothing and all heavier ones stay as they are, so no division of a group among the shards comes twice.

The law ``rows`` is then made exact: rows are numbered within their shard, linked
ones first, and what exceeds the shard's quota fills the places free on others. Numbers
come from bucket sums and an order within buckets of bounded size; no shard is ever in one task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, rest, small, stored

SHARDS = 16
#: Salts per shard, and documents from which there are more of them.
SALTS, SALT_ROWS = 16, 50_000
#: What the rounds may put on a shard beyond its even share.
SLACK = 0.1
#: Requests for a shard are granted in so many hash slices.
SLICES = 512
#: Mean number of rows that are numbered in one task group.
BUCKET_ROWS = 4_000


def _running(by: str, order: str, value: str) -> Column:
    """The sum of ``value`` in the rows before, within ``by``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def propagate(units: DataFrame, quota: int, n_shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """Moves units (grp, salt, n, label) towards the shards of their group, under ``quota`` rows a shard.

    A unit asks for a shard where its group weighs more than in its own, equal weights in a hash order of the group's own. Heavier shards are
    preferred, with some chance for others, so that the units of a large group do not all ask for one. Every move is to a heavier shard, so
    groups draw together. ``rounds`` ends them before nothing moves.
    """
    for step in count() if rounds is None else range(rounds):
        loads = {r["label"]: r["n"] for r in units.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one number a shard
        room = F.element_at(F.array(*(F.lit(quota - loads.get(s, 0)).cast("bigint") for s in range(n_shards))), F.col("goal") + 1)
        held = units.groupBy("grp", "label").agg(F.sum("n").alias("weight")) \
            .withColumn("rank", F.struct("weight", F.xxhash64("grp", "label").alias("turn")))
        own = held.select("grp", "label", F.col("rank").alias("own"))
        others = held.select("grp", F.col("label").alias("goal"), "rank").withColumn("room", room).where("room > 0")
        chance = F.pmod(F.xxhash64("grp", "salt", "goal", F.lit(step)), F.lit(1000)) / 2000 + 0.5
        wants = (
            units.join(own, ["grp", "label"]).join(others, ["grp"]).where(F.col("rank") > F.col("own"))
            .groupBy("grp", "salt").agg(F.max(F.struct((F.col("rank.weight") * chance).alias("pull"), "goal")).alias("w"))
            .select("grp", "salt", F.col("w.goal").alias("goal"))
        )
        asked = units.join(wants, ["grp", "salt"], "left").withColumn("slice", F.pmod(F.xxhash64("grp", "salt"), F.lit(SLICES)))
        demand = asked.where("goal is not null").groupBy("goal", "slice").agg(F.sum("n").alias("demand"))
        granted = (
            demand.withColumn("fits", room - _running("goal", "slice", "demand")).where("fits > 0")
        )
        moved = asked.join(small(granted, n_shards * SLICES), ["goal", "slice"], "left")
        upto = F.sum("n").over(Window.partitionBy("goal", "slice").orderBy("grp", "salt"))
        columns = ["grp", "salt", "n", "label", "goal"]
        # of a slice that fits in part, the units whose running size fits
        partly = moved.where("fits < demand").withColumn("upto", upto).select(*columns, (F.col("upto") <= F.col("fits")).alias("ok"))
        plain = moved.where("fits is null or fits >= demand").select(*columns, F.col("fits").isNotNull().alias("ok"))
        after = stored(partly.unionByName(plain), "moved")
        n_moved = after.where("ok").count()
        units = after.select("grp", "salt", "n", F.when(F.col("ok"), F.col("goal")).otherwise(F.col("label")).cast("int").alias("label"))
        if not n_moved:
            break
    return units


def shard_documents(
    docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
    rounds: int | None = None, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every document with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``rows``: the counts of two shards differ by one at most, and equal
    texts are kept together as far as the quotas allow. ``size`` is the number of UTF-8 bytes plus
    1; a null text has none, and counts as equal to the empty one. Slots of a shard
    run from 0 without gaps; ``grown_shard`` belongs to another law and is null. Rows that agree in all that
    orders them are interchangeable. With fewer documents than shards some shards
    stay empty. The other columns of ``docs`` follow, but for those that clash.
    """
    out = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    extra = rest(docs, [doc_id, *out])
    body = F.coalesce(col(text), F.lit(""))
    total = docs.count()
    salts = n_shards * max(SALTS, total // (n_shards * SALT_ROWS))
    # of the row itself only its id decides; repeated ids share a salt
    spot = F.pmod(F.xxhash64(col(doc_id), F.lit(11)), F.lit(salts)).cast("int")
    base = docs.select(
        col(doc_id).alias("_doc"), (F.octet_length(body) + 1).cast("bigint").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"), F.md5(body).alias("_grp"), spot.alias("_salt"),
        *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    cells = stored(base.groupBy(F.col("_grp").alias("grp"), F.col("_salt").alias("salt")).agg(F.count(F.lit(1)).alias("n")), "cells")
    quota = int(total / n_shards * (1 + SLACK))
    linked = cells.groupBy("grp").agg(F.sum("n").alias("rows")).where("rows > 1")
    units = stored(cells.join(linked, "grp").withColumn("label", F.col("salt") % n_shards), "units")
    sizes = units.select("grp", "salt", (F.col("rows") > bucket_rows).alias("large"))
    units = propagate(units.drop("rows"), quota, n_shards, rounds).join(sizes, ["grp", "salt"])
    placed = units.select(F.col("grp").alias("u_grp"), F.col("salt").alias("u_salt"), F.col("label").alias("u_label"), "large")
    labelled = base.join(
        placed, (F.col("_grp") == F.col("u_grp")) & (F.col("_salt") == F.col("u_salt")), "left"
    )
    buckets = max(1, -(-total // (n_shards * bucket_rows)))
    # what comes last is moved on if the shard is too full: single documents, then small groups, which are in one
    # piece; large groups come first, and their salts go to buckets of their own
    large = F.pmod(F.xxhash64("_grp", F.floor(F.col("_salt") / n_shards)), F.lit(buckets))
    whole = F.lit(buckets) + F.pmod(F.xxhash64("_grp"), F.lit(buckets))
    alone = F.lit(2 * buckets) + F.pmod(F.xxhash64("_doc"), F.lit(buckets))
    labelled = labelled.select(
        "_doc", "_size", "_crc", "_grp", "_salt", *(f"_x{i}" for i in range(len(extra))),
        F.coalesce("u_label", F.col("_salt") % n_shards).alias("_label"),
        F.when(F.col("large"), large).when(F.col("u_label").isNotNull(), whole).otherwise(alone).alias("_bucket"),
    )
    sums = labelled.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("rows"))
    offsets = stored(sums.select(
        F.col("_label").alias("o_label"), F.col("_bucket").alias("o_bucket"),
        _running("_label", "_bucket", "rows").alias("offset"), "rows"), "offsets")
    counts = {r["o_label"]: r["rows"] for r in offsets.groupBy("o_label").agg(F.sum("rows").alias("rows")).collect()}
    places = _places(counts, total, n_shards)
    within = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_grp", "_doc"))
    numbered = labelled.withColumn("_in", within).join(
        small(offsets, 3 * buckets * n_shards), (F.col("_label") == F.col("o_label")) & (F.col("_bucket") == F.col("o_bucket"))
    ).withColumn("_pos", F.col("offset") + F.col("_in") - 1)
    shard, slot = places(F.col("_label"), F.col("_pos"))
    return numbered.select(
        F.col("_doc").alias(doc_id), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )


def _places(counts: dict[int, int], total: int, n_shards: int):
    """(label, position) to (shard, slot): rows within the quota stay, the others fill the free places in order.

    ``counts`` has one number a shard, so the rule is a short expression.
    """
    order = sorted(range(n_shards), key=lambda s: (-counts.get(s, 0), s))
    quota = {s: total // n_shards + (rank < total % n_shards) for rank, s in enumerate(order)}
    spills, spilt = {}, 0  # first number of a shard's surplus rows
    for s in range(n_shards):
        spills[s] = spilt
        spilt += max(0, counts.get(s, 0) - quota[s])
    free, at = [], 0  # (first, last, shard, rows it has)
    for s in range(n_shards):
        have = counts.get(s, 0)
        if have < quota[s]:
            free.append((at, at + quota[s] - have, s, have))
            at += quota[s] - have

    def rule(label: Column, position: Column) -> tuple[Column, Column]:
        limits = F.element_at(F.array(*(F.lit(quota[s]).cast("bigint") for s in range(n_shards))), label + 1)
        first = F.element_at(F.array(*(F.lit(spills[s]).cast("bigint") for s in range(n_shards))), label + 1)
        number = first + position - limits
        shard, slot = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for lo, hi, s, have in free:
            mine = (number >= lo) & (number < hi)
            shard, slot = F.when(mine, F.lit(s)).otherwise(shard), F.when(mine, number - lo + have).otherwise(slot)
        stays = position < limits
        return F.when(stays, label).otherwise(shard), F.when(stays, position).otherwise(slot)

    return rule
