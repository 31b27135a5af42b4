"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The levels (domain, language, source, ...) form a tree. The token budget flows from
the root down: the children of a node share its budget by weight, and a child
whose supply is smaller takes all of it and leaves the rest to its siblings.
Because the supply of a node is that of all leaves below, a shortage is made up
among siblings as long as they have tokens, and only what a whole subtree lacks
goes to the siblings of its ancestors.

A leaf with a quota of ``full`` times its tokens and a rest takes each document
``full`` times, and the token-prefix of the next epoch once. An epoch is the order by a
hash of seed, epoch number and document id. The end of the prefix is found in two
steps, so that no leaf is ever sorted in one task: sums over hash buckets of bounded
row numbers first, then the rows of the one bucket that holds the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, rest, small, stored

#: Whitespace-separated tokens.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Mean number of documents in a hash bucket.
BUCKET_ROWS = 2_000


@dataclass(frozen=True)
class Level:
    """One level of the tree: the name of its column in the result, its value, and the weight of a value."""

    name: str
    value: Column
    weight: Column


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``quota``: ``budget`` shared among the children of each parent by ``weight``, none above its ``supply``.

    In the order of supply / weight the nodes that get all they have come first, so
    one running sum of supplies and weights tells which these are. All amounts are whole
    numbers and add up exactly; single tokens left over go by largest remainder.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("supply") / F.col("weight"), name)
    taken = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    all_of_it = (_wide(F.col("budget") - taken) * _wide(F.col("weight"))) >= (_wide(F.col("supply")) * _wide(left))
    out = nodes.withColumn("sated", all_of_it)
    rest_budget = F.col("budget") - F.sum(F.when(F.col("sated"), F.col("supply")).otherwise(0)).over(by)
    rest_weight = F.sum(F.when(F.col("sated"), 0).otherwise(F.col("weight"))).over(by)
    out = out.withColumn("rest_budget", rest_budget).withColumn("rest_weight", F.greatest(rest_weight, F.lit(1)))
    product = "cast(rest_budget as decimal(19,0)) * cast(weight as decimal(19,0))"
    out = out.withColumn("even", F.expr(f"({product}) div cast(rest_weight as decimal(38,0))").cast("bigint")) \
        .withColumn("remainder", F.expr(f"({product}) % cast(rest_weight as decimal(38,0))").cast("bigint"))
    spare = F.col("rest_budget") - F.sum(F.when(F.col("sated"), 0).otherwise(F.col("even"))).over(by)
    turn = F.row_number().over(by.orderBy("sated", F.col("remainder").desc(), name))
    quota = F.when(F.col("sated"), F.col("supply")).otherwise(F.col("even") + (turn <= spare).cast("bigint"))
    return out.withColumn("spare", spare).withColumn("quota", quota).drop(
        "sated", "rest_budget", "rest_weight", "even", "remainder", "spare"
    )


def quotas(leaves: DataFrame, names: list[str], budget: int, max_epochs: int) -> DataFrame:
    """Each leaf with ``quota``, the ``full`` epochs and the tokens of the ``part`` of the next one."""
    usable = leaves
    for name in names:
        usable = usable.where(F.col(f"w_{name}") > 0)
    usable = usable.withColumn("supply", F.col("tokens") * max_epochs)
    reach = usable.agg(F.sum("supply")).first()[0] or 0
    parent: DataFrame | None = None
    for depth, name in enumerate(names):
        path, above = names[: depth + 1], names[:depth]
        nodes = usable.groupBy(*path).agg(
            F.sum("supply").alias("supply"), F.max(f"w_{name}").cast("bigint").alias("weight")
        )
        if parent is None:
            nodes = nodes.withColumn("budget", F.lit(min(budget, reach)).cast("bigint"))
        else:
            nodes = nodes.join(parent.select(*above, F.col("quota").alias("budget")), above)
        parent = share_out(nodes, above, name)
    out = leaves.join(parent.select(*names, "quota"), names, "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    whole = F.greatest("tokens", F.lit(1))
    return out.withColumn("full", F.expr("quota div greatest(tokens, 1)")).withColumn("part", F.col("quota") % whole)


def mix_sources(
    docs: DataFrame, levels: list[Level], share: float, max_epochs: int = 3, seed: int = 17,
    doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every document with its leaf, ``tokens`` and ``n_epochs``: how often the mixture takes it.

    The budget is ``share`` of all tokens (rounded down). A level value that is null
    counts as ``""``; a node of weight 0 gets nothing. The prefix of an epoch ends before the first
    document that would exceed it, so a leaf falls short of its quota by less than one document.
    Rows that agree in id are peers: an epoch takes all or none of them. A null id is an id like others, a null text has no
    tokens. Empty documents of a leaf are taken with the documents before them. The
    other columns of ``docs`` follow, but for those that clash with the result's names.
    """
    names = [x.name for x in levels]
    out = [*names, "tokens", "n_epochs"]
    extra = rest(docs, [doc_id, *out])
    base = docs.select(
        col(doc_id).alias("_doc"), n_tokens(col(text)).alias("_tokens"),
        *(F.coalesce(x.value.cast("string"), F.lit("")).alias(f"_l_{x.name}") for x in levels),
        *(x.weight.cast("bigint").alias(f"_w_{x.name}") for x in levels),
        *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    narrow = stored(
        base.select("_doc", F.col("_tokens").alias("tokens"), *(F.col(f"_l_{n}").alias(n) for n in names),
                    *(F.coalesce(f"_w_{n}", F.lit(0)).alias(f"w_{n}") for n in names)), "narrow")
    leaves = stored(narrow.groupBy(*names).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"),
        *(F.max(f"w_{n}").alias(f"w_{n}") for n in names)), "leaves")
    total, n_leaves = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    plan = stored(
        quotas(leaves, names, int(total * share), max_epochs)
        .select(*names, "full", "part", F.ceil(F.col("docs") / bucket_rows).cast("bigint").alias("buckets")), "plan")
    plan = small(plan, n_leaves)

    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("_doc").cast("string"), F.lit(""))))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * F.col("buckets") / F.lit(float(2**32)))
    placed = narrow.join(plan, names).where("part > 0").withColumn("_key", key).withColumn("_bucket", bucket)
    sums = placed.groupBy(*names, "_bucket", "part").agg(F.sum("tokens").alias("in_bucket"))
    running = F.sum("in_bucket").over(Window.partitionBy(*names).orderBy("_bucket"))
    ends = (
        sums.withColumn("_to", running).where("_to > part")
        .groupBy(*names).agg(F.min(F.struct("_bucket", (F.col("_to") - F.col("in_bucket")).alias("before"))).alias("e"))
        .select(*names, F.col("e._bucket").alias("_end"), F.col("e.before").alias("_before"))
    )
    ends = stored(ends, "ends")
    inside = placed.join(small(ends, n_leaves), names).where("_bucket = _end")
    upto = F.col("_before") + F.sum("tokens").over(Window.partitionBy(*names).orderBy("_key"))
    last = (
        inside.withColumn("_upto", upto).where("_upto <= part")
        .groupBy(*names).agg(F.max("_key").alias("_last"))
    )
    decided = stored(plan.join(ends, names, "left").join(last, names, "left"), "decided")
    decided = decided.select(
        *(F.col(n).alias(f"_d_{n}") for n in names), "full", "part", "buckets", "_end", "_last"
    )
    same = None
    for n in names:
        test = F.col(f"_l_{n}") == F.col(f"_d_{n}")
        same = test if same is None else same & test
    prefix = (F.col("part") > 0) & (
        (F.col("_bucket") < F.col("_end")) | ((F.col("_bucket") == F.col("_end")) & (F.col("_key") <= F.col("_last")))
    )
    taken = (
        base.join(small(decided, n_leaves), same).withColumn("_key", key).withColumn("_bucket", bucket)
        .withColumn("_n", F.col("full") + F.coalesce(prefix, F.lit(False)).cast("bigint"))
    )
    return taken.select(
        F.col("_doc").alias(doc_id), *(F.col(f"_l_{n}").alias(n) for n in names),
        F.col("_tokens").alias("tokens"), F.col("_n").cast("int").alias("n_epochs"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )
