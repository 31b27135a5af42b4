"""Relevance of one row: BM25 over arrays of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def length_norm(length: Column, average: Column) -> Column:
    return K1 * (1.0 - B + B * length / average)


def saturation(tf: Column, norm: Column) -> Column:
    """``tf / (tf + norm)``, written so that ``tf`` is worked out once."""
    return 1.0 / (1.0 + norm / tf)


def frequency(terms: Column, term: Column) -> Column:
    """How often a term stands in an array of terms."""
    return F.size(F.filter(terms, lambda t: t == term))


def weighted_sum(occurrences: Column, hits: Column, norm: Column, keyword: bool) -> Column:
    """Sum of the weights of ``hits`` (``term``, ``weight``), damped by frequency.

    ``occurrences`` are the row's terms, cut down to those of the hits.
    """

    def add(total: Column, hit: Column) -> Column:
        tf = F.lit(1.0) if keyword else frequency(occurrences, hit["term"]).cast("double")
        return total + hit["weight"] * saturation(tf, norm)

    return F.aggregate(hits, F.lit(0.0), add)


def phrase_frequency(terms: Column, slots: list[tuple[int, str]], slop: int) -> Column:
    """Sum of ``1 / (1 + width)`` over the minimal windows no wider than ``slop``.

    Each occurrence is moved back by the position its term has in the query, so
    an exact phrase collapses to one point. One pass over the occurrences keeps
    the latest position of every query term. Of windows with the same end only the
    narrowest is minimal.
    """
    words = sorted({t for _, t in slots})
    placed = F.filter(
        F.transform(terms, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
        lambda x: x["t"].isin(words),
    )
    return phrase_frequency_of(placed, slots, slop)


def phrase_frequency_of(placed: Column, slots: list[tuple[int, str]], slop: int) -> Column:
    """The same from the query's words as they stand: an array of ``(t, i)``, word and position."""
    first = slots[0][0]
    offsets = [p - first for p, _ in slots]
    repeated = len({t for _, t in slots}) < len(slots)

    def occurrences_of(slot: int) -> Column:
        word, offset = slots[slot][1], offsets[slot]
        return F.transform(
            F.filter(placed, lambda x: x["t"] == word),
            lambda x: F.struct((x["i"] - offset).alias("at"), F.lit(slot).alias("slot")),
        )

    occurrences = F.array_sort(F.flatten(F.array(*map(occurrences_of, range(len(slots))))))
    start = F.struct(
        F.array(*[F.lit(None).cast("int") for _ in slots]).alias("latest"),
        F.lit(None).cast("int").alias("left"),
        F.lit(None).cast("int").alias("end"),
        F.lit(0.0).alias("last"),
        F.lit(0.0).alias("freq"),
    )
    shifts = F.array(*[F.lit(o) for o in offsets])

    def merge(state: Column, o: Column) -> Column:
        latest = F.transform(
            state["latest"], lambda v, j: F.when(j == o["slot"], o["at"]).otherwise(v)
        )
        complete = ~F.exists(latest, lambda v: v.isNull())
        if repeated:
            # one word of the text cannot stand for two words of the query
            spots = F.zip_with(latest, shifts, lambda v, s: v + s)
            complete = complete & (F.size(F.array_distinct(spots)) == len(slots))
        left = F.array_min(latest)
        fresh = complete & (state["left"].isNull() | (left > state["left"]))
        width = o["at"] - left
        value = F.when(width <= slop, 1.0 / (1.0 + width)).otherwise(F.lit(0.0))
        # several words may end at the same place; the last of them gives the narrowest window
        ended = fresh & (state["end"].isNull() | (o["at"] > state["end"]))
        return F.struct(
            latest.alias("latest"),
            F.when(fresh, left).otherwise(state["left"]).alias("left"),
            F.when(fresh, o["at"]).otherwise(state["end"]).alias("end"),
            F.when(fresh, value).otherwise(state["last"]).alias("last"),
            (state["freq"] + F.when(ended, state["last"]).otherwise(F.lit(0.0))).alias("freq"),
        )

    return F.aggregate(occurrences, start, merge, lambda s: s["freq"] + s["last"])
