"""Edit distance with transpositions, from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed_edits(term: str) -> int:
    """Automatic fuzziness: short terms must match exactly."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def swaps(w: Column) -> Column:
    """The word with each pair of neighbours exchanged once."""
    n = F.length(w)
    return F.when(
        n >= 2,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.concat(
                F.substr(w, F.lit(1), i - 1),
                F.substr(w, i + 1, F.lit(1)),
                F.substr(w, i, F.lit(1)),
                F.substr(w, i + 2, n),
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _swapped(q: str) -> Column:
    words = {q[:i] + q[i + 1] + q[i] + q[i + 2 :] for i in range(len(q) - 1)}
    return F.array(*[F.lit(w) for w in sorted(words)]).cast("array<string>")


def _within(a: Column, b: Column, k: int) -> Column:
    return F.levenshtein(a, b, k) >= 0


def may_be_near(term: Column, query: str, k: int) -> Column:
    """Cheap test that every word within ``k`` edits passes: its length is near, and
    at most ``k`` of its letters are foreign to the query."""
    if k == 0:
        return term == query
    foreign = F.length(F.translate(term, "".join(sorted(set(query))), ""))
    return F.length(term).between(len(query) - k, len(query) + k) & (foreign <= k)


def edit_distance(term: Column, query: str, k: int) -> Column:
    """Edits between a column and a literal, up to ``k`` (0 to 2), else null.

    An exchange of neighbours counts as one edit. ``levenshtein`` alone would
    count two, so one or both words are also tried with a pair exchanged.
    """
    q = F.lit(query)
    out = F.when(term == q, 0)
    if k == 0:
        return out
    # An exchange is two plain edits, so a word within k edits is within 2k plain ones.
    near = may_be_near(term, query, k) & _within(term, q, 2 * k)
    few = F.when(_within(term, q, 1) | F.array_contains(_swapped(query), term), 1)
    if k >= 2:
        # beside an exchange, one more edit leaves a word that passes the test for one
        exchanged = may_be_near(term, query, 1) & (
            F.exists(_swapped(query), lambda v: _within(v, term, 1))
            | F.exists(swaps(term), lambda v: _within(v, q, 1))
            | F.arrays_overlap(_swapped(query), swaps(term))
        )
        few = few.when(_within(term, q, 2) | exchanged, 2)
    return out.when(near, few)
