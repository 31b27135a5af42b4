"""Text analysis: words, lower case, stop words, stems.

``analyze`` returns one array per text. The array index is the word position:
a stop word leaves a null in its place, so phrases still see the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .scalars import col
from .stemming import (
    MAX_TOKEN_LENGTH,
    STOP_WORDS,
    term_of,
    terms_in_place,
    terms_of_words,
)

# Word characters are letters, marks, digits and underscore. Some marks join two
# letters (``can't``, ``node.js``) or two digits (``1,000.5``); everywhere else
# they separate. One separator is one character, so the pattern needs no
# backtracking however long the text is.
_WORD = r"\p{L}\p{M}\p{N}_"
_JOIN_LETTERS = r".:'’‘·"
_JOIN_DIGITS = r".,;'’‘"
_JOINS = r".:,;'’‘·"
# Most characters are letters: the first range and the look at the joins spare them the long tests.
SEPARATOR = (
    rf"[^a-z{_WORD}{_JOINS}]"
    rf"|(?=[{_JOINS}])(?!(?<=[\p{{L}}\p{{M}}])[{_JOIN_LETTERS}]\p{{L}}|(?<=\p{{N}})[{_JOIN_DIGITS}]\p{{N}})[{_JOINS}]"
)
_HAS_WORD_CHAR = r"[\p{L}\p{N}]"


# A text is plain when no run of 256 characters lacks a blank, so that no word
# can be too long, and no underscore or mark stands without a letter or digit.
# Runs are looked for from their first character only.
_NOT_PLAIN = (
    rf"(?:^|\s)\S{{{MAX_TOKEN_LENGTH + 1}}}|(?=[_\p{{M}}])(?<![{_WORD}])[_\p{{M}}]+(?![{_WORD}])"
)


def tokenize(text: Column | str, lower: bool = True) -> Column:
    """The words of a text, in order. Words over 255 characters are cut in pieces."""
    source = F.lower(col(text)) if lower else col(text)
    plain = F.array_remove(F.split(source, SEPARATOR), "")
    cut = F.flatten(
        F.transform(
            F.filter(plain, lambda t: t.rlike(_HAS_WORD_CHAR)),
            lambda t: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(t) - 1) / MAX_TOKEN_LENGTH).cast("int")),
                lambda i: F.substr(t, i * MAX_TOKEN_LENGTH + 1, F.lit(MAX_TOKEN_LENGTH)),
            ),
        )
    )
    return F.when(col(text).rlike(_NOT_PLAIN), cut).otherwise(plain)


def drop_stop_words(words: Column) -> Column:
    """Stop words become null, so that positions stay as they were."""
    return F.transform(words, lambda t: F.when(~t.isin(STOP_WORDS), t))


def analyze(text: Column | str, stem: bool = True) -> Column:
    """Terms by position; null where a stop word stood. Null text has no terms."""
    if stem:
        return terms_of_words(F.array_remove(F.split(F.lower(col(text)), SEPARATOR), ""))
    return drop_stop_words(tokenize(text))


def present(terms: Column) -> Column:
    """The terms without the gaps."""
    return F.filter(terms, lambda t: t.isNotNull())


def query_terms(spark: SparkSession, text: str, stem: bool = True) -> list[tuple[int, str]]:
    """Analyze a query by the same rules: ``(position, term)`` pairs.

    The one row that comes back holds the caller's own query.
    """
    words = spark.range(1).select(tokenize(F.lit(text)).alias("words")).head()["words"]
    return [
        (i, term_of(w) if stem else w) for i, w in enumerate(words) if w not in STOP_WORDS
    ]


def runs(text: Column) -> Column:
    """The text cut into words and single separators; joined, it is the text again."""
    marked = F.regexp_replace(text, f"({SEPARATOR})", "\u0001$1\u0001")
    return F.split(marked, "\u0001")


def highlight(text: Column | str, terms: Column, stem: bool = True) -> Column:
    """The text with every word whose term is in ``terms`` wrapped in ``<em>``."""
    words = runs(F.lower(col(text)))
    analyzed = terms_in_place(words) if stem else words
    marked = F.transform(
        F.arrays_zip(runs(col(text)).alias("piece"), analyzed.alias("term")),
        lambda p: F.when(
            F.coalesce(F.array_contains(terms, p["term"]), F.lit(False)),
            F.concat(F.lit("<em>"), p["piece"], F.lit("</em>")),
        ).otherwise(p["piece"]),
    )
    return F.array_join(marked, "")
