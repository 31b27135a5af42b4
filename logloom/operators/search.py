"""Full-text search over a table of records.

Everything about a row is computed on that row: its terms are an array column,
and matching, phrase distance and score are array expressions. No row is taken
apart and put together again by its id, so repeated ids do no harm and no
shuffle moves the texts. What the whole table contributes (how many rows, how
long on average, in how many rows each query term occurs) is one small aggregate
that enters the scoring as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import analysis
from ..functions.fuzzy import allowed_edits, edit_distance, may_be_near
from ..functions.scoring import (
    frequency,
    idf,
    length_norm,
    phrase_frequency,
    saturation,
    weighted_sum,
)


@dataclass(frozen=True)
class TextField:
    """A searchable field. A keyword is one term per value, never analyzed."""

    path: str
    keyword: bool = False
    multi: bool = False
    stem: bool = True

    @property
    def stored(self) -> str:
        """Name of the column that holds the terms when they were stored."""
        return self.path.replace(".", "_") + "_terms"

    def terms(self) -> Column:
        if self.multi:
            return F.array_distinct(F.col(self.path))
        if self.keyword:
            value = F.col(self.path)
            return F.when(value.isNotNull(), F.array(value))
        return analysis.analyze(self.path, self.stem)


MESSAGE = TextField("message")
ERROR_MESSAGE = TextField("error.message")
ERROR_TYPE = TextField("error.type", keyword=True)
REQUEST_PATH = TextField("request.path", keyword=True)
TAGS = TextField("tags", keyword=True, multi=True)

SEARCH_FIELDS = [MESSAGE, ERROR_MESSAGE, REQUEST_PATH]
SIMILAR_FIELDS = [MESSAGE, ERROR_MESSAGE, ERROR_TYPE]

MIN_DOC_FREQ = 5
MAX_QUERY_TERMS = 12
MIN_SHOULD_MATCH = 0.3


def store_terms(logs: DataFrame, fields: list[TextField] | None = None) -> DataFrame:
    """Add the analyzed terms as columns, to be written with the table.

    Searches use such columns when they are there and skip the analysis.
    """
    for f in fields or [MESSAGE, ERROR_MESSAGE]:
        logs = logs.withColumn(f.stored, f.terms())
    return logs


def _terms(df: DataFrame, f: TextField) -> Column:
    return F.col(f.stored) if f.stored in df.columns else f.terms()


def _length(terms: Column, f: TextField) -> Column:
    """Field length; a keyword counts its values, a text its kept words."""
    size = F.size(terms) if f.keyword else F.size(analysis.present(terms))
    return F.when(terms.isNotNull(), size).otherwise(0)


def _query_terms(df: DataFrame, f: TextField, query: str) -> list[tuple[int, str]]:
    if f.keyword:
        return [(0, query)]
    return analysis.query_terms(df.sparkSession, query, f.stem)


def _may_contain(f: TextField, term: str) -> Column:
    """Cheap test on the raw text that every row with this term passes.

    Stemming rewrites at most the last two letters it keeps.
    """
    if f.multi:
        return F.array_contains(f.path, term)
    if f.keyword:
        return F.col(f.path) == term
    part = term[: max(1, len(term) - 2)] if f.stem else term
    if any(c in part for c in "'’‘＇"):
        return F.col(f.path).isNotNull()
    return F.contains(F.lower(F.col(f.path)), F.lit(part))


# -- what the whole table contributes -----------------------------------------


def _average() -> Column:
    """Mean field length; 1 where no row has the field and so nothing can match."""
    return F.coalesce(F.try_divide(F.col("total"), F.col("n")), F.lit(1.0))


STATISTICS = ["field", "term", "log_date"]


def term_statistics(logs: DataFrame, fields: list[TextField] | None = None) -> DataFrame:
    """``(field, term, log_date, df, n, total)``: in how many rows of a day each term occurs.

    The row without a term carries the number of rows, of those with the field,
    and their total length. Statistics of several loads add up (``merged``), so
    each load writes its own, and searches need no scan to weigh their terms.
    """

    each = list(fields or dict.fromkeys([*SEARCH_FIELDS, *SIMILAR_FIELDS]))
    day = F.to_date("timestamp") if "timestamp" in logs.columns else F.lit(None).cast("date")

    def source(f: TextField) -> Column:
        """What the terms of a field are made of: a text, or a list of terms."""
        listed = f.stored in logs.columns or f.multi
        value = F.col(f.stored if f.stored in logs.columns else f.path)
        return F.struct(
            F.lit(f.path).alias("field"),
            (F.lit(None) if listed else value).cast("string").alias("text"),
            (value if listed else F.lit(None)).cast("array<string>").alias("list"),
        )

    # many records say the same: each text is analyzed once for a day, however often it occurs
    distinct = (
        logs.select(day.alias("log_date"), F.inline(F.array(*map(source, each))))
        .groupBy("log_date", "field", "text", "list").agg(F.count(F.lit(1)).alias("rows"))
    )
    terms = _distinct_terms(each, logs.columns)
    measured = distinct.select("log_date", "field", "rows", terms.alias("terms"))
    keyword = F.col("field").isin([f.path for f in each if f.keyword])
    known = F.coalesce(F.array_distinct(analysis.present(F.col("terms"))), F.array().cast("array<string>"))
    size = F.when(keyword, F.size("terms")).otherwise(F.size(analysis.present(F.col("terms"))))
    length = F.when(F.col("terms").isNotNull(), size).otherwise(0).cast("bigint")

    def entry(term: Column, length: Column) -> Column:
        return F.struct(term.alias("term"), length.alias("length"))

    entries = F.concat(
        F.transform(known, lambda t: entry(t, F.lit(None).cast("bigint"))),
        F.array(entry(F.lit(None).cast("string"), length)),
    )
    return (
        measured.select("log_date", "field", "rows", F.inline(entries))
        .groupBy(*STATISTICS)
        .agg(
            F.sum("rows").alias("df"),
            F.coalesce(F.sum(F.when(F.col("length") > 0, F.col("rows"))), F.lit(0)).alias("n"),
            F.sum(F.col("length") * F.col("rows")).alias("total"),
        )
    )


def _distinct_terms(fields: list[TextField], columns: list[str]) -> Column:
    """The terms of a row ``(field, text, list)``, by the rules of its field."""
    field, text, listed = F.col("field"), F.col("text"), F.col("list")
    terms = F.lit(None).cast("array<string>")
    for f in fields:
        if f.stored not in columns and (f.keyword or f.multi):
            own = F.array_distinct(listed) if f.multi else F.when(text.isNotNull(), F.array(text))
            terms = F.when(field == f.path, own).otherwise(terms)
    for stem in (True, False):
        paths = [f.path for f in fields if f.stored not in columns and not (f.keyword or f.multi) and f.stem == stem]
        if paths:
            # the stemmer sees null for the rows of other fields
            own = analysis.analyze(F.when(field.isin(paths), text), stem)
            terms = F.when(field.isin(paths), own).otherwise(terms)
    stored = [f.path for f in fields if f.stored in columns]
    return F.when(field.isin(stored), listed).otherwise(terms) if stored else terms


def merged(statistics: DataFrame) -> DataFrame:
    """Statistics of any number of loads as one, by day."""
    return statistics.groupBy(*STATISTICS).agg(
        F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def _of_field(statistics: DataFrame, f: TextField) -> DataFrame:
    return statistics.where(F.col("field") == f.path)


def _exact_weights(
    df: DataFrame, f: TextField, words: list[str], statistics: DataFrame | None = None
) -> DataFrame:
    """One row: average length and the weight of each query term."""
    if statistics is not None:
        counted = (
            _of_field(statistics, f)
            .where(F.col("term").isNull() | F.col("term").isin(words))
            .agg(
                F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("n"),
                F.sum("total").alias("total"),
                *[
                    F.coalesce(F.sum(F.when(F.col("term") == w, F.col("df"))), F.lit(0)).alias(f"df{i}")
                    for i, w in enumerate(words)
                ],
            )
        )
        return _weighed(counted, words)
    terms = df.select(_terms(df, f).alias("terms"))
    length = _length(F.col("terms"), f)
    counted = terms.agg(
        F.count_if(length > 0).alias("n"),
        F.sum(length).alias("total"),
        *[
            F.count_if(F.array_contains("terms", w)).alias(f"df{i}")
            for i, w in enumerate(words)
        ],
    )
    return _weighed(counted, words)


def _weighed(counted: DataFrame, words: list[str]) -> DataFrame:
    hits = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                F.lit(w).alias("term"),
                idf(F.col("n"), F.col(f"df{i}")).alias("weight"),
            )
            for i, w in enumerate(words)
        ]
    )
    return counted.select(
        F.struct(_average().alias("average"), hits.alias("hits")).alias("s")
    )


def _reach(words: list[str]) -> Callable[[Column], Column]:
    """Whether a term is near enough in length to one of the words."""
    spans = [(len(w) - allowed_edits(w), len(w) + allowed_edits(w)) for w in words]
    return lambda t: reduce(Column.__or__, [F.length(t).between(a, b) for a, b in spans])


def _boost(edits: Column, term: Column, word: str) -> Column:
    """1 for the word itself, less for each edit; null beyond the allowed ones."""
    return 1.0 - edits / F.least(F.length(term), F.lit(len(word)))


def _vocabulary(
    df: DataFrame, f: TextField, words: list[str], statistics: DataFrame | None = None
) -> DataFrame:
    """The words of a fitting length with their number of rows, and the edits to each query word.

    The row without a term carries the number of rows and their total length.
    Counted by a partial and a final aggregate.
    """
    if statistics is not None:
        counted = (
            _of_field(statistics, f)
            .where(F.col("term").isNull() | _reach(words)(F.col("term")))
            .groupBy("term")
            .agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("total").alias("total"))
        )
        return _with_edits(counted, words)
    fitting = F.filter(F.array_distinct("terms"), _reach(words))
    # the length is worked out below the unfolding, once per row
    texts = df.select(_terms(df, f).alias("terms"))
    measured = texts.select("terms", _length(F.col("terms"), f).alias("length"))
    rows = measured.select(
        "length",
        F.explode(
            F.concat(F.coalesce(fitting, F.array().cast("array<string>")), F.array(F.lit(None)))
        ).alias("term"),
    )
    total = F.when(F.col("term").isNull(), F.col("length"))
    counted = rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.count_if(total > 0).alias("n"),
        F.sum(total).alias("total"),
    )
    return _with_edits(counted, words)


def _with_edits(counted: DataFrame, words: list[str]) -> DataFrame:
    """One column of edits per query word, so that each is worked out once."""
    return counted.select(
        "*",
        *[
            edit_distance(F.col("term"), w, allowed_edits(w)).alias(f"edits{i}")
            for i, w in enumerate(words)
        ],
    )


def expansions(df: DataFrame, f: TextField, words: list[str]) -> DataFrame:
    """The whole vocabulary within the allowed edits of each query word.

    ``(q, term, edits, boost, df, rank)``, the closest terms first. Searches do
    not need this list; it shows what a query word stands for.
    """
    per_word = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                F.col(f"edits{i}").alias("edits"),
                _boost(F.col(f"edits{i}"), F.col("term"), w).alias("boost"),
            )
            for i, w in enumerate(words)
        ]
    )
    found = (
        _vocabulary(df, f, words)
        .where(F.col("term").isNotNull())
        .select("term", "df", F.inline(F.filter(per_word, lambda x: x["boost"] > 0)))
    )
    order = W.partitionBy("q").orderBy(F.col("boost").desc(), F.col("term").asc())
    return found.withColumn("rank", F.row_number().over(order))


def _fuzzy_weights(
    df: DataFrame, f: TextField, words: list[str], statistics: DataFrame | None = None
) -> DataFrame:
    """One row: average length and the weight of each query word.

    All expansions of a word share the largest document count among them, so that a
    rare misspelling does not outweigh the word itself.
    """
    near = [
        F.max(F.when(_boost(F.col(f"edits{i}"), F.col("term"), w) > 0, F.col("df")))
        for i, w in enumerate(words)
    ]
    one = _vocabulary(df, f, words, statistics).agg(
        F.max("n").alias("n"),
        F.max("total").alias("total"),
        *[most.alias(f"df{i}") for i, most in enumerate(near)],
    )
    weights = F.array(*[idf(F.col("n"), F.col(f"df{i}")) for i in range(len(words))])
    return one.select(F.struct(_average().alias("average"), weights.alias("weights")).alias("s"))


def _fuzzy_hits(i: int, words: list[str]) -> Column:
    """The row's own terms within the allowed edits of the query words, with their weights."""

    def near(t: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    t.alias("term"),
                    (
                        _boost(edit_distance(t, w, allowed_edits(w)), t, w)
                        * F.col(f"__s{i}.weights")[q]
                    ).alias("weight"),
                )
                for q, w in enumerate(words)
            ]
        )

    # edits are worked out for the few terms that pass the cheap tests
    fitting = F.filter(
        F.array_distinct(F.col(f"__t{i}")),
        lambda t: reduce(Column.__or__, [may_be_near(t, w, allowed_edits(w)) for w in words]),
    )
    return F.filter(F.flatten(F.transform(fitting, near)), lambda h: h["weight"] > 0)


# -- scoring -------------------------------------------------------------------
#
# A row is scored in an array of no or one element: what is worked out in one
# step is bound to the lambda variable of the next, so nothing is computed twice,
# and unfolding the array drops the rows that do not match. (A plain filter on
# the score would be pushed below the projection, together with a second copy of
# the whole analysis.)


def _drop_scratch(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _nothing(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False)).withColumn("score", F.lit(None).cast("double"))


def _prepare(df: DataFrame, fields: list[TextField], weights: list[DataFrame]) -> DataFrame:
    """Add the terms ``__t<i>`` and the table's weights ``__s<i>`` of each field."""
    for i, (f, w) in enumerate(zip(fields, weights)):
        df = df.withColumn(f"__t{i}", _terms(df, f)).withColumn(f"__s{i}", w.scalar())
    return df


def _known(i: int) -> Column:
    """The weighted terms that the row has in field ``i``."""
    return F.array_intersect(
        F.col(f"__t{i}"), F.transform(F.col(f"__s{i}.hits"), lambda h: h["term"])
    ).alias(f"known{i}")


def _evidence(fields: list[TextField], own_hits: bool = False) -> Callable[[Column], Column]:
    """Step from the known terms to their occurrences, weights and length norm.

    With ``own_hits`` the weighted terms were found on the row itself.
    """

    def step(x: Column) -> Column:
        out = []
        for i, f in enumerate(fields):
            terms = F.col(f"__t{i}")
            if own_hits:
                hits = x[f"hits{i}"]
                known = F.array_distinct(F.transform(hits, lambda h: h["term"]))
            else:
                known = x[f"known{i}"]
                hits = _weights_of(F.col(f"__s{i}.hits"), known)
            length = F.lit(1) if f.keyword else _length(terms, f)
            out += [
                known.alias(f"known{i}"),
                _among(terms, known).alias(f"found{i}"),
                hits.alias(f"hits{i}"),
                length_norm(length.cast("double"), F.col(f"__s{i}.average")).alias(f"norm{i}"),
            ]
        return F.struct(*out)

    return step


def _among(terms: Column, known: Column) -> Column:
    return F.filter(terms, lambda t: F.array_contains(known, t))


def _weights_of(hits: Column, known: Column) -> Column:
    return F.filter(hits, lambda h: F.array_contains(known, h["term"]))


def _field_score(x: Column, i: int, f: TextField) -> Column:
    """Score of one field; null where the row has none of the terms."""
    total = weighted_sum(x[f"found{i}"], x[f"hits{i}"], x[f"norm{i}"], f.keyword)
    return F.when(F.size(x[f"known{i}"]) > 0, total)


def match(
    df: DataFrame,
    query: str,
    f: TextField = MESSAGE,
    operator: str = "and",
    scope: DataFrame | None = None,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Rows with all (or any) of the query's terms, with a ``score`` column.

    ``scope`` is the table that term statistics are taken from, ``df`` itself by
    default; filters narrow ``df`` without changing the scores. Written
    ``statistics`` of that table spare the scan for them.
    """
    words = sorted({t for _, t in _query_terms(df, f, query)})
    if not words:
        return _nothing(df)
    weights = _exact_weights(df if scope is None else scope, f, words, statistics)
    tests = [_may_contain(f, w) for w in words]
    combine = Column.__and__ if operator == "and" else Column.__or__
    rows = _prepare(df.where(reduce(combine, tests)), [f], [weights])
    need = len(words) if operator == "and" else 1
    step = F.array(F.struct(_known(0)))
    step = F.filter(step, lambda x: F.size(x["known0"]) >= need)
    step = F.transform(step, _evidence([f]))
    step = F.transform(step, lambda x: F.struct(_field_score(x, 0, f).alias("score")))
    return _drop_scratch(rows.select("*", F.inline(step)))


def match_phrase(
    df: DataFrame,
    query: str,
    slop: int = 0,
    f: TextField = MESSAGE,
    scope: DataFrame | None = None,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Rows whose words stand as in the query, up to ``slop`` moves apart."""
    slots = _query_terms(df, f, query)
    if not slots:
        return _nothing(df)
    words = sorted({t for _, t in slots})
    weights = _exact_weights(df if scope is None else scope, f, words, statistics)
    tests = reduce(Column.__and__, [_may_contain(f, w) for w in words])
    rows = _prepare(df.where(tests), [f], [weights])
    # each place in the query adds the weight of its word
    places = {w: sum(t == w for _, t in slots) for w in words}
    weight = reduce(
        Column.__add__,
        [F.col("__s0.hits")[i]["weight"] * places[w] for i, w in enumerate(words)],
    )
    norm = length_norm(_length(F.col("__t0"), f).cast("double"), F.col("__s0.average"))
    step = F.array(phrase_frequency(F.col("__t0"), slots, slop))
    step = F.filter(step, lambda x: x > 0)
    step = F.transform(step, lambda x: F.struct((weight * saturation(x, norm)).alias("score")))
    return _drop_scratch(rows.select("*", F.inline(step)))


def multi_match(
    df: DataFrame,
    query: str,
    fields: list[TextField] = SEARCH_FIELDS,
    scope: DataFrame | None = None,
    keep_terms: bool = False,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Typo-tolerant search: any query word in any field, best field counts.

    With ``keep_terms`` a column ``<field>_matched`` per text field lists the
    terms that matched, for highlighting.
    """
    base = df if scope is None else scope
    used, weights, wanted = [], [], []
    asked: dict[bool, list[str]] = {}
    for f in fields:
        if f.keyword:
            words = [query]
        else:
            # text fields share one analysis of the query
            if f.stem not in asked:
                asked[f.stem] = sorted({t for _, t in _query_terms(df, f, query)})
            words = asked[f.stem]
        if words:
            used.append(f)
            wanted.append(words)
            weights.append(_fuzzy_weights(base, f, words, statistics))
    if not used:
        return _nothing(df)
    rows = _prepare(df, used, weights)

    def scored(x: Column) -> Column:
        parts = [_field_score(x, i, f) for i, f in enumerate(used)]
        out = [(F.greatest(*parts) if len(parts) > 1 else parts[0]).alias("score")]
        if keep_terms:
            out += [
                x[f"known{i}"].alias(f.path.replace(".", "_") + "_matched")
                for i, f in enumerate(used)
                if not f.keyword
            ]
        return F.struct(*out)

    step = F.array(F.struct(*[_fuzzy_hits(i, w).alias(f"hits{i}") for i, w in enumerate(wanted)]))
    step = F.filter(
        step,
        lambda x: reduce(
            Column.__or__,
            [F.coalesce(F.size(x[f"hits{i}"]) > 0, F.lit(False)) for i in range(len(used))],
        ),
    )
    step = F.transform(step, _evidence(used, own_hits=True))
    return _drop_scratch(rows.select("*", F.inline(F.transform(step, scored))))


def by_score(time: str | None = "timestamp", key: str = "id") -> list[Column]:
    """Best first, then newest first, then by id."""
    order = [F.col("score").desc()]
    if time:
        order.append(F.col(time).desc_nulls_last())
    return order + [F.col(key).asc()]


def with_highlight(
    hits: DataFrame, matched: dict[str, Column], stem: bool = True, name: str = "highlight"
) -> DataFrame:
    """Add a struct with the marked text of each field; meant for a page of hits."""
    for i, (path, terms) in enumerate(matched.items()):
        hits = hits.withColumn(f"__h{i}", analysis.highlight(path, terms, stem))
    # a field without a matching word has no highlight
    marked = [
        F.when(F.contains(F.col(f"__h{i}"), F.lit("<em>")), F.col(f"__h{i}")).alias(
            p.replace(".", "_")
        )
        for i, p in enumerate(matched)
    ]
    return _drop_scratch(hits.withColumn(name, F.struct(*marked)))


def query_highlight(hits: DataFrame, query: str, f: TextField = MESSAGE) -> DataFrame:
    """Highlight for queries that match their own terms only."""
    words = [t for _, t in _query_terms(hits, f, query)]
    terms = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    return with_highlight(hits, {f.path: terms}, f.stem)


# -- more like this --------------------------------------------------------------


def _shared_terms(shared: Column, i: int) -> Column:
    return F.transform(
        F.coalesce(shared, F.array().cast("array<string>")),
        lambda t: F.struct(
            F.lit(i).alias("field"),
            t.alias("term"),
            F.lit(0).alias("length"),
            frequency(F.col(f"like.t{i}"), t).alias("tf"),
        ),
    )


def similar_terms(
    df: DataFrame,
    like_id: Column | str,
    fields: list[TextField] = SIMILAR_FIELDS,
    key: str = "id",
    newest: str | None = "timestamp",
    max_query_terms: int = MAX_QUERY_TERMS,
    min_doc_freq: int = MIN_DOC_FREQ,
    min_term_freq: int = 1,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """The terms that tell most about one record: ``(field, term, tf, df, rank, …)``.

    ``field`` is an index into ``fields``. Rows without a term carry the counts
    of the whole table, one per field. The record is looked up first; of several
    with its id the newest stands for them. Every other row contributes only the
    terms it shares with that record.
    """
    order = [F.col(newest).desc_nulls_last()] if newest else []
    cols = [_terms(df, f).alias(f"t{i}") for i, f in enumerate(fields)]
    like = (
        df.where(F.col(key) == like_id)
        .orderBy(*order, F.col(key))
        .limit(1)
        .select(*cols)
        .select(F.struct(*[F.col(f"t{i}") for i in range(len(fields))]).alias("like"))
    )
    if statistics is not None:
        return _told(
            _counted_by_statistics(like, fields, statistics), max_query_terms, min_doc_freq, min_term_freq
        )
    corpus = df.select(*cols).withColumn("like", like.scalar())
    entries = []
    for i, f in enumerate(fields):
        shared = F.array_intersect(
            analysis.present(F.col(f"t{i}")), F.col(f"like.t{i}")
        )
        length = _length(F.col(f"t{i}"), f)
        own = _shared_terms(shared, i)
        whole = F.array(
            F.struct(
                F.lit(i).alias("field"),
                F.lit(None).cast("string").alias("term"),
                length.alias("length"),
                F.lit(0).alias("tf"),
            )
        )
        entries.append(F.concat(own, whole))
    counted = (
        corpus.where(F.col("like").isNotNull())
        .select(F.inline(F.concat(*entries) if len(entries) > 1 else entries[0]))
        .groupBy("field", "term")
        .agg(
            F.max("tf").alias("tf"),
            F.count(F.lit(1)).alias("df"),
            F.count_if(F.col("length") > 0).alias("n"),
            F.sum("length").alias("total"),
        )
    )
    return _told(counted, max_query_terms, min_doc_freq, min_term_freq)


def _counted_by_statistics(
    like: DataFrame, fields: list[TextField], statistics: DataFrame
) -> DataFrame:
    """The record's own terms, and the row without a term of each field, with their counts."""
    names = F.array(*[F.lit(f.path) for f in fields])
    own = []
    for i in range(len(fields)):
        terms = F.coalesce(analysis.present(F.col(f"like.t{i}")), F.array().cast("array<string>"))
        own.append(_shared_terms(F.array_distinct(terms), i))
    # one record's terms
    mine = like.select(F.inline(F.concat(*own) if len(own) > 1 else own[0])).select(
        F.element_at(names, F.col("field") + 1).alias("field"), "term", "tf"
    )
    found = statistics.join(F.broadcast(mine), ["field", "term"]).select(
        "field", "term", "tf", "df", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("total")
    )
    whole = statistics.where(F.col("term").isNull() & F.col("field").isin([f.path for f in fields])).select(
        "field", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), "df", "n", "total"
    )
    place = F.array_position(names, F.col("field")).cast("int") - 1
    return (
        found.unionByName(whole)
        .groupBy(place.alias("field"), "term")
        .agg(
            F.max("tf").alias("tf"),
            F.sum("df").alias("df"),
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
        )
    )


def _told(
    counted: DataFrame, max_query_terms: int, min_doc_freq: int, min_term_freq: int
) -> DataFrame:
    whole = F.col("term").isNull()
    rows = F.max(F.when(whole, F.col("df"))).over(W.partitionBy())
    per_field = W.partitionBy("field")
    told = counted.select(
        "field",
        "term",
        "tf",
        "df",
        rows.alias("rows"),
        F.max("n").over(per_field).alias("n"),
        F.max("total").over(per_field).alias("total"),
    ).where(~whole & (F.col("df") >= min_doc_freq) & (F.col("tf") >= min_term_freq))
    value = F.col("tf") * (1.0 + F.log((F.col("rows") + 1.0) / (F.col("df") + 1.0)))
    best = told.withColumn("value", value)
    return (
        best.orderBy(F.col("value").desc(), F.col("field").asc(), F.col("term").asc())
        .limit(max_query_terms)
        .withColumn("weight", idf(F.col("n"), F.col("df")))
        .withColumn("average", F.col("total") / F.col("n"))
    )


def more_like_this(
    df: DataFrame,
    like_id: Column | str,
    fields: list[TextField] = SIMILAR_FIELDS,
    key: str = "id",
    newest: str | None = "timestamp",
    max_query_terms: int = MAX_QUERY_TERMS,
    min_doc_freq: int = MIN_DOC_FREQ,
    min_term_freq: int = 1,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Records that share enough of one record's telling terms, with ``score``.

    At least 30 % of the chosen terms must occur; the record itself is left out.
    """
    chosen = similar_terms(
        df, like_id, fields, key, newest, max_query_terms, min_doc_freq, min_term_freq, statistics
    )
    # at most max_query_terms rows are gathered here
    one = chosen.agg(
        F.struct(
            F.count(F.lit(1)).alias("size"),
            *[
                F.struct(
                    F.max(F.when(F.col("field") == i, F.col("average"))).alias("average"),
                    F.collect_list(
                        F.when(F.col("field") == i, F.struct("term", "weight"))
                    ).alias("hits"),
                ).alias(f"f{i}")
                for i in range(len(fields))
            ],
        ).alias("s")
    )
    rows = df.where(F.col(key) != like_id).withColumn("__s", one.scalar())
    for i, f in enumerate(fields):
        rows = rows.withColumn(f"__t{i}", _terms(df, f)).withColumn(f"__s{i}", F.col(f"__s.f{i}"))
    need = F.greatest(F.lit(1), F.floor(F.col("__s.size") * MIN_SHOULD_MATCH).cast("int"))

    def shared(x: Column) -> Column:
        sizes = [
            F.when(x[f"known{i}"].isNotNull(), F.size(x[f"known{i}"])).otherwise(0)
            for i in range(len(fields))
        ]
        return reduce(Column.__add__, sizes)

    def scored(x: Column) -> Column:
        parts = [
            F.coalesce(_field_score(x, i, f), F.lit(0.0)) for i, f in enumerate(fields)
        ]
        return F.struct(reduce(Column.__add__, parts).alias("score"))

    step = F.array(F.struct(*[_known(i) for i in range(len(fields))]))
    step = F.filter(step, lambda x: shared(x) >= need)
    step = F.transform(step, _evidence(fields))
    return _drop_scratch(rows.select("*", F.inline(F.transform(step, scored))))
