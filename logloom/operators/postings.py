"""Full-text search over a table of postings, written with each load.

A posting says where a term stands in one field of one record: ``(field, term,
log_date, id, timestamp, row, positions, length)``. The table is partitioned by a hash
of the term and sorted by it, so a query reads the buckets of its own terms and
skips the row groups of others; the records themselves are read only for the
hits that are shown. ``row`` is a hash of the record's content: records that share
an id stay apart, and a record that was stored twice is found twice.

For searches that forgive typing errors, the words of the vocabulary stand in a
second table under all that is left of them when up to two letters are taken
away. Words within ``k`` edits of each other, an exchange of neighbours counted as
one, share what is left after ``k`` letters are taken from each, so looking up the
few remains of a query word finds every candidate; edit distances are worked out for these alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions.fuzzy import allowed_edits, edit_distance
from ..functions.scoring import length_norm, phrase_frequency_of, saturation
from . import search
from .search import SEARCH_FIELDS, SIMILAR_FIELDS, TextField

FIELDS = list(dict.fromkeys([*SEARCH_FIELDS, *SIMILAR_FIELDS, search.TAGS]))

#: Folders by hash of the term; parts that a bucket is written in, so that a term in every record is no single task.
BUCKETS, SLICES = 64, 4
#: Letters up to which a word stands under its remains; longer words stand under their length.
LONGEST = 24
#: Query terms that are named in the filters; beyond it the join alone selects them.
MAX_NAMED = 5_000

#: What identifies a record among the postings.
ROW = ["id", "log_date", "timestamp", "row"]


def bucket_of(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def buckets_of(terms: list[str]) -> list[int]:
    """The folders of some terms, without a job."""
    return sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})


def row_hash(fields: list[TextField] = FIELDS) -> Column:
    """What tells records apart that have their id and time in common."""
    return F.xxhash64("id", "timestamp", *(F.to_json(F.struct(F.col(f.path))) for f in fields))


# -- writing ---------------------------------------------------------------------------


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(terms: Column) -> Column:
    """Each term of a list once, as structs of (term, positions).

    A list that repeats a term is sorted and cut where the term changes, so the work follows its length.
    """

    def entry(term: Column, positions: Column) -> Column:
        return F.struct(term.alias("term"), positions.alias("positions"))

    def cut(words: Column, starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            own = F.slice(words, start + 1, F.coalesce(F.get(starts, k + 1), F.size(words)) - start)
            return entry(F.get(words, start)["term"], own["position"])

        return F.transform(starts, one)

    def starts_of(words: Column) -> Column:
        changes = F.transform(
            words, lambda w, i: F.when((i == 0) | ~w["term"].eqNullSafe(F.get(words, i - 1)["term"]), i)
        )
        return F.filter(changes, lambda i: i.isNotNull())

    words = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("position"))))
    gathered = _bound(words, lambda w: _bound(starts_of(w), lambda starts: cut(w, starts)))
    repeats = F.size(F.array_distinct(terms)) < F.size(terms)
    return F.when(repeats, gathered).otherwise(F.transform(terms, lambda t, i: entry(t, F.array(i))))


def postings(logs: DataFrame, fields: list[TextField] = FIELDS) -> DataFrame:
    """All postings of the records, with their ``bucket``.

    The words of a record are gathered by term where the record is; the one shuffle deals the
    postings out by bucket and a part of the record's hash. A record that a load has twice
    has its postings twice, as one that two loads have; readers count them once.
    """
    entries = []
    for f in fields:
        terms = search._terms(logs, f)
        entries.append(
            F.struct(F.lit(f.path).alias("field"), terms.alias("terms"), search._length(terms, f).cast("int").alias("length"))
        )
    day = F.to_date("timestamp").alias("log_date")
    unfolded = logs.select("id", day, "timestamp", row_hash(fields).alias("row"), F.inline(F.array(*entries)))
    gathered = unfolded.select(*ROW, "field", "length", F.inline(_placed(F.col("terms")))).where(F.col("term").isNotNull())
    bucket = bucket_of(F.col("term"))
    return (
        gathered.select("field", "term", *ROW, "positions", "length", bucket.alias("bucket"))
        .repartition("bucket", F.pmod("row", F.lit(SLICES)).cast("int"))
    )


def _remains(word: Column, letters: int) -> Column:
    """What is left of a word when so many letters are taken away, as structs of (variant, deleted)."""

    def fewer(w: Column) -> Column:
        n = F.length(w)
        cut = F.transform(
            F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, n))
        )
        return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))

    levels = [F.array(word)]
    for _ in range(letters):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], fewer))))
    return F.concat(
        *[F.transform(level, lambda v: F.struct(v.alias("variant"), F.lit(k).alias("deleted"))) for k, level in enumerate(levels)]
    )


def _by_length(length: Column) -> Column:
    return F.concat(F.lit("\u0000"), length.cast("string"))


def variants(statistics: DataFrame) -> DataFrame:
    """``(field, variant, deleted, term, bucket)`` for every word of written term statistics."""
    words = statistics.where(F.col("term").isNotNull()).select("field", "term").distinct()
    n = F.length("term")
    short = words.where(n <= LONGEST).select("field", "term", F.inline(_remains(F.col("term"), 2)))
    long = words.where(n > LONGEST).select("field", "term", _by_length(n).alias("variant"), F.lit(0).alias("deleted"))
    both = short.unionByName(long)
    return both.select("field", "variant", "deleted", "term", bucket_of(F.col("variant")).alias("bucket"))


def write(logs: DataFrame, path: str, fields: list[TextField] = FIELDS, batch_id: int | None = None) -> None:
    """Append the postings of a load, its term statistics and its vocabulary's remains below ``path``."""

    # a load has a folder of its own; as a column of one value the batch would make the writer sort anew, by folder only
    load = "" if batch_id is None else f"/batch={batch_id}"

    def save(df: DataFrame, name: str, order: list[str]) -> None:
        by = ["bucket"] if "bucket" in df.columns else []
        (
            df.sortWithinPartitions(*by, *order).write.mode("append").option("compression", "zstd")
            .partitionBy(*by).parquet(f"{path}/{name}{load}")
        )

    save(postings(logs, fields), "postings", ["field", "term", "log_date"])
    statistics = search.term_statistics(logs, fields)
    save(statistics, "statistics", ["field", "term"])
    if load:
        # the load's own, as just written, not counted once more
        statistics = logs.sparkSession.read.schema(statistics.schema).parquet(f"{path}/statistics{load}")
    save(variants(statistics).repartition("bucket"), "variants", ["field", "variant"])


@dataclass(frozen=True)
class Index:
    """The written tables of an index."""

    postings: DataFrame
    statistics: DataFrame
    variants: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "statistics", "variants")))


# -- reading ---------------------------------------------------------------------------


def _named(df: DataFrame, column: str, values: dict[str, list[str]]) -> DataFrame:
    """The rows of some terms of each field: their buckets only, and of these the row groups that can hold them."""
    every = [v for own in values.values() for v in own]
    asked = [(F.col("field") == field) & F.col(column).isin(own) for field, own in values.items()]
    return df.where(F.col("bucket").isin(buckets_of(every)) & F.col(column).isin(every) & reduce(Column.__or__, asked))


def _scored(found: DataFrame, fields: list[TextField], need: int) -> DataFrame:
    """Records with at least ``need`` of the weighted terms in a field, and the score of their best field.

    ``found`` has the postings with ``weight`` and ``average``. What is gathered for a record is bounded by the
    terms of the query, and what two loads of one record have alike counts once.
    """
    keyword = F.col("field").isin([f.path for f in fields if f.keyword])
    length = F.when(keyword, 1).otherwise(F.col("length"))
    tf = F.when(keyword, 1.0).otherwise(F.size("positions").cast("double"))
    part = F.struct("term", (F.col("weight") * saturation(tf, length_norm(length.cast("double"), F.col("average")))).alias("score"))
    total = F.aggregate(F.array_sort("parts"), F.lit(0.0), lambda sum_, x: sum_ + x["score"])
    return (
        found.groupBy(*ROW, "field")
        .agg(F.collect_set(part).alias("parts"))
        .where(F.size("parts") >= need)
        .select(*ROW, total.alias("score"))
        .groupBy(*ROW)
        .agg(F.max("score").alias("score"))
    )


def _nothing(index: Index) -> DataFrame:
    return index.postings.select(*ROW, F.lit(None).cast("double").alias("score")).where(F.lit(False))


def _weights(index: Index, f: TextField, words: list[str]) -> DataFrame:
    """(field, term, weight, average) of the query's own terms."""
    one = search._exact_weights(index.postings, f, words, index.statistics)
    weighed = one.select(F.col("s.average").alias("average"), F.inline("s.hits"))
    return weighed.select(F.lit(f.path).alias("field"), "term", "weight", "average")


def _terms_of(index: Index, f: TextField, query: str) -> list[tuple[int, str]]:
    return [(0, query)] if f.keyword else analysis.query_terms(index.postings.sparkSession, query, f.stem)


def match(index: Index, query: str, f: TextField = search.MESSAGE, operator: str = "and") -> DataFrame:
    """``(id, log_date, timestamp, row, score)`` of the records with all (or any) of the query's terms."""
    words = sorted({t for _, t in _terms_of(index, f, query)})
    if not words:
        return _nothing(index)
    found = _named(index.postings, "term", {f.path: words}).join(_weights(index, f, words), ["field", "term"])
    return _scored(found, [f], len(words) if operator == "and" else 1)


def match_phrase(index: Index, query: str, slop: int = 0, f: TextField = search.MESSAGE) -> DataFrame:
    """Records whose words stand as in the query, up to ``slop`` moves apart, by intersecting positions."""
    slots = _terms_of(index, f, query)
    if not slots:
        return _nothing(index)
    words = sorted({t for _, t in slots})
    places = F.create_map(*[F.lit(x) for w in words for x in (w, sum(t == w for _, t in slots))])
    found = _named(index.postings, "term", {f.path: words}).join(_weights(index, f, words), ["field", "term"])
    rows = found.groupBy(*ROW).agg(
        F.collect_set(F.struct("term", "positions")).alias("terms"),
        F.max("length").alias("length"),
        F.max("average").alias("average"),
        F.array_sort(F.collect_set(F.struct("term", "weight"))).alias("weights"),
    ).where(F.size("weights") == len(words))
    placed = F.flatten(F.transform("terms", lambda x: F.transform(
        x["positions"], lambda i: F.struct(x["term"].alias("t"), i.alias("i")))))
    rows = rows.select(*ROW, "length", "average", "weights", phrase_frequency_of(placed, slots, slop).alias("freq"))
    weight = F.aggregate("weights", F.lit(0.0), lambda total, x: total + x["weight"] * F.element_at(places, x["term"]))
    norm = length_norm(F.col("length").cast("double"), F.col("average"))
    return rows.where(F.col("freq") > 0).select(*ROW, (weight * saturation(F.col("freq"), norm)).alias("score"))


def remains_of(word: str, letters: int) -> list[str]:
    """What is left of a query word when up to so many letters are taken away."""
    out = set()
    for k in range(min(letters, len(word)) + 1):
        for gone in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return sorted(out)


def expansions(index: Index, f: TextField, words: list[str]) -> DataFrame:
    """``(q, term, edits, boost)``: the vocabulary's words within the allowed edits of each query word."""
    near = None
    for q, word in enumerate(words):
        k = allowed_edits(word)
        keys = remains_of(word, k) if len(word) <= LONGEST + k else []
        keys += [f"\u0000{n}" for n in range(max(LONGEST + 1, len(word) - k), len(word) + k + 1)]
        met = _named(index.variants, "variant", {f.path: keys}).where(F.col("deleted") <= k)
        edits = edit_distance(F.col("term"), word, k)
        one = (
            met.select("term").distinct().select(F.lit(q).alias("q"), "term", edits.alias("edits"))
            .where(F.col("edits").isNotNull())
            .withColumn("boost", search._boost(F.col("edits"), F.col("term"), word))
            .where(F.col("boost") > 0)
        )
        near = one if near is None else near.unionByName(one)
    return near


def _near_weights(index: Index, f: TextField, words: list[str]) -> DataFrame:
    """(field, term, weight, average): the terms near the query's words; those of a word share the largest document count among them."""
    near = expansions(index, f, words)
    own = index.statistics.where(F.col("field") == f.path)
    counted = (
        own.where(F.col("term").isNotNull()).join(near, "term")
        .groupBy("q", "term", "boost").agg(F.sum("df").alias("df"))
    )
    whole = own.where(F.col("term").isNull()).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    most = counted.groupBy("q").agg(F.max("df").alias("most"))
    weighed = (
        counted.join(most, "q")
        .withColumn("whole", whole.select(F.struct("n", search._average().alias("average")).alias("s")).scalar())
        .withColumn("weight", F.col("boost") * search.idf(F.col("whole.n"), F.col("most")))
    )
    by_term = weighed.groupBy("term").agg(F.sum("weight").alias("weight"), F.max("whole.average").alias("average"))
    return by_term.select(F.lit(f.path).alias("field"), "term", "weight", "average")


def multi_match(index: Index, query: str, fields: list[TextField] = SEARCH_FIELDS) -> DataFrame:
    """Typo-tolerant search: any query word in any field, the best field counts."""
    weights, asked = None, {}
    for f in fields:
        if f.stem not in asked and not f.keyword:
            asked[f.stem] = sorted({t for _, t in _terms_of(index, f, query)})
        words = [query] if f.keyword else asked[f.stem]
        if words:
            own = _near_weights(index, f, words)
            weights = own if weights is None else weights.unionByName(own)
    if weights is None:
        return _nothing(index)
    # what is near a few words is a small part of the vocabulary; it is brought here to name the buckets
    known = weights.limit(MAX_NAMED + 1).collect()
    if not known:
        return _nothing(index)
    found = index.postings
    if len(known) <= MAX_NAMED:
        weights = found.sparkSession.createDataFrame(known, weights.schema)
        found = _named(found, "term", {f.path: [r["term"] for r in known if r["field"] == f.path] for f in fields})
    return _scored(found.join(weights, ["field", "term"]), fields, 1)


def page(hits: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """The hits of a page, best first, then newest, then by id; needs no record."""
    return hits.orderBy(*search.by_score()).offset(offset).limit(limit)


def rows_of(table: DataFrame, hits: DataFrame, fields: list[TextField] = FIELDS, named: bool = False) -> DataFrame:
    """The records of the hits, with ``score``.

    With ``named`` the hits are a page: their ids are named in the filter, so that only files whose Bloom filter
    knows one of them are read, and only in their days.
    """
    keys = hits.select(F.col("row").alias("__row"), F.col("log_date").alias("__day"), "score")
    if named:
        few = hits.select("id", "log_date", "timestamp", "row", "score").collect()
        spark = table.sparkSession
        hits = spark.createDataFrame(few, hits.select(*ROW, "score").schema)
        keys = hits.select(F.col("row").alias("__row"), F.col("log_date").alias("__day"), "score")
        ids, days = {r["id"] for r in few} - {None}, {r["log_date"] for r in few} - {None}
        table = table.where(F.col("id").isin(sorted(ids)) | F.col("id").isNull())
        if "log_date" in table.columns:
            table = table.where(F.col("log_date").isin(sorted(days)) | F.col("log_date").isNull())
    day = F.to_date("timestamp")
    # the day is part of the hash's record; joined on both, a sorted table is read by day
    return (
        table.withColumn("__of", row_hash(fields))
        .join(keys, (F.col("__of") == F.col("__row")) & day.eqNullSafe(F.col("__day")))
        .drop("__of", "__row", "__day")
    )
