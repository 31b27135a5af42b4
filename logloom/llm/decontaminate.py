"""Benchmark contamination by a prefix-filtered set join, in DataFrame operations only.

A window (13 consecutive words of an item, or a whole shorter item) can occur in
a document only where its rarest word occurs. So each window is indexed by that
one word, its necessary prefix under the order by rarity in the corpus, and by the
word's place in the window:

1. count, over all documents, the words that the benchmark uses;
2. keep for each window its rarest word; a window with a word that no document
   has is dropped, it cannot occur; windows of an item that share the place of their
   rarest word are one entry;
3. unfold the documents' words, join those that are prefixes, look at the words beside
   them, test by position and length that a window fits, and compare the words of the
   item-sized window;
4. per document, add up the words covered by the windows found.

The windows are the query set: they are counted and broadcast in blocks of
bounded size, each of which meets all documents. Only hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, pick, rest, small, stored

WINDOW = 13
#: Entries, of at most a window's length of windows each, that are broadcast at a time.
BLOCK = 20_000
#: Contaminated from one covered word in so many.
SHARE = 20

#: What separates words: ASCII characters that are no letters or digits.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


def pieces(text: Column) -> Column:
    """The words of a text in order, in their own case; the first and the last piece may be empty, which no word is."""
    return F.split(F.coalesce(text, F.lit("")), _SEPARATORS)


def split_words(text: Column) -> Column:
    """The words of a text in order, in their own case; none for a null or empty one."""
    parts = pieces(text)
    first = (F.element_at(parts, 1) == "").cast("int")
    last = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def _windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, start, win): the windows of each item, in lower case. Rows with equal id and text count once."""
    rows = items.select(
        F.coalesce(col(item_id).cast("string"), F.lit("")).alias("item"), split_words(ascii_lower(col(text))).alias("w")
    ).where(F.size("w") > 0).distinct()
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))))
    return rows.select("item", "w", starts.alias("start")).select(
        "item", F.sha2(F.array_join("w", " "), 256).alias("body"), "start",
        F.slice("w", F.col("start") + 1, F.least(F.size("w"), F.lit(size))).alias("win"))


# Words are joined by lower(), which also maps letters beyond ASCII. It maps words that are equal in the sense of the rule to
# equal words, so no occurrence is lost; the comparison that follows is exact.


def _prefixes(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, item, before, after, wins): each place of an item that is the rarest in windows that can occur.

    ``before`` and ``after`` are the words beside it in these windows, null if it is at the edge of all;
    ``wins`` has the words before the place, the length and the text of each window.
    """
    vocabulary = stored(windows.select(F.explode("win").alias("raw")).select(F.lower("raw").alias("word")).distinct(), "vocabulary")
    found = (
        texts.select(F.explode(pieces(F.col("text"))).alias("raw")).select(F.lower("raw").alias("word"))
        .join(small(vocabulary, vocabulary.count()), "word")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = (
        windows.select("item", "body", "start", "win", F.posexplode("win").alias("at", "raw"))
        .withColumn("word", F.lower("raw")).join(found, "word")
        .groupBy("item", "body", "start", "win")
        .agg(F.min(F.struct("n", "word", "at")).alias("first"), F.count(F.lit(1)).alias("present"))
        .where(F.col("present") == F.size("win"))
        .select("item", "body", "win", "first.word", F.col("first.at").alias("at"), (F.col("start") + F.col("first.at")).alias("place"))
    )
    # at most as many windows of an item have one place as a window has words
    return rarest.groupBy("item", "body", "place", "word").agg(
        F.max(F.when(F.col("at") > 0, F.lower(F.get("win", F.col("at") - 1)))).alias("before"),
        F.max(F.lower(F.get("win", F.col("at") + 1))).alias("after"),
        F.collect_list(F.struct("at", F.size("win").alias("len"), F.array_join("win", " ").alias("text"))).alias("wins"),
    ).select("word", "item", "before", "after", "wins")


def _hits(texts: DataFrame, block: DataFrame) -> DataFrame:
    """(doc, hash, start, len, item) of the windows of one broadcast block in all documents.

    A window of several words that holds a word holds one of its neighbours, so a place where neither
    neighbour agrees is left at once.
    """
    # an empty first piece moves all places alike
    places = texts.select("doc", "hash", pieces(F.col("text")).alias("w")).select(
        "doc", "hash", "w", F.posexplode("w").alias("pos", "raw")
    ).withColumn("word", F.lower("raw"))
    alone = F.col("before").isNull() & F.col("after").isNull()
    beside = (
        F.coalesce(F.lower(F.get("w", F.col("pos") - 1)) == F.col("before"), F.lit(False))
        | F.coalesce(F.lower(F.get("w", F.col("pos") + 1)) == F.col("after"), F.lit(False))
    )
    near = places.join(F.broadcast(block), "word").where(beside | alone)
    start = F.col("pos") - F.col("x.at")
    same = ascii_lower(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("x.len")), " ")) == F.col("x.text")
    return near.select("doc", "hash", "w", "pos", "item", F.explode("wins").alias("x")).where(
        (start >= 0) & (start + F.col("x.len") <= F.size("w")) & same
    ).select("doc", "hash", start.alias("start"), F.col("x.len").alias("len"), "item")


def find_hits(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """The places where windows of the benchmark occur: (doc, hash, start, len, item), ``hash`` being that of the text."""
    texts = pick(docs, doc=doc_id, text=text).where("text is not null").withColumn("hash", F.xxhash64("text"))
    windows = stored(_windows(benchmark, item_id, item_text, size), "windows")
    prefixes = stored(_prefixes(windows, texts), "prefixes")
    blocks = -(-prefixes.count() // block)
    part = F.pmod(F.xxhash64("word", "item", "wins"), F.lit(max(blocks, 1)))
    found = [_hits(texts, prefixes.where(part == b) if blocks > 1 else prefixes) for b in range(blocks)]
    if not found:
        return _hits(texts, prefixes).limit(0)
    return stored(reduce(DataFrame.unionByName, found), "hits")


def _summary(hits: DataFrame) -> DataFrame:
    """Per document text: covered words and the items."""
    w = Window.partitionBy("doc", "hash").orderBy("start", "len")
    before = F.max(F.col("start") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("len")
    gain = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    covered = (
        hits.select("doc", "hash", "start", "len").distinct().withColumn("gain", gain)
        .groupBy("doc", "hash").agg(F.sum("gain").alias("n_hit"))
    )
    items = hits.groupBy("doc", "hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = covered["doc"].eqNullSafe(items["doc"]) & (covered["hash"] == items["hash"])
    return covered.join(items, same).select(
        covered["doc"].alias("h_doc"), covered["hash"].alias("h_hash"), "n_hit", "items"
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block: int = BLOCK, share: int = SHARE,
) -> DataFrame:
    """Every document with ``n_words``, ``n_hit``, ``n_items``, ``items``, ``items_sha256`` and ``contaminated``.

    A word is hit if it lies in any occurrence of a window. A null or empty text
    has no words and is clean; so is every document if the benchmark is empty.
    Rows that agree in id and text have the same result, as have equal texts
    under different ids; equal items count by their ids. An item without an id counts as the
    item ``""``. The other columns of ``docs`` follow, but for those that clash with these names.
    """
    out = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    extra = rest(docs, [doc_id, *out])
    found = _summary(find_hits(docs, benchmark, doc_id, text, item_id, item_text, size, block))
    base = docs.select(
        col(doc_id).alias("_doc"), F.xxhash64(col(text)).alias("_hash"),
        pieces(col(text)).alias("_w"),
        *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    base = base.withColumn(
        "_words", (F.size("_w") - (F.element_at("_w", 1) == "").cast("int")
                   - ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")).cast("bigint")).drop("_w")
    joined = base.join(
        small(found, found.count()), base["_doc"].eqNullSafe(found["h_doc"]) & (base["_hash"] == found["h_hash"]), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("_doc").alias(doc_id), F.col("_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), items.alias("items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("_words"))).alias("contaminated"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )
