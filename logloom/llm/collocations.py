"""Phrase collocations, counted in counting quotient filters.

*Words.* The words of each language are counted first. A word's id is a 64-bit hash of language and word, checked to be different
for different words (else another seed is taken), so an n-gram is packed losslessly into as many 64-bit numbers as it has words.

*Counters.* A task permutes its packed n-grams invertibly. The first ``QUOTIENT`` bits of the result, the quotient, are stored as a
place only: one bit per place and one per entry say how many entries a place has. The full remainder is stored beside a counter
of one byte, wider ones apart. Sorted filters are merged by ranges of quotients, one range a group, with as many ranges as the
counted input asks for; a frequent phrase is one entry of each filter, whatever its number of occurrences.

*Levels.* All parts of a phrase are at least as frequent as the phrase, so pairs of frequent words are counted first, then n-grams of
three words whose pairs were frequent, then longer ones whose parts of three words were. That test looks into a bitmap of a size bounded by
``BITMAP``; where it errs, an n-gram is counted in vain, and dropped by its exact count.

Cuts, scores and the choice among nested phrases are joins of the tables of frequent n-grams.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import col, mix, small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Least occurrences, longest phrase, percent of a phrase's occurrences inside a longer one that drop it, phrases of a language.
LEAST, WORDS, INSIDE, TOP = 100, 5, 100, 2000
#: Bits of the quotient; n-grams that a task gathers before it makes a filter of them; input n-grams per range of quotients.
QUOTIENT, GATHER, RANGE = 20, 1 << 20, 500_000
#: Ranges that are merged in one task, about; it holds one at a time.
TOGETHER = 4
#: Bits of a bitmap of frequent n-grams, at most; different words a task remembers.
BITMAP, REMEMBER = 1 << 27, 400_000

_K = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << (64 - QUOTIENT)) - 1)
_REST = (64 - QUOTIENT + 7) // 8
#: What stands for the end of a piece: no byte of UTF-8.
_END = b"\xff"

# Fixed value: what ends a piece of text, and what separates words.
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", _END * 10 + b" abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in order, and a token of its own where a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(_END, b" \xff ").split()


def lang_seed(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


def word_id(word: bytes, seed: int) -> int:
    """A number from 1 to 2**64 - 1, with the seed of a language; 0 stands for no word."""
    return xxhash.xxh64_intdigest(word, seed) or 1


# ---- the filter ----------------------------------------------------------------------------------------------


def _step(n: int) -> np.uint64:
    return np.uint64((n + 1) * int(_K) % 2**64)


def permuted(grams: np.ndarray) -> np.ndarray:
    """Rows of packed n-grams, scrambled invertibly: each number takes on a function of the one before, in three rounds."""
    out = grams.copy()
    k = out.shape[1]
    for step in range(3 * k):
        out[:, step % k] ^= mix(out[:, (step - 1) % k] + _step(step))
    return out


def restored(rows: np.ndarray) -> np.ndarray:
    """What ``permuted`` was made of."""
    out = rows.copy()
    k = out.shape[1]
    for step in reversed(range(3 * k)):
        out[:, step % k] ^= mix(out[:, (step - 1) % k] + _step(step))
    return out


class QuotientFilter:
    """Counters of permuted rows, in the order of the rows."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows, self.counts = rows, counts

    @classmethod
    def of(cls, rows: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """Equal rows become one entry."""
        if counts is None:
            counts = np.ones(len(rows), np.int64)
        order = np.argsort(rows[:, 0], kind="stable")
        rows, counts = rows[order], counts[order]
        same = (rows[1:] == rows[:-1]).all(axis=1)
        if (rows[1:, 0] == rows[:-1, 0])[~same].any():  # different rows with the same first number
            order = np.lexsort(rows.T[::-1])
            rows, counts = rows[order], counts[order]
            same = (rows[1:] == rows[:-1]).all(axis=1)
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(rows) else np.zeros(0, np.int64)
        return cls(rows[first], np.add.reduceat(counts, first) if len(first) else counts)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        return cls.of(np.concatenate([f.rows for f in filters]), np.concatenate([f.counts for f in filters]))

    def quotients(self) -> np.ndarray:
        return (self.rows[:, 0] >> np.uint64(64 - QUOTIENT)).astype(np.int64)

    def pack(self, lo: int, hi: int) -> bytes:
        """The entries with quotients from ``lo`` to before ``hi``: places as bits, remainders, counters, wide counters."""
        quotients = self.quotients()
        a, b = np.searchsorted(quotients, [lo, hi])
        rows, counts, own = self.rows[a:b], self.counts[a:b], quotients[a:b] - lo
        places = np.zeros(hi - lo + len(rows), np.uint8)
        places[own + np.arange(len(rows))] = 1  # a zero closes each place
        head = (rows[:, 0] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_REST]
        wide = counts >= 255
        return b"".join([
            np.array([rows.shape[1], len(rows)], "<i8").tobytes(), np.packbits(places).tobytes(), head.tobytes(),
            rows[:, 1:].astype("<u8").tobytes(), np.where(wide, 255, counts).astype(np.uint8).tobytes(), counts[wide].astype("<i8").tobytes()])

    @classmethod
    def unpack(cls, data: bytes, lo: int, hi: int) -> QuotientFilter:
        width, n = (int(x) for x in np.frombuffer(data, "<i8", 2))
        bits, at = hi - lo + n, 16
        places = np.unpackbits(np.frombuffer(data, np.uint8, (bits + 7) // 8, at), count=bits)
        at += (bits + 7) // 8
        quotients = np.flatnonzero(places) - np.arange(n) + lo
        head = np.zeros((n, 8), np.uint8)
        head[:, :_REST] = np.frombuffer(data, np.uint8, n * _REST, at).reshape(n, _REST)
        at += n * _REST
        rows = np.empty((n, width), np.uint64)
        rows[:, 0] = head.reshape(-1).view("<u8") | (quotients.astype(np.uint64) << np.uint64(64 - QUOTIENT))
        rows[:, 1:] = np.frombuffer(data, "<u8", n * (width - 1), at).reshape(n, width - 1)
        at += n * (width - 1) * 8
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        wide = counts == 255
        counts[wide] = np.frombuffer(data, "<i8", int(wide.sum()), at + n)
        return cls(rows, counts)


def bounds(ranges: int) -> np.ndarray:
    """Where the ranges of quotients begin, and the end of the last."""
    return (np.arange(ranges + 1) << QUOTIENT) // ranges


# ---- bitmaps -------------------------------------------------------------------------------------------------


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each n-gram, given by the columns of its ids."""
    h = columns[0]
    for ids in columns[1:]:
        h = mix(h * _K + ids)
    return h


def _bit_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places for each number."""
    return [h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]


def holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for place in _bit_places(h, len(bitmap) * 64):
        out &= (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _bits_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            if not len(lists):
                continue
            ids = np.asarray(lists.flatten()).view(np.uint64).reshape(len(lists), -1)
            h = gram_hash(list(ids.T))
            place = np.concatenate(_bit_places(h, bits))
            slot, bit = (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit.view(np.int64))], ["slot", "bit"])

    return run


def bitmap_of(grams: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of the ``ids`` of a table of so many rows; its slots, at most ``BITMAP`` / 64 of them, come to the driver."""
    bits = 1 << 12
    while bits < min(BITMAP, 16 * rows):
        bits *= 2
    slots = grams.select("ids").mapInArrow(_bits_of(bits), "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, "<u8")
    out[slots.column("slot").to_numpy()] = slots.column("bit").to_numpy().view(np.uint64)
    return out


# ---- passes over the texts -----------------------------------------------------------------------------------


def _word_counts(seed: int, remember: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows, ids = [], []
            for lang, words in counts.items():
                own = lang_seed(lang, seed)
                rows += [(lang, word, n) for word, n in words.items()]
                ids += [word_id(word, own) for word in words]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.int64())], ["id", "lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = counts.setdefault(lang, {})
                before = len(words)
                for word in tokens(text):
                    words[word] = words.get(word, 0) + 1
                words.pop(_END, None)
                held += len(words) - before
                if held >= remember:
                    yield flush()
                    counts, held = {}, 0
        if counts:
            yield flush()

    return run


class _Ids(dict):
    """Ids of the words of a language; 0 for words that are not frequent, and for the end of a piece."""

    def __init__(self, lang: str, seed: int, bitmap: np.ndarray):
        super().__init__()
        self.seed, self.bits, self.most = lang_seed(lang, seed), bitmap.tobytes(), len(bitmap) * 64 - 1
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        n = word_id(word, self.seed)
        a, b = n & self.most, n >> 32 & self.most
        n = n if self.bits[a >> 3] >> (a & 7) & self.bits[b >> 3] >> (b & 7) & 1 else 0
        self[word] = n
        return n


def _gram_filters(sizes: tuple[int, ...], tested: int, seed: int, ranges: int, frequent, parts, gather: int, remember: int):
    """(words, part, blob): filters of the n-grams of some sizes whose parts of ``tested`` words are frequent, a row for each range of quotients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bounds(ranges)
        known: dict[str, _Ids] = {}
        buffers: dict[int, list[np.ndarray]] = {words: [] for words in sizes}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for words, rows in buffers.items():
                if rows:
                    made = QuotientFilter.of(permuted(np.concatenate(rows)))
                    present = np.unique(np.searchsorted(cuts, made.quotients(), "right") - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(present), words, np.int32)), pa.array(present.astype(np.int32)),
                         pa.array([made.pack(cuts[p], cuts[p + 1]) for p in present], pa.binary())], ["words", "part", "blob"])
                    rows.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = tokens(text)
                if len(found) < sizes[0]:
                    continue
                ids = known.get(lang)
                if ids is None or len(ids) > remember:
                    ids = known[lang] = _Ids(lang, seed, frequent.value)
                x = np.fromiter(map(ids.__getitem__, found), np.uint64, len(found))
                begin = x != 0  # where frequent parts begin
                for k in range(1, tested):
                    begin = begin[:-1] & (x[k:] != 0)
                if tested > 1:
                    at = np.flatnonzero(begin)
                    begin[at] = holds(parts.value, gram_hash([x[at + k] for k in range(tested)]))
                for words in sizes:
                    ok = begin
                    for k in range(1, words - tested + 1):
                        ok = ok[:-1] & begin[k:]
                    at = np.flatnonzero(ok)
                    if len(at):
                        buffers[words].append(np.stack([x[at + k] for k in range(words)], 1))
                        held += len(at)
                if held >= gather:
                    yield from flush()
                    held = 0
            if len(known) > 64:  # languages are few; where they are not, their words are not all remembered
                known = {}
        yield from flush()

    return run


def _merger(ranges: int, least: int):
    """(ids, n) of the frequent n-grams, from blobs sorted by number of words and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bounds(ranges)
        last, total, fresh, held = None, None, [], 0

        def together() -> QuotientFilter:
            return QuotientFilter.merged([total, *fresh] if total is not None else fresh)

        def frequent(found: QuotientFilter) -> pa.RecordBatch:
            keep = found.counts >= least
            ids = restored(found.rows[keep]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * ids.shape[1]), pa.array(ids.reshape(-1)))
            return pa.RecordBatch.from_arrays([lists, pa.array(found.counts[keep])], ["ids", "n"])

        for batch in batches:
            for words, part, blob in zip(batch.column("words").to_pylist(), batch.column("part").to_pylist(), batch.column("blob")):
                if (words, part) != last and last is not None:
                    yield frequent(together())
                    total, fresh, held = None, [], 0
                last = words, part
                fresh.append(QuotientFilter.unpack(blob.as_buffer(), int(cuts[part]), int(cuts[part + 1])))
                held += len(fresh[-1].rows)
                if held > 500_000:  # what is merged stays as large as the different n-grams of the range
                    total, fresh, held = together(), [], 0
        if last is not None:
            yield frequent(together())

    return run


def frequent_grams(texts: DataFrame, most: int, least: int, gather: int = GATHER, per_range: int = RANGE, remember: int = REMEMBER):
    """From (lang, text): the words (id, lang, word, n), all of them, and (ids, n) of the frequent n-grams of 2 and more words."""
    spark = texts.sparkSession
    for seed in range(20):
        words = stored(
            texts.mapInArrow(_word_counts(seed, remember), "id bigint, lang string, word binary, n bigint")
            .groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if not words.groupBy("id").agg(F.count(F.lit(1)).alias("words")).where("words > 1").limit(1).count():
            break
    else:
        raise RuntimeError("no seed gives different words different ids")
    common = words.where(F.col("n") >= least)
    facts = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= least).alias("common")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(facts["n"] or 0) // (per_range * TOGETHER)))
    ranges = min(tasks * TOGETHER, 1 << QUOTIENT)
    frequent = parts = spark.sparkContext.broadcast(bitmap_of(common.select(F.array("id").alias("ids")), facts["common"]))
    found = []
    for sizes in [(k,) for k in (2, 3) if k <= most] + ([tuple(range(4, most + 1))] if most > 3 else []):
        grams = stored(
            texts.mapInArrow(_gram_filters(sizes, sizes[0] - 1, seed, ranges, frequent, parts, gather, remember), "words int, part int, blob binary")
            .repartition(tasks, "words", "part").sortWithinPartitions("words", "part")
            .mapInArrow(_merger(ranges, least), "ids array<bigint>, n bigint"), "grams")
        rows = grams.count()
        if not rows:
            break
        found.append(grams)
        if sizes[-1] < most:
            parts = spark.sparkContext.broadcast(bitmap_of(grams, rows))
    return words, found


# ---- the operator --------------------------------------------------------------------------------------------


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most: int = WORDS, inside: int = INSIDE, top: int = TOP,
    gather: int = GATHER, per_range: int = RANGE, remember: int = REMEMBER,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``most`` words of each language.

    Words are what blanks separate, with A-Z in lower case; a phrase does not go beyond ``.,;:!?`` or a line end. ``a`` counts the
    phrase, ``l`` and ``r`` its two parts at the cut with the lowest score (ties: the earliest cut), ``n`` all words of the
    language; the score is 1000 * a * n / (l * r), rounded down, in exact arithmetic. A phrase that occurs less than ``least`` times is none, and
    one with ``inside`` percent of its occurrences in a longer phrase is left out. Order: score, a, phrase in the order of its bytes. Every row counts,
    repeated ones too; a null language is ``und``, a null or empty text has no words. Other columns are not read.
    """
    texts = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).cast("string").alias("text"))
    words, levels = frequent_grams(texts, most, least, gather, per_range, remember)
    if not levels:
        levels = [docs.sparkSession.createDataFrame([], "ids array<bigint>, n bigint")]
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = stored(words.where(F.col("n") >= least).select("id", "lang", F.col("word").cast("string").alias("word"), "n"), "common")
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    grams = grams.select("ids", F.col("n").alias("a"))

    # nested phrases: every part of two and more words of a longer phrase
    size = F.size("ids")
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("ids", s, m))))
    longer = (
        grams.where(size > 2).select(F.explode(pieces).alias("part"), F.col("a").alias("of"))
        .groupBy("part").agg(F.max("of").alias("of"))
    )
    kept = stored(
        grams.join(longer, F.col("ids") == F.col("part"), "left")
        .where(F.col("of").isNull() | (F.col("of") * 100 < F.col("a") * inside)).select("ids", "a"), "kept")

    # the occurrences of the parts at each cut
    counts = common.select(F.array("id").alias("c_ids"), F.col("n").alias("c")).unionByName(
        grams.where(size < most).select(F.col("ids").alias("c_ids"), F.col("a").alias("c")))
    counts = small(counts, counts.count())
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, size).alias("rest"))
    cuts = cuts.join(counts.withColumnRenamed("c", "l"), F.col("first") == F.col("c_ids")).drop("c_ids", "first")
    cuts = cuts.join(counts.withColumnRenamed("c", "r"), F.col("rest") == F.col("c_ids")).drop("c_ids", "rest")
    named = common.join(totals.withColumnRenamed("n", "total"), "lang").select(F.col("id").alias("h_id"), "lang", "total")
    cuts = cuts.join(small(named, common.count()), F.col("ids")[0] == F.col("h_id"))

    def exact(*factors: str):
        out = F.lit(1).cast("decimal(38,0)")
        for factor in factors:
            out = (out * F.col(factor).cast("decimal(20,0)")).cast("decimal(38,0)")
        return out

    scored = cuts.withColumn("x", (exact("a", "total") * F.lit(1000)).cast("decimal(38,0)")).withColumn("y", exact("l", "r"))
    scored = scored.withColumn("score", F.expr("x div y"))
    best = scored.groupBy("ids").agg(
        F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("total").alias("n"),
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = (
        best.select("ids", F.posexplode("ids").alias("at", "id")).join(small(common.select("id", "word"), common.count()), "id")
        .groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    rows = best.join(spelt, "ids").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
