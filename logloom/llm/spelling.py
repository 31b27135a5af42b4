"""Spelling variants by finite-state composition.

The words are counted over all texts. The pairs of words one edit apart are what the composition of three machines
accepts: the minimised acceptor of the vocabulary, a transducer that changes, adds or takes away one symbol, the acceptor again. While nothing is
changed both tapes have read the same, so the composition's states before the edit are those of the acceptor, and it can be entered
at any of them: a task gets the words that share what was read on the way to its initial state.

*Initial states.* Let the shorter word of a pair have L symbols. The edit falls either behind its first half, which both words then have in common, or
before its second half, which the reversed machines read first. Each word thus enters under its own length and as the longer one
under one symbol less, with its first and with its second half.

*Large groups.* The words of an initial state that are more than ``HOT`` enter one step further, at the states behind
the edit: those that have everything but the place of the edit in common. Such a group has one word for each symbol at most.

A group yields one row a word: how many near words it has there, and the most frequent of them. No table of pairs is made.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Least symbols and occurrences of a word; how many times as frequent its form must be; a run changes if this divides its hash.
LEAST, OCCURRENCES, TIMES, CHANGED = 7, 2, 10, 31
#: Words of an initial state that are composed in one group; different words a task counts before it hands them on.
HOT, REMEMBER = 20_000, 400_000

# Fixed value: the runs [A-Za-z\u00C0-\u00FF]+ after A-Z in lower case, as UTF-8.
_RUNS, _ASCII_RUNS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+"), re.compile(rb"[a-z]+")


# ---- the vocabulary ------------------------------------------------------------------------------------------


def words_of(doc: str, text: str | None, changed: int = CHANGED) -> list[bytes]:
    """The words of a text, in UTF-8: its runs, of which some lose a symbol that a hash names."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    runs = (_ASCII_RUNS if data.isascii() else _RUNS).findall(data)
    if not runs:
        return runs
    crc32, seen = zlib.crc32, zlib.crc32(f"{doc}:".encode())
    hashes = np.fromiter((crc32(run, seen) for run in runs), np.uint32, len(runs))
    for k in np.flatnonzero(hashes % changed == 0):
        symbols = runs[k].decode()
        at = int(hashes[k]) % len(symbols)
        runs[k] = (symbols[:at] + symbols[at + 1 :]).encode()
    return runs


def _word_counts(least: int, changed: int, remember: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in counts.items() if len(w.decode()) >= least]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.binary()).cast(pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                for word in words_of(doc, text, changed):
                    if len(word) >= least:
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) >= remember:
                    yield flush()
                    counts = {}
        if counts:
            yield flush()

    return run


def vocabulary(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES,
    changed: int = CHANGED, remember: int = REMEMBER,
) -> DataFrame:
    """(word, n) of the words of enough symbols and occurrences."""
    texts = docs.select(F.coalesce(col(doc_id).cast("string"), F.lit("")).alias("doc"), col(text).cast("string").alias("text"))
    return (
        texts.mapInArrow(_word_counts(least, changed, remember), "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)
    )


# ---- machines ------------------------------------------------------------------------------------------------


class Acceptor:
    """The minimised acceptor of sorted, different strings.

    State ``q`` has the arcs ``arcs[q]``, (symbol, state, number of strings before) in order of symbols, accepts if ``final[q]``, and has
    ``count[q]`` strings; the numbers along a path add up to the place of its string among all.
    """

    def __init__(self, strings: list[str]):
        self.arcs: list[tuple] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self._known: dict[tuple, int] = {}
        self.start = self._build(strings)

    def _state(self, final: bool, arcs: tuple[tuple[str, int], ...]) -> int:
        """The one state with these arcs: states that accept the same strings are one."""
        known = self._known.get((final, arcs))
        if known is None:
            before, own = int(final), []
            for symbol, to in arcs:
                own.append((symbol, to, before))
                before += self.count[to]
            known = self._known[final, arcs] = len(self.arcs)
            self.arcs.append(tuple(own))
            self.final.append(final)
            self.count.append(before)
        return known

    def _build(self, strings: list[str]) -> int:
        # one open state for each symbol of the last string; what the next string does not share is closed
        open_: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], self._state(final, tuple(arcs))))

        for string in strings:
            shared = 0
            while shared < len(last) and shared < len(string) and last[shared] == string[shared]:
                shared += 1
            close(shared)
            open_ += [(False, []) for _ in range(len(string) - shared)]
            open_[-1] = (True, open_[-1][1])
            last = string
        close(0)
        return self._state(open_[0][0], tuple(open_[0][1]))


def near_pairs(acceptor: Acceptor) -> Iterator[tuple[int, int, bool]]:
    """Pairs of places of strings one edit apart, each once: (first, second, whether the second has one symbol more).

    A state of the composition is a state of either acceptor and whether the edit is done; before it both are the same. A
    symbol that could be added at several neighbouring places is added at the last of them.
    """
    arcs, final, count = acceptor.arcs, acceptor.final, acceptor.count
    before = [(acceptor.start, 0)]
    while before:
        q, place = before.pop()
        out = arcs[q]
        for k, (symbol, to, shift) in enumerate(out):
            before.append((to, place + shift))
            behind = [(other, place + shift_, to, place + shift, False) for _, other, shift_ in out[:k]]
            # the second tape reads a symbol more; the first goes on with any other symbol
            if final[q] and final[to]:
                yield place, place + shift, True
            onward = {s: (t, n) for s, t, n in arcs[to]}
            for s, t, n in out:
                if s != symbol and s in onward:
                    t2, n2 = onward[s]
                    behind.append((t, place + n, t2, place + shift + n2, True))
            while behind:
                a, i, b, j, longer = behind.pop()
                if a == b:
                    for n in range(count[a]):
                        yield i + n, j + n, longer
                    continue
                if final[a] and final[b]:
                    yield i, j, longer
                if not arcs[a] or not arcs[b]:
                    continue
                onward = {s: (t, n) for s, t, n in arcs[b]}
                for s, t, n in arcs[a]:
                    if s in onward:
                        t2, n2 = onward[s]
                        behind.append((t, i + n, t2, j + n2, longer))


# ---- groups --------------------------------------------------------------------------------------------------


def _solver():
    """(word, n_near, best_n, best): from rows (length, side, shared, at, part, n) sorted by group and part."""

    def solve(key: tuple, parts: list[str], ns: list[int], out: dict[str, list]) -> None:
        length, side, shared, at = key
        if at >= 0:
            words = [shared[:at] + part + shared[at:] for part in parts]
        elif side == "p":
            words = [shared + part for part in parts]
        else:
            words = [part[::-1] + shared for part in parts]
        half = length // 2
        for i, j, longer in near_pairs(Acceptor(parts)):
            a, b = words[i], words[j]
            if not longer and len(a) != length:  # two of the longer words, which meet under their own length
                continue
            if side == "s" and a[:half] == b[:half]:  # found behind their first half
                continue
            for x, y, n in ((a, b, ns[j]), (b, a, ns[i])):
                found = out.get(x)
                if found is None:
                    out[x] = [1, n, y]
                else:
                    found[0] += 1
                    if n > found[1] or n == found[1] and y < found[2]:
                        found[1:] = n, y

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        rows = [(word, *found) for word, found in out.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, ns = None, [], []
        out: dict[str, list] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("length", "side", "shared", "at", "part", "n"))
            for length, side, shared, at, part, n in zip(*columns):
                key = (length, side, shared, at)
                if key != last:
                    if len(parts) > 1:
                        solve(last, parts, ns, out)
                        if len(out) >= 20_000:
                            yield batch_of(out)
                            out = {}
                    last, parts, ns = key, [], []
                parts.append(part)
                ns.append(n)
        if len(parts) > 1:
            solve(last, parts, ns, out)
        if out:
            yield batch_of(out)

    return run


def _entries(words: DataFrame, least: int) -> DataFrame:
    """(length, side, shared, at, part, word, n): each word at its initial states; ``at`` is -1."""
    n = F.length("word")
    rows = []
    for shorter in (n, n - 1):
        half = F.floor(shorter / 2).cast("int")
        kept = (shorter - half).cast("int")
        rows.append(F.struct(
            shorter.cast("int").alias("length"), F.lit("p").alias("side"), F.substring("word", F.lit(1), half).alias("shared"),
            F.substring("word", half + 1, n).alias("part")))
        rows.append(F.struct(
            shorter.cast("int").alias("length"), F.lit("s").alias("side"), F.substring("word", n - kept + 1, kept).alias("shared"),
            F.reverse(F.substring("word", F.lit(1), n - kept)).alias("part")))
    return words.select("word", "n", F.inline(F.array(*rows))).where(F.col("length") >= least).withColumn("at", F.lit(-1))


def _behind_the_edit(rows: DataFrame) -> DataFrame:
    """The same words, entering behind an edit: at each place outside the shared half, without its symbol and as they are."""
    n, length = F.length("word"), F.col("length")
    half = F.floor(length / 2).cast("int")
    # in the shorter word's places: behind the first half, or before the second
    lo = F.when(F.col("side") == "p", half).otherwise(F.lit(0))
    hi = F.when(F.col("side") == "p", n).otherwise(n - (length - half))
    symbol = lambda at: F.substring("word", at + 1, F.lit(1))
    without = lambda at: F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, n))
    changed = F.transform(F.sequence(lo, hi - 1), lambda at: F.struct(without(at).alias("shared"), at.alias("at"), symbol(at).alias("part")))
    # a longer word gives a symbol away at the last of the places that would leave the same
    changed = F.filter(changed, lambda x: (n == length) | (x["at"] == n - 1) | (symbol(x["at"]) != symbol(x["at"] + 1)))
    whole = F.transform(
        F.sequence(lo, hi), lambda at: F.struct(F.col("word").alias("shared"), at.alias("at"), F.lit("").alias("part")))
    both = F.when(n == length, F.concat(changed, whole)).otherwise(changed)
    return rows.where(hi >= lo).select("length", "side", "word", "n", F.inline(both)).select("length", "side", "shared", "at", "part", "n")


def near_words(words: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(word, n_near, best_n, best): partial results, to be added up by word; words without near words are left out."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = _entries(words, least)
    group = ["length", "side", "shared"]
    large = stored(entries.groupBy(*group).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > hot).select(*group), "large")
    rows = large.count()
    plain = ["length", "side", "shared", "at", "part", "n"]
    if rows:
        named = small(large.select(*(F.col(c).alias(f"g_{c}") for c in group)), rows)
        same = (F.col("length") == F.col("g_length")) & (F.col("side") == F.col("g_side")) & (F.col("shared") == F.col("g_shared"))
        entries = entries.join(named, same, "left_anti").select(*plain).unionByName(
            _behind_the_edit(entries.join(named, same, "left_semi")))
    return (
        entries.select(*plain).repartition(parts, "length", "side", "shared", "at")
        .sortWithinPartitions("length", "side", "shared", "at", "part")
        .mapInArrow(_solver(), "word string, n_near bigint, best_n bigint, best string")
    )


# ---- the operator --------------------------------------------------------------------------------------------


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES,
    times: int = TIMES, changed: int = CHANGED, hot: int = HOT, remember: int = REMEMBER,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of ``least`` symbols and ``occurrences`` or more.

    Words are runs of Latin letters with A-Z in lower case; of a run whose hash with its document's id ``changed`` divides, one symbol is
    taken away first. ``n_near`` counts the words one symbol's change, addition or loss away; the most frequent of them (ties: the
    first in code-point order) is the word's ``form`` if it occurs at least ``times`` times as often, ``form_n`` its number; else both
    are null. ``root`` follows the forms to the last. A null id counts as an empty one, a null or empty text has no words;
    repeated rows count as often as they come; other columns are not read.
    """
    words = stored(vocabulary(docs, doc_id, text, least, occurrences, changed, remember), "words")
    nothing = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("best_n"),
                           F.lit(None).cast("string").alias("best"))
    partial = near_words(words, least, hot).select("word", F.lit(None).cast("bigint").alias("n"), "n_near", "best_n", "best")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    judged = (
        nothing.unionByName(partial).groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    )
    follows = -F.col("best.less") >= F.col("n") * times
    judged = stored(judged.select(
        "word", F.when(follows, F.col("best.word")).alias("form"), "n", "n_near", F.when(follows, -F.col("best.less")).alias("form_n")), "forms")

    # a form is at least ``times`` times as frequent, so chains are short: each round doubles the steps that are known
    chains = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    steps, reach = 1, max(2, times)
    while reach < 1 << 63:
        reach, steps = reach * max(2, times), steps + 1
    for _ in range(steps.bit_length()):
        onward = chains.select(F.col("word").alias("via"), F.col("root").alias("far"))
        chains = stored(chains.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
    last = chains.select(F.col("word").alias("r_word"), "root")
    return judged.join(last, F.col("word") == F.col("r_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
