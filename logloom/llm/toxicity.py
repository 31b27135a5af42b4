"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

*Folding* turns upper case, homoglyphs, digit substitutions and signs inside
words into one small alphabet, and everything that is no letter into a blank, so
that ``1d10t``, ``IDIOT`` and one spelt with Cyrillic letters are the same word.
The lexicon is folded in the same way.

*Learning* counts, over all labelled texts outside the held-out fold, in how many
toxic and clean texts each word, of any length, and each word beginning of 4 to 40 letters occurs. Those that are
significantly more frequent in toxic texts enter the lexicon with their log odds, all of them: by the
bound of Chernoff, about one pattern in the whole lexicon is expected to be there by chance, however many were
counted. A pattern that a shorter beginning says as well is left out;
insults that no label showed come from a fixed list.

*Scoring* adds the weights of the matches of a whole text, leaves out matches
inside exception phrases, and maps the sum and the sum by length to a
probability with a logistic model.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, lowest, pick, rest, small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Look-alike letters, digit and sign substitutions, common insults, harmless phrases.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
INSULTS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting",
           "clown", "imbecile", "jerk", "dumbass", "asshole", "bastard", "bitch", "retard"]
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection",
              "clown fish", "clownfish", "circus clown", "white trash can", "pathetic fallacy"]

#: Weight of an insult of the fixed list before any label is seen.
PRIOR_WEIGHT = 4.0
#: A pattern enters if it is in so many toxic texts, and so much more likely there.
MIN_TEXTS, MIN_LOG_ODDS = 5, 2.5
#: Letters of a beginning.
SHORTEST, LONGEST = 4, 40
#: Labelled texts on which the three numbers of the logistic model are fitted.
FIT_ROWS = 20_000

_SIGN = re.compile(r"(?<=\w)[@$!|€]+(?=\w)")
_SIGNS = str.maketrans(SIGNS)


class Fold(dict):
    """A table for ``str.translate`` that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = ""
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0)
        if code not in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF) and not 0x300 <= code <= 0x36F:
            for x in c.lower():
                x = HOMOGLYPHS.get(x, DIGITS.get(x, x))
                x = "i" if x == "l" else x  # l, i and 1 stand for each other
                out += x if x.isalnum() else "" if 0x300 <= ord(x) <= 0x36F else " "
        self[code] = out
        return out


def fold(text: str | None, table: Fold) -> str:
    if not text:
        return " "
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: m[0].translate(_SIGNS), text)
    return f" {text.translate(table)} "


@dataclass
class Lexicon:
    """Folded patterns with weights: ``" idiot "`` is a word, ``" idio"`` a beginning; and the logistic model."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    logistic: tuple[float, float, float] = (-2.0, 1.0, 0.5)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            out.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), 0.0))
        if len(out):
            out.make_automaton()
        return out


def base_lexicon() -> Lexicon:
    table = Fold()
    return Lexicon(
        {f" {w.translate(table)} ": PRIOR_WEIGHT for w in INSULTS},
        [f" {e.translate(table)} " for e in EXCEPTIONS],
    )


def matches(folded: str, automaton) -> float:
    """The sum of the weights; of the matches that begin at one place the longest counts, exceptions cover what they hold."""
    best: dict[int, tuple[int, float]] = {}
    for end, (n, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end - n + 1
        if start not in best or n > best[start][0]:
            best[start] = (n, weight)
    total, covered = 0.0, -1
    for start in sorted(best):
        n, weight = best[start]
        if weight == 0.0:
            covered = max(covered, start + n - 1)
        elif start >= covered:
            total += weight
    return total


def _measure(texts: pd.Series, table: Fold, automaton) -> tuple[np.ndarray, np.ndarray]:
    total, words = np.zeros(len(texts)), np.zeros(len(texts))
    for k, text in enumerate(texts):
        folded = fold(text, table)
        total[k], words[k] = matches(folded, automaton), len(folded.split())
    return total, words


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], 1)


def _count_patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each batch, the number of toxic and of clean texts that hold a word or a word beginning."""
    table = Fold()
    for batch in (b.iloc[k : k + 2000] for b in batches for k in range(0, len(b), 2000)):
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            found = set()
            for word in set(fold(text, table).split()):
                found.add(f" {word} ")
                found.update(f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1))
            seen[int(toxic)].update(found)
        keys = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({
            "pattern": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys],
        })


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from; a missing id is in it."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled texts outside the held-out fold; several labels of an id count as their maximum."""
    marks = (
        pick(labels, doc="doc_id", toxic="toxic").where("doc is not null and toxic is not null")
        .groupBy("doc").agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc")))
    )
    texts = pick(docs, doc="doc_id", text="text").where("text is not null")
    return texts.join(small(marks, marks.count()), "doc").select("doc", "text", F.col("toxic").cast("int").alias("toxic"))


def significant(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(pattern, t, c, odds) of the patterns that are much more frequent in toxic texts than chance among so many would make them."""
    patterns = counts.count()
    t, c, base = F.col("t"), F.col("c"), n_toxic / (n_toxic + n_clean)
    evidence = t * F.log(t / ((t + c) * base)) + F.when(c == 0, 0.0).otherwise(c * F.log(c / ((t + c) * (1 - base))))
    return (
        counts.where((t >= MIN_TEXTS) & (evidence >= float(np.log(max(patterns, 1)))))
        .withColumn("odds", F.log((t + 0.5) * (n_clean + 1) / ((c + 0.5) * (n_toxic + 1))))
        .where(F.col("odds") >= MIN_LOG_ODDS)
    )


def _beginnings(most: Column) -> Column:
    """The beginnings of a pattern of up to ``most`` characters, its blank included."""
    least = F.lit(SHORTEST + 1)
    ends = F.when(most >= least, F.sequence(least, F.greatest(least, F.least(most, F.lit(LONGEST + 1)))))
    return F.explode(F.transform(ends, lambda k: F.substring(F.col("pattern"), F.lit(1), k)))


def shortest(telling: DataFrame) -> DataFrame:
    """The patterns that no other one makes superfluous.

    A beginning must hold clearly more texts than each word it begins, else the word says it better; and a pattern goes if a shorter
    beginning is as pure.
    """
    rows = telling.withColumn("whole", F.col("pattern").endswith(" ")).withColumn("purity", F.col("t") / (F.col("t") + F.col("c")))
    words = (
        rows.where("whole").select(_beginnings(F.length("pattern") - 1).alias("b_pattern"), "t")
        .groupBy("b_pattern").agg(F.max("t").alias("b_t"))
    )
    rows = (
        rows.join(words, F.col("pattern") == F.col("b_pattern"), "left")
        .where(F.col("whole") | (F.col("t") >= 1.2 * F.coalesce("b_t", F.lit(0)))).drop("b_pattern", "b_t")
    )
    shorter = rows.where("not whole").select(F.col("pattern").alias("part"), F.col("purity").alias("s_purity"))
    covers = (
        rows.select(F.col("pattern").alias("c_pattern"), _beginnings(F.length("pattern") - 1).alias("part")).join(shorter, "part")
        .groupBy("c_pattern").agg(F.max("s_purity").alias("cover"))
    )
    return (
        rows.join(covers, F.col("pattern") == F.col("c_pattern"), "left")
        .where(F.col("cover").isNull() | (F.col("cover") < 0.98 * F.col("purity")))
    )


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of all labelled texts, and the logistic model of at most FIT_ROWS of them."""
    lexicon = base_lexicon()
    rows = labelled(docs, labels)
    totals = rows.groupBy("toxic").count().collect()
    n = {int(bool(r["toxic"])): r["count"] for r in totals}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return lexicon
    counts = stored(
        rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
        .mapInPandas(_count_patterns, "pattern string, toxic bigint, clean bigint")
        .groupBy("pattern").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .where(F.col("t") + F.col("c") >= MIN_TEXTS), "patterns")
    telling = stored(significant(counts, n_toxic, n_clean), "telling")
    lexicon.weights.update({r["pattern"]: r["odds"] for r in shortest(telling).select("pattern", "odds").collect()})

    sample = lowest(rows.withColumn("hash", F.xxhash64("doc")), F.col("hash"), n_toxic + n_clean, FIT_ROWS)
    measured = sample.mapInPandas(_fit_rows(lexicon), "hash bigint, total double, words double, toxic int")
    parts = measured.orderBy("hash", "toxic", "total").limit(FIT_ROWS).toPandas()
    x, y = _features(parts["total"].to_numpy(), parts["words"].to_numpy()), (parts["toxic"].to_numpy() > 0).astype(float)
    lexicon.logistic = fit_logistic(x, y)
    return lexicon


def _fit_rows(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, automaton = Fold(), lexicon.automaton()
        for batch in batches:
            total, words = _measure(batch["text"], table, automaton)
            yield pd.DataFrame({"hash": batch["hash"], "total": total, "words": words, "toxic": batch["toxic"].astype("int32")})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small ridge on the slopes; slopes are kept from turning negative."""
    penalty = np.diag([1e-6, ridge, ridge])

    def solve(keep: list[int]) -> np.ndarray:
        w = np.zeros(len(keep))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x[:, keep] @ w, -30, 30)))
            own = penalty[np.ix_(keep, keep)]
            grad = x[:, keep].T @ (p - y) + own @ w
            w = w - np.linalg.solve((x[:, keep] * (p * (1 - p))[:, None]).T @ x[:, keep] + own + 1e-9 * np.eye(len(keep)), grad)
        return w

    keep = [0, 1, 2]
    w = solve(keep)
    if (w[1:] < 0).any():
        keep = [0, 1] if w[1] >= w[2] else [0, 2]
        w = solve(keep)
    out = dict(zip(keep, w))
    return tuple(float(out.get(k, 0.0)) for k in range(3))


def scorer(lexicon: Lexicon):
    """A UDF from text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, automaton = Fold(), lexicon.automaton()
        weights = np.array(lexicon.logistic)
        for texts in batches:
            z = _features(*_measure(texts, table, automaton)) @ weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Only the text enters the score; a null or empty text has no matches and a
    low score. The other columns of ``docs`` follow, but for those that clash
    with the three names. Rows are scored one by one, so repeated rows agree and an
    empty table gives an empty result.
    """
    extra = rest(docs, [doc_id, "held_out", "score", "predicted"])
    scored = docs.select(
        col(doc_id).alias("_doc"), scorer(lexicon)(col(text).cast("string")).alias("_score"),
        *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    return scored.select(
        F.col("_doc").alias(doc_id), held_out(F.col("_doc")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )
