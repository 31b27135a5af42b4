"""Token counts by the whole-token shortcut.

Byte-pair merging never crosses a pre-token, so the count of a text is the sum
of the counts of its pre-tokens. Most pre-tokens are entries of the vocabulary.
``whole_tokens`` proves offline, by merging each entry once, which of them come out as
one token; such a pre-token counts 1 without merging. Only the rest is merged,
each different one once for as long as it stays in a bounded cache.

Texts in Latin-1 are cut into pre-tokens here, by the tokenizer's own pattern with
its classes written out; there normalisation is lower case alone. All other texts, those
that hold special strings, and tokenizers with another pattern are cut by the library.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, rest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Merged pre-tokens that a task remembers; beyond it the cache starts anew.
CACHE = 1_000_000
LIMIT = 2048


# Fixed value: the pattern of word_bpe_49k.json, as its file has it.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _latin_pattern() -> re.Pattern:
    """KNOWN_PATTERN for texts in Latin-1."""
    def chars(*kinds: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] in kinds)

    letters, numbers, blanks = chars("L"), chars("N"), r"\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


def latin_splitter(path: str) -> re.Pattern | None:
    """The pattern for Latin-1 texts, if the tokenizer normalises and splits in the known way."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    known = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": KNOWN_PATTERN} and split.get("invert")
    return _latin_pattern() if known else None


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + odd.index(b)) for b in range(256)]


def whole_tokens(path: str) -> frozenset[str]:
    """The pieces of normalised text that the tokenizer turns into exactly one token.

    Every entry that can end a word is spelt out as text, cut and merged on its own. An entry that the cutter splits, or that the
    merges do not reach in one piece although the vocabulary has it, is left out.
    """
    from tokenizers import Tokenizer, decoders

    tokenizer, spell = Tokenizer.from_file(path), decoders.ByteLevel()
    model, splitter, suffix = tokenizer.model, tokenizer.pre_tokenizer, tokenizer.model.end_of_word_suffix or ""
    out = set()
    for entry in tokenizer.get_vocab(False):
        if entry.endswith(suffix):
            word = entry[: len(entry) - len(suffix)]
            piece = spell.decode([word])
            if [p for p, _ in splitter.pre_tokenize_str(piece)] == [word] and len(model.tokenize(word)) == 1:
                out.add(piece)
    return frozenset(out)


class PieceCounter:
    """Counts the tokens of one text after another, as ``Tokenizer.encode`` without special tokens does."""

    def __init__(self, path: str, whole: frozenset[str], cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.model, self.whole, self.limit, self.latin = self.tokenizer.model, whole, cache, latin_splitter(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.merged: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.specials):  # the library cuts these out before it normalises
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.latin is not None and self.is_latin(text):
            return self.total(self.latin.findall(text.lower()), self.spelt)
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return self.total([text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)], self.cut)

    def total(self, pieces: list[str], tokens) -> int:
        out = 0
        for piece, n in Counter(pieces).items():
            out += n if piece in self.whole else n * self.merge(piece, tokens)
        return out

    def spelt(self, piece: str) -> int:
        """Tokens of one piece of a Latin-1 text, whose bytes are spelt here."""
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def cut(self, piece: str) -> int:
        return sum(len(self.model.tokenize(p)) for p, _ in self.splitter.pre_tokenize_str(piece))

    @staticmethod
    def is_latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def merge(self, piece: str, tokens) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = tokens(piece)
            if len(self.merged) >= self.limit:
                self.merged.clear()
            self.merged[piece] = n
        return n


def token_counter(path: str):
    """A UDF from text to token count; the proven set is made once, on the driver."""
    whole = whole_tokens(path)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(path, whole)
        for texts in batches:
            yield pd.Series([counter(t) for t in texts], dtype="int64")

    return count


def count_tokens(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Every document with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``path`` names a tokenizer file that every executor can open. Whole texts are counted; a
    null or empty text has 0 bytes and 0 tokens. Special strings inside a text are
    handled as the library does by default. The other columns of ``docs`` follow,
    but for those that clash with the three names.
    """
    out = ["n_bytes", "n_tokens", "over_limit"]
    extra = rest(docs, [doc_id, *out])
    counted = docs.select(
        col(doc_id).alias("_doc"),
        F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint").alias("_bytes"),
        token_counter(path)(col(text)).alias("_tokens"),
        *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    return counted.select(
        F.col("_doc").alias(doc_id), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"),
        (F.col("_tokens") > limit).alias("over_limit"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )
