"""Secret scans: patterns, and a token-efficiency test for random strings.

Three patterns give the base findings: assignments to telling names, access keys, long hexadecimal runs. The token-efficiency
test adds kind ``random``: a byte-pair vocabulary has learnt what text looks like, so words take few tokens and random
strings many. A run of ``LEAST`` or more key characters whose characters per token are at most ``RATIO`` is reported, unless it is

* a known digest (hexadecimal digits in the length of MD5, SHA-1, SHA-224, SHA-256, SHA-384 or SHA-512),
* a known identifier: a UUID, or words and numbers, alone or joined by ``_``, ``-``, ``/``, ``=``, ``+`` (names, paths, dates, digits in groups),
* of one kind of character only (a word, be it capitalised, has no second kind), or
* part of a base finding, which stands already.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, rest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters from which a run is tested, and characters per token up to which it counts as random.
LEAST, RATIO = 20, 2.0
#: Characters that are tokenised at a time; the tokens of a longer run are those of its pieces.
PIECE = 1024

#: The base kinds in their order; further kinds follow them.
KINDS = ("assign", "access", "hex", "random")

# The base patterns. Of a run of hexadecimal digits or of an access key the whole run is the match, so the least
# length can stand in the pattern; a short value of an assignment still uses up its text, so its length is tested afterwards.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
VALUE = 8
_NAMES = ("passw", "secret", "token", "apikey", "api_key")

# Fixed value: hexadecimal digits of the usual digests.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_JOINTS = re.compile(r"[_/=+-]+")
_WORD = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]+)[0-9]*")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The findings of the three patterns, as (kind, start, end) in code points."""
    out: list[Span] = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def known(run: str) -> bool:
    """Whether a run is a digest, an identifier or a plain word."""
    kinds = any(c.islower() for c in run[1:]) + any(c.isupper() for c in run[1:]) + any(c.isdigit() for c in run)
    if kinds < 2 or _UUID.fullmatch(run) or all(_WORD.fullmatch(part) for part in _JOINTS.split(run)):
        return True
    return len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run) is not None


def ratio(run: str, tokens: Callable[[str], int], piece: int = PIECE) -> float:
    """Characters per token."""
    return len(run) / sum(tokens(run[at : at + piece]) for at in range(0, len(run), piece))


def random_spans(text: str, tokens: Callable[[str], int], runs: re.Pattern, most: float, base: list[Span]) -> list[Span]:
    """Runs of key characters that the vocabulary does not know."""
    out: list[Span] = []
    ordered, at, covered = sorted((s, e) for _, s, e in base), 0, 0
    for m in runs.finditer(text):
        start, end = m.span()
        while at < len(ordered) and ordered[at][0] <= start:
            covered = max(covered, ordered[at][1])
            at += 1
        if end <= covered or known(m[0]):
            continue
        if ratio(m[0], tokens) <= most:
            out.append(("random", start, end))
    return out


def spelt(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind, joined by commas."""
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def token_counter(path: str, pattern: str) -> Callable[[str], int]:
    """Tokens of a text under a tiktoken vocabulary file."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def scanner(path: str, pattern: str, least: int = LEAST, most: float = RATIO):
    """A UDF from text to the counts by kind, the digest of the base findings and all findings."""

    @F.pandas_udf("assign bigint, access bigint, hex bigint, random bigint, base string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens, runs = token_counter(path, pattern), re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}")
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, tokens, runs, most, base)
                counts = Counter(kind for kind, _, _ in base + more)
                rows.append((*(counts[k] for k in KINDS), hashlib.sha256(spelt(base).encode()).hexdigest(), spelt(base + more)))
            yield pd.DataFrame(rows, columns=[*KINDS, "base", "spans"])

    return scan


def scan_secrets(
    docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: float = RATIO,
) -> DataFrame:
    """Every document with ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256`` and ``spans``.

    ``vocabulary`` is a tiktoken file at the same place on every machine, ``pattern`` its pre-token pattern. ``spans`` has all findings
    as ``kind:start:end`` in code points, ``base_sha256`` is the digest of those of the patterns. A null or empty text has none.
    Rows are judged one by one: repeated rows and ids, of whatever type, null ones too, stay as they are. The
    other columns of ``docs`` follow, but for those that clash.
    """
    out = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    extra = rest(docs, [doc_id, *out])
    scanned = docs.select(
        col(doc_id).alias("_doc"), scanner(vocabulary, pattern, least, most)(col(text).cast("string")).alias("_found"),
        *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)))
    return scanned.select(
        F.col("_doc").alias(doc_id), *(F.col("_found")[k].alias(name) for k, name in zip([*KINDS, "base", "spans"], out)),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )
