"""Long repeated passages, found with a run-compressed suffix index.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier.

1. *Anchors.* The smallest of the hashed ``GRAM``-byte strings inside a window of ``LENGTH`` bytes is its
   anchor. Equal windows have equal anchors, and neighbouring windows share one; a *context* is the stretch of
   all windows of one anchor place, a third longer than a window. Only anchors that occur twice
   matter. Tasks fold what repeats among neighbouring rows (a few thousand) and say so, hence a
   hot anchor or a hot context sends one row for these, not one a copy.
2. *Contexts* of repeated anchors meet by anchor. Of equal contexts the first stays, all windows of the others repeat.
3. *Index.* The different contexts of an anchor, in document order, form a text. Its Burrows-Wheeler transform is cut into
   runs, and for the row at each run's start the text place, the text place of the row before (a run's
   end) and their common prefix are sampled. From these samples alone, matching statistics are streamed over the text: for
   each place the neighbour in suffix order and the length of the match. Windows that match over ``LENGTH`` bytes form
   chains; all but the first window of a chain repeat.
4. The repeated windows of a document are merged to spans and cut out.

An anchor whose contexts may not fit a block is split: each of its windows becomes a context of its own, which meets its equals by the hash of
the whole window. Different contexts are counted where the anchors are found, after folding among the rows at hand, and added up.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix, rest, small, stored
from .minhash import Powers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a match, and of the strings whose hashes choose anchors.
LENGTH, GRAM = 100, 32
#: Text that is indexed at a time (whole anchor groups), and text that is hashed at a time.
BLOCK, CHUNK = 1 << 20, 1 << 21
#: Bytes of texts that are looked at together, and of texts whose anchors are sorted together.
SLICE, SPAN = 1 << 24, 1 << 25
#: Contexts of an anchor, at their longest, that fit a block; an anchor with more is split by window.
HOT = BLOCK // (2 * LENGTH - GRAM)

#: Windows of a stretch that a record can hold; a longer stretch is two of the same anchor.
MOST = 127

_TOP = np.uint64(0xFFFFFFFFFF000000)
_LOW = np.uint64(0x0000000000FFFFFF)
_MASK48 = (1 << 48) - 1


# ---- anchors -------------------------------------------------------------------------------------------------


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbours."""
    n = len(v) - w + 1
    padded = np.concatenate([v, np.full(-len(v) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _piece_runs(text: np.ndarray, powers: Powers, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    up, down = powers.upto(len(text) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], dtype=np.uint64)])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1])
    places = _sliding_min((grams & _TOP) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _LOW
    new = np.concatenate([[True], places[1:] != places[:-1]])
    first = np.flatnonzero(new)
    if length - gram + 1 > MOST:
        within = np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))
        first = np.flatnonzero(within % MOST == 0)
    last = np.concatenate([first[1:], [len(places)]])
    contexts = (sums[last + length - 1] - sums[first]) * down[first]
    return grams[places[first].astype(np.int64)], first, last, contexts


def _hashed_runs(text: bytes, powers: Powers, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, end of windows, hash of the context) of the stretches of windows with the same anchor place.

    Long texts are hashed piece by piece; pieces overlap so that every window is in one. A stretch that is cut there
    is two stretches of the same anchor, which changes no result.
    """
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    found, at = [], 0
    while at + length <= len(raw):
        piece = raw[at : at + CHUNK + length - 1]
        anchors, first, last, contexts = _piece_runs(piece, powers, length, gram)
        found.append((anchors, first + at, last + at, contexts))
        at += len(piece) - length + 1
    return tuple(np.concatenate(x) for x in zip(*found))


def anchor_runs(text: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, end of windows) of the stretches of windows with the same anchor place."""
    return _hashed_runs(text, powers, length, gram)[:3]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, whose texts have at most so many bytes or are a single one."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            fit = int(np.searchsorted(ends, size + (ends[lo - 1] if lo else 0), "right"))
            hi = max(lo + 1, min(lo + rows, fit))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _text(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def _anchor_rows(parts: int, length: int, gram: int):
    """(part, blob) of packed 16-byte records: 40 bits of the anchor, 2 of the kind; 48 of the document; the place and the windows.

    Kinds: 0 stands for these rows, 1 does so and repeats among them, 3 repeats and stands for none. A record of kind 2 has
    no document: its place is the number of contexts that differ here, without the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in _batches(batches):
            docs = batch.column("d").to_numpy(zero_copy_only=False).astype(np.uint64)
            runs = [_hashed_runs(_text(t), powers, length, gram) for t in batch.column("text").to_pylist()]
            owner = np.repeat(docs, [len(r[0]) for r in runs])
            anchor = (np.concatenate([r[0] for r in runs]) >> np.uint64(24)) << np.uint64(24)
            place = np.concatenate([r[1] for r in runs]).astype(np.uint64)
            windows = np.concatenate([r[2] - r[1] for r in runs]).astype(np.uint64)
            context = np.concatenate([r[3] for r in runs])
            if not len(anchor):
                continue
            order = np.lexsort((context, anchor))
            anchor, owner, place, context, windows = anchor[order], owner[order], place[order], context[order], windows[order]
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            more = np.add.reduceat(np.concatenate([[False], context[1:] != context[:-1]]) & ~new, np.flatnonzero(new), dtype=np.int64)
            repeats = ~new | np.concatenate([~new[1:], [False]])
            part = anchor >> np.uint64(24)
            # the first of each anchor stands for this task; the others are known to repeat and go anywhere
            part = np.where(new, part, mix(owner + place)) % np.uint64(parts)
            kind = np.where(new, np.uint64(0), np.uint64(2)) + repeats.astype(np.uint64)
            high = anchor | (kind << np.uint64(22)) | (owner >> np.uint64(26))
            low = ((owner & np.uint64((1 << 26) - 1)) << np.uint64(38)) | (place << np.uint64(7)) | windows
            record = np.stack([high, low], 1)
            several = anchor[new][more > 0]
            record = np.concatenate([record, np.stack([several | np.uint64(2 << 22), more[more > 0].astype(np.uint64)], 1)])
            part = np.concatenate([part, (several >> np.uint64(24)) % np.uint64(parts)])
            order = np.argsort(part, kind="stable")
            record, part = record[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cuts[:-1]].astype(np.int32)),
                 pa.array([record[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["part", "blob"])

    return run


def _repeated():
    """(d, place, windows, anchor, contexts) of the anchor places that repeat; ``contexts`` is told by the places that stand for rows.

    Rows are sorted by part, and a part, which has all rows that stand for an anchor, is looked at by itself.
    """

    def solve(blobs: list[bytes]) -> pa.RecordBatch:
        record = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
        high, low = record[:, 0], record[:, 1]
        anchor, kind = high >> np.uint64(24), (high >> np.uint64(22)) & np.uint64(3)
        order = np.argsort(anchor, kind="stable")
        sorted_, kind = anchor[order], kind[order]
        standing, further = kind < 2, np.where(kind == 2, low[order], np.uint64(0)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        sizes = np.diff(np.append(new, len(sorted_)))
        count = np.repeat(np.add.reduceat(standing.astype(np.int64), new), sizes)
        contexts = count + np.repeat(np.add.reduceat(further, new), sizes)
        keep = ((count > 1) | (kind > 0)) & (kind != 2)
        high, low, contexts = high[order][keep], low[order][keep], np.where(standing, contexts, 0)[keep]
        doc = ((high & np.uint64((1 << 22) - 1)) << np.uint64(26)) | (low >> np.uint64(38))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc.astype(np.int64)), pa.array(((low >> np.uint64(7)) & np.uint64((1 << 31) - 1)).astype(np.int32)),
             pa.array((low & np.uint64(127)).astype(np.int32)), pa.array((high >> np.uint64(24)).astype(np.int64)), pa.array(contexts)],
            ["d", "place", "windows", "anchor", "contexts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        last = None
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                if part != last and blobs:
                    yield solve(blobs)
                    blobs = []
                last = part
                blobs.append(blob)
        if blobs:
            yield solve(blobs)

    return run


# ---- contexts ------------------------------------------------------------------------------------------------


def _context_rows(length: int):
    """(key, doc, thash, start, ctx): contexts of repeated anchors; without ``ctx``, a span that is known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1024):
            rows = batch.to_pydict()
            first: dict[tuple[int, bytes], tuple] = {}
            out: list[tuple] = []
            for doc, thash, text, places in zip(rows["doc"], rows["thash"], rows["text"], rows["places"]):
                raw = _text(text)
                for p in places:
                    # of a text whose hash another one shares, places that do not fit are left out
                    s, a, split = p["place"], p["anchor"], p["split"]
                    e = min(s + p["windows"], len(raw) - length + 1)
                    if e <= s:
                        continue
                    pieces = [(s, e)] if not split else [(w, w + 1) for w in range(s, e)]
                    for lo, hi in pieces:
                        ctx = raw[lo : hi + length - 1]
                        key = a if not split else int.from_bytes(hashlib.blake2b(ctx, digest_size=8).digest(), "little")
                        here = (doc is not None, doc, thash, lo)
                        known = first.get((key, ctx))
                        if known is None:
                            first[key, ctx] = here
                        elif known != here:
                            later = max(known, here)
                            first[key, ctx] = min(known, here)
                            out.append((int(thash) ^ lo, *later[1:], len(ctx), None))
            out += [(key, *here[1:], len(ctx), ctx) for (key, ctx), here in first.items()]
            if out:
                keys, docs, hashes, at, sizes, ctxs = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([k & (2**64 - 1) for k in keys], np.uint64).view(np.int64)),
                     pa.array(docs, batch.schema.field("doc").type), pa.array(hashes, pa.int64()),
                     pa.array(at, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ctxs, pa.binary())],
                    ["key", "doc", "thash", "start", "size", "ctx"])

    return run


# ---- the index -----------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of symbols below 512, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    depth = 7
    while True:
        order = np.argsort(key, kind="quicksort")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        steps = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank[order] = steps
        if steps[-1] == n - 1 or depth >= n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - depth] = rank[depth:] + 1
        key = rank * (n + 1) + after
        depth *= 2


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of a text, with samples at the ends of its runs.

    ``symbol`` and ``begin`` are the runs. For the row at the beginning of each run ``place`` is its text
    place, ``before`` that of the row above (the end of the run above) and ``common`` the length of
    their common prefix; ``place`` is in text order. The last symbol of the text must be its smallest, and single.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        bwt = text[order - 1].astype(np.int64)
        bwt[order == 0] = -1  # what precedes the whole text is a run of its own
        self.size = len(text)
        self.begin = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.symbol = bwt[self.begin]
        place, before = order[self.begin], order[np.maximum(self.begin - 1, 0)]
        common = _common(text, place, before)
        by_place = np.argsort(place)
        self.place, self.before, self.common = place[by_place], before[by_place], common[by_place]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text place, streamed from the samples: its neighbour in suffix order and the length they share.

        From a sampled place on, the neighbour moves along and the match shrinks by one a place, until the next sample.
        """
        counts = np.diff(np.append(self.place, self.size))
        back = np.arange(self.size) - np.repeat(self.place, counts)
        return np.repeat(self.before, counts) + back, np.repeat(self.common, counts) - back


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes, 7 symbols at a time; 0 for a suffix with itself."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, text.dtype)])
    words = np.zeros(n + 8, np.uint64)
    for k in range(7):
        words = (words << np.uint64(9)) | padded[k : k + n + 8].astype(np.uint64)
    out, active = np.zeros(len(a), np.int64), np.flatnonzero(a != b)
    while len(active):
        differ = words[a[active] + out[active]] ^ words[b[active] + out[active]]
        equal = sum((differ >> np.uint64(9 * k) == 0).astype(np.int64) for k in range(7))
        out[active] += equal
        active = active[equal == 7]
    return out


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, given in order: which of its windows also begin earlier among the contexts."""
    sizes = np.array([len(c) for c in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8).astype(np.uint16) + np.uint16(2)
    text[begins + sizes], text[-1] = 1, 0  # bytes are 2 and more, 1 ends a context, 0 the text
    neighbour, shared = RunIndex(text).statistics()
    within = np.arange(len(text)) - np.repeat(np.append(begins, len(text) - 1), np.append(sizes + 1, 1))
    window = within + length <= np.repeat(np.append(sizes, 0), np.append(sizes + 1, 1))
    linked = window & (shared >= length)
    head = np.where(linked, neighbour, np.arange(len(text)))
    while True:  # chains to their heads, by doubling
        further = head[head]
        if (further == head).all():
            break
        head = further
    first = np.full(len(text), len(text))
    places = np.flatnonzero(window)
    np.minimum.at(first, head[places], places)
    repeats = window & (first[head] < np.arange(len(text)))
    return [repeats[b : b + max(0, s - length + 1)] for b, s in zip(begins, sizes)]


def _spans(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edges[::2], edges[1::2])]


def _matcher(length: int, block: int):
    """(doc, thash, start, end) of the windows that repeat, from rows sorted by key; whole keys are indexed in blocks."""

    def solve(groups: list[dict[bytes, tuple]], out: list[tuple]) -> None:
        ordered = [(here, ctx) for first in groups if len(first) > 1 for ctx, here in first.items()]
        if ordered:
            ordered.sort(key=lambda x: x[0])
            flags = repeated_windows([ctx for _, ctx in ordered], length)
            for (here, _), f in zip(ordered, flags):
                out += [(here[1], here[2], a, b) for a, b in _spans(f, here[3], length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict[bytes, tuple]] = []  # the different contexts of each key, with their first places
        size, last, schema = 0, None, None

        def flush(out: list[tuple]) -> pa.RecordBatch:
            docs, hashes, starts, ends = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, schema), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["doc", "thash", "start", "end"])

        out: list[tuple] = []
        for batch in batches:
            schema = batch.schema.field("doc").type
            for key, doc, thash, start, n, ctx in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "thash", "start", "size", "ctx"))):
                if ctx is None:
                    out.append((doc, thash, start, start + n))
                    continue
                if key != last:
                    if size >= block:
                        solve(groups, out)
                        groups, size = [], 0
                    groups.append({})
                    last = key
                first, here = groups[-1], (doc is not None, doc, thash, start)
                known = first.get(ctx)
                if known is None:
                    first[ctx] = here
                    size += n
                elif known != here:
                    first[ctx] = min(known, here)
                    later = max(known, here)
                    out.append((later[1], later[2], later[3], later[3] + n))
            if out:
                yield flush(out)
                out = []
        solve(groups, out)
        if out:
            yield flush(out)

    return run


# ---- the operator --------------------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _batches(batches, 1024):
        rows = batch.to_pydict()
        removed, spans, kept = [], [], []
        for text, found in zip(rows["text"], rows["found"]):
            raw, at, n, k, left = _text(text), 0, 0, 0, []
            for x in sorted(found, key=lambda x: (x["start"], x["end"])):
                if x["start"] > at or not k:
                    left.append(raw[at : x["start"]])
                    k += 1
                    at = x["start"]
                if x["end"] > at:
                    n += x["end"] - at
                    at = x["end"]
            left.append(raw[at:])
            removed.append(n)
            spans.append(k)
            kept.append(b"".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("thash"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc", "thash", "n_removed", "n_spans", "kept"])


def contexts_by_key(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
) -> DataFrame:
    """(key, doc, thash, start, size, ctx): what is compared; contexts that share a window of ``length`` bytes have a key in common."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(col(doc_id).alias("doc"), col(text).alias("text")).where(F.octet_length("text") >= length) \
        .withColumn("thash", F.xxhash64("text")).withColumn("d", F.xxhash64("doc", "thash").bitwiseAND(F.lit(_MASK48)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = tasks * (1 + size // (tasks * SPAN))
    anchors = texts.select("d", "text").mapInArrow(_anchor_rows(parts, length, gram), "part int, blob binary")
    places = stored(
        anchors.repartition(tasks, "part").sortWithinPartitions("part")
        .mapInArrow(_repeated(), "d bigint, place int, windows int, anchor bigint, contexts bigint"), "places")
    split = stored(places.where(F.col("contexts") > hot).select("anchor").distinct().withColumn("split", F.lit(True)), "split")
    places = (
        places.join(small(split, split.count()), "anchor", "left").groupBy(F.col("d").alias("p_d"))
        .agg(F.collect_list(F.struct("place", "windows", "anchor", F.coalesce("split", F.lit(False)).alias("split"))).alias("places"))
    )
    return texts.join(places, F.col("d") == F.col("p_d")).select("doc", "thash", "text", "places").mapInArrow(
        _context_rows(length), f"key bigint, doc {kind}, thash bigint, start int, size int, ctx binary")


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    block: int = BLOCK, hot: int = HOT,
) -> DataFrame:
    """(doc, thash, start, end): byte ranges that repeat, overlapping ones included; ``thash`` is that of the text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts = contexts_by_key(docs, doc_id, text, length, gram, hot)
    return (
        contexts.repartition(parts, "key").sortWithinPartitions("key")
        .mapInArrow(_matcher(length, block), f"doc {kind}, thash bigint, start int, end int")
    )


def suffix_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    block: int = BLOCK, hot: int = HOT,
) -> DataFrame:
    """Every document with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (what is left, as UTF-8 bytes).

    Texts are bytes; a null text is empty. Documents come in the order of their ids, null first, and texts with equal ids
    in the order of a hash. Rows that agree in id and text are one document: they do not remove each other's bytes and have
    the same result. ``kept`` may begin or end inside a character, as the rule is on bytes. The other
    columns of ``docs`` follow, but for those that clash.
    """
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    extra = rest(docs, [doc_id, *out])
    kind = docs.schema[doc_id].dataType.simpleString()
    spans = stored(repeated_spans(docs, doc_id, text, length, gram, block, hot), "spans")
    found = stored(
        spans.groupBy(F.col("doc").alias("f_doc"), F.col("thash").alias("f_thash"))
        .agg(F.collect_list(F.struct("start", "end")).alias("found")), "found")
    texts = docs.select(col(doc_id).alias("doc"), col(text).alias("text")).withColumn("thash", F.xxhash64("text"))
    same = F.col("doc").eqNullSafe(F.col("f_doc")) & (F.col("thash") == F.col("f_thash"))
    names = found.select("f_doc", "f_thash")
    affected = texts.join(small(names, names.count()), same, "left_semi")
    cut = (
        affected.join(found, same).select("doc", "thash", "text", "found")
        .mapInArrow(_cut, f"doc {kind}, thash bigint, n_removed bigint, n_spans bigint, kept binary")
        .select(F.col("doc").alias("c_doc"), F.col("thash").alias("c_thash"), "n_removed", "n_spans",
                F.sha2("kept", 256).alias("c_sha"), "kept")
        .dropDuplicates(["c_doc", "c_thash"])
    )
    body = F.coalesce(col(text), F.lit("")).cast("binary")
    base = docs.select(
        col(doc_id).alias("_doc"), F.xxhash64(col(text)).alias("_thash"), F.octet_length(body).cast("bigint").alias("_bytes"),
        F.sha2(body, 256).alias("_sha"), body.alias("_body"), *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    joined = base.join(cut, F.col("_doc").eqNullSafe(F.col("c_doc")) & (F.col("_thash") == F.col("c_thash")), "left")
    return joined.select(
        F.col("_doc").alias(doc_id), F.col("_bytes").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("c_sha", "_sha").alias("kept_sha256"), F.coalesce("kept", "_body").alias("kept"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )

