"""Near duplicates by fast similarity sketching, banding and exact verification.

*Sketch.* Round ``i`` of the first ``T`` rounds throws every shingle into a random coordinate
with a random value in [i, i + 1); a coordinate keeps its smallest value. Rounds go on until all
coordinates are filled; ``T`` further rounds throw all shingles into one fixed coordinate each, which guarantees
that. Values agree with the probability of the similarity, concentrated as for
independent hashes, and large sets need one or two rounds only.

*Candidates.* Equal shingle sets are one class. Classes that agree in all ``ROWS`` values of a
band meet in a bucket. A bucket is not unfolded into pairs: each class is first compared with a few
hubs of its bucket, and the links are merged to components. Where a bucket still holds several
components, the classes of one are compared with those of the others, in blocks. Both comparisons look at sizes
and whole sketches first: a pair whose sketches agree far less than those of similar sets do (six standard deviations) is
no candidate, and is never written.

*Verification.* Candidates are compared by their whole shingle sets: those of the hubs in a join, those inside a block in the block, which
gets the sets of the classes that have a candidate there. A block joins components as it goes, skips pairs that are in one already, and
writes only the links that joined two, fewer than it has classes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix, rest, small, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words in a shingle; percent of similarity from which documents are linked.
SHINGLE, PERCENT = 5, 75
#: Coordinates in a band and bands: at similarity 0.75 a pair is missed with probability (1 - 0.75 ** 5) ** 44 < 1e-5.
ROWS, BANDS = 5, 44
#: Hubs that the classes of a bucket are compared with first.
STARS = 2
#: Classes of a bucket that are compared in one task group, and shingles they have together.
BLOCK, BLOCK_SHINGLES = 2_000, 2_000_000
#: Bytes that are hashed at a time.
CHUNK = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True


class Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P_INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def word_hashes(text: bytes, powers: Powers) -> np.ndarray:
    """A hash for each word of the text, piece by piece; pieces end at blanks."""
    out, at = [], 0
    while at < len(text):
        end = at + CHUNK
        if end >= len(text):
            end = len(text)
        else:
            while end < len(text) and not _WHITE[text[end]]:
                end += 1
        b = np.frombuffer(text, np.uint8, end - at, at)
        white = _WHITE[b]
        inside = np.concatenate([[False], ~white, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            up, down = powers.upto(len(b) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
            h = (sums[ends] - sums[starts]) * down[starts]
            out.append(mix(h + (ends - starts).astype(np.uint64) * _K))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, powers: Powers, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the different shingles; a shorter text is one shingle, one without words none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower(), powers)
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        h = h * _K + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h))


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` values for each set that is not empty."""
    out = np.full((len(sets), size), np.uint64(2**64 - 1))
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * size):
        if not len(items):
            break
        h = mix(items + np.uint64((i + 1) * int(_K) % 2**64))
        where = (h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32) if i < size else np.full(len(items), np.uint64(i - size))
        value = (np.uint64(i) << np.uint64(54)) | (mix(h) >> np.uint64(10))
        np.minimum.at(flat, owner * size + where.astype(np.int64), value)
        if i < 4 or i % 4 == 0:
            open_ = (out == np.uint64(2**64 - 1)).any(axis=1)
            keep = open_[owner]
            items, owner = items[keep], owner[keep]
    return out


def band_keys(sketches: np.ndarray, rows: int, bands: int) -> np.ndarray:
    values = sketches.reshape(len(sketches), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _K, values.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * _P + values[:, :, r])
    return keys


def _set_digest(s: np.ndarray) -> bytes:
    """128 bits of a set; two sums of scrambled members, and so of the set alone."""
    a, b = mix(s * _K), mix(s + _P)
    both = np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64) ^ np.uint64(len(s))], dtype=">u8")
    return both.tobytes()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _sketcher(size: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in _parts(batches):
            sets = [shingle_set(t, powers, size) for t in part.column("text").to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            lists, sigs = [np.zeros(0, np.uint64)] * len(sets), [b""] * len(sets)
            if full:
                sketches = sketch([sets[k] for k in full], rows * bands)
                bytes_ = (mix(sketches) & np.uint64(255)).astype(np.uint8)
                for k, row, sig in zip(full, band_keys(sketches, rows, bands), bytes_):
                    lists[k], sigs[k] = row, sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("thash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_set_digest(s) for s in sets], pa.binary()), _lists(lists), pa.array(sigs, pa.binary())],
                ["doc", "thash", "n", "cls", "bands", "sig"])

    return run


def _set_maker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in _parts(batches):
            sets = [shingle_set(t, powers, size) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("cls"), _lists(sets)], ["cls", "members"])

    return run


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(cls, comp): the smallest node that each linked node reaches.

    Labels spread along the links and jump to the label of their label, so the number of
    rounds grows with the logarithm of the longest path. While the labels are few, counted first, they
    are broadcast, and a round is one aggregation.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("cls"), F.min("b")).alias("comp")), "labels")
    nodes = labels.count()
    for _ in range(rounds):
        known = small(labels, nodes)
        heard = both.join(known, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("heard"))
        spread = heard.join(known, F.col("cls") == F.col("a")).select("cls", F.least("comp", "heard").alias("next"), "comp")
        jump = small(labels.select(F.col("cls").alias("via"), F.col("comp").alias("far")), nodes)
        after = stored(
            spread.join(jump, F.col("next") == F.col("via"))
            .select("cls", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("new")), "labels")
        changed = after.where("new").limit(1).count()
        labels = after.select("cls", "comp")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, which are followed between components only."""
    named = comps.select(F.col("cls").alias("of"), F.col("comp").alias("at"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(named, F.col(end) == F.col("of"), "left").withColumn(end, F.coalesce("at", end)).drop("of", "at")
    roots = stored(components(ends.where("a <> b").distinct()), "roots")
    moved = roots.select(F.col("cls").alias("of"), F.col("comp").alias("at"))
    old = comps.join(moved, F.col("comp") == F.col("of"), "left").select("cls", F.coalesce("at", "comp").alias("comp"))
    return old.unionByName(roots.join(comps.select("cls"), "cls", "left_anti").select("cls", "comp"))


def _set_reader(texts: DataFrame, involved: DataFrame, size: int):
    """From a table of classes (cls) to their whole sets, made anew from a text of each."""

    def read(wanted: DataFrame) -> DataFrame:
        chosen = stored(
            involved.join(wanted.distinct(), "cls", "left_semi")
            .select(F.col("r.doc").alias("w_doc"), F.col("r.thash").alias("w_thash"), "cls"), "wanted")
        return (
            texts.join(small(chosen, chosen.count()), F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("thash") == F.col("w_thash")))
            .select("cls", "text").mapInArrow(_set_maker(size), "cls binary, members array<bigint>")
            .groupBy("cls").agg(F.first("members").alias("members"))
        )

    return read


def _verified(pairs: DataFrame, sets_of, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = stored(pairs, "pairs")
    sets = stored(sets_of(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))), "sets")
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("mb"))
    common = F.size(F.array_intersect("ma", "mb"))
    return (
        pairs.join(left, "a").join(right, "b").withColumn("common", common)
        .where(F.col("common") * 100 >= (F.size("ma") + F.size("mb") - F.col("common")) * percent)
        .select("a", "b")
    )


def agreement(size: int, percent: int) -> int:
    """Of ``size`` coordinates, how many must agree: six standard deviations less than expected at the least similarity."""
    p = percent / 100
    return int(size * p - 6 * (size * p * (1 - p)) ** 0.5)


def _columns(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    keys = batch.column("key").to_numpy(zero_copy_only=False)
    cls = batch.column("cls").to_pylist()
    n = batch.column("n").to_numpy(zero_copy_only=False)
    sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, size)
    return keys, cls, n, sigs


def _near(n: int, sig: np.ndarray, ns: np.ndarray, sigs: np.ndarray, need: int, percent: int) -> np.ndarray:
    """Which of many classes may be similar enough to one, by size and sketch."""
    sizes = np.minimum(ns, n) * 100 >= np.maximum(ns, n) * percent
    out = np.flatnonzero(sizes)
    return out[(sigs[out] == sig).sum(1) >= need]


def _emit(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    ordered = {(min(x), max(x)) for x in found}
    a, b = zip(*ordered)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _star_pairs(stars: int, size: int, need: int, percent: int):
    """Pairs of the classes with the first ``stars`` of their bucket, from rows sorted by key and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hubs = None, []
        for batch in batches:
            keys, cls, n, sigs = _columns(batch, size)
            found: list[tuple[bytes, bytes]] = []
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != last:
                    last, hubs = keys[lo], []
                for k in range(lo, min(hi, lo + stars - len(hubs))):
                    hubs.append((cls[k], n[k], sigs[k].copy()))
                for hub, hub_n, hub_sig in hubs:
                    for k in lo + _near(hub_n, hub_sig, n[lo:hi], sigs[lo:hi], need, percent):
                        if cls[k] != hub:
                            found.append((hub, cls[k]))
            if found:
                yield _emit(found)

    return run


def _blocks_of(batches: Iterator[pa.RecordBatch], size: int, extra: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The blocks of rows sorted by key and blocks: lists of (cls, comp, n, sig, mine, alone, ...)."""
    rows: list[tuple] = []
    last = None
    for batch in batches:
        keys, cls, n, sigs = _columns(batch, size)
        comps, mine, first, second = (batch.column(c).to_pylist() for c in ("comp", "mine", "first", "second"))
        more = [batch.column(c) for c in extra]
        for k in range(len(keys)):
            if (keys[k], first[k], second[k]) != last:
                if len(rows) > 1:
                    yield rows
                rows, last = [], (keys[k], first[k], second[k])
            rows.append((cls[k], comps[k], n[k], sigs[k].copy(), mine[k], first[k] == second[k], *(np.asarray(c[k].values) for c in more)))
    if len(rows) > 1:
        yield rows


def _block_wanted(size: int, need: int, percent: int):
    """The classes that have a candidate of another component in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches, size, ()):
            ns, sigs = np.array([r[2] for r in rows]), np.stack([r[3] for r in rows])
            names: dict[bytes, int] = {}
            comps = np.array([names.setdefault(r[1], len(names)) for r in rows])
            mine = np.array([r[4] for r in rows])
            wanted = np.zeros(len(rows), bool)
            for k, row in enumerate(rows):
                near = k + 1 + _near(row[2], row[3], ns[k + 1 :], sigs[k + 1 :], need, percent)
                near = near[(comps[near] != comps[k]) & (row[5] | (mine[near] != mine[k]))]
                wanted[near] = True
                wanted[k] |= len(near) > 0
            if wanted.any():
                yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in np.flatnonzero(wanted)], pa.binary())], ["cls"])

    return run


def _block_links(size: int, need: int, percent: int):
    """Of the linked pairs of a block those that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches, size, ("members",)):
            ns, sigs = np.array([r[2] for r in rows]), np.stack([r[3] for r in rows])
            names: dict[bytes, int] = {}
            comps = np.array([names.setdefault(r[1], len(names)) for r in rows])
            mine = np.array([r[4] for r in rows])
            found: list[tuple[bytes, bytes]] = []
            for k, (cls, _, n, sig, own, alone, members) in enumerate(rows):
                near = k + 1 + _near(n, sig, ns[k + 1 :], sigs[k + 1 :], need, percent)
                for j in near[(comps[near] != comps[k]) & (alone | (mine[near] != own))]:
                    if comps[j] == comps[k]:  # joined since
                        continue
                    common = len(np.intersect1d(members, rows[j][6], assume_unique=True))
                    if 100 * common >= percent * (len(members) + len(rows[j][6]) - common):
                        found.append((cls, rows[j][0]))
                        comps[comps == comps[j]] = comps[k]
            if found:
                yield _emit(found)

    return run


def _in_blocks(apart: DataFrame, block: int) -> DataFrame:
    """Rows of buckets of several components, large buckets cut into blocks of about ``block`` rows, once for each pair of blocks."""
    sizes = apart.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    blocks = F.ceil(F.greatest(F.col("rows") / block, F.col("n") / BLOCK_SHINGLES)).cast("int")
    cut = apart.join(sizes.select("key", blocks.alias("blocks")), "key")
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("mine", o).alias("first"), F.greatest("mine", o).alias("second")))
    return cut.select("key", "cls", "comp", "n", "sig", "mine", F.inline(pairs))


def judged(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
    rows: int = ROWS, bands: int = BANDS, stars: int = STARS, block: int = BLOCK,
) -> DataFrame:
    """(doc, thash, n, least): per row its id, the hash of its text, the size of its set, the smallest id linked to it."""
    texts = docs.select(col(doc_id).alias("doc"), col(text).alias("text")).withColumn("thash", F.xxhash64("text"))
    schema = f"doc {docs.schema[doc_id].dataType.simpleString()}, thash bigint, n bigint, cls binary, bands array<bigint>, sig binary"
    sketched = stored(texts.select("doc", "thash", "text").mapInArrow(_sketcher(size, rows, bands), schema), "sketches")

    classes = stored(
        sketched.where("n > 0").groupBy("cls")
        .agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
             F.min(F.struct("doc", "thash")).alias("r")), "classes")
    keys = classes.select(F.explode("bands").alias("key"), "cls")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key")
    members = stored(keys.join(shared, "key"), "members")
    involved = stored(classes.join(members.select("cls").distinct(), "cls", "left_semi").drop("bands"), "involved")
    marked = members.join(involved.select("cls", "n", "sig"), "cls")
    parts, size_of_sketch = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * bands
    need = agreement(size_of_sketch, percent)

    sets_of = _set_reader(texts, involved, size)
    comps: DataFrame | None = None
    links: DataFrame | None = None
    if stars:
        pairs = (
            marked.withColumn("turn", F.xxhash64("cls")).repartition(parts, "key").sortWithinPartitions("key", "turn", "cls")
            .select("key", "cls", "n", "sig").mapInArrow(_star_pairs(stars, size_of_sketch, need, percent), "a binary, b binary").distinct()
        )
        links = stored(_verified(pairs, sets_of, percent), "links")
        if links.limit(1).count():
            comps = stored(components(links), "components")
    # the rest: buckets that still hold several components, the classes of each against those of the others
    if comps is None:
        apart = marked.withColumn("comp", F.col("cls"))
    else:
        apart = marked.join(small(comps, comps.count()), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    order = ["key", "first", "second"]
    blocks = stored(_in_blocks(apart, block), "blocks")
    wanted = stored(
        blocks.repartition(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_block_wanted(size_of_sketch, need, percent), "cls binary").distinct(), "candidates")
    sets = stored(sets_of(wanted), "sets")
    more = stored(
        blocks.join(sets, "cls").repartition(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_block_links(size_of_sketch, need, percent), "a binary, b binary").distinct(), "more")
    if more.limit(1).count():
        comps = components(more) if comps is None else _joined(comps, more)
        comps = stored(comps, "components")

    known = sketched.select("doc", "thash", "n", "cls")
    if comps is not None:
        known = known.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    else:
        known = known.withColumn("comp", F.col("cls"))
    known = stored(known.select("doc", "thash", "n", "comp"), "known")
    smallest = stored(known.where("n > 0").groupBy("comp").agg(F.min("doc").alias("least")), "smallest")
    return known.join(smallest, "comp", "left").select(
        "doc", "thash", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("least"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
    rows: int = ROWS, bands: int = BANDS, stars: int = STARS, columns: list[str] | None = None,
) -> DataFrame:
    """Every document with ``n_shingles``, ``component_id`` and ``kept``.

    Words are what blanks separate, with A-Z in lower case. Documents are linked if the similarity of their
    sets of ``size``-word shingles is ``percent`` or more; ``component_id`` is the smallest id that links
    reach, and the document with that id is kept. A text of fewer words is one shingle; a null, empty or blank text has none, is linked
    with nothing and kept. A null id is never the smallest; rows that agree in id are one document, all kept or
    none. The other ``columns`` of ``docs`` (all, unless named) follow, but for those that clash.
    """
    out = ["n_shingles", "component_id", "kept"]
    extra = rest(docs, [doc_id, *out]) if columns is None else columns
    found = judged(docs, doc_id, text, size, percent, rows, bands, stars)
    if extra:
        own = found.distinct().select(F.col("doc").alias("j_doc"), F.col("thash").alias("j_thash"), "n", "least")
        found = docs.select(
            col(doc_id).alias("doc"), F.xxhash64(col(text)).alias("thash"), *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
        ).join(own, F.col("doc").eqNullSafe(F.col("j_doc")) & (F.col("thash") == F.col("j_thash")))
    return found.select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("least")).alias("kept"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are kept, whole rows: of each group of linked ones that with the smallest id."""
    found = judged(docs, doc_id, text, **options)
    dropped = stored(
        found.where(~F.col("doc").eqNullSafe(F.col("least"))).select(F.col("doc").alias("j_doc"), F.col("thash").alias("j_thash")).distinct(),
        "dropped")
    return docs.join(
        small(dropped, dropped.count()),
        col(doc_id).eqNullSafe(F.col("j_doc")) & (F.xxhash64(col(text)) == F.col("j_thash")), "left_anti")
