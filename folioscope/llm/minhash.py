"""Near-duplicate documents by b-bit MinHash.

Each distinct shingle set gets 128 minima, whose bands of four give candidates, and a signature of 1024 further minima
(one a bin of one permutation), of which only four low bits are kept, packed in bit planes. The share of equal codes
among bins that are not empty, corrected for chance collisions, estimates a candidate pair's similarity by bit counts.
Pairs clearly below the threshold are dropped by that estimate, unless a set is small; the rest are confirmed on their
full shingle sets.

Only what decides the components is compared. Equal sets are one class. Within a band bucket each class is first
compared with the bucket's least class (a star, not all pairs); a star's centre travels once for each chunk of its
classes, each class with one text. After the links of the stars are joined into components, buckets that still hold
several components are searched in full, block by block. Blocks hold classes of about one size, and only blocks whose
sizes can reach the threshold meet: packed signatures name the classes that may link across components, these come
with their texts, and the block itself confirms links on full sets and emits those that join components, at most one
fewer than its classes. Hence no link that joins documents which the stars did not join is lost, and pairs are never
emitted. A pair is looked at in the first of its bands only.

Sets are compared as 64-bit hashes of shingles (a polynomial modulo 2**64, mixed): chance collisions don't matter at
any size of corpus, but texts built to collide could pass as equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.components import components
from folioscope.llm.memory import trimmed
from folioscope.llm.shingles import mix, shingle_sets
from folioscope.session import discard, materialize

HASHES = 128
ROWS = 4
BANDS = HASHES // ROWS
BINS = 1024
BITS = 4
CODES = (1 << BITS) - 1  # code 0 marks an empty bin
#: Estimates this far below the threshold (over five standard deviations) rule a pair out.
MARGIN = 0.07
#: Where a set fills fewer bins than this, one chance collision can outweigh the margin: no estimate rules it out.
SMALL_BINS = 64
#: Sets sketched at a time.
SKETCH_ROWS = 512
#: Classes that meet one copy of a star's centre.
STAR_CHUNK = 256
#: A block of a bucket holds about this many classes and shingles at most.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1_000_000
_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, SHIFTS = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Least value of each hash function over each non-empty set (sets x 128)."""
    flat = np.concatenate(sets)
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    out = np.empty((len(sets), HASHES), np.uint64)
    work = np.empty_like(flat)
    for k in range(HASHES):
        np.multiply(flat, FACTORS[k], out=work)
        np.add(work, SHIFTS[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """64-bit key of each band's four minima, salted by the band's number."""
    g = m.reshape(len(m), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), g.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + g[:, :, r])
    return h.view(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Codes of each set's least value a bin, one plane of packed bits for each kept bit (sets x BITS x BINS / 8)."""
    flat = mix(np.concatenate(sets) ^ np.uint64(0xC2B2AE3D27D4EB4F))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(sets) * BINS, empty)
    np.minimum.at(least, row * BINS + (flat & np.uint64(BINS - 1)).astype(np.int64), flat)
    code = np.where(least == empty, 0, 1 + (mix(least) >> np.uint64(8)) % np.uint64(CODES)).astype(np.uint8).reshape(-1, BINS)
    return np.stack([np.packbits(code >> b & 1, axis=1) for b in range(BITS)], axis=1)


def _counts(a: np.ndarray, b: np.ndarray):
    """Bins of signatures a and b (broadcasting over leading axes): filled by both and equal, filled by both, by either,
    filled by one or unequal, and the fewer filled of a's and b's."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    count = lambda x: np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
    full_a, full_b = np.bitwise_or.reduce(a, axis=-2), np.bitwise_or.reduce(b, axis=-2)
    differ = np.bitwise_or.reduce(a ^ b, axis=-2)
    both = full_a & full_b
    return count(both & ~differ), count(both), count(full_a | full_b), count(differ), np.minimum(count(full_a), count(full_b))


def _estimate(equal, both, either) -> np.ndarray:
    return (equal - both / CODES) / (1 - 1 / CODES) / np.maximum(either, 1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of signatures (broadcasting over leading axes)."""
    return _estimate(*_counts(a, b)[:3])


def allowed(a: np.ndarray, b: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """Whether signatures and set sizes leave a pair to be confirmed.

    A bin whose minima differ holds an element that only one set has, so unequal bins bound the symmetric difference
    from below: a bound that is never wrong, and close for sets much smaller than the bins. Beyond it the estimate must
    be at most MARGIN below the threshold, unless a set is small, where it rules nothing out."""
    equal, both, either, unequal, filled = _counts(a, b)
    possible = unequal * (100 + percent) <= (100 - percent) * (n_a + n_b)
    possible &= 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return possible & ((_estimate(equal, both, either) >= percent / 100 - MARGIN) | (filled < SMALL_BINS))


def _binary(column) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after the other."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]] if len(column) else np.zeros(0, np.uint8)


def _unpack(column) -> np.ndarray:
    return _binary(column).reshape(-1, BITS, BINS // 8)


def _sketch(batches):
    names = ["doc_id", "n_shingles", "k1", "k2", "signature", "bands"]
    for batch in batches:
        ids = batch.column("doc_id")
        for start, slice_ in shingle_sets(batch.column("text")):
            for lo in range(0, len(slice_), SKETCH_ROWS):
                sets = slice_[lo : lo + SKETCH_ROWS]
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                signature, bands = [None] * len(n), [None] * len(n)
                if len(full):
                    some = [sets[i] for i in full]
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    flat = np.concatenate(some)
                    k1[full] = np.add.reduceat(mix(flat), starts)
                    k2[full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
                    m = minima(some)
                    keys, packed = band_keys(m), signatures(some).reshape(len(m), -1)
                    for j, i in enumerate(full.tolist()):
                        signature[i], bands[i] = packed[j].tobytes(), keys[j]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start + lo, len(n)), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=names
                )


def _passing(percent: int):
    """Keeps candidate pairs (a, b, signatures, sizes) whose estimate allows the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
                ok = allowed(_unpack(batch.column("sa")), _unpack(batch.column("sb")), n_a, n_b, percent)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small)) if len(large) else 0


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = _shared(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm_stars(percent: int):
    """Links of star centres on full shingle sets: 100 * intersection >= percent * union.

    Rows (centre, chunk, class, text) come sorted, a chunk's centre (class null) before its classes; its sets are held
    while its classes pass by, so a centre of any number of classes needs its own sets only."""

    def run(batches):
        here, centre = None, []
        for batch in batches:
            centres, chunks, classes = (batch.column(c).to_pylist() for c in ("centre", "chunk", "class"))
            a, b = [], []
            for first, sets in shingle_sets(batch.column("text")):
                for i, x in enumerate(sets, first):
                    if (centres[i], chunks[i]) != here:
                        here, centre = (centres[i], chunks[i]), []
                    if classes[i] is None:
                        centre.append(x)
                    elif any(_linked(x, y, percent) for y in centre):
                        a.append(classes[i])
                        b.append(centres[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class _Side:
    """The classes of one block of a bucket, from row k of a column of lists of cells."""

    def __init__(self, column, k: int):
        offsets = np.asarray(column.offsets)
        cells = column.values.slice(int(offsets[k]), int(offsets[k + 1] - offsets[k]))
        own = lambda name: cells.field(cells.type.get_field_index(name))
        self.ids, self.comp, self.n = (own(c).to_numpy(zero_copy_only=False) for c in ("class", "comp", "n_shingles"))
        self.signature = _unpack(own("signature"))
        self.bands = own("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)


def _candidates(band: int, left: _Side, right: _Side, same: bool, percent: int):
    """For each class of `left`: its place and those of `right` that may link with it across components, and that
    share no band before this one."""
    for i in range(len(left.ids)):
        fit = (right.comp != left.comp[i]) & (100 * np.minimum(right.n, left.n[i]) >= percent * np.maximum(right.n, left.n[i]))
        at = np.flatnonzero(fit & (right.ids > left.ids[i]) if same else fit)
        if len(at):
            equal = right.bands[at] == left.bands[i]
            at = at[left.bands[i][equal.argmax(axis=1)] == band]
        if len(at):
            at = at[allowed(left.signature[i], right.signature[at], left.n[i], right.n[at], percent)]
        if len(at):
            yield i, at


def _block_rows(batch):
    column, other = batch.column("left"), batch.column("right")
    for k in range(batch.num_rows):
        left, same = _Side(column, k), not other[k].is_valid
        yield k, left, left if same else _Side(other, k), same


def _involved(percent: int):
    """(band, pair, class): the classes of a pair of blocks that have a candidate there."""

    def run(batches):
        for batch in batches:
            for k, left, right, same in _block_rows(batch):
                band, pair = batch.column("band")[k].as_py(), batch.column("pair")[k].as_py()
                found: set[int] = set()
                for i, at in _candidates(band, left, right, same, percent):
                    found.add(int(left.ids[i]))
                    found.update(right.ids[at].tolist())
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([band] * n, pa.int64()), pa.array([pair] * n, pa.string()), pa.array(sorted(found), pa.int64())], names=["band", "pair", "class"])

    return run


def _confirm_blocks(percent: int):
    """Components that links join in a pair of blocks, confirmed on the full sets of the texts that came with it."""

    def run(batches):
        for batch in batches:
            came = batch.column("texts")
            offsets = np.asarray(came.offsets)
            for k, left, right, same in _block_rows(batch):
                part = came.values.slice(int(offsets[k]), int(offsets[k + 1] - offsets[k]))
                owner = part.field(part.type.get_field_index("class")).to_pylist()
                sets: dict[int, list[np.ndarray]] = {}
                for first, some in shingle_sets(part.field(part.type.get_field_index("text"))):
                    for i, s in enumerate(some, first):
                        sets.setdefault(owner[i], []).append(s)
                parent: dict[int, int] = {}

                def find(x: int, parent=parent) -> int:
                    while parent.get(x, x) != x:
                        parent[x] = x = parent.get(parent[x], parent[x])
                    return x

                a, b = [], []
                for i, at in _candidates(batch.column("band")[k].as_py(), left, right, same, percent):
                    for j in at.tolist():
                        x, y = find(int(left.comp[i])), find(int(right.comp[j]))
                        p, q = int(left.ids[i]), int(right.ids[j])
                        if x != y and any(_linked(s, t, percent) for s in sets.get(p, ()) for t in sets.get(q, ())):
                            parent[max(x, y)] = min(x, y)
                            a.append(x)
                            b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text).

    Documents link where 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id
    reachable. Null texts and texts without words have an empty set, link with nothing and are kept. Rows that repeat
    a doc_id are one document, linked where any of its texts is. Rows with a null doc_id stand for themselves: they
    have a null component and are kept. Other columns of `docs` are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(source.mapInArrow(trimmed(_sketch), "doc_id long, n_shingles long, k1 long, k2 long, signature binary, bands array<long>"), "sketch")
    filled = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # One row a distinct set, named by its least doc_id.
    unique = materialize(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("class"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "unique")
    sig = unique.select("class", "signature", "n_shingles")
    banded = unique.select("class", "n_shingles", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(buckets, "buckets")  # joined from a table, a hot bucket can be split
    stars = materialize(banded.join(buckets, "band"), "stars")

    def texts_of(classes: DataFrame) -> DataFrame:
        """(class, text) of the classes named."""
        return materialize(source.join(classes.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "class"), "texts")

    pairs = stars.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()
    side = lambda x: sig.select(F.col("class").alias(x), F.col("signature").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    # Hot centres first: the join before the Python step then has even keys.
    signed = pairs.join(side("b"), "b").join(side("a"), "a")
    first = materialize(signed.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(trimmed(_passing(percent)), "a long, b long").distinct(), "pairs")
    texts = texts_of(first.select(F.col("a").alias("class")).union(first.select("b")))
    chunks = materialize(first.groupBy(F.col("b").alias("centre")).agg(F.ceil(F.count("*") / STAR_CHUNK).cast("int").alias("chunks")), "chunks")
    middle = chunks.select(F.col("centre"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(texts.withColumnRenamed("class", "centre"), "centre").select("centre", "chunk", F.lit(None).cast("long").alias("class"), "text")
    around = first.select(F.col("a").alias("class"), F.col("b").alias("centre")).join(chunks, "centre").select("centre", F.pmod(F.xxhash64("class"), "chunks").cast("int").alias("chunk"), "class").join(texts, "class").select("centre", "chunk", "class", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = middle.union(around).repartition(parts, "centre", "chunk").sortWithinPartitions("centre", "chunk", F.col("class").asc_nulls_first())
    confirmed = materialize(met.mapInArrow(trimmed(_confirm_stars(percent)), "a long, b long"), "links")
    discard(texts)
    # A doc_id that repeats with several sets joins their classes.
    repeated = filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    own = filled.select("doc_id", "k1", "k2").join(repeated, "doc_id").distinct().join(unique.select("k1", "k2", "class"), ["k1", "k2"])
    links = confirmed.union(own.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b")))
    comp = components(links)

    # Buckets in which several components are left. Their least class has met all others; sets whose sizes lie more
    # than one step of 100 / percent apart can't link, so blocks of a step meet their own and the next step's.
    placed = stars.where("n > 2 AND class <> least").select("band", "class", "n_shingles").join(comp.withColumnRenamed("node", "class"), "class", "left").select("band", "class", "n_shingles", F.coalesce("component", "class").alias("comp"))
    several = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    placed = materialize(placed.join(several, "band").withColumn("step", step), "several")
    count = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = materialize(placed.groupBy("band", "step").agg(count.alias("parts")), "sizes")
    above = sizes.select("band", (F.col("step") - 1).alias("step"), F.col("parts").alias("above"))
    cells = placed.join(sizes, ["band", "step"]).join(unique.select("class", "signature", "bands"), "class").withColumn("block", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    blocks = cells.groupBy("band", "step", "block").agg(F.collect_list(F.struct("class", "comp", "n_shingles", "signature", "bands")).alias("cells"))
    blocks = materialize(blocks.join(sizes, ["band", "step"]).join(above, ["band", "step"], "left"), "blocks")
    name = lambda *x: F.concat_ws("/", *x)
    inner = blocks.select("band", name("step", "block").alias("pair"), F.col("cells").alias("left"), F.lit(None).cast(blocks.schema["cells"].dataType).alias("right"))
    next_ = F.expr("IF(block < parts - 1, transform(sequence(block + 1, parts - 1), x -> struct(step AS step, x AS block)), array())")
    higher = F.expr("IF(above IS NULL, array(), transform(sequence(0, above - 1), x -> struct(step + 1 AS step, x AS block)))")
    lefts = blocks.select("band", F.col("step").alias("s"), F.col("block").alias("i"), F.col("cells").alias("left"), F.explode(F.concat(next_, higher)).alias("other"))
    rights = blocks.select("band", F.struct("step", "block").alias("other"), F.col("cells").alias("right"))
    outer = lefts.join(rights, ["band", "other"]).select("band", name("s", "i", "other.step", "other.block").alias("pair"), "left", "right")
    crossed = inner.union(outer)
    involved = materialize(crossed.mapInArrow(trimmed(_involved(percent)), "band long, pair string, class long"), "involved")
    texts = texts_of(involved)
    carried = involved.join(texts, "class").groupBy("band", "pair").agg(F.collect_list(F.struct("class", "text")).alias("texts"))
    more = materialize(crossed.join(carried, ["band", "pair"]).mapInArrow(trimmed(_confirm_blocks(percent)), "a long, b long"), "more-links")
    for used in (texts, involved, blocks, sizes, placed, chunks, first, stars, buckets):
        discard(used)
    named = unique.select("k1", "k2", "class").join(comp.withColumnRenamed("node", "class"), "class", "left").select("k1", "k2", F.coalesce("component", "class").alias("component_id"))
    if not more.isEmpty():  # only the components themselves are joined further
        tops = components(more).select(F.col("node").alias("component_id"), F.col("component").alias("top"))
        named = named.join(tops, "component_id", "left").select("k1", "k2", F.coalesce("top", "component_id").alias("component_id"))

    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
