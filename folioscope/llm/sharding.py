"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

A keyed balanced Feistel network is a bijection on the power of four just above N; cycle walking (apply it again
while the image is outside 0..N-1) makes it a bijection on 0..N-1. With p = permute(row number), the shard is
p mod S and the slot is p div S, so shard sizes differ by at most one, slots are gapless, and both are computable
from the row number alone; `unpermute` leads back from (shard, slot) to the row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed
from folioscope.session import fanout, materialize

ROUNDS = 6
MASK32 = 0xFFFFFFFF
IN_PARTITION = (1 << 33) - 1


def half_bits(n: int) -> int:
    """Bits of one Feistel half: the smallest h with 4**h >= n."""
    h = 1
    while 1 << (2 * h) < n:
        h += 1
    return h


def round_keys(seed: int) -> list[int]:
    """One 31-bit key a round, from the seed by a multiplicative generator."""
    keys, x = [], (seed * 2654435761 + 0x9E3779B9) & MASK32
    for _ in range(ROUNDS):
        x = (x * 1664525 + 1013904223) & MASK32
        keys.append(x >> 1)
    return keys


def _mix(x: int, key: int, bits: int) -> int:
    x = (x + key) & 0x7FFFFFFF
    x = (x * 0x2C1B3C6D) & 0x7FFFFFFF
    x ^= x >> 15
    x = (x * 0x297A2D39) & 0x7FFFFFFF
    x ^= x >> 13
    return x & ((1 << bits) - 1)


def permute(i: int, n: int, seed: int = 0) -> int:
    """Image of row number i in 0..n-1 (plain integers)."""
    h, keys = half_bits(n), round_keys(seed)
    while True:
        left, right = i >> h, i & ((1 << h) - 1)
        for k in keys:
            left, right = right, left ^ _mix(right, k, h)
        i = left << h | right
        if i < n:
            return i


def unpermute(p: int, n: int, seed: int = 0) -> int:
    """Row number whose image is p."""
    h, keys = half_bits(n), round_keys(seed)
    while True:
        left, right = p >> h, p & ((1 << h) - 1)
        for k in reversed(keys):
            left, right = right ^ _mix(left, k, h), left
        p = left << h | right
        if p < n:
            return p


def permute_array(i: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """`permute` over an array of row numbers: images outside 0..n-1 walk on until none is left."""
    h, keys = half_bits(n), round_keys(seed)
    out, at = i.astype(np.int64), np.arange(len(i))
    while len(at):
        x = out[at]
        left, right = x >> h, x & ((1 << h) - 1)
        for k in keys:
            left, right = right, left ^ _mix(right, k, h)
        out[at] = x = left << h | right
        at = at[x >= n]
    return out


def row_numbers(df: DataFrame, order: list[str], name: str = "__row") -> tuple[DataFrame, int]:
    """Dense global row numbers from 0 in the order of the columns `order`, and the number of rows.

    Range partitions are sorted, written once to the shared folder with each row's place in its partition, and the
    partitions' sizes (one row a partition) are summed into offsets. Rows equal in every column are interchangeable,
    so the input position may break ties: one repeated row cannot fill one range.
    """
    keyed = df.withColumn("__tie", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(fanout(df), *order, "__tie").sortWithinPartitions(*order, "__tie")
    placed = materialize(placed.withColumn("__at", F.monotonically_increasing_id()).drop("__tie"), "rows")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(IN_PARTITION).cast("long"))
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    offsets = df.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "__part long, __start long")
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__start") + place).drop("__part", "__start", "__at"), total


def shard_by_rows(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs` (law `rows`).

    Rows are numbered by (doc_id, checksum, size); other columns of `docs`, whatever their names, are ignored. Null
    text counts as no bytes (size 16, checksum 0), null doc_ids come first, repeated rows are numbered one by one, and an
    empty table gives an empty result.
    """
    raw = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    numbered, n = row_numbers(rows, ["doc_id", "text_crc32", "size"])

    def place(batches):
        for batch in batches:
            p = permute_array(batch.column("__row").to_numpy(zero_copy_only=False), n, seed)
            cols = [batch.column(c) for c in ("doc_id", "size", "text_crc32")]
            m = len(p)
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(["rows"] * m, pa.string()), pa.array((p % shards).astype(np.int32)), pa.array(p // shards), pa.nulls(m, pa.int32())],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    return numbered.mapInArrow(trimmed(place), "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
