"""Variable-capacity best-fit packing of token sequences.

Pieces are packed in order of falling length: each goes to the open bin that it leaves least room in; where none has
room, a bin is opened whose size costs least for what can still fill it. At the end every bin shrinks to the smallest
permitted size that holds its contents. Lengths are at most the largest size, so the histogram of lengths (one row a
length, whatever the corpus) decides the whole packing: equal pieces are placed in runs on the driver, and a piece
finds its bin from its length and its rank among pieces of that length.

Lengths are numbers of token ids, as `token_files` writes them: a piece (doc_id, start, length) is those ids of its
document, so `fill` cuts them out of the ids and lays them into their bins.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed
from folioscope.llm.sharding import row_numbers
from folioscope.llm.token_files import encoder
from folioscope.session import materialize

SIZES = (512, 1024, 2048)
#: Cost of a bin beside its size, in tokens.
OVERHEAD = 16


@dataclass
class Plan:
    """Runs of equal pieces, in the order of pieces (length falling): the run from piece `first[i]` on puts `per[i]`
    pieces each in bins `bin[i]`, `bin[i]` + 1, ..., from `offset[i]` on; bins from `bin_first[j]` on have
    `capacity[j]`."""

    first: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bin_first: list[int] = field(default_factory=list)
    capacity: list[int] = field(default_factory=list)
    bins: int = 0


def cheapest(length: int, count: int, lighter: int, sizes: tuple[int, ...], overhead: int = OVERHEAD) -> int:
    """The size to open for `count` pieces of `length` when shorter pieces hold `lighter` tokens: least cost a token,
    smaller size on ties. Room that pieces of this length leave counts as filled as far as shorter ones last."""

    def cost(size: int) -> float:
        own = min(size // length, count)
        opened = -(-count // own)
        room = size - own * length
        return (size + overhead) / (own * length + min(room, lighter / opened))

    return min((s for s in sizes if s >= length), key=lambda s: (cost(s), s))


def plan_packing(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> Plan:
    """Best-fit over a histogram of lengths (1 to the largest size), as if piece by piece."""
    sizes = tuple(sorted(sizes))
    plan = Plan()
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> runs of bins (first, number, size)
    rooms: list[int] = []
    closed: list[tuple[int, int, int, int]] = []  # first, number, contents, size
    lighter = sum(n * c for n, c in histogram.items())
    placed = 0

    def put(room: int, first: int, number: int, size: int) -> None:
        if not number:
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        bisect.insort(open_[room], (first, number, size))

    def take(room: int) -> tuple[int, int, int]:
        run = open_[room].pop(0)
        if not open_[room]:
            del open_[room]
            rooms.remove(room)
        return run

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        lighter -= length * count
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                size = cheapest(length, count, lighter, sizes, overhead)
                number = max(1, count // (size // length))
                put(size, plan.bins, number, size)
                plan.bins += number
                continue
            room = rooms[at]
            first, number, size = take(room)
            per = room // length
            full = min(number, count // per)
            if full == 0:
                full, per = 1, count
            for name, v in (("first", placed), ("length", length), ("per", per), ("bin", first), ("offset", size - room)):
                getattr(plan, name).append(v)
            placed += full * per
            count -= full * per
            put(room - per * length, first, full, size)
            put(room, first + full, number - full, size)
    for room, runs in open_.items():
        closed += [(first, number, size - room, size) for first, number, size in runs]
    for first, _, contents, _ in sorted(closed):
        plan.bin_first.append(first)
        plan.capacity.append(next(s for s in sizes if s >= contents))
    return plan


def token_lengths(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """(doc_id, length): the token ids of each text and its end id; null text is empty."""

    def run(batches):
        own = encoder(vocabulary, end_id)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own.lengths(b.column("text")))], names=["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, length long")


def pack(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """Where each piece of each row of `lengths` (doc_id, length) goes: doc_id, piece, start, length, bin, bin_offset,
    capacity.

    Rows longer than the largest size are cut into pieces of it and a rest; rows of length 0 or null take no place
    and no row. Equal lengths are placed in order of doc_id (nulls first) and piece; repeated rows are packed one by
    one; an empty table gives an empty result."""
    spark, most = lengths.sparkSession, max(sizes)
    rows = lengths.where("length > 0").select("doc_id", F.col("length").cast("long").alias("total"))
    last = F.ceil(F.col("total") / most).cast("long") - 1
    pieces = rows.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(most).cast("long"), F.col("total") - F.col("piece") * most).alias("length"), (-F.least(F.lit(most).cast("long"), F.col("total") - F.col("piece") * most)).alias("__falling"))
    numbered, _ = row_numbers(pieces, ["__falling", "doc_id", "piece"])
    histogram = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}  # one row a length
    plan = plan_packing(histogram, sizes, overhead)
    shared = spark.sparkContext.broadcast({k: np.array(getattr(plan, k), np.int64) for k in ("first", "length", "per", "bin", "offset", "bin_first", "capacity")})

    def place(batches):
        p = shared.value
        for b in batches:
            row = b.column("__row").to_numpy(zero_copy_only=False)
            run = np.searchsorted(p["first"], row, "right") - 1
            step = row - p["first"][run]
            at = p["bin"][run] + step // p["per"][run]
            offset = p["offset"][run] + step % p["per"][run] * p["length"][run]
            capacity = p["capacity"][np.searchsorted(p["bin_first"], at, "right") - 1]
            piece = b.column("piece").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), pa.array(piece * most), b.column("length"), pa.array(at), pa.array(offset), pa.array(capacity)], names=["doc_id", "piece", "start", "length", "bin", "bin_offset", "capacity"])

    return numbered.select("doc_id", "piece", "length", "__row").mapInArrow(trimmed(place), "doc_id long, piece long, start long, length long, bin long, bin_offset long, capacity long")


def pack_documents(docs: DataFrame, vocabulary: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Pack the texts of `docs` by their token ids under the tokenizer file `vocabulary`, each with one end id; null
    texts are empty (the end id alone), other columns are ignored."""
    return pack(materialize(token_lengths(docs, vocabulary), "lengths"), sizes)


def fill(placed: list[tuple[int, int, int, int, np.ndarray]], pad: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bins (ids and, for each id, 1 + the place of its piece in the bin, 0 for padding) from pieces (bin, capacity,
    bin_offset, length, ids)."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    number: dict[int, int] = {}
    for at, capacity, offset, length, ids in sorted(placed, key=lambda p: (p[0], p[2])):
        if at not in out:
            out[at] = np.full(capacity, pad, np.uint32), np.zeros(capacity, np.int32)
        number[at] = number.get(at, 0) + 1
        out[at][0][offset : offset + length] = ids
        out[at][1][offset : offset + length] = number[at]
    return out
