"""Repeated passages: documents are aligned pair by pair and aligned common blocks leave the later document.

Documents overlap where they share rare lines, or a run of lines. A line that a few documents have pairs them all. Every
shortest run of lines that reaches the words of a block is hashed, from each line forward and from each line back, and
pairs each document that has it with the first that has; so every block of a document that an earlier one has is in some
pair, however often and in however many documents it stands, and pairs stay in proportion to lines.

Each pair is aligned by patience diff on line hashes: lines that occur once in both are matched in their longest common
order, and runs between matches are aligned again. An aligned block of at least a few words is deleted from the document
with the larger doc_id. A run that named the pair and that this alignment left (it stands in another order, or has no
line that is unique in both) is aligned by itself with its place in the earlier document. Nothing is deleted but what an
alignment of a pair matched. Lines and runs are told apart by 64-bit hashes of their bytes (a polynomial modulo 2**64,
mixed): chance collisions don't matter at any size of corpus, but lines built to collide could pass as equal.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed
from folioscope.llm.shingles import count_words, mix, slices, span_hashes, string_buffers
from folioscope.session import discard, materialize

#: A line is rare up to so many documents; rare lines pair all of them.
RARE = 4
#: Lines of fewer words don't make documents candidates for alignment (they take part in alignments and in runs).
LINE_WORDS = 3
#: Blocks of fewer words stay.
BLOCK_WORDS = 8
WORD = re.compile(r"[^\x20\x09-\x0D]")


def longest_rising(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops, ends, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (i, j) of a patience diff, rising in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        once = [(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where]
        anchors = [once[k] for k in longest_rising([j for _, j in once])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def common_lines(a: list, b: list, words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Positions in `b` of aligned blocks (lines that follow each other in both) of at least `least` words."""
    out, block = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[k] for _, k in block) >= least:
                out += [k for _, k in block]
            block = []
        block.append((i, j))
    return out


def named_runs(a: list, b: list, words: list[int], runs: list[tuple[int, int]], least: int = BLOCK_WORDS) -> list[int]:
    """Positions in `b` to delete: aligned blocks, and of the runs (first and last position in `b`, of at least `least`
    words) those left by them, each aligned by itself with its first place in `a`."""
    out = set(common_lines(a, b, words, least))
    left = [(i, j) for i, j in runs if not out.issuperset(range(i, j + 1))]
    if left:
        places: dict = {}
        for k, h in enumerate(a):
            places.setdefault(h, []).append(k)
        for i, j in left:
            run = b[i : j + 1]
            at = next((k for k in places.get(run[0], ()) if a[k : k + len(run)] == run), None)
            if at is not None:
                out.update(i + k for k in common_lines(a[at : at + len(run)], run, words[i : j + 1], least))
    return sorted(out)


def _line_table(batches):
    """One row a document: numbers, hashes and word counts of its lines that have words."""
    names = ["doc_id", "text_hash", "lines", "hashes", "words"]
    for b in batches:
        data, offsets = string_buffers(b.column("text"))
        for lo, hi in slices(offsets):
            part = offsets[lo : hi + 1]
            base = int(part[0])
            text, cut = data[base : int(part[-1])], part - base
            breaks = np.flatnonzero(text == 10)
            line_at = np.unique(np.concatenate([cut[:-1], breaks + 1]))
            line_at = line_at[line_at < len(text)]
            stops = np.concatenate([line_at[1:], [len(text)]]) if len(line_at) else line_at
            words = count_words(text, np.concatenate([line_at, [len(text)]])) if len(line_at) else np.zeros(0, np.int64)
            real = stops - (text[stops - 1] == 10) if len(stops) else stops
            hashes = span_hashes(text, line_at, real).view(np.int64)
            row = np.searchsorted(cut, line_at, "right") - 1
            number = np.arange(len(line_at)) - np.searchsorted(row, row, "left")
            keep = words > 0
            row, number, hashes, words = row[keep], number[keep], hashes[keep], words[keep]
            at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (number.astype(np.int32), hashes, words.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("text_hash").slice(lo, hi - lo), *lists], names=names)


def _runs(least: int):
    """One row a run: the shortest runs of at least `least` words from each line on and up to each line."""

    def run(batches):
        for b in batches:
            tables = [b.column(c) for c in ("lines", "hashes", "words")]
            numbers, hashes, words = (x.flatten().to_numpy(zero_copy_only=False) for x in tables)
            sizes = np.diff(np.asarray(tables[0].offsets))
            row = np.repeat(np.arange(len(sizes)), sizes)
            total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])  # rises at each line, as each has words
            at = np.arange(len(words))
            end = np.searchsorted(total[1:], total[:-1] + least)
            start = np.searchsorted(total[:-1], total[1:] - least, "right") - 1
            lo, hi = np.concatenate([at, start]), np.concatenate([end, at])
            inside = (lo >= 0) & (hi < len(words))
            lo, hi = lo[inside], hi[inside]
            inside = row[lo] == row[hi]
            lo, hi = np.divmod(np.unique(lo[inside] * len(words) + hi[inside]), max(1, len(words)))
            n = hi - lo + 1
            h = n.astype(np.uint64)
            for k in range(int(n.max(initial=0))):
                part = hashes[np.minimum(lo + k, hi)].view(np.uint64)
                h = np.where(n > k, mix(h * np.uint64(0xD6E8FEB86659FD93) + part), h)
            first = np.concatenate([[0], np.cumsum(n)])
            cells = numbers[np.repeat(lo - first[:-1], n) + np.arange(first[-1])]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(cells, pa.int32()))
            owner = pa.array(row[lo])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(owner), b.column("text_hash").take(owner), pa.array(h.view(np.int64)), lists], names=["doc_id", "text_hash", "hash", "lines"])

    return run


def repeated_lines(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text_hash, lines): numbers (from 0) of the lines to delete; one row for each text that loses any."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    source = source.withColumn("text_hash", F.xxhash64("text"))
    tables = materialize(source.select("doc_id", "text_hash", "text").mapInArrow(trimmed(_line_table), "doc_id long, text_hash long, lines array<int>, hashes array<long>, words array<int>"), "lines")
    enough = F.filter(F.arrays_zip("hashes", "words"), lambda x: x["words"] >= LINE_WORDS)
    # A line counts once a text, however often it stands there.
    lines = tables.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform(enough, lambda x: x["hashes"]))).alias("hash"))
    holders = lines.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where(f"first < last AND n <= {RARE}").select("hash")
    holders = materialize(holders, "holders")
    rare = lines.join(holders, "hash")
    few = rare.alias("l").join(rare.select("hash", F.col("doc_id").alias("earlier")).alias("e"), "hash").where("earlier < doc_id").select("doc_id", "text_hash", "earlier").distinct()
    runs = materialize(tables.mapInArrow(trimmed(_runs(least)), "doc_id long, text_hash long, hash long, lines array<int>"), "runs")
    # Joined from a table, a hot run can be split.
    firsts = materialize(runs.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first"), "firsts")
    span = F.struct(F.element_at("lines", 1).alias("lo"), F.element_at("lines", -1).alias("hi"))
    named = runs.join(firsts, "hash").where("doc_id > first").select("doc_id", "text_hash", F.col("first").alias("earlier"), span.alias("run"))
    pairs = named.union(few.select("*", F.lit(None).cast("struct<lo:int,hi:int>").alias("run"))).groupBy("doc_id", "text_hash", "earlier").agg(F.collect_set("run").alias("runs"))
    pairs = materialize(pairs, "pairs")
    later = tables.select("doc_id", "text_hash", F.col("lines").alias("b_lines"), F.col("hashes").alias("b"), F.col("words").alias("b_words"))
    earlier = tables.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("a")).distinct()
    both = pairs.join(earlier, "earlier").join(later, ["doc_id", "text_hash"])

    def align(batches):
        for batch in batches:
            cells = {c: (np.asarray(batch.column(c).offsets), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in ("a", "b", "b_lines", "b_words")}
            spans = batch.column("runs")
            span_at, lo, hi = np.asarray(spans.offsets), *(spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            own = lambda c, k: cells[c][1][cells[c][0][k] : cells[c][0][k + 1]]
            rows, lists = [], []
            for k in range(batch.num_rows):
                numbers, part = own("b_lines", k), slice(span_at[k], span_at[k + 1])
                first, last = np.searchsorted(numbers, lo[part]).tolist(), np.searchsorted(numbers, hi[part]).tolist()
                at = named_runs(own("a", k).tolist(), own("b", k).tolist(), own("b_words", k).tolist(), sorted(zip(first, last)), least)
                if at:
                    rows.append(k)
                    lists.append(numbers[at])
            owner = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("text_hash").take(owner), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "lines"])

    aligned = both.select("doc_id", "text_hash", "a", "b", "b_lines", "b_words", "runs").mapInArrow(trimmed(align), "doc_id long, text_hash long, lines array<int>")
    found = aligned.select("doc_id", "text_hash", F.explode("lines").alias("line")).distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    out = materialize(found, "repeated")
    for used in (firsts, runs, pairs, holders, tables):
        discard(used)
    return out


def remove_repeated_lines(docs: DataFrame, least: int = BLOCK_WORDS, drop_emptied: bool = True) -> DataFrame:
    """`docs` with repeated blocks deleted from the later documents, all columns kept.

    Rows of one doc_id don't shorten each other; rows with a null doc_id or text stay as they are. A document that
    loses every line with words is dropped with `drop_emptied`, else left with what remains. Line breaks around what
    stays are kept as they were between lines; an empty table gives an empty result."""
    gone = repeated_lines(docs, least).alias("g")
    name = "__fs_lines"
    while name in docs.columns:
        name += "_"
    on = (F.col("d.doc_id").cast("long") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_hash"))
    joined = docs.alias("d").join(gone, on, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("g.lines").alias(name))
    at, schema = docs.columns.index("text"), docs.schema

    def cut(batches):
        for b in batches:
            lines = b.column(b.num_columns - 1)
            keep, new = np.ones(b.num_rows, bool), None
            if lines.null_count < b.num_rows:
                new = b.column(at).to_pylist()
                for k in np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    gone_here = set(lines[k].as_py())
                    new[k] = "\n".join(x for i, x in enumerate(new[k].split("\n")) if i not in gone_here)
                    keep[k] = not drop_emptied or WORD.search(new[k]) is not None
            columns = [pa.array(new, b.column(at).type) if i == at and new is not None else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array(keep))

    return joined.mapInArrow(trimmed(cut), schema)
