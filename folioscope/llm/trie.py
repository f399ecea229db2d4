"""The prefix trie of conversations, from one global sort.

Each conversation becomes a key: a digest a turn, one after the other. Keys are sorted over all partitions by range (so
that even a conversation that a third of the rows repeat is dealt to many tasks), and in each range the longest common
prefixes of neighbours open and close nodes on a stack: a node closes where the next key no longer starts with it, and
hands its sums to its parent. A range knows the last key before it and the first key after it; by these it tells nodes
that begin or end elsewhere. Nodes that reach over a border leave the range as partial sums and are stitched by adding
these up: as only the range where a node begins counts it, and only the range where it ends decides whether it is
childless, every number is a plain sum.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.llm.memory import trimmed
from folioscope.llm.spelling import crc32_sql
from folioscope.session import discard, fanout, materialize

#: Hexadecimal digits of a turn's digest (128 bits of SHA-256).
DIGITS = 32
EVERY = 20
HEADS = 4
#: Ranges are told apart by so many turns at most.
RANGE_TURNS = 64
#: Ids of a node's own conversations that travel in one row.
CHUNK = 8192
ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_SCHEMA = "kind int, node string, part long, seq long, ids string, conv_id long, depth long, parent string, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FIELDS = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in _SCHEMA.split(", "))])
#: Kinds of rows that leave a range: whole nodes, nodes below a border's node, parts of nodes, ids of parts.
WHOLE, BELOW, PART, ENDS = range(4)


def sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, turns): turns (turn, digest, words) in order; null first, turns with one number by digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, DIGITS)
    turns = convs.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(convs: DataFrame) -> DataFrame:
    """(conv_id, key, words): each conversation c with the first h turns of conversation c - c % 20 in the place of its
    own first h turns, h = crc32(c) % 4."""
    all_ = sequences(convs)
    heads = all_.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    joined = all_.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).withColumn("h", h).join(heads, "base", "left")
    turns = F.expr("concat(coalesce(slice(head, 1, h), array()), slice(turns, h + 1, size(turns)))")
    return joined.select("conv_id", turns.alias("t")).select("conv_id", F.array_join(F.expr("t.digest"), "").alias("key"), F.expr("t.words").alias("words"))


def _common(a: str | None, b: str | None) -> int:
    """Turns that two keys share at their start; -1 without one of the keys."""
    return -1 if a is None or b is None else len(commonprefix([a, b])) // DIGITS


class _Range:
    """The sweep over the sorted keys of one range."""

    def __init__(self, part: int, before: str | None, after: str | None):
        self.part, self.before, self.after = part, before, after
        self.key, self.path, self.out = None, [], []

    def _open(self, continued: bool, words: int) -> None:
        if self.path:
            parent = self.path[-1]
            parent["child"] = True
            parent["children"] += not continued
        self.path.append({"continued": continued, "words": words, "n": 0, "conv": None, "child": False, "children": 0, "leaves": 0, "saved": 0 if continued else -words, "ends": [], "below": []})

    def add(self, conv: int, key: str, words: list[int]) -> None:
        depth = len(key) // DIGITS
        if self.key is None:
            known = _common(self.before, key)
            self._open(known >= 0, 0)
            for d in range(depth):
                self._open(d < known, words[d])
        else:
            same = _common(self.key, key)
            self._close(same)
            for d in range(same, depth):
                self._open(False, words[d])
        self.key = key
        for node in self.path:
            node["n"] += 1
            node["saved"] += node["words"]
            if node["conv"] is None or conv < node["conv"]:
                node["conv"] = conv
        self.path[-1]["ends"].append(conv)

    def _row(self, kind: int, depth: int, closed: dict, **more) -> dict:
        return {"kind": kind, "conv_id": closed["conv"], "depth": depth, "n_convs": closed["n"], "n_children": closed["children"], "n_leaves": closed["leaves"], "saved_tokens": closed["saved"], **more}

    def _names(self) -> list[str]:
        """A name for each node of the path."""
        h, names = hashlib.sha256(), []
        for d in range(len(self.path)):
            h.update(self.key[DIGITS * (d - 1) : DIGITS * d].encode() if d else b"")
            names.append(h.copy().hexdigest())
        return names

    def _close(self, keep: int, open_: int = -1) -> None:
        """Close the nodes deeper than `keep`; at the end of the range those up to depth `open_` go on elsewhere."""
        names = None
        while len(self.path) > keep + 1:
            depth, node = len(self.path) - 1, self.path[-1]
            goes_on = depth <= open_
            if not (node["child"] or goes_on):
                node["leaves"] += 1
            if node["continued"] or goes_on:
                names = names or self._names()
                self.out.append(self._row(PART, depth, node, node=names[depth], parent=names[depth - 1] if depth else None))
                self.out += [x | {"kind": BELOW, "parent": names[depth]} for x in node["below"]]
                ends = node["ends"]
                self.out += [{"kind": ENDS, "node": names[depth], "part": self.part, "seq": i, "ids": ",".join(map(str, ends[i : i + CHUNK]))} for i in range(0, len(ends), CHUNK)]
            else:
                self.out += [x | {"parent_conv_id": node["conv"]} for x in node["below"]]
                row = self._row(WHOLE, depth, node, ends_sha256=hashlib.sha256(",".join(map(str, node["ends"])).encode()).hexdigest())
                if depth == 0:
                    self.out.append(row)
                elif self.path[-2]["continued"] or depth == 1 and self.after is not None:
                    names = names or self._names()
                    self.out.append(row | {"kind": BELOW, "parent": names[depth - 1]})
                else:
                    self.path[-2]["below"].append(row)
            self.path.pop()
            if self.path:
                self.path[-1]["leaves"] += node["leaves"]
                self.path[-1]["saved"] += node["saved"]

    def end(self) -> None:
        if self.path:
            self._close(-1, _common(self.key, self.after))


def _sweep(batches):
    """Rows (part, key, conv_id, words, before, after), sorted; the first row of a part has its neighbours' keys."""
    at = None
    for b in batches:
        parts, keys, convs, words, before, after = (b.column(c).to_pylist() for c in ("part", "key", "conv_id", "words", "before", "after"))
        out = []
        for i, part in enumerate(parts):
            if at is None or at.part != part:
                if at is not None:
                    at.end()
                    out += at.out
                at = _Range(part, before[i], after[i])
            if convs[i] is not None:
                at.add(convs[i], keys[i], words[i])
                out += at.out
                at.out = []
            while len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out[:ROWS], schema=_FIELDS)
                out = out[ROWS:]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_FIELDS)
    if at is not None:
        at.end()
        for i in range(0, len(at.out), ROWS):
            yield pa.RecordBatch.from_pylist(at.out[i : i + ROWS], schema=_FIELDS)


def _digest_ends(batches):
    """(node, ends_sha256) of rows (node, part, seq, ids), sorted: each node's ids pass by once, none are kept."""
    node, h = None, None
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    for b in batches:
        out = []
        for name, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
            if name != node:
                if node is not None:
                    out.append({"node": node, "ends_sha256": h.hexdigest()})
                node, h = name, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": h.hexdigest()}], schema=schema)


def prefix_trie(keys: DataFrame, parts: int | None = None) -> DataFrame:
    """The nodes of the trie of `keys` (conv_id, key, words; one row a conversation).

    A conversation is one row of 32 bytes a turn, so it must fit a row; ids of the conversations that end in one node
    pass through one task (a digest of them all can't be split) in rows of 8192 ids. No rows give no nodes."""
    parts = parts or fanout(keys)
    short = F.length("key") <= DIGITS * RANGE_TURNS
    # Rises with (key, conv_id); only longer keys that share all these turns can't be dealt apart.
    by = [F.substring("key", 1, DIGITS * RANGE_TURNS), ~short, F.when(short, F.col("conv_id"))]
    ranged = materialize(keys.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id().cast("long")), "ranged")
    edges = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("part")  # one row a range
    edges = edges.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    rows = ranged.select("part", "key", "conv_id", "words", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    marks = edges.select("part", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<int>").alias("words"), "before", "after")
    sorted_ = rows.union(marks).repartition(parts, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "conv_id")
    swept = materialize(sorted_.mapInArrow(trimmed(_sweep), _SCHEMA), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ends = swept.where(F.col("kind") == ENDS).select("node", "part", "seq", "ids").repartition(parts, "node").sortWithinPartitions("node", "part", "seq")
    ends = ends.mapInArrow(trimmed(_digest_ends), "node string, ends_sha256 string")
    joined = swept.where(F.col("kind") == PART).groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums).join(ends, "node", "left")
    joined = materialize(joined, "joined")
    above = joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = swept.where(F.col("kind") == WHOLE).select(columns)
    below = swept.where(F.col("kind") == BELOW).drop("parent_conv_id").join(above, "parent", "left").select(columns)
    over = joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).join(above, "parent", "left").select(columns)
    return whole.union(below).union(over)


def conversation_trie(convs: DataFrame, parts: int | None = None) -> DataFrame:
    """The trie's nodes over rebuilt conversations (see `rebuild`).

    Null roles and texts are empty, null turns come first, turns of one number are ordered by their digest, rows that
    repeat are turns of their own, rows with a null conv_id are left out; other columns are ignored."""
    keys = materialize(rebuild(convs), "keys")
    out = prefix_trie(keys, parts)
    discard(keys)
    return out


SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, substring(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, {DIGITS}) AS digest, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), original AS (SELECT conv_id AS c, list({{'d': digest, 'w': words}} ORDER BY turn NULLS FIRST, digest) AS seq FROM turns GROUP BY conv_id
), hashed AS (SELECT c, seq, {crc32_sql("c::VARCHAR")} % {HEADS} AS h FROM original
), rebuilt AS (SELECT a.c, list_concat(coalesce(list_slice(b.seq, 1, a.h), []), list_slice(a.seq, a.h + 1, len(a.seq))) AS seq FROM hashed a LEFT JOIN hashed b ON b.c = a.c - a.c % {EVERY}
), keyed AS (SELECT c, len(seq) AS k, array_to_string(list_transform(seq, lambda x: x.d), '') AS key, list_transform(seq, lambda x: x.w) AS w FROM rebuilt
), prefixes AS (SELECT c, k, d, substring(key, 1, {DIGITS} * d) AS p, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, k + 1)) AS d FROM keyed)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE k = d), '')) AS ends_sha256 FROM prefixes GROUP BY p, d
), families AS (
  SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM nodes n
  LEFT JOIN nodes u ON n.d > 0 AND u.p = substring(n.p, 1, {DIGITS} * (n.d - 1)) AND u.d = n.d - 1
  LEFT JOIN (SELECT substring(p, 1, {DIGITS} * (d - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL) k ON k.p = n.p
), above AS (SELECT substring(p, 1, {DIGITS} * i) AS p, n_children, (n_convs - 1) * w AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM families)
), totals AS (SELECT p, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY p)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256 FROM families f JOIN totals t USING (p)
"""
