"""A reviewer's log of structural edits, folded in order: inserts, moves, deletions, retypings, and undoing any of them.

A document's parse is never renumbered and never gathered: an edit only touches the nodes it names and their neighbours,
so the fold keeps links of touched nodes over the parse's own order, and a document costs what its edits cost. A moved
node's place is the unmoved node it now stands behind and its turn there; all nodes take their places by a join, and sort
by (base, nth).

Log: doc, seq, op, idx, after_idx, of, type, number, heading, text. Operations: `insert` and `place` put idx directly
after after_idx (-1: at the start), `delete` and `restore`, `retype` (type, number), and `undo` of the edit with seq `of`
(an undo can be undone). Nodes of a parse are 0, 1, ...; inserted ones have numbers of their own."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.operators.edits import block_under
from folioscope.operators.sequence import breadcrumbs
from folioscope.session import fanout

START = -1
#: Rows of states that are given back at once.
OUT_ROWS = 4096
STATE = "idx long, base long, nth long, deleted boolean, inserted boolean, type string, number string, heading string, text string, seq long, refused string"


class _Links:
    """Who stands behind whom, where it differs from the parse's 0, 1, ..., n - 1."""

    def __init__(self, n: int):
        self.n, self.behind, self.before, self.moved = n, {}, {}, set()

    def after(self, i: int) -> int | None:
        return self.behind.get(i, i + 1 if i + 1 < self.n and i < self.n else None)

    def ahead(self, i: int) -> int:
        return self.before.get(i, i - 1)

    def _join(self, a: int, b: int | None) -> None:
        self.behind[a] = b
        if b is not None:
            self.before[b] = a

    def put(self, i: int, anchor: int, new: bool) -> None:
        if not new:
            self._join(self.ahead(i), self.after(i))
        follows = self.after(anchor)
        self._join(anchor, i)
        self._join(i, follows)
        self.moved.add(i)

    def places(self) -> dict[int, tuple[int, int]]:
        """(the unmoved node before it, its turn there) of each moved node; each is walked past once."""
        out: dict[int, tuple[int, int]] = {}
        for first in self.moved:
            base = self.ahead(first)
            if base in self.moved:
                continue
            at, turn = first, 1
            while at is not None and at in self.moved:
                out[at] = base, turn
                at, turn = self.after(at), turn + 1
        return out


def _undone(log: list[dict]) -> set[int]:
    """Numbers of edits that don't count: what a later undo that counts names."""
    gone: set[int] = set()
    for r in reversed(log):
        if r["op"] == "undo" and r["seq"] not in gone and r["of"] is not None and r["of"] < r["seq"]:
            gone.add(r["of"])
    return gone


def _folded(n: int, log: list[dict]) -> list[dict]:
    """What a document's log, in order of seq, makes of its n nodes."""
    links, deleted, inserted, typed, refused = _Links(n), set(), {}, {}, []
    void = _undone(log)
    known = lambda i: 0 <= i < n or i in inserted
    for r in log:
        op, i, anchor = r["op"], r["idx"], r["after_idx"]
        if r["seq"] in void or op == "undo":
            continue
        reason = None
        if op == "insert" and known(i):
            reason = "number taken"
        elif op != "insert" and not known(i):
            reason = "no such node"
        elif op in ("insert", "place") and (anchor is None or not (anchor == START or known(anchor))):
            reason = "no such anchor"
        elif op in ("insert", "place") and anchor == i:
            reason = "after itself"
        if reason:
            refused.append({"idx": i, "seq": r["seq"], "refused": reason})
            continue
        if op in ("insert", "place"):
            links.put(i, anchor, op == "insert")
        if op == "insert":
            inserted[i] = {k: r[k] for k in ("type", "number", "heading", "text")}
        elif op == "delete":
            deleted.add(i)
        elif op == "restore":
            deleted.discard(i)
        elif op == "retype":
            typed[i] = {"type": r["type"], "number": r["number"]}
    places, out = links.places(), []
    for i in {*places, *deleted, *inserted, *typed}:
        base, nth = places.get(i, (i, 0))
        out.append({"idx": i, "base": base, "nth": nth, "deleted": i in deleted, "inserted": i in inserted, **inserted.get(i, {}), **typed.get(i, {})})
    return out + refused


def fold_log(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """The state of every node that edits touch, and the edits that can't be (`refused`: an anchor or node that isn't
    there, a node after itself, a number that is taken), which change nothing."""
    size = nodes.groupBy("doc").agg((F.max("idx") + 1).cast("long").alias("__n"))
    kind = nodes.schema["doc"].dataType.simpleString()
    columns = [F.col(c).cast("long").alias(c) for c in ("seq", "idx", "after_idx", "of")]
    rows = log.select(F.col("doc").cast(kind).alias("doc"), "op", *columns, "type", "number", "heading", "text").join(size, "doc", "left")
    # One pass over sorted rows, whole documents at a time: a call a document would cost more than its edits.
    dealt = rows.repartition(fanout(rows), "doc").sortWithinPartitions("doc", "seq")
    return dealt.mapInArrow(_states, f"doc {kind}, {STATE}")


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    out: list[dict] = []
    schema = None

    def rows() -> Iterator[dict]:
        nonlocal schema
        for batch in batches:
            schema = schema or pa.schema([("doc", batch.schema.field("doc").type), *((c, types[t]) for c, t in map(str.split, STATE.split(", ")))])
            yield from batch.to_pylist()

    for doc, log in groupby(rows(), lambda r: r["doc"]):
        log = list(log)
        out += [{"doc": doc, **r} for r in _folded(log[0]["__n"] or 0, log)]
        if len(out) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def edited(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Live nodes (doc, idx, type, number, heading, text, base, nth) after the log; in a document they sort by base, nth."""
    state = fold_log(nodes, log).where("refused IS NULL")
    own = state.where("NOT inserted").select("doc", "idx", "base", "nth", "deleted", F.struct("type", "number").alias("new"))
    parsed = nodes.select("doc", F.col("idx").cast("long").alias("idx"), "type", "number", "heading", "text").join(own, ["doc", "idx"], "left").where("NOT coalesce(deleted, false)")
    typed = F.col("new.type").isNotNull()
    parsed = parsed.select("doc", "idx", F.when(typed, F.col("new.type")).otherwise(F.col("type")).alias("type"), F.when(typed, F.col("new.number")).otherwise(F.col("number")).alias("number"), "heading", "text", F.coalesce("base", "idx").alias("base"), F.coalesce("nth", F.lit(0)).alias("nth"))
    return parsed.union(state.where("inserted AND NOT deleted").select("doc", "idx", "type", "number", "heading", "text", "base", "nth"))


def placed(nodes: DataFrame) -> DataFrame:
    """Adds `position` and the names of the levels above (see `breadcrumbs`) to edited nodes: what an edit changes for the
    nodes behind it."""
    at = nodes.withColumn("position", F.row_number().over(Window.partitionBy("doc").orderBy("base", "nth")) - 1)
    return breadcrumbs(at, "doc", "position")


def block_moves(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Log rows for moves (doc, seq, idx, after_idx) of nodes with all that is nested under them: the node goes after the
    anchor, and each of its block after the one before. A move into the node's own block is left out. Sequence numbers
    are spread a million apart."""
    blocks = block_under(nodes, moves.select("doc", "idx").distinct())
    inside = moves.join(blocks.select("doc", F.col("root").alias("idx"), F.col("idx").alias("after_idx")), ["doc", "idx", "after_idx"], "left_semi").select("doc", "seq")
    good = moves.join(inside, ["doc", "seq"], "left_anti").select("doc", F.col("idx").alias("root"), "seq", F.col("after_idx").alias("__to"))
    w = Window.partitionBy("doc", "seq").orderBy("idx")
    rows = good.join(blocks, ["doc", "root"]).withColumn("__before", F.lag("idx").over(w)).withColumn("__k", F.row_number().over(w) - 1)
    none = F.lit(None)
    return rows.select("doc", (F.col("seq") * 1_000_000 + F.col("__k")).cast("long").alias("seq"), F.lit("place").alias("op"), F.col("idx").cast("long").alias("idx"), F.coalesce("__before", "__to").cast("long").alias("after_idx"), none.cast("long").alias("of"), *[none.cast("string").alias(c) for c in ("type", "number", "heading", "text")])
