"""The fold of an edit log against a replay on whole lists."""

import random

from pyspark.sql import functions as F

from folioscope.operators import edit_log as G

NODE = "doc int, idx int, type string, number string, heading string, text string"
LOG = "doc int, seq long, op string, idx long, after_idx long, of long, type string, number string, heading string, text string"


def replay(n, log):
    """Live nodes in order with their types, and the refused edits, by list operations one after the other."""
    void = set()
    for seq, op, _, _, of, _ in sorted(log, reverse=True):
        if op == "undo" and seq not in void and of is not None and of < seq:
            void.add(of)
    order, deleted, types, refused = list(range(n)), set(), {i: "p" for i in range(n)}, []
    for seq, op, idx, after, of, kind in sorted(log):
        if op == "undo" or seq in void:
            continue
        bad = (idx in types) == (op == "insert") or (op in ("insert", "place") and (after == idx or after is None or not (after == -1 or after in types)))
        if bad:
            refused.append(seq)
            continue
        if op in ("insert", "place"):
            if op == "place":
                order.remove(idx)
            order.insert(order.index(after) + 1 if after != -1 else 0, idx)
        if op in ("insert", "retype"):
            types[idx] = kind
        if op == "delete":
            deleted.add(idx)
        if op == "restore":
            deleted.discard(idx)
    return [(i, types[i]) for i in order if i not in deleted], refused


def test_random_logs_equal_a_replay(spark):
    rnd = random.Random(8)
    nodes, log, expected = [], [], {}
    for d in range(60):
        n, own, fresh = rnd.randint(1, 8), [], 100
        nodes += [(d, i, "p", str(i), None, f"t{i}") for i in range(n)]
        for seq in rnd.sample(range(1000), rnd.randint(0, 25)):
            op = rnd.choice(["insert", "place", "place", "place", "delete", "restore", "retype", "undo"])
            some = [*range(n), *range(100, fresh), -5]
            idx = fresh if op == "insert" and rnd.random() < 0.9 else rnd.choice(some)
            fresh += op == "insert" and idx == fresh
            own.append((seq, op, idx, rnd.choice([*some, -1]) if op in ("insert", "place") else None, rnd.choice([o[0] for o in own] or [None]) if op == "undo" else None, rnd.choice("xyz") if op in ("insert", "retype") else None))
        log += [(d, seq, op, i, a, of, kind, None, None, None) for seq, op, i, a, of, kind in own]
        expected[d] = replay(n, own)
    nodes, log = spark.createDataFrame(nodes, NODE), spark.createDataFrame(log, LOG).repartition(3)
    got = {d: [] for d in expected}
    for r in G.edited(nodes, log).orderBy("doc", "base", "nth").collect():
        got[r["doc"]].append((r["idx"], r["type"]))
    assert got == {d: v for d, (v, _) in expected.items()}
    refused = {}
    for r in G.fold_log(nodes, log).where("refused IS NOT NULL").collect():
        refused.setdefault(r["doc"], []).append(r["seq"])
    assert {d: sorted(v) for d, v in refused.items()} == {d: sorted(v) for d, (_, v) in expected.items() if v}


def test_paths_and_blocks(spark):
    kinds = ["section", "paragraph", "subparagraph", "paragraph", "section"]
    nodes = spark.createDataFrame([(1, i, k, n, None, None) for i, (k, n) in enumerate(zip(kinds, ["1", "a", "i", "b", "2"]))], NODE)
    ranked = nodes.withColumn("rank", F.expr("CASE type WHEN 'section' THEN 5 WHEN 'paragraph' THEN 7 ELSE 8 END"))
    moves = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 1, 2)], "doc int, seq long, idx int, after_idx int")
    log = G.block_moves(ranked, moves)
    at = {r["idx"]: (r["position"], r["in_section"], r["in_paragraph"]) for r in G.placed(G.edited(nodes, log)).collect()}
    assert at == {0: (0, "1", None), 3: (1, "1", "b"), 4: (2, "2", None), 1: (3, "2", "a"), 2: (4, "2", "a")}
    assert G.edited(nodes, log.where("false")).count() == 5 and G.edited(nodes.where("false"), log).count() == 0


def test_documents_share_calls(spark):
    """Many short documents are one pass over sorted rows: no call of Python a document."""
    nodes = spark.range(6000).selectExpr("cast(id DIV 2 AS int) AS doc", "cast(id % 2 AS int) AS idx", "'p' AS type", "'1' AS number", "'h' AS heading", "'t' AS text")
    log = nodes.selectExpr("doc", "2L AS seq", "'place' AS op", "cast(idx AS long) AS idx", "-1L AS after_idx", "cast(null AS long) AS of", *[f"cast(null AS string) AS {c}" for c in ("type", "number", "heading", "text")]).where("idx = 1")
    states = G.fold_log(nodes, log)
    assert "FlatMapGroups" not in states._jdf.queryExecution().executedPlan().toString()
    assert states.where("idx = 1 AND base = -1 AND nth = 1").select("doc").distinct().count() == 3000
