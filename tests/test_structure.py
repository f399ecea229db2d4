"""Ordered passes, versions, links, deltas, reviews, rules and parsers on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import delta as X
from folioscope.operators import linking as K
from folioscope.operators import lineage as L
from folioscope.operators import parsing as P
from folioscope.operators import review as R
from folioscope.operators import sequence as Q
from folioscope.operators import teaching as T

NODE = "work string, version int, idx int, type string, number string, heading string, text string, notes array<string>"


def test_units(frame):
    types = ["note", "section", "subsection", "heading_group", "paragraph", "section", "dictionary", "part", "definition", "schedule", "part", "definition"]
    d = frame([(1, i, t) for i, t in enumerate(types)], "doc int, idx int, type string")
    assert [r["unit"] for r in Q.units(d, "doc").orderBy("idx").collect()] == [1, 2, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10]


def test_breadcrumbs_clear(frame):
    rows = [("part", "1"), ("section", "1"), ("paragraph", "a"), ("part", "2"), ("paragraph", "b")]
    d = frame([(1, i, t, n, None) for i, (t, n) in enumerate(rows)], "doc int, idx int, type string, number string, heading string")
    got = [(r["in_part"], r["in_section"], r["in_paragraph"]) for r in Q.breadcrumbs(d, "doc").orderBy("idx").collect()]
    assert got == [("1", None, None), ("1", "1", None), ("1", "1", "a"), ("2", None, None), ("2", None, "b")]


def test_names(frame):
    d = frame([(1, 0, "s", "x", "", "a"), (1, 1, "s", "x", "", "a"), (1, 2, "s", "x", "", "a"), (1, 3, "s", "x", "", "b")], "doc int, idx int, name string, type string, heading string, text string")
    names = [r["node_id"] for r in Q.unique_names(d, "doc").orderBy("idx").collect()]
    assert names[0] == "s" and names[1].startswith("s~") and names[2] == names[1] + "-2" and len(set(names)) == 4


def version(v, *nodes):
    return [("w", v, i, *n, []) for i, n in enumerate(nodes)]


def test_diff_of_versions(frame):
    old = version(1, ("section", "1", "H", "same\n  words"), ("section", "2", "H", "one two"), ("section", "3", "H", "gone"), ("section", "4", "H", "x y"), ("schedule", "1", None, ""), ("item", "1", "H", "a"))
    new = version(2, ("section", "1", "H", "same words"), ("section", "2", "H", "two one"), ("section", "4", "H2", "y x"), ("section", "5", "H", "new"), ("section", "5", "H", "again"), ("schedule", "1", None, ""), ("item", "1", "H", "b"))
    p = L.provisions(frame(old + new, NODE))
    got = {(r["schedule"], r["number"], r["kind"]): r["change"] for r in L.compare(p.where("version = 1"), p.where("version = 2"), L.KEY).collect()}
    assert got == {(None, "1", "provision"): "unchanged", (None, "2", "provision"): "reordered", (None, "3", "provision"): "repealed", (None, "4", "provision"): "changed", (None, "5", "provision"): "inserted", (None, "1", "schedule"): "unchanged", ("1", "1", "provision"): "changed"}
    assert L.timeline(p).count() == 4


STATE = "work string, version int, key string, text_hash string"


def test_wordings(frame):
    s = frame([("w", 1, "a", "x"), ("w", 2, "a", "y"), ("w", 3, "a", "x"), ("w", 1, "b", "q"), ("w", 4, "b", "q"), ("w", 5, "z", "z")], STATE)
    spans = lambda d: [(r["from_version"], r["to_version"], r["absent"], r["ended_by"]) for r in d.where("key = 'a'").orderBy("span").collect()]
    assert spans(L.wordings(s)) == [(1, 1, False, "changed"), (2, 2, False, "changed"), (3, 3, False, "repealed"), (4, 5, True, None)]
    none = s.select("work", "version", "key").where("false")
    assert spans(L.wordings(s, none)) == [(1, 3, False, "repealed"), (4, 5, True, None)]


def test_inheritance(frame):
    s = frame([("w", v, "a", t) for v, t in enumerate("xxyyx", 1)], STATE)
    got = lambda *rv: {r["version"]: (r["status"], r["source"]) for r in L.review_status(s, frame([("w", "a", v) for v in rv], "work string, key string, version int")).collect()}
    assert got(2) == {1: ("inherits", 2), 2: ("reviewed", 2), 3: ("follows", 4), 4: ("to_review", None), 5: ("to_review", None)}
    assert got(3) == {1: ("follows", 2), 2: ("to_review", None), 3: ("reviewed", 3), 4: ("inherits", 3), 5: ("to_review", None)}


def test_chains_through_renames(frame):
    s = frame([("w", 1, "a"), ("w", 2, "b"), ("w", 3, "c"), ("w", 3, "a")], "work string, version int, key string")
    links = frame([("w", 2, "b", "a"), ("w", 3, "c", "b")], "work string, version int, new_key string, old_key string")
    assert {(r["version"], r["key"]): r["chain_key"] for r in L.chains(s, links).collect()} == {(1, "a"): "a@1", (2, "b"): "a@1", (3, "c"): "a@1", (3, "a"): "a@3"}

    skips = frame([("a", 0, "k"), ("a", 2, "k"), ("b", 0, "k"), ("b", 1, "k"), ("b", 2, "k")], "work string, version int, key string")
    assert {r["chain_key"] for r in L.chains(skips, links.where("false")).collect()} == {"k@0"}


def test_clause_match(frame):
    side = "idx int, number string, schedule string, text string"
    bill = frame([(0, "1A", None, "same text here"), (1, "1", "1", "abc"), (2, "9", None, "x")], side)
    act = frame([(5, "1a", None, "same text here"), (6, "1A", None, "dup"), (7, "1", "1", "zzzzzzzz")], side)
    assert {r["clause_idx"]: (r["act_idx"], r["status"]) for r in K.match_clauses(bill, act).collect()} == {0: (5, "matched"), 1: (7, "flagged"), 2: (None, "unmatched")}


def test_citation_cascade(frame):
    cite = "id int, act_no string, year string"
    cites = frame([(1, "7", "2009"), (2, "8679", None), (3, "5", "2001"), (4, "6", None), (5, "7", "1999")], cite)
    acts = frame([(0, "7", "2009", "A"), (1, "8679", None, "B")], "pos int, act_no string, year string, title string")
    registry = frame([("5", "2001", "C"), ("6", "1990", "D"), ("6", "1991", "E")], "act_no string, year string, title string")
    assert {r["id"]: (r["title"], r["source"]) for r in K.resolve_citations(cites, acts, registry).collect()} == {1: ("A", "endnotes"), 2: ("B", "endnotes"), 3: ("C", "registry"), 4: (None, None), 5: (None, None)}


def test_boxes(frame):
    lines = frame([(1, 0.0, 10.0, 20.0, 32.0, "in"), (1, 0.0, 10.0, 120.0, 132.0, "below"), (2, 0.0, 10.0, 20.0, 32.0, "page"), (1, 8.0, 30.0, 22.0, 30.0, "aside")], "page int, x0 double, x1 double, y0 double, y1 double, text string")
    boxes = frame([("b", 1, 0.0, 12.0, 0.0, 110.0)], "box_id string, page int, x0 double, x1 double, y0 double, y1 double")
    assert [(r["box_id"], r["text"]) for r in K.text_in_boxes(lines, boxes).collect()] == [("b", "in")]


PIECE = "name string, text string, idx int"


def test_delta_round_trip(frame):
    neighbour = frame([("s1", "one", 0), ("s1/a", "x", 1), ("s11", "eleven", 2), ("s2", "two", 3), ("s2/a", "y", 4)], PIECE)
    whole = [("s0", "zero", 0), ("s1", "ONE", 1), ("s1/a", "x", 2), ("s1/b", "new", 3), ("s11", "eleven", 4)]
    v = frame(whole, PIECE)
    pieces, removed = X.slim(v, neighbour)
    assert {r["name"] for r in removed.collect()} == {"s2", "s2/a"} and "s11" not in {r["name"] for r in pieces.collect()}
    assert [tuple(r) for r in X.assemble(neighbour, pieces, removed).orderBy("idx").collect()] == whole
    assert {r["name"] for r in X.outermost(frame([("s1",), ("s1/a",), ("s11",)], "name string")).collect()} == {"s1", "s11"}


def test_delta_chain(frame):
    p = frame([(3, None), (2, 3), (1, 2), (8, 9), (9, 8)], "version int, toward int")
    assert {(r["version"], r["base"], r["steps"]) for r in X.delta_chain(p).collect()} == {(3, 3, 0), (2, 3, 1), (1, 3, 2)}


def test_remap(frame):
    side = "doc int, idx int, type string, number string, heading string, text string"
    old = frame([(1, 0, "section", "1", "A", "t", True), (1, 1, "section", "2", "B", "u", True), (1, 2, "note", None, None, "n", True), (1, 3, "note", None, None, "n", False)], side + ", accepted boolean")
    new = frame([(1, 0, "note", None, None, "n"), (1, 4, "section", "1", "A", "t"), (1, 5, "section", "2", "B2", "changed")], side)
    assert {r["old_idx"]: (r["new_idx"], r["outcome"]) for r in R.remap(old, new).collect()} == {0: (4, "kept"), 1: (5, "withdrawn"), 2: (0, "kept"), 3: (None, "orphan")}


def test_document_order(frame):
    nodes = frame([(1, i) for i in range(4)], "doc int, idx int")
    edit = "doc int, idx int, after_idx int, deleted boolean, seq int"
    got = R.document_order(nodes, frame([(1, 3, 0, False, 0), (1, 10, 0, False, 1), (1, 2, -1, False, 2), (1, 1, None, True, 3)], edit))
    assert [r["idx"] for r in got.orderBy("position").collect()] == [2, 0, 10, 3]
    with pytest.raises(Exception, match="circle"):
        R.document_order(nodes, frame([(1, 1, 2, False, 0), (1, 2, 1, False, 1)], edit)).collect()


def test_upserts(frame):
    stored, new = frame([(1, "a"), (None, "n")], "k int, v string"), frame([(1, "b"), (None, "m"), (2, "c")], "k int, v string")
    assert {tuple(r) for r in R.upsert(stored, new, ["k"]).collect()} == {(1, "b"), (None, "m"), (2, "c")}


def test_tree_and_rules(frame):
    xs = [{"bold": i % 2 == 0, "size": float(i)} for i in range(12)]
    tree = T.grow(xs, ["head" if x["bold"] else "body" for x in xs])
    assert tree.test == ("bold", "=", False) and T.predict(tree, {"bold": True, "size": 1.0}).label == "head"
    d = frame([(True, 1.0), (False, 2.0), (None, None)], "bold boolean, size double").select(T.tree_column(tree)["label"].alias("l"))
    assert [r["l"] for r in d.collect()] == ["head", "body", "head"]
    r = frame([("(1) x", True, 12.0, "part"), ("y", None, 9.0, None)], "text string, bold boolean, size double, parent string")
    assert [x["recognised"] for x in T.first_rule(r, [{"id": "a", "type": "sub", "priority": 1, "pattern": r"^\(\d", "flags": {"bold": True}, "ranges": {"size": (11, 13)}, "parents": ["part"]}]).collect()] == ["sub", None]


def test_bracket_levels():
    assert P.bracket_level("i", {}) == "paragraph" and P.bracket_level("i", {"paragraph": "a"}) == "subparagraph"
    assert P.bracket_level("i", {"paragraph": "h"}) == "paragraph" and P.bracket_level("ii", {"subparagraph": "i", "paragraph": "a"}) == "subparagraph"
    assert [P.next_letter(x) for x in ("a", "z", "az")] == ["b", "aa", "ba"] and P.roman_to_int("xiv") == 14 and P.roman_to_int("iiii") is None


LINE = "doc int, line_no int, text string, page int, x0 double, x1 double, y0 double, size double, bold boolean"


def test_line_parser(frame):
    texts = [("Part 1—General", True), ("1 Purposes", True), ("The purposes are—", False), ("(a) to re-", False), ("peal; and", False), ("(b) to", False), ("(i) x", False), ("Note", False), ("see 2", False), ("* * *", False), ("2 Next", True)]
    lines = frame([(1, i, t, 1, 0.0, 9.0, 0.0, 12.0, b) for i, (t, b) in enumerate(texts)], LINE)
    nodes = P.parse_lines(lines)
    got = [(r["type"], r["number"], r["text"]) for r in nodes.orderBy("idx").collect()]
    assert got == [("part", "1", ""), ("section", "1", "The purposes are—"), ("paragraph", "a", "to re-peal; and"), ("paragraph", "b", "to"), ("subparagraph", "i", "x"), ("note", None, "see 2"), ("repealed", None, "* * *"), ("section", "2", "")]
    assert P.diagnostics(nodes, lines).where("severity = 'error'").count() == 0
    assert P.diagnostics(nodes.where("idx > 0"), lines).where("category = 'incomplete'").count() == 1


def test_rows_and_endnotes(frame):
    at = lambda i, t, x, y: (1, i, t, 1, x, x + 9, y, 12.0, False)
    rows = frame([at(0, "b", 50.0, 1.5), at(1, "a", 0.0, 0.0), at(2, "c", 0.0, 3.0)], LINE)
    assert [r["texts"] for r in P.visual_rows(rows).orderBy("row_no").collect()] == [["a", "b"], ["c"]]
    end = frame([(1, i, t, 1, 0.0, 9.0, 0.0, 12.0, False) for i, t in enumerate(["Crimes Act, No. 1/2026", "Assent Date: 3 March 2026", "x"])], LINE)
    r = P.parse_endnotes(end).first()
    assert (r["act_no"], r["year"], r["fields"]) == ("1", "2026", {"assent_date": "3 March 2026"})


def test_notes_attach(frame):
    nodes = frame([(1, 0, "4", [], "section"), (1, 1, "4", ["1"], "subsection"), (1, 2, "4", ["1", "a"], "paragraph"), (1, 3, "5", [], "repealed")], "doc int, idx int, section string, levels array<string>, type string")
    notes = frame([(1, 0, "4", ["1", "a"], "amended"), (1, 1, "4", ["1", "z"], "amended"), (1, 2, "5", [], "repealed"), (1, 3, "9", [], "amended")], "doc int, note_no int, section string, path array<string>, kind string")
    assert [(r["idx"], r["confidence"]) for r in P.attach_notes(nodes, notes).orderBy("note_no").collect()] == [(2, "exact"), (1, "parent"), (3, "repealed_row"), (None, None)]


def test_islands(frame):
    d = frame([(1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a")], "k int, o int, v string")
    assert [r["island"] for r in Q.islands(d, ["k"], "o", F.col("v")).orderBy("o").collect()] == [1, 2, 2, 3]


def test_previous_across_ranges(spark):
    """The row before, in a group that fills most ranges, in small groups, and where a group begins a range."""
    from pyspark.sql import functions as F

    from folioscope.operators.sequence import with_previous

    rows = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), (F.col("id") * 3).alias("o"))
    expected, last = set(), {}
    for r in sorted(map(tuple, rows.collect())):
        expected.add((*r, last.get(r[0])))
        last[r[0]] = r[1]
    assert {tuple(r) for r in with_previous(rows.repartition(5), "g", "o").select("g", "o", "previous").collect()} == expected
    assert with_previous(rows.where("false"), "g", "o").count() == 0


def test_long_and_circular_ways(spark):
    pointers = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100), (200, 999)], "version int, toward int")
    from folioscope.operators.delta import delta_chain

    assert {(r["version"], r["base"], r["steps"]) for r in delta_chain(pointers).collect()} == {(i, 0, i) for i in range(40)}


def test_figures_behind_nodes_of_one_height(frame):
    """Nodes at one place are told apart by their idx, whatever order they come in."""
    nodes = frame([(1, 3, 5, i) for i in (4, 9, 2, 7)] + [(2, 3, 5, i) for i in (9, 1)], "doc int, page int, y int, idx int").coalesce(1)
    figures = frame([(1, 3, 5, "a"), (1, 2, 5, "b"), (2, 3, 6, "c")], "doc int, page int, y int, figure_id string")
    assert {r["figure_id"]: r["after_idx"] for r in K.place_figures(nodes, figures).collect()} == {"a": 9, "b": None, "c": 9}


def test_boxes_of_one_place_are_compared_once(frame, monkeypatch):
    """Boxes that share a place are one row of the join, in lists of a bounded length; each is found."""
    monkeypatch.setattr(K, "BOX_IDS", 8)
    boxes = frame([(i, 1, 0.0, 100.0, 40.0, 60.0) for i in range(40)] + [(90, 1, 0.0, 10.0, 40.0, 60.0), (91, 2, 0.0, 100.0, 40.0, 60.0), (92, 1, None, 100.0, 40.0, 60.0)], "box_id int, page int, x0 double, x1 double, y0 double, y1 double")
    lines = frame([("a", 1, 10.0, 60.0, 45.0, 55.0), ("b", 1, 80.0, 300.0, 45.0, 55.0), ("c", 1, 10.0, 60.0, 57.0, 67.0)], "text string, page int, x0 double, x1 double, y0 double, y1 double")
    found = K.lines_in_boxes(lines, boxes)
    assert sorted((r["text"], r["box_id"]) for r in found.collect()) == [("a", i) for i in range(40)]
    assert set(found.columns) == {*lines.columns, "box_id"} and "__ids" in found._jdf.queryExecution().optimizedPlan().toString()
