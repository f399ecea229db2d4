"""The reader of statutes: shapes of lines, tables, boxes, learned rules, and the same nodes whatever the ranges."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import statutes as S

LINES = "doc int, line_no int, text string, page int, x0 double, x1 double, y0 double, y1 double, size double, bold boolean, lbi string"
HEAD, WRAP, PARA, SUB = 190.2, 209.8, 215.7, 237.2


def line(text, x0=HEAD, bold=False, size=12.0, page=1, lbi=None, y0=None, x1=None):
    return text, page, x0, x0 + 200.0 if x1 is None else x1, y0, size, bold, lbi


def big(text, **more):
    return line(text, bold=True, size=14.0, **more)


def head(text, x0=HEAD, **more):
    return line(text, x0, bold=True, **more)


@pytest.fixture
def read(spark):
    """Many small documents in one job: {name: lines} to {name: [(type, number, heading, text, parent's number)]}."""

    def run(docs, **more):
        names, rows = list(docs), []
        for d, name in enumerate(names):
            for i, (text, page, x0, x1, y0, size, bold, lbi) in enumerate(docs[name]):
                y = i * 14.0 if y0 is None else y0
                rows.append((d, i, text, page, x0, x1, y, y + 10, size, bold, lbi))
        found = S.read_statutes(spark.createDataFrame(rows, LINES), **more).collect()
        at = {(r["doc"], r["node"]): r["number"] or r["heading"] for r in found}
        out = {name: [] for name in names}
        for r in sorted(found, key=lambda r: (r["doc"], r["idx"])):
            out[names[r["doc"]]].append((r["type"], r["number"], r["heading"], r["text"], at.get((r["doc"], r["parent"]))))
        return out

    return run


CASES = {
    "levels": (
        [big("Part 1—Preliminary"), big("Division 2—Scope"), head("1 Purposes"), line("The purposes are—"), line("(a) one; and", PARA), line("(i) deep; or", SUB), line("(A) deeper;", 260.0), line("(ii) deep too.", SUB), line("(b) two.", PARA), head("2 Next"), line("(1) Text of it"), line("that goes on.")],
        [("part", "1", "Preliminary", "", None), ("division", "2", "Scope", "", "1"), ("section", "1", "Purposes", "The purposes are—", "2"), ("paragraph", "a", None, "one; and", "1"), ("subparagraph", "i", None, "deep; or", "a"), ("sub_subparagraph", "A", None, "deeper;", "i"),
         ("subparagraph", "ii", None, "deep too.", "a"), ("paragraph", "b", None, "two.", "1"), ("section", "2", "Next", "", "2"), ("subsection", "1", None, "Text of it that goes on.", "2")],
    ),
    "subdivision": ([big("Part 1—Offences"), head("(3) Common assault"), head("20 Threats to kill"), line("Text."), head("(4) Endangering"), head("21 Traps")],
                    [("part", "1", "Offences", "", None), ("subdivision", "3", "Common assault", "", "1"), ("section", "20", "Threats to kill", "Text.", "3"), ("subdivision", "4", "Endangering", "", "1"), ("section", "21", "Traps", "", "4")]),
    "wrapped heading": ([head("44"), head("Alternative verdicts"), line("A jury may."), head("464ZGFB Destruction"), head("of samples"), line("Text.")],
                        [("section", "44", "Alternative verdicts", "A jury may.", None), ("section", "464ZGFB", "Destruction of samples", "Text.", None)]),
    "citations": ([head("5 Repeals"), line("The following are repealed by the"), head("Crimes (Theft) Act"), head("1973 as amended"), line("and nothing more.")],
                  [("section", "5", "Repeals", "The following are repealed by the Crimes (Theft) Act 1973 as amended and nothing more.", None)]),
    "groups": ([head("1 One"), line("Text."), head("Theft, robbery and burglary"), head("2 Two"), line("accused means one", x0=HEAD)],
               [("section", "1", "One", "Text.", None), ("heading_group", None, "Theft, robbery and burglary", "", "1"), ("section", "2", "Two", "accused means one", None)]),
    "definitions": (
        [head("3 Definitions"), line("In this Act—"), line("accused means a person who—", lbi="accused"), line("(a) is charged; or", PARA), line("(b) is not.", PARA), line("Chief Officer of the", lbi="Chief Officer of the", bold=True), line("Institute means one.", WRAP, lbi="Institute"), line("of the"), line("court has no start", lbi="court")],
        [("section", "3", "Definitions", "In this Act—", None), ("definition", None, "accused", "means a person who—", "3"), ("paragraph", "a", None, "is charged; or", "accused"), ("paragraph", "b", None, "is not.", "accused"), ("definition", None, "Chief Officer of the Institute", "means one. of the court has no start", "3")],
    ),
    "lead-in": ([head("4 Meaning of offence"), line("(6) In this section—"), line("offence means a thing;", lbi="offence"), line("thing means a thing.", lbi="thing"), line("(7) Next.")],
                [("section", "4", "Meaning of offence", "", None), ("subsection", "6", None, "In this section—", "4"), ("definition", None, "offence", "means a thing;", "6"), ("definition", None, "thing", "means a thing.", "6"), ("subsection", "7", None, "Next.", "4")]),
    "hanging list": ([head("5 Footpaths"), line("(1) A person who—"), line("(a) stands; or", PARA), line("(b) sits—", PARA), line("is guilty of an offence."), line("(2) Another.")],
                     [("section", "5", "Footpaths", "", None), ("subsection", "1", None, "A person who—", "5"), ("paragraph", "a", None, "stands; or", "1"), ("paragraph", "b", None, "sits—", "1"), ("continuation", None, None, "is guilty of an offence.", "1"), ("subsection", "2", None, "Another.", "5")]),
    "insertions": ([head("6 Runs"), line("(a) one;", PARA), line("(ab) inserted;", PARA), line("(ac) again;", PARA), line("(b) two;", PARA), line("(i) in two;", SUB), line("(ia) more;", SUB), line("(ii) end.", SUB), line("(c) three.", PARA)],
                   [("section", "6", "Runs", "", None)] + [("paragraph", n, None, t, "6") for n, t in (("a", "one;"), ("ab", "inserted;"), ("ac", "again;"), ("b", "two;"))] + [("subparagraph", n, None, t, "b") for n, t in (("i", "in two;"), ("ia", "more;"), ("ii", "end."))] + [("paragraph", "c", None, "three.", "6")]),
    "h then i": ([head("7 Letters"), line("(g) g;", PARA), line("(h) h;", PARA), line("(i) i;", PARA), line("(j) j.", PARA)], [("section", "7", "Letters", "", None)] + [("paragraph", n, None, t, "7") for n, t in (("g", "g;"), ("h", "h;"), ("i", "i;"), ("j", "j."))]),
    "repealed": ([head("8 Stars"), line("(b) b;", PARA), *[line("*", 200.0 + 50 * i, y0=28.0) for i in range(4)], line("(d) d.", PARA), line("* * *"), line("(2) Two.")],
                 [("section", "8", "Stars", "", None), ("paragraph", "b", None, "b;", "8"), ("repealed", None, None, "* * * *", "b"), ("paragraph", "d", None, "d.", "8"), ("repealed", None, None, "* * *", "d"), ("subsection", "2", None, "Two.", "8")]),
    "two stars are text": ([head("9 Few"), line("Text"), line("*"), line("*", y0=100.0), line("more.")], [("section", "9", "Few", "Text * * more.", None)]),
    "notes": ([head("10 Noted"), line("(1) Text."), line("Notes"), line("1 See section 3."), line("2 See the", x1=500.0), line("1958 Act.", x1=500.0), head("11 After"), line("Note"), line("Unnumbered."), head("12 Last")],
              [("section", "10", "Noted", "", None), ("subsection", "1", None, "Text.", "10"), ("note", "1", None, "See section 3.", "1"), ("note", "2", None, "See the 1958 Act.", "1"), ("section", "11", "After", "", None), ("note", None, None, "Unnumbered.", "11"), ("section", "12", "Last", "", None)]),
    "examples": ([head("13 Harm"), line("Examples"), line("• one thing."), line("• another."), line("(2) Text."), line("Example"), line("A person may—"), line("(a) run;"), line("(b) stop.")],
                 [("section", "13", "Harm", "", None), ("example", "1", None, "one thing.", "13"), ("example", "2", None, "another.", "13"), ("subsection", "2", None, "Text.", "13"), ("example", None, None, "A person may—", "2"), ("example", "a", None, "run;", "2"), ("example", "b", None, "stop.", "2")]),
    "penalties": ([head("14 Offence"), line("(1) Don't."), line("Penalty: If intended—"), line("5 years or more."), line("(2) Nor this."), line("No Penalty: word inside.")],
                  [("section", "14", "Offence", "", None), ("subsection", "1", None, "Don't.", "14"), ("penalty", None, None, "Penalty: If intended— 5 years or more.", "1"), ("subsection", "2", None, "Nor this. No Penalty: word inside.", "14")]),
    "schedules": ([head("15 End"), line("Text."), big("Schedule 2—Amendments of Acts"), line("Section 15"), head("1 Courts"), line("Text."), line("2 Juries are", WRAP), line("2.1 Part of two", WRAP), line("2005 is no item", WRAP), big("SCHEDULE 3"), line("Sections 6(3), 15"), big("Savings"), head("1 Old matters")],
                  [("section", "15", "End", "Text.", None), ("schedule", "2", "Amendments of Acts (Section 15)", "", None), ("item", "1", "Courts", "Text.", "2"), ("item", "2", None, "Juries are", "2"), ("subitem", "2.1", None, "Part of two 2005 is no item", "2"), ("schedule", "3", "Savings (Sections 6(3), 15)", "", None), ("clause", "1", "Old matters", "", "3")]),
    "front": ([line("Authorised Version"), line("Preamble"), line("Whereas."), line("The Parliament of Victoria therefore enacts:"), big("Part 1—X"), head("1 Y")],
              [("preamble", None, "Preamble", "Whereas.", None), ("part", "1", "X", "", None), ("section", "1", "Y", "", "1")]),
    "wrapped reference": ([head("16 Long"), line("(1) as set out in subsection", x1=395.0), line("(3), which has it.", x1=395.0), line("(2) Clean.", x1=395.0)],
                          [("section", "16", "Long", "", None), ("subsection", "1", None, "as set out in subsection (3), which has it.", "16"), ("subsection", "2", None, "Clean.", "16")]),
    "words": ([head("17 Words"), line("re-"), line("peal of twenty-"), line("Two"), line("• item"), line(""), line("end—"), line("on")], [("section", "17", "Words", "re-peal of twenty- Two\n• item end— on", None)]),
    "before all": ([line("Some text"), line("and more."), big("Part 1—A")], [("part", None, "Preliminary", "Some text and more.", None), ("part", "1", "A", "", None)]),
    "table": ([head("18 Forms"), line("Text—"), head("Table 1"), line("Old", y0=60.0), line("New", 330.0, y0=60.0), line("a long", y0=80.0), line("b", 330.0, y0=80.0), line("cell", y0=92.0), line("c", y0=112.0), line("d", 330.0, y0=112.5), line("Old", page=2, y0=0.0), line("New", 330.0, page=2, y0=0.0), line("e", page=2, y0=20.0), line("f", 330.0, page=2, y0=20.0), head("19 Next", page=2)],
              [("section", "18", "Forms", "Text—", None), ("table", None, "Table 1", "Old | New\na long cell | b\nc | d\ne | f", "18"), ("section", "19", "Next", "", None)]),
    "table of lines": ([head("20 Styles"), line("These:", y0=-20.0), *[line(t, x, y0=20.0 * r) for r, row in enumerate(("ab", "cd", "ef")) for t, x in zip(row, (HEAD, 330.0))], *[line("*", HEAD + 60 * i, y0=60.0) for i in range(4)], line("g", y0=80.0), line("h.", 330.0, y0=80.0), line("(2) After", PARA, y0=100.0)],
                       [("section", "20", "Styles", "These:", None), ("table", None, None, "a | b\nc | d\ne | f\n* * * * | \ng | h.", "20"), ("subsection", "2", None, "After", "20")]),
    "no tables": ([head("464ZGFB", y0=0.0), head("Long number", 254.0, y0=0.0), line("one", y0=20.0), line("row", 330.0, y0=20.0), line("indent", WRAP, y0=40.0), line("only", HEAD, y0=60.0), line("20 apart", 211.0, y0=60.0)],
                  [("section", "464ZGFB", "Long number", "one row indent only 20 apart", None)]),
    "nothing": ([line(" ")], []),
}


def test_cases(read):
    found = read({k: lines for k, (lines, _) in CASES.items()})
    assert found == {k: expected for k, (_, expected) in CASES.items()}


def test_bills_profiles_and_learned_rules(read):
    clause = read({"b": [big("Chapter 1—A"), big("Part 5.2—B"), head("3 C")]}, profile=S.Profile(patterns={"part": r"^Part\s+(\d+\.\d+)\s*—\s*(.+)$"}, provision="clause"))
    assert clause["b"] == [("chapter", "1", "A", "", None), ("part", "5.2", "B", "", "1"), ("clause", "3", "C", "", "5.2")]
    with pytest.raises(ValueError, match="group"):
        S.Profile(patterns={"part": "^Part$"})
    rules = ({"id": "r1", "pattern": r"^Rule (\d+)\s*", "flags": {"bold": False}, "parents": ["section"], "then": {"open": "subsection", "number": True}}, {"id": "r2", "ranges": {"size": (8, 10)}, "then": {"continue": True}}, {"id": "r3", "pattern": "^Remark", "then": {"open": "note"}})
    lines = [line("Rule 1 outside"), head("1 Rules"), line("Rule 7 inside"), line("(a) small", PARA, size=9.0), line("Remark here")]
    assert read({"l": lines}, profile=S.Profile(learned=rules))["l"] == [("part", None, "Preliminary", "Rule 1 outside", None), ("section", "1", "Rules", "", "Preliminary"), ("subsection", "7", None, "inside (a) small", "1"), ("note", None, None, "Remark here", "7")]
    items = read({"i": [big("Schedule 4—Things"), head("1 A")]}, profile=S.Profile(item_schedules=("4",)))
    assert items["i"][1][0] == "item"


def random_document(rnd, n):
    pool = [*(x for lines, _ in CASES.values() for x in lines if x[0].strip() and not x[0].startswith("The Parliament")), *(big(f"Schedule {k}—S") for k in range(2)), line("In this Part—"), line("term means", lbi="term")]
    out = []
    while len(out) < n:
        k = rnd.randrange(len(pool))
        out += pool[k : k + rnd.randint(1, 6)]
    return [(t, 1 + i // 4, x0, x1, (i % 4) * 14.0 if y0 is None else y0, s, b, l) for i, (t, _, x0, x1, y0, s, b, l) in enumerate(out)]


def test_ranges_of_any_size_give_equal_nodes(read):
    rnd = random.Random(5)
    docs = {k: random_document(rnd, 80) for k in range(9)}
    whole = read(docs, range_pages=10**6)
    for pages in (1, 5):
        assert read(docs, range_pages=pages) == whole


def test_every_line_is_told_once_and_boxes_hold_runs(spark):
    rnd = random.Random(6)
    rows = [(1, i, t, p, x0, x1, y0, y0 + 10, s, b, l) for i, (t, p, x0, x1, y0, s, b, l) in enumerate(random_document(rnd, 200))]
    lines = spark.createDataFrame(rows, LINES)
    tags = S.tag_lines(lines, range_pages=3)
    assert sorted(r["line_no"] for r in tags.select("line_no").collect()) == list(range(len(rows)))
    at = {r["line_no"]: r["node"] for r in tags.collect()}
    own = {}
    for r in S.node_boxes(tags, lines).collect():
        own.setdefault(r["node"], []).append(r)
    for i, row in enumerate(rows):
        if at[i] is not None:
            assert any(b["page"] == row[3] and b["x0"] <= row[4] + 0.1 and b["x1"] >= row[5] - 0.1 and b["y0"] <= row[6] and b["y1"] >= row[7] for b in own[at[i]])


def test_of_nothing(spark):
    assert S.read_statutes(spark.createDataFrame([], LINES)).count() == 0
    odd = spark.createDataFrame([(1, 0, None, None, "c"), (1, 1, "1 A", None, "c")], "doc int, line_no int, text string, page int, type string").withColumn("bold", F.lit(True))
    assert [(r["type"], r["number"]) for r in S.read_statutes(odd).collect()] == [("section", "1")]


def test_rows_of_a_batch_are_its_rows(spark):
    """Nested columns with and without nulls come to the reader as they are."""
    import pyarrow as pa

    shape, flags = [[None, ["1", "A"], None], [None] * 3, [["2", ""], None, ["3", "b"]]], [[True, False], [False, False], [True, True]]
    line = lambda i: {"doc": 1, "kind": 1, "head": None, "shapes": shape[i], "flags": flags[i], "rules": None, "text": "x"}
    head = {"doc": 1, "kind": 0, "head": {"state": "{}", "right": [1.0]}, "shapes": None, "flags": None, "rules": None, "text": None}
    ruled = line(1) | {"rules": [{"rule": 0, "number": "4"}]}
    kinds = pa.schema([("doc", pa.int64()), ("kind", pa.int32()), ("head", pa.struct([("state", pa.string()), ("right", pa.list_(pa.float64()))])), ("shapes", pa.list_(pa.list_(pa.string()))), ("flags", pa.list_(pa.bool_())), ("rules", pa.list_(pa.struct([("rule", pa.int32()), ("number", pa.string())]))), ("text", pa.string())])
    for rows in ([head, line(0), line(1), line(2), ruled], [line(0), line(2)], [head], [line(1)], []):
        whole = pa.RecordBatch.from_pylist([head, *rows], schema=kinds)
        assert list(S._rows(whole)) == [head, *rows] and list(S._rows(whole.slice(1))) == rows  # a part of a batch, too


def test_topics_in_one_way(spark):
    """A line of many words is no topic, however its words could be cut up."""
    import re

    plain, one_way = r"^(?=[A-Z])(?!.*[—–]\s*$)(?:\S+\s*){1,8}$", S.TESTS["topic"]
    lines = ["A", "Ab cd ef gh ij kl mn op", "Ab cd ef gh ij kl mn op qr", "ab cd", "Ab —", "Ab — c", "A b c d e f g h\u2028", "A b c d e f g h \u2028", "A\r—"]
    got = spark.createDataFrame([(t,) for t in lines], "t string").selectExpr("t", *[f"t RLIKE r'{p}' AS x{i}" for i, p in enumerate((plain, one_way))]).collect()
    assert all(r["x0"] == r["x1"] for r in got) and [r["x1"] for r in got][:4] == [True, True, False, False]
    assert "++" in one_way and re.compile(one_way)  # Python knows possessive repeats as well
