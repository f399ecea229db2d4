"""What entries of a memorandum name, and ranges over inserted provisions."""

from pyspark.sql import functions as F

from folioscope.operators import memoranda as E


def test_entries(spark):
    rows = [
        (1, 1, "1", None, "General outline."),
        (1, 2, "2", None, "Substitutes section 44A(1) and\nsections 5 to 6 of the Evidence Act 2008"),
        (1, 3, "3", None, "Clause 3 inserts new sections 4 to 5B, 9 and 12 of the Crimes Act 1958, which the Bail Act 1977 cites."),
        (1, 4, "4", None, "Amends section 7 to fix it."),
        (1, 5, "4", "1", "Nothing named."),
        (1, 6, "4", None, None),
        (2, 1, "1", None, "This Act begins."),
    ]
    entries = spark.createDataFrame(rows, "doc int, idx int, number string, schedule string, text string")
    acts = spark.createDataFrame([("Crimes Act 1958", "crimes", True), ("Bail Act 1977", None, False)], "title string, act string, in_force boolean")
    clauses = spark.createDataFrame([(1, "4", None), (1, "4", "1"), (1, "4", "1")], "doc int, number string, schedule string")
    own = spark.createDataFrame([(1, "cpa"), (2, "other")], "doc int, act string")
    t = E.resolve_entries(entries, acts, clauses, own)
    got = {(r["doc"], r["idx"]): (r["kind"], r["act"], r["act_title"], r["action"], r["section_ref"]) for r in t.collect()}
    assert got == {
        (1, 1): (None, None, None, None, None), (1, 2): ("act_section", None, "Evidence Act 2008", "substitutes", "44A(1)"),
        (1, 3): ("act_section", "crimes", "Crimes Act 1958", "inserts", "4 to 5B, 9 and 12"), (1, 4): ("act_section", "crimes", "Crimes Act 1958", "amends", "7"),
        (1, 5): ("bill_clause", "cpa", None, None, None), (1, 6): ("bill_clause", "cpa", None, None, None), (2, 1): ("act_section", "other", None, None, None),
    }
    provisions = spark.createDataFrame([("crimes", n, i) for i, n in enumerate(["3", "4", "4A", "5", "5A", "5B", "6", "7", "9"])], "act string, number string, position int")
    reach = {}
    for r in E.explained(t, provisions).where("doc = 1").collect():
        reach.setdefault(r["idx"], set()).add(r["number"])
    assert reach == {2: {"44a"}, 3: {"4", "4a", "5", "5a", "5b", "9", "12"}, 4: {"7"}}
    links = spark.createDataFrame([(1, "4", None, None, "77"), (1, "4", "1", "2", "8")], "doc int, clause string, clause_schedule string, schedule string, number string")
    assert {r["idx"]: (r["schedule"], r["number"]) for r in E.suggestions(t, provisions, links).where("doc = 1").collect()} == {2: (None, None), 3: (None, "4"), 4: (None, "7"), 5: ("2", "8"), 6: (None, "77")}


def test_references(spark):
    ref = lambda s: [tuple(x) for x in spark.range(1).select(E.references(F.lit(s)).alias("r")).first()["r"]]
    assert ref("4(1) to 5B, 9 and 12A(2)(a)") == [("4", "5b"), ("9", None), ("12a", None)] and ref("7") == [("7", None)]


def test_references_are_spread_once(spark):
    """What a reference reaches is found once a distinct Act and reference, in one pass without a union, and entries are
    sorted in as many partitions as the session has."""
    entries = spark.createDataFrame([(d, i, "1", None, "Amends sections 4 to 5 and 5 to 4, 9 of this Act.") for d in range(3) for i in range(20)], "doc int, idx int, number string, schedule string, text string")
    acts = spark.createDataFrame([("Crimes Act 1958", "crimes", True)], "title string, act string, in_force boolean")
    own = spark.createDataFrame([(d, "own") for d in range(3)], "doc int, act string")
    t = E.resolve_entries(entries, acts, entries.select("doc", "number", "schedule"), own)
    assert "RepartitionByExpression" in t._jdf.queryExecution().optimizedPlan().toString()
    provisions = spark.createDataFrame([("own", n, i) for i, n in enumerate(["4", "4A", "5"])], "act string, number string, position int")
    reach = E.reached(t, provisions)
    assert "Union" not in reach._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["number"] for r in reach.collect()) == ["4", "4a", "5", "9"]
    assert E.explained(t, provisions).count() == 240
    links = spark.createDataFrame([], "doc int, clause string, clause_schedule string, schedule string, number string")
    assert {r["number"] for r in E.suggestions(t.union(t), provisions, links).collect()} == {"4"}
