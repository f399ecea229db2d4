"""Small forms that no table query covers."""

from pyspark.sql import functions as F

from folioscope.functions import labels as B
from folioscope.operators import edits as E
from folioscope.operators import library as L


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_forms(spark):
    assert one(spark, B.lead_in_act(F.lit("an offence against section 3 of the Crimes (Appeals) Act 1958—"))) == "Crimes (Appeals) Act 1958"
    assert one(spark, B.lead_in_act(F.lit("of the Crimes Act 1958 and more"))) is None and one(spark, B.lead_in_act(F.lit(None).cast("string"))) is None
    rows = F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("d")))
    assert one(spark, B.markdown_table(rows)) == "| a\\|b | c |\n| --- | --- |\n| d |  |"
    text = F.lit("In this Part—\ncourt means a\nplace;\n\njudge means one")
    assert one(spark, B.definition_clauses(text, lambda x: x.rlike(r"^\w+ means"))) == ["In this Part—", "court means a place;", "judge means one"]
    assert one(spark, B.line_shape(F.lit("12A(b). Word"))) == r"^\d+A\(b\)\." and one(spark, B.line_shape(F.lit(" "))) is None
    assert one(spark, B.printed_number(F.lit("example"), F.lit("a"))) == "(a)" and one(spark, B.printed_number(F.lit("example"), F.lit("1"))) == "1"
    same = [one(spark, B.rule_signature(F.lit('{"bold": true}'), F.lit('{"type": "x"}'))) for _ in range(2)]
    assert same[0] == same[1] and len(same[0]) == 12


def test_numbers():
    assert L.level_ranks(["part", "section", "subsection"], {"clause": "section", "x": "y"}) == {"part": 0, "section": 1, "subsection": 2, "clause": 1}
    assert L.pages_of(45, 20) == {"pages": 3, "page": 2, "previous": 0, "next": 40} and L.pages_of(0, 0) == {"pages": 1, "page": 1, "previous": -1, "next": -1}


def test_schema_grows(spark, frame):
    stored = frame([(1, "a")], "idx int, note string")
    grown = E.with_columns(stored, {"note": "string", "flag": "boolean"})
    assert grown.columns == ["idx", "note", "flag"] and tuple(grown.first()) == (1, "a", None)


def test_refused_split_changes_nothing(frame):
    nodes = frame([(1, 0, "head", True), (1, 1, "abc def", True), (1, 2, "gone", False)], "doc int, idx int, text string, live boolean")
    for at, target in ((0, 0), (7, 0), (3, 1), (3, 2)):
        out = E.split_text(nodes, frame([(1, 1, at, target)], "doc int, idx int, at int, target int"))
        assert {r["idx"]: r["text"] for r in out.collect()} == {0: "head", 1: "abc def", 2: "gone"}
    out = E.split_text(nodes, frame([(1, 1, 3, 0)], "doc int, idx int, at int, target int"))
    assert {r["idx"]: r["text"] for r in out.collect()} == {0: "head\ndef", 1: "abc", 2: "gone"}


def test_untouched_rows_keep_null_texts(frame):
    nodes = frame([(1, 0, None, None, True), (1, 1, None, "abc def", True), (1, 2, None, None, True), (1, 3, 1, "", True)], "doc int, idx int, unit int, text string, live boolean")
    out = E.split_text(nodes, frame([(1, 1, 3, 0)], "doc int, idx int, at int, target int"))
    assert {r["idx"]: r["text"] for r in out.collect()} == {0: "def", 1: "abc", 2: None, 3: ""}
    units = nodes.withColumn("unit", F.lit(1))
    out = E.merged(units, frame([(1, 0, 1)], "doc int, target int, source int"))
    assert {r["idx"]: (r["text"], r["live"]) for r in out.collect()} == {0: ("abc def", True), 1: ("abc def", False), 2: (None, True), 3: ("", True)}


def test_blocks_of_any_rank(frame):
    ranks = [12, 12, 3, 40, 41, None, 3, 0]
    nodes = frame([(1, i, r) for i, r in enumerate(ranks)], "doc int, idx int, rank int")
    got = {}
    for r in E.block_under(nodes, nodes.select("doc", "idx")).collect():
        got.setdefault(r["root"], []).append(r["idx"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [0], 1: [1], 2: [2, 3, 4, 5], 3: [3, 4, 5], 4: [4, 5], 5: [5], 6: [6], 7: [7]}
