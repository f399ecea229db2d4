import datetime

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.diff import diff_markup, is_reordering, node_diff, side_text, spans, word_diff
from folioscope.functions.html import main_text, main_text_of, sanitise
from folioscope.functions.instructions import match_instructions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert one(spark, T.search_tokens(F.lit("S 3(1), Élan-vital_x"))) == ["s", "3", "1", "élan", "vital", "x"]
    assert one(spark, T.vocabulary_tokens(F.lit("a ab a1bc"))) == ["ab", "bc"]
    assert one(spark, T.diff_tokens(F.lit(""))) == []


def test_normal_forms(spark):
    assert one(spark, T.normalise(F.lit("a \n b  "))) == "a b b"
    assert one(spark, T.reflow_keeping_bullets(F.lit("a\nb\n• c\nd"))) == "a b\n• c d"
    assert one(spark, T.join_printed_lines(F.array(*map(F.lit, ["charge-", "sheet", "• x", "y"])))) == "charge-sheet\n• x y"
    assert one(spark, T.slugify(F.lit(" Crimes Act (1958)! "))) == "crimes-act-1958"
    assert one(spark, T.digit_mask(F.lit("page  12 of 30"))) == "page ## of ##"


def test_dates_and_slugs(spark):
    assert one(spark, T.printed_date(F.lit("as at 1 July 2026"))) == datetime.date(2026, 7, 1)
    assert one(spark, T.printed_date(F.lit("1 Jul 2026"))) == datetime.date(2026, 7, 1)
    assert one(spark, T.printed_date(F.lit("July"))) is None
    assert one(spark, T.work_of(F.lit("evidence-act-v13"))) == "evidence-act"
    assert one(spark, T.version_of(F.lit("evidence-act"))) is None


def test_front_matter(spark):
    f = one(spark, T.front_matter(F.lit("Version No. 105\nCriminal Procedure Act 2009\nNo. 7 of 2009\nVersion incorporating amendments as at\n26 April 2026")))
    assert (f["version"], f["as_at"], f["act_no"], f["year"]) == (105, datetime.date(2026, 4, 26), "7", 2009)
    assert one(spark, T.front_matter(F.lit("nothing")))["version"] is None


def test_notes(spark):
    note = F.lit("S. 4(8C)(f) amended by Nos 26/2014 s. 3, 68/2009 s. 97(Sch. item 1).")
    assert one(spark, T.citations(note)) == ["26/2014", "68/2009"]
    assert one(spark, T.note_target(note)) == "s. 4(8c)(f)"
    assert one(spark, T.change_kind(F.lit("S. 9 inserted by No. 1/2000, repealed by No. 2/2001"))) == "repealed"
    assert one(spark, T.sub_path(F.lit("(1)(a)(ii)"))) == ["1", "a", "ii"]


def test_names(spark):
    assert one(spark, T.ancestors(F.lit("pt2/s97/d"))) == ["pt2", "pt2/s97", "pt2/s97/d"]
    assert one(spark, T.section_numbers(F.lit("sections 12 to 15 and 44A"))) == ["12", "44A"]
    assert one(spark, T.defined_terms(F.lit("court, tribunal and panel means x\nother"))) == ["court", "tribunal", "panel"]
    assert one(spark, T.split_rows(F.lit("a | b\n\nc | d"))) == [["a", "b"], ["c", "d"]]


def test_word_diff(spark, frame):
    assert spans("the old law".split(), "the new law".split()) == [(True, 0, 1, 0, 1), (False, 1, 1, 1, 1), (True, 2, 1, 2, 1)]
    d = frame([("a b", "a b"), ("a b c", "c a b"), ("a", None), (None, None), ("the old law", "the <new> law")], "old string, new string").withColumn("d", word_diff(F.col("old"), F.col("new")))
    got = d.select("d", is_reordering(F.col("d")).alias("r"), diff_markup(F.col("d")).alias("m"), side_text(F.col("d"), "old").alias("o"), side_text(F.col("d"), "new").alias("n")).collect()
    assert [tuple(x) for x in got[4]["d"]] == [("equal", "the"), ("delete", "old"), ("insert", "<new>"), ("equal", "law")]
    assert (got[4]["m"], got[4]["o"], got[4]["n"]) == ("the <del>old</del> <ins>&lt;new&gt;</ins> law", "the old law", "the <new> law")
    assert [x["op"] for x in got[0]["d"]] == ["equal"] and not got[0]["r"] and got[1]["r"]
    assert [x["op"] for x in got[2]["d"]] == ["delete"] and got[3]["d"] == []


def test_node_diff(frame):
    d = frame([(["1", "2"], ["x", "y"], ["1", "3"], ["x z", "w"])], "ok array<string>, ot array<string>, nk array<string>, nt array<string>")
    ops = [(p["op"], p["old"], p["new"]) for p in d.select(node_diff(F.col("ok"), F.col("ot"), F.col("nk"), F.col("nt")).alias("d")).first()["d"]]
    assert ops == [("changed", 0, 0), ("delete", 1, None), ("insert", None, 1)]


def test_html(spark):
    assert sanitise('<div><p>a<script>x("</p>")</script><p>b &amp; <b onclick=1>c</div>') == "<p>a</p>\n<p>b &amp; <b>c</b></p>"
    assert sanitise(None) == "" and sanitise("<h1>T</h1>one<br><br>two<br>three<ul><li>x</li><li> </li></ul><p><br></p>") == "<h3>T</h3>\n<p>one</p>\n<p>two<br>three</p>\n<ul><li>x</li></ul>"
    page = "<body><nav><p>menu</p></nav><div><p>one</p></div><article><p>two words</p><p>three</p></article></body>"
    assert main_text(page) == "<p>two words</p>\n<p>three</p>" and main_text("<div>no paragraphs</div>") == ""
    assert one(spark, main_text_of(F.lit("<title>Request Rejected</title>"))) is None
    assert sanitise("<div>" * 3000 + "<b>" * 3000 + "deep").count("<b>") == 3000


def test_instructions(frame):
    ins = frame([(1, "4", "substitute_words", "old", "new"), (2, "4", "insert_after_words", "a", "far"), (3, "9", "omit_words", "zz", None), (4, "5", "insert_at_end", None, "there")], "id int, section string, action string, old string, new string")
    ch = frame([("4", "the old law", "the new law"), ("7", "b", "b far"), ("5", "there", "there x")], "section string, before string, after string")
    assert {r["id"]: r["status"] for r in match_instructions(ins, ch).collect()} == {1: "matched", 2: "elsewhere", 3: "not_found", 4: "earlier"}
