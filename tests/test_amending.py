"""The grammar of amending sentences, and whole amending Acts."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import amending as A

CPA = "Criminal Procedure Act 2009"


@pytest.fixture
def read(spark):
    def run(*sentences):
        rows = [(i, t, "s. 9", CPA) for i, t in enumerate(sentences)]
        found = A.read_amendments(spark.createDataFrame(rows, "id int, text string, provision string, principal string")).orderBy("id", "op_no").collect()
        return [[r for r in found if r["id"] == i] for i in range(len(sentences))]

    return run


def test_sentences(read):
    got = read(
        "In section 4(1)(f) of the Criminal Procedure Act 2009, for “charge-sheet” substitute “charge”.",
        'In section 353(1) of the Principal Act— (a) in paragraph (b), for "x" substitute "y"; (b) after "offence" insert "or a stalking offence"; (c) omit "or".',
        "In section 5(2)(b)(ii)(A) and (iii) of the Principal Act, omit “(a) one; (b) two”.",
        "In section 6 of the Principal Act, for “the words “in “deep” quotes” here” substitute “none",
        "In the definition of court in section 3 of the Bail Act 1977, after “a” insert “b”.",
        "In section 3 of the Principal Act— (a) in the definition of “court”, omit “x”; and (b) for the definition of judge substitute— “judge means one;”.",
        "Before section 7(1) of the Principal Act insert— “(1A) Earlier.”.",
        "Clauses of no form",
        None,
        "",
        "In section 8(1), (3) and (4)(a) of the Principal Act, omit “z”.",
        "After section 9 of the Principal Act insert— words without quotes.",
    )
    brief = lambda r: (r["provision"], r["section"], "/".join(r["path"]), r["action"], r["old"], r["new"])
    assert [brief(r) for r in got[0]] == [("s. 9", "4", "1/f", "substitute", "charge-sheet", "charge")]
    assert [brief(r) for r in got[1]] == [("s. 9(a)", "353", "1/b", "substitute", "x", "y"), ("s. 9(b)", "353", "1", "insert_after", "offence", "or a stalking offence"), ("s. 9(c)", "353", "1", "omit", "or", None)]
    assert [brief(r) for r in got[2]] == [("s. 9", "5", p, "omit", "(a) one; (b) two", None) for p in ("2/b/ii/A", "2/b/iii")]
    assert [brief(r) for r in got[3]] == [("s. 9", "6", "", "substitute", "the words “in “deep” quotes” here", "none")]
    assert (got[4][0]["definition"], got[4][0]["target_act"], got[4][0]["action"]) == ("court", "Bail Act 1977", "insert_after")
    assert [(r["definition"], r["action"], r["new"]) for r in got[5]] == [("court", "omit", None), ("judge", "replace_definition", "judge means one;")]
    assert (got[6][0]["action"], got[6][0]["number"], got[6][0]["new"], got[6][0]["before"]) == ("insert_provision", "1A", "Earlier.", True)
    assert [got[k][0]["action"] for k in (7, 8, 9)] == ["unparsed"] * 3 and all(len(got[k]) == 1 for k in (7, 8, 9))
    assert [brief(r)[2] for r in got[10]] == ["1", "3", "4/a"]
    assert (got[11][0]["action"], got[11][0]["new"]) == ("insert_provision", "words without quotes")


def test_words_in_quotes_are_no_grammar(read):
    """Whatever stands in quotes comes back as it is, and makes no operation."""
    words = ["(a) omit; and (b) repeal", "of the Crimes Act 1958", "substitute", "is repealed.", "‹0›", "In section 4, omit", "; (c) x—(d) y"]
    for w, (r, *more) in zip(words, read(*[f"In section 4 of the Principal Act, for “{w}” substitute “{w}{w}”." for w in words])):
        assert (r["action"], r["old"], r["new"], r["target_act"], more) == ("substitute", w, w + w, CPA, [])


def test_whole_acts(spark):
    nodes = [
        ("part", "3", "Amendment of Criminal Procedure Act 2009", ""), ("section", "71", "Committal", ""), ("subsection", "1", None, "In section 181(2) of the Principal Act—"), ("paragraph", "a", None, "omit “or”;"), ("paragraph", "b", None, "after “trial” insert “or hearing”."),
        ("section", "72", "Schedule", "The Acts in Schedule 3 are amended as set out in it."), ("part", "4", "Other", ""), ("section", "73", None, "In this Part, Principal Act means the Bail Act 1977."), ("section", "74", None, "Section 5 of the Principal Act is repealed."),
        ("schedule", "3", "Amendments", ""), ("schedule_act", None, "Courts Act 1990", ""), ("item", "2.1", None, "In section 1, omit “x”."),
    ]
    frame = spark.createDataFrame([(1, i, *n) for i, n in enumerate(nodes)], "doc int, idx int, type string, number string, heading string, text string")
    got = [(r["provision"], r["target_act"], r["action"], r["section"]) for r in A.read_acts(frame).orderBy("first", "op_no").collect()]
    assert got == [("s. 71(1)(a)", CPA, "omit", "181"), ("s. 71(1)(b)", CPA, "insert_after", "181"), ("s. 72", CPA, "unparsed", None), ("s. 74", "Bail Act 1977", "repeal", "5"), ("s. 72(Sch. 3 item 2.1)", "Courts Act 1990", "omit", "1")]
    assert A.read_acts(frame.where("false")).count() == 0
    keys = {r["key"]: r["instructions"] for r in A.instructions_by_key(A.read_acts(frame)).collect()}
    assert keys == {f"{CPA}|s181|": 2, "Bail Act 1977|s5|": 1, "Courts Act 1990|s1|": 1}


def test_groups_come_from_one_match(read, spark):
    """All groups at once, the same as one by one, also where a text holds the sign that parts them."""
    lines = ["In section 4(1) of the Principal Act, omit", "Section 5 of the Bail Act 1977 is repealed.", "In section 6 of the Principal Act,\x01 omit", "\x01", "", "of no form"]
    frame = spark.createDataFrame([(t,) for t in lines], "t string").select("t", A._groups(F.col("t"), A.SENTENCE, 9).alias("g"), *[F.when(F.col("t").rlike(A.SENTENCE), F.regexp_extract("t", A.SENTENCE, k)).alias(f"g{k}") for k in range(1, 10)])
    for r in frame.collect():
        assert list(r["g"]) == [r[f"g{k}"] for k in range(1, 10) if r[f"g{k}"] is not None]
    (r,), (x,) = read("In section 6 of the Principal Act, for “\x01” substitute “y”.", "In section 6 of the Principal Act,\x01 omit “z”.")
    assert (r["section"], r["action"], r["old"], r["new"]) == ("6", "substitute", "\x01", "y")
    assert (x["section"], x["target_act"], x["action"]) == ("6", CPA, "unparsed")


def test_keys_find_actions_once(spark):
    """No filter below the aggregate finds the actions a second time; unparsed sentences alone make no key."""
    frame = spark.createDataFrame([(1, "Section 5 of the Bail Act 1977 is repealed.", "s. 1", CPA), (2, "Of no form", "s. 2", CPA)], "id int, text string, provision string, principal string")
    keys = A.instructions_by_key(A.read_amendments(frame))
    filters = [x for x in keys._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("regexp" in x or "RLIKE" in x for x in filters)
    assert [tuple(r) for r in keys.collect()] == [("Bail Act 1977|s5|", 1, "repeal")]
