"""Mentions in texts against one regular expression over each text, and the links that are written."""

import random
import re

from pyspark.sql import functions as F

from folioscope.operators import links as K

ACT = r"(?-i:\b[A-Z][\w'()-]*(?:\s+(?:[A-Z][\w'()-]*|of|the|and|for|in|on|to|by|or))*\s+(?:Act|Bill)\s+(?:18|19|20)\d{2}\b)"
OTHERS = [("section", r"\bsections?\s+\d+[A-Za-z]*\b(?!(?:\s*\([^)]*\))?(?:\s+and\s+\d+[A-Za-z]*)?\s+of\s+(?:the|that|any)\b)"), ("part", r"\bPart\s+(?:[IVXLCDM]+|\d+[A-Za-z]*)\b"), ("division", r"\bDivision\s+\d+[A-Za-z]*\b"), ("act", ACT)]


def brute(text, terms):
    """One alternation: terms, the longest first, then the other mentions."""
    words = sorted({t.lower() for t in terms if re.match(r"\w", t)}, key=lambda t: (-len(t), t))
    parts = [("term", r"\b(?:" + "|".join(map(re.escape, words)) + r")\b")] * bool(words) + OTHERS
    return [(m.start(), m.lastgroup, m[0]) for m in re.finditer("|".join(f"(?P<{k}>{p})" for k, p in parts), text or "", re.I)]


def test_mentions_are_those_of_a_scan(spark):
    rnd = random.Random(4)
    pool = ["court", "Court", "high court", "judge", "judge's", "the", "act", "section 5", "sections 5A", "section 5(2) of the", "section 7 and 8 of that", "Part IV", "part 3A", "Division 2", "division", "Crimes Act 1958", "the Law of Courts Act 1990", "Bill 2001", "x-ray", "é", "Änderung", "co-op", "(", ".", ",", "\n", "—", "5", "ab", "abc"]
    terms = ["court", "high court", "high court judge", "Judge's", "section", "x-ray", "x", "Part IV court", "änderung", "co-op", "act", "ab", "abc", "", "—y", "court (x)"]
    texts = [None, ""] + [" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    t = spark.createDataFrame([(i % 3, i, x) for i, x in enumerate(texts)], "doc long, idx int, text string").repartition(4)
    own = {d: rnd.sample(terms, 9) for d in range(2)}  # the third document has none
    k = spark.createDataFrame([(d, x) for d, v in own.items() for x in [*v, *v[:2]]], "doc long, term string")
    found = {}
    for r in K.mentions(t, k).collect():
        found.setdefault(r["idx"], []).append((r["at"], r["kind"], r["said"]))
    for i, x in enumerate(texts):
        assert sorted(found.get(i, [])) == brute(x, own.get(i % 3, [])), (x, own.get(i % 3))
    assert K.mentions(t.where("false"), k).count() == 0


def test_links(spark):
    t = spark.createDataFrame([(1, 0, "A court <under> section 5, Part 2 or section 9 & the Crimes Act 1958.", None), (1, 1, "section 5 of this list; court", "5.html#court"), (1, 2, "the Own Act 1999, the Bail Act 1977", None)], "doc long, idx int, text string, here string")
    terms = spark.createDataFrame([(1, "court")], "doc long, term string")
    targets = spark.createDataFrame([("1", "term", "court", "5.html#court"), ("1", "section", "5", "5.html"), ("crimes act 1958", "section", "5", "/crimes/5.html"), ("1", "part", "2", "#part2"), ("", "act", "crimes act 1958", "/crimes/"), ("", "act", "own act 1999", "/own/"), ("", "act", "bail act 1977", "/bail/?a=1&b")], "owner string, kind string, key string, target string")
    own = spark.createDataFrame([(1, "Own Act 1999")], "doc long, title string")
    scopes = spark.createDataFrame([(1, 1, "Crimes Act 1958"), (1, 2, "Own Act 1999")], "doc long, idx int, scope string")
    links = K.resolved(K.mentions(t, terms), targets, scopes, own)
    html = {r["idx"]: r["linked"] for r in K.linked(t, links).collect()}
    assert html == {
        0: 'A <a href="5.html#court">court</a> &lt;under&gt; <a href="5.html">section 5</a>, <a href="#part2">Part 2</a> or section 9 &amp; the <a href="/crimes/">Crimes Act 1958</a>.',
        1: '<a href="/crimes/5.html">section 5</a> of this list; court', 2: 'the Own Act 1999, the <a href="/bail/?a=1&amp;b">Bail Act 1977</a>',
    }
    assert {r["idx"]: r["linked"] for r in K.linked(t, links, markdown=True).collect()}[0].startswith("A [court](5.html#court) <under> [section 5](5.html), [Part 2](#part2)")
    row = spark.range(1).select(K.governing_act(F.lit("an offence under the Crimes Act 1958—")).alias("a"), K.governing_act(F.lit("under the Crimes Act 1958 and")).alias("b")).first()
    assert (row["a"], row["b"]) == ("Crimes Act 1958", None)


def test_long_lists_of_terms_are_folded(spark, monkeypatch):
    """Terms of a document in many lists give what they give in one, and no row a word is made."""
    monkeypatch.setattr(K, "TERMS", 2)
    rnd = random.Random(5)
    terms = ["court", "high court", "high court judge", "judge rules", "court judge", "judge", "part", "crimes", "crimes act", "high"]
    texts = [" ".join(rnd.choice([*terms, "Crimes Act 1958", "Part IV", "section 5", "High", ",", "Bail"]) for _ in range(25)) for _ in range(40)]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc long, idx int, text string").repartition(4)
    k = spark.createDataFrame([(1, x) for x in terms], "doc long, term string")
    found = K.mentions(t, k)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["idx"], []).append((r["at"], r["kind"], r["said"]))
    assert all(sorted(got.get(i, [])) == brute(x, terms) for i, x in enumerate(texts))


def test_runs_of_capital_words(spark):
    """A run's one Act from any of its words on, a run without a year, and an Act that is longer than the window."""
    texts = ["Court Crimes Act 1958", "A-Crimes Act 1958", "Act 1958", "The Often Act 1958 Act 1960", "of-Bail Bill 2001", "Big " * 3000 + "Act", "Zed " * 1030 + "Act 1958", "X Act 19580"]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc long, idx int, text string")
    k = spark.createDataFrame([(1, "court"), (1, "a")], "doc long, term string")
    got = {}
    for r in K.mentions(t, k).collect():
        got.setdefault(r["idx"], []).append((r["at"], r["said"]))
    long = next(texts[6][i:] for i in range(0, 200, 4) if len(texts[6]) - i <= K.WINDOW)
    assert {i: sorted(v) for i, v in got.items()} == {0: [(0, "Court"), (6, "Crimes Act 1958")], 1: [(0, "A"), (2, "Crimes Act 1958")], 3: [(0, "The Often Act 1958")], 4: [(3, "Bail Bill 2001")], 6: [(len(texts[6]) - len(long), long)]}
