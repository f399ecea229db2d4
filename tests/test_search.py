import math

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search as S

NODES = [(1, "Who may appeal", "a person may appeal an order"), (2, "Orders", "an order is an order"), (3, "Meaning of order", "order means any order"), (4, "", "nothing here")]


@pytest.fixture
def nodes(frame):
    return frame(NODES, "node_id int, heading string, body string")


def plain_bm25(terms, weight=8.0):
    docs = {i: (h.lower().split(), b.lower().split()) for i, h, b in NODES}
    n, avg = len(docs), sum(len(h) + len(b) for h, b in docs.values()) / len(docs)
    out = {}
    for t in terms:
        df = sum(t in h + b for h, b in docs.values())
        idf = math.log((n - df + 0.5) / (df + 0.5))
        for i, (h, b) in docs.items():
            f = weight * h.count(t) + b.count(t)
            if f:
                out[i] = out.get(i, 0) - (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(h) + len(b)) / avg))
    return out


def test_bm25_both_ways(nodes):
    terms = ["appeal", "order", "means"]  # order is in most rows: its idf is clamped
    want = plain_bm25(terms)
    got = {r["node_id"]: r["rank"] for r in S.bm25(nodes, terms).collect()}
    lengths = S.with_tokens(nodes).select("node_id", (F.size("heading_tokens") + F.size("body_tokens")).alias("dl"))
    stored = {r["node_id"]: r["rank"] for r in S.bm25_from_postings(S.postings(nodes), lengths, terms).collect()}
    assert got.keys() == stored.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k]) and stored[k] == pytest.approx(want[k])


def test_analysis(frame):
    vocab = frame([("appeal", 5), ("appear", 9), ("order", 2)], "term string, cnt int")
    q = S.analyse("who can appeel an order", vocab)
    assert q.words == ["appeel", "order"] and q.corrections == {"appeel": "appeal"} and q.asks == "who"
    assert q.terms == ["appeel", "appeal", "order"]
    assert S.analyse("the of").words == ["the", "of"]  # only stopwords: kept
    assert S.analyse("what is an order").wants_definition and S.analyse("").terms == []
    assert S.analyse("apeal ord", vocab).corrections == {"apeal": "appeal"}  # three letters are never corrected
    assert S.corrections(frame([("appea",)], "word string"), vocab).first()["fixed"] == "appear"  # tie: the commoner


@pytest.mark.parametrize("raw", ['"', "-", "AND", '"a" NOT', "s 3(1)*", 'x "', "OR OR"])
def test_hostile_queries(nodes, raw):
    S.search(nodes, S.analyse(raw)).collect()


def test_verbatim(nodes):
    ids = lambda raw: sorted(r["node_id"] for r in S.search(nodes, S.analyse(raw)).collect())
    assert ids('"an order"') == [1, 2]
    assert ids('order NOT appeal "order"') == [2, 3]
    assert ids("app*") == [1]


def test_structure_lifts_answers(nodes):
    top = lambda raw: S.search(nodes, S.analyse(raw)).orderBy("place").first()["node_id"]
    assert top("who may appeal an order") == 1
    assert top("meaning of order") == 3


def test_scope(frame):
    d = frame([(1, "act", True), (2, "em", True), (3, "act", False), (4, "treaty", True)], "i int, kind string, is_current boolean")
    ids = lambda s: [r["i"] for r in d.where(s.condition(F.col("kind"), F.col("is_current"))).orderBy("i").collect()]
    assert ids(S.Scope()) == [1, 4] and ids(S.Scope.from_params({"explanatory": "yes", "superseded": "1"})) == [1, 2, 3, 4]


def test_fusion_and_evaluation(frame):
    lex, sem = frame([(1, 1), (2, 2)], "node_id int, place int"), frame([(2, 1), (3, 2)], "node_id int, place int")
    got = {r["node_id"]: r["rrf"] for r in S.fuse(lex, sem).collect()}
    assert got == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 62 + 1 / 61), 3: pytest.approx(1 / 62)}
    results = frame([(1, 7, 2), (2, 8, 30)], "query_id int, node_id int, place int")
    e = S.evaluation(S.ranks_of(results, frame([(1, 7), (2, 8)], "query_id int, node_id int"))).first()
    assert (e["queries"], e["mrr"], e["at_1"], e["at_5"], e["missed"]) == (2, 0.25, 0, 1, 1)


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " order here"
    s = spark.range(1).select(S.snippet(F.lit(text), ["order"]).alias("s")).first()["s"]
    assert s.startswith("… ") and "\x02order\x03" in s and s.endswith("\x02order\x03 …") and len(s.split()) == 20


def test_an_index_cuts_texts_once(frame, spark, tmp_path):
    """Postings, words and statistics come from counts made inside each row; an id that stands twice is one node."""
    from folioscope.sources import writers

    rows = frame([*NODES, (5, None, None), (6, "A1b2 order", "Order, a1B2; order!"), (6, "A1b2 order", "Order, a1B2; order!")], "node_id int, heading string, body string")
    writers.build_index(rows, f"file://{tmp_path}/index", "one")
    index = writers.open_index(spark, f"file://{tmp_path}/index")
    in_order = lambda df: sorted(map(tuple, df.collect()))
    assert in_order(index["posting"].select("term", "node_id", "tf_heading", "tf_body")) == in_order(S.postings(rows))
    assert in_order(index["word"]) == in_order(S.vocabulary(rows))
    assert in_order(index["statistics"]) == in_order(S.index_stats(rows))
    assert in_order(S.counted(rows).where("node_id = 6").select("dl", F.inline("runs")))[0] == (5, "a1b2", 1, 1)


def test_many_queries_are_ranked_by_node(nodes, spark, frame, tmp_path, monkeypatch):
    from folioscope.sources import writers

    writers.build_index(nodes, f"file://{tmp_path}/index", "one")
    index = writers.open_index(spark, f"file://{tmp_path}/index")
    asked = [(7, "appeal"), (7, "order"), (9, "order"), (9, "nothing"), (9, "order"), (11, "absent")]
    queries = frame(asked, "query_id int, term string")
    got = {}
    for bound in (S.PAIRS, 0):  # by node, and a row for each query and node
        monkeypatch.setattr(S, "PAIRS", bound)
        ranked = S.rank_queries(index, queries, top=2)
        if bound:
            assert "MapInArrow" in ranked._jdf.queryExecution().toString()
        got[bound] = sorted((r["query_id"], r["place"], r["node_id"], round(r["rank"], 9)) for r in ranked.collect())
        monkeypatch.undo()
    assert got[S.PAIRS] == got[0] and len(got[0]) == 4
    for q, terms in ((7, ["appeal", "order"]), (9, ["order", "nothing"])):
        want = sorted((round(r, 6), i) for i, r in plain_bm25(terms).items())[:2]
        assert [(round(r, 6), i) for p, _, i, r in got[0] if p == q] == want


def test_the_stored_search_mends_words_with_the_index(frame, tmp_path, spark, monkeypatch):
    """The question's mistyped word is searched as the index's own word too, in the query and in its SQL."""
    import duckdb

    from folioscope.plans import SQL
    from folioscope.plans import search as P

    rows = [(1, "A heading\nthe para of one"), (2, "Other\nerst words"), (3, "Other\npare words"), (4, "None\nof these"), (5, "Two\npara para erst"), (6, "Six\nmore of these")]
    frame([(i, t, "en", "src1") for i, t in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "QUESTION", "who can appeal erst and parra")
    got = {r["node_id"]: (r["score"], r["place"]) for r in P.search_stored(spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = {n: (s, p) for n, s, p in c.execute(SQL["search_stored"]).fetchall()}
    assert got == want and set(got) == {1, 2, 5}  # 1 by the mended word alone
