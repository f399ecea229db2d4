"""Links over the driver tables: orders and lines stand for clauses and sections, customers for cited Acts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import linking as K
from folioscope.operators import links as M
from folioscope.operators import memoranda as E
from folioscope.plans import query
from folioscope.session import table


@query("""WITH b AS (SELECT o_orderkey AS idx, (o_custkey % 500)::VARCHAR AS number, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS schedule FROM orders),
a AS (SELECT s_suppkey AS idx, s_suppkey::VARCHAR AS number, CASE WHEN s_nationkey % 3 = 0 THEN NULL WHEN s_nationkey % 3 = 1 THEN 'O' ELSE 'P' END AS schedule FROM supplier),
f AS (SELECT *, row_number() OVER (PARTITION BY schedule, number ORDER BY idx) AS n FROM a)
SELECT b.idx AS clause_idx, b.number AS clause_number, b.schedule, f.idx AS act_idx, CASE WHEN f.idx IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM b LEFT JOIN f ON b.schedule IS NOT DISTINCT FROM f.schedule AND b.number = f.number AND n = 1""")
def clause_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe on the Schedule; the first provision of a number wins."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 500).cast("string").alias("number"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("schedule"), F.lit("x").alias("text"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_suppkey").cast("string").alias("number"), F.when(F.col("s_nationkey") % 3 == 1, "O").when(F.col("s_nationkey") % 3 == 2, "P").alias("schedule"), F.lit("x").alias("text"))
    return K.match_clauses(o, s).select("clause_idx", "clause_number", "schedule", "act_idx", "status")


@query("""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS line, (l_partkey % 400)::VARCHAR AS act_no, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE (1990 + l_suppkey % 4)::VARCHAR END AS year FROM lineitem),
acts AS (SELECT p_partkey AS pos, (p_partkey % 250)::VARCHAR AS act_no, (1990 + p_size % 4)::VARCHAR AS year, p_name AS title FROM part),
reg AS (SELECT c_custkey, (c_custkey % 397)::VARCHAR AS act_no, (1990 + c_nationkey % 4)::VARCHAR AS year, c_name AS title FROM customer),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY act_no, year ORDER BY pos) AS n FROM acts) WHERE n = 1), f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY act_no ORDER BY pos) AS n FROM acts) WHERE n = 1),
r1 AS (SELECT act_no, year, any_value(title) AS title FROM reg GROUP BY act_no, year HAVING count(*) = 1), r2 AS (SELECT act_no, any_value(title) AS title FROM reg GROUP BY act_no HAVING count(*) = 1)
SELECT id, line, c.act_no, c.year, coalesce(f1.title, CASE WHEN c.year IS NULL OR c.year = f2.year THEN f2.title END, r1.title, CASE WHEN c.year IS NULL THEN r2.title END) AS title
FROM c LEFT JOIN f1 ON c.act_no = f1.act_no AND c.year = f1.year LEFT JOIN f2 ON c.act_no = f2.act_no LEFT JOIN r1 ON c.act_no = r1.act_no AND c.year = r1.year LEFT JOIN r2 ON c.act_no = r2.act_no""")
def citation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    cites = line.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 400).cast("string").alias("act_no"), F.when(F.col("l_linenumber") % 3 != 0, (1990 + F.col("l_suppkey") % 4).cast("string")).alias("year"))
    acts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 250).cast("string").alias("act_no"), (1990 + F.col("p_size") % 4).cast("string").alias("year"), F.col("p_name").alias("title"))
    registry = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 397).cast("string").alias("act_no"), (1990 + F.col("c_nationkey") % 4).cast("string").alias("year"), F.col("c_name").alias("title"))
    return K.resolve_citations(cites, acts, registry).select("id", "line", "act_no", "year", "title")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events")
def asof_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return K.carry_forward(e, "user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")), "event_id").select("user_id", "event_id", "target")


@query("""WITH links AS (SELECT 'b' || l_suppkey % 5 AS bill, l_orderkey * 10 + l_linenumber AS pos, (l_partkey % 90)::VARCHAR AS cn, (l_suppkey % 60)::VARCHAR AS an, round(l_discount * 10, 2) AS sim, CASE WHEN l_discount >= 0.05 THEN 'matched' ELSE 'flagged' END AS status FROM lineitem),
best AS (SELECT *, row_number() OVER (PARTITION BY bill, cn, an ORDER BY status = 'matched' DESC, sim DESC, pos) AS n FROM links),
rows_ AS (SELECT an AS number, 'bill' AS route, bill AS source, cn AS entry FROM best WHERE n = 1),
map AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill, cn ORDER BY pos) AS m FROM links) WHERE m = 1),
em AS (SELECT o_orderkey AS entry, 'b' || o_custkey % 5 AS bill, (o_custkey % 90)::VARCHAR AS cn, (o_custkey % 60)::VARCHAR AS ref, CASE o_orderkey % 3 WHEN 0 THEN 'bill_clause' WHEN 1 THEN 'act_section' ELSE 'reviewed' END AS kind FROM orders)
SELECT * FROM rows_ UNION ALL SELECT map.an, 'bill_clause', 'em1', em.entry::VARCHAR FROM em JOIN map ON em.bill = map.bill AND em.cn = map.cn WHERE kind = 'bill_clause'
UNION ALL SELECT ref, kind, 'em1', entry::VARCHAR FROM em WHERE kind <> 'bill_clause'""")
def commentary_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections to the clauses and memorandum entries behind them, by one and two hops."""
    none = F.lit(None).cast("string")
    li = table(spark, sf_dir, "lineitem")
    links = li.select(F.concat(F.lit("b"), (F.col("l_suppkey") % 5).cast("string")).alias("bill"), F.lit("w-v1").alias("act"), none.alias("clause_schedule"), (F.col("l_partkey") % 90).cast("string").alias("clause_number"), none.alias("act_schedule"), (F.col("l_suppkey") % 60).cast("string").alias("act_number"), F.round(F.col("l_discount") * 10, 2).alias("similarity"), F.when(F.col("l_discount") >= 0.05, "matched").otherwise("flagged").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "bill_clause").when(F.col("o_orderkey") % 3 == 1, "act_section").otherwise("reviewed")
    em = table(spark, sf_dir, "orders").select(F.lit("em1").alias("em"), F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string")).alias("bill"), F.col("o_orderkey").alias("entry"), kind.alias("kind"), F.lit("w-v2").alias("act"), none.alias("schedule"), (F.col("o_custkey") % 90).cast("string").alias("clause_number"), (F.col("o_custkey") % 60).cast("string").alias("section_ref"))
    return K.commentary(links, em, "w").select("number", "route", "source", "entry")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 40).cast("int").alias("page"), (F.col("l_suppkey") % 300).cast("double").alias("x0"), (F.col("l_suppkey") % 300 + 60).cast("double").alias("x1"), (F.col("l_partkey") % 700).cast("double").alias("y0"), (F.col("l_partkey") % 700 + 12).cast("double").alias("y1"), F.col("l_shipdate").cast("string").alias("text"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 40 AS page, (l_suppkey % 300)::DOUBLE AS x0, (l_suppkey % 300 + 60)::DOUBLE AS x1, (l_partkey % 700)::DOUBLE AS y0, (l_partkey % 700 + 12)::DOUBLE AS y1 FROM lineitem),
b AS (SELECT s_suppkey AS box_id, s_suppkey % 40 AS page, (s_suppkey * 7 % 200)::DOUBLE AS x0, (s_suppkey * 7 % 200 + 150)::DOUBLE AS x1, (s_suppkey * 13 % 600)::DOUBLE AS y0, (s_suppkey * 13 % 600 + 90)::DOUBLE AS y1 FROM supplier)
SELECT l_orderkey, l_linenumber, box_id FROM l JOIN b ON l.page = b.page AND (l.y0 + l.y1) / 2 BETWEEN b.y0 AND b.y1 AND least(l.x1, b.x1) - greatest(l.x0, b.x0) >= 0.5 * (l.x1 - l.x0)""")
def box_line_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select(s.alias("box_id"), (s % 40).cast("int").alias("page"), (s * 7 % 200).cast("double").alias("x0"), (s * 7 % 200 + 150).cast("double").alias("x1"), (s * 13 % 600).cast("double").alias("y0"), (s * 13 % 600 + 90).cast("double").alias("y1"))
    return K.lines_in_boxes(_lines(spark, sf_dir), boxes).select("l_orderkey", "l_linenumber", "box_id")


@query("""WITH n AS (SELECT o_custkey AS doc, o_orderkey::INT AS idx, (epoch(o_orderdate) // 86400)::INT AS page, (o_orderkey % 7)::INT AS y FROM orders),
f AS (SELECT o_custkey AS doc, l_orderkey || '-' || l_linenumber AS figure_id, (epoch(l_shipdate) // 86400)::INT AS page, l_linenumber::INT AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT doc, page, y, idx, NULL AS figure_id FROM n UNION ALL SELECT doc, page, y, NULL, figure_id FROM f)
SELECT doc, figure_id, after_idx FROM (SELECT *, last_value(idx IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, y, figure_id IS NOT NULL, idx, figure_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after_idx FROM b) WHERE figure_id IS NOT NULL""")
def figure_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the last node at or above each figure."""
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    o = table(spark, sf_dir, "orders")
    n = o.select(F.col("o_custkey").alias("doc"), day("o_orderdate").alias("page"), (F.col("o_orderkey") % 7).cast("int").alias("y"), F.col("o_orderkey").cast("int").alias("idx"))
    f = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc"), day("l_shipdate").alias("page"), F.col("l_linenumber").cast("int").alias("y"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("figure_id"))
    return K.place_figures(n, f).select("doc", "figure_id", "after_idx")


@query("""WITH n AS (SELECT l_orderkey % 50 || '/' || l_linenumber AS name, (l_partkey % 30)::VARCHAR AS target, (l_suppkey % 20)::VARCHAR AS act, CASE l_linenumber % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'inserted' ELSE 'repealed' END AS kind FROM lineitem WHERE year(l_shipdate) >= 1998),
o AS (SELECT DISTINCT (l_partkey % 30)::VARCHAR AS target, (l_suppkey % 20)::VARCHAR AS act FROM lineitem WHERE year(l_shipdate) < 1998 AND l_suppkey % 2 = 0)
SELECT name, CASE max(CASE kind WHEN 'repealed' THEN 3 WHEN 'inserted' THEN 2 ELSE 1 END) WHEN 3 THEN 'repealed' WHEN 2 THEN 'inserted' ELSE 'changed' END AS kind, len(list(DISTINCT act))::INT AS acts FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.target = n.target AND o.act = n.act) GROUP BY name""")
def note_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "changed").when(F.col("l_linenumber") % 3 == 1, "inserted").otherwise("repealed")
    rows = li.select(F.concat_ws("/", (F.col("l_orderkey") % 50).cast("string"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_partkey") % 30).cast("string").alias("target"), (F.col("l_suppkey") % 20).cast("string").alias("act"), kind.alias("kind"), F.year("l_shipdate").alias("y"), "l_suppkey")
    out = K.note_targets_changed(rows.where("y < 1998 AND l_suppkey % 2 = 0"), rows.where("y >= 1998"))
    return out.select("name", "kind", F.size("acts").alias("acts"))


@query("""SELECT lower(trim(c_mktsegment)) AS term, min(c_custkey) AS idx FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1""")
def definition_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return K.definition_index(c.select(F.when(F.col("c_nationkey") % 2 == 0, "definition").otherwise("section").alias("type"), F.col("c_mktsegment").alias("heading"), F.col("c_custkey").alias("idx")))


@query("""WITH i AS (SELECT lower(trim(c_mktsegment)) AS term, min(c_custkey) AS idx FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1), s AS (SELECT o_orderkey AS span_id, CASE WHEN o_orderkey % 3 = 0 THEN 'BUILDING ' WHEN o_orderkey % 3 = 1 THEN 'Machinery' ELSE 'none' END AS text FROM orders)
SELECT span_id, lower(trim(s.text)) AS term, i.idx FROM s LEFT JOIN i ON i.term = lower(trim(s.text))""")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to the definitions of their terms."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    index = K.definition_index(c.where("c_nationkey % 2 = 0").select(F.lit("definition").alias("type"), F.col("c_mktsegment").alias("heading"), F.col("c_custkey").alias("idx")))
    text = F.when(F.col("o_orderkey") % 3 == 0, "BUILDING ").when(F.col("o_orderkey") % 3 == 1, "Machinery").otherwise("none")
    return K.resolve_terms(o.select(F.col("o_orderkey").alias("span_id"), text.alias("text")), index).select("span_id", "term", "idx")


@query("""SELECT l_orderkey, l_linenumber, c.act_no, c.year FROM lineitem, LATERAL (SELECT (l_partkey % 90)::VARCHAR AS act_no, year(l_shipdate)::VARCHAR AS year UNION ALL SELECT (l_suppkey % 70 + 100)::VARCHAR, '2001') c""")
def note_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a note and Act it cites."""
    li = table(spark, sf_dir, "lineitem")
    raw = F.concat(F.lit("S. 3 amended by Nos "), (F.col("l_partkey") % 90).cast("string"), F.lit("/"), F.year("l_shipdate").cast("string"), F.lit(" s. 3, "), (F.col("l_suppkey") % 70 + 100).cast("string"), F.lit("/2001 s. 5."))
    return K.note_citations(li.select("l_orderkey", "l_linenumber", raw.alias("raw"))).select("l_orderkey", "l_linenumber", "act_no", "year")


@query("""WITH e AS (SELECT o_custkey AS em, o_orderkey AS entry, 'act_section' AS kind, NULL::VARCHAR AS schedule, (o_orderkey % 40)::VARCHAR AS section_ref FROM orders), r AS (SELECT o_custkey AS em, o_orderkey AS entry, 'sch' AS schedule, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'R' || o_orderkey % 5 END AS section_ref FROM orders WHERE o_orderkey % 4 = 0)
SELECT em, entry, CASE WHEN r.entry IS NOT NULL THEN 'reviewed' ELSE kind END AS kind, CASE WHEN r.entry IS NOT NULL THEN r.schedule ELSE e.schedule END AS schedule, CASE WHEN r.entry IS NOT NULL THEN r.section_ref ELSE e.section_ref END AS section_ref FROM e LEFT JOIN r USING (em, entry)""")
def reviewed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's targets replace the guesses, an empty target too."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("em"), F.col("o_orderkey").alias("entry"))
    links = o.select("em", "entry", F.lit("act_section").alias("kind"), F.lit(None).cast("string").alias("schedule"), (F.col("entry") % 40).cast("string").alias("section_ref"))
    reviewed = o.where("entry % 4 = 0").select("em", "entry", F.lit("sch").alias("schedule"), F.when(F.col("entry") % 8 != 0, F.concat(F.lit("R"), (F.col("entry") % 5).cast("string"))).alias("section_ref"))
    return K.with_reviewed_links(links, reviewed).select("em", "entry", "kind", "schedule", "section_ref")


@query("""WITH t AS (SELECT DISTINCT lower(trim(p_type)) AS k FROM part), x AS (SELECT o_orderkey AS text_id, 'under the ' || CASE o_orderkey % 3 WHEN 0 THEN (SELECT min(p_type) FROM part) WHEN 1 THEN (SELECT max(p_type) FROM part) ELSE 'nothing known here' END AS text FROM orders)
SELECT text_id, (SELECT k FROM t WHERE ends_with(lower(text), k) ORDER BY length(k) DESC, k LIMIT 1) AS title_key FROM x""")
def act_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to the known title they end with."""
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    ends = p.agg(F.min("p_type").alias("lo"), F.max("p_type").alias("hi"))
    text = F.concat(F.lit("under the "), F.when(F.col("o_orderkey") % 3 == 0, F.col("lo")).when(F.col("o_orderkey") % 3 == 1, F.col("hi")).otherwise("nothing known here"))
    texts = o.crossJoin(F.broadcast(ends)).select(F.col("o_orderkey").alias("text_id"), text.alias("text"))  # one row
    return K.resolve_act_titles(texts, p.select(F.col("p_type").alias("title")), p.select(F.col("p_type").alias("title"))).select("text_id", "title_key")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 40 AS page, (l_partkey % 700)::INT AS ry FROM lineitem), k AS (SELECT s_suppkey AS key_id, s_suppkey % 40 AS page, (s_suppkey * 13 % 600)::INT AS ry FROM supplier)
SELECT key_id, l_orderkey, l_linenumber FROM k JOIN l ON k.page = l.page AND abs(k.ry - l.ry) <= 1""")
def lines_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page at a height or one beside it."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key_id"), (F.col("s_suppkey") % 40).cast("int").alias("page"), (F.col("s_suppkey") * 13 % 600).cast("double").alias("y"))
    return K.lookup_near(_lines(spark, sf_dir), keys).select("key_id", "l_orderkey", "l_linenumber")


@query(None)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text against that of the one before it in its source; a null text counts as empty."""
    from folioscope.functions.diff import similarity

    from folioscope.plans.lineage import consecutive_texts

    pairs = consecutive_texts(spark, sf_dir)
    return pairs.select("doc_id", F.round(similarity(F.col("old"), F.col("text")), 6).alias("similarity"))


def mention_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with a few references behind them, the two words each of them opens with as its term, and what references
    lead to. Every third document stands under a lead-in of another Act."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("idx"), "text", "lang")
    n = F.pmod("doc", F.lit(9)).cast("string")
    more = F.concat(F.lit("\nSee section "), n, F.lit("(1), Part "), n, F.lit(" and the "), F.initcap("lang"), F.lit(" Roads Act 1986."))
    texts = d.withColumn("text", F.concat("text", more)).withColumn("scope", F.when(F.col("doc") % 3 == 0, "En Roads Act 1986")).drop("lang")
    terms = d.select("doc", F.regexp_extract("text", r"(?U)\w+ \w+", 0).alias("term"))
    own = terms.where("term <> ''").select(F.col("doc").cast("string").alias("owner"), F.lit("term").alias("kind"), F.lower("term").alias("key"), F.lit("#term").alias("target"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")
    parts = d.select(F.col("doc").cast("string").alias("owner"), F.explode(F.array(F.lit("section"), F.lit("part"))).alias("kind"), numbers).select("owner", "kind", F.col("n").cast("string").alias("key"), F.concat(F.lit("#"), "kind", "n").alias("target"))
    acts = table(spark, sf_dir, "documents").select(F.concat(F.lower("lang"), F.lit(" roads act 1986")).alias("title")).where("title IS NOT NULL").distinct()
    others = acts.select(F.lit("").alias("owner"), F.lit("act").alias("kind"), F.col("title").alias("key"), F.concat(F.lit("/"), F.replace("title", F.lit(" "), F.lit("-"))).alias("target"))
    abroad = acts.select(F.col("title").alias("owner"), F.lit("section").alias("kind"), numbers, "title").select("owner", "kind", F.col("n").cast("string").alias("key"), F.concat(F.lit("/"), F.replace("title", F.lit(" "), F.lit("-")), F.lit("#section"), "n").alias("target"))
    return texts, terms, own.union(parts).union(others).union(abroad)


@query(None)
def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, sections, Parts and Acts that whole documents mention, with what they lead to."""
    texts, terms, targets = mention_texts(spark, sf_dir)
    return M.resolved(M.mentions(texts, terms), targets, texts.where("scope IS NOT NULL"))


@query(None)
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as HTML with their links."""
    texts, terms, targets = mention_texts(spark, sf_dir)
    return M.linked(texts, M.resolved(M.mentions(texts, terms), targets, texts.where("scope IS NOT NULL")))


_MEMO = """e AS (SELECT o_custkey AS doc, o_orderkey AS idx, o_orderkey % 5 AS k, (o_orderkey % 50 + 1)::INT AS a FROM orders),
n AS (SELECT *, last_value(CASE k WHEN 0 THEN 'Crimes Act 1958' WHEN 3 THEN 'Evidence Act 2008' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx) AS title FROM e),
t AS (SELECT doc, idx, k, a, CASE WHEN k <> 2 THEN 'act_section' WHEN a % 2 = 0 THEN 'bill_clause' END AS kind, CASE WHEN k = 2 AND a % 2 = 1 THEN NULL WHEN k = 2 OR title IS NULL THEN 'own' WHEN title = 'Crimes Act 1958' THEN 'crimes' END AS act,
CASE WHEN k <> 2 THEN title END AS act_title, CASE k WHEN 0 THEN 'inserts' WHEN 1 THEN 'amends' WHEN 3 THEN 'repeals' END AS action, CASE WHEN k <> 2 THEN title = 'Crimes Act 1958' END AS in_force FROM n),
p AS (SELECT act, p_partkey::INT AS position, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey - 1) || 'A' ELSE p_partkey::VARCHAR END AS number FROM part, (VALUES ('own'), ('crimes')) AS v(act) WHERE p_partkey % 7 <> 0)"""


def memorandum(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (a memorandum a customer), their targets, and the provisions of two Acts, every fifth one inserted."""
    a = F.col("o_orderkey") % 50 + 1
    n = lambda c: c.cast("string")
    texts = [F.concat(F.lit("This clause inserts section "), n(a), F.lit(" of the\nCrimes Act 1958.")), F.concat(F.lit("It amends sections "), n(a), F.lit(" to "), n(a + 3), F.lit(" and "), n(a + 10), F.lit("(1) of the Principal Act.")), F.lit("It is general."), F.lit("Repeals section 9 of the Evidence Act 2008"), F.concat(F.lit("See sections "), n(a), F.lit(", "), n(a + 3), F.lit(" and "), n(a + 10), F.lit("."))]
    k = (F.col("o_orderkey") % 5).cast("int")
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("idx"), n(a).alias("number"), F.lit(None).cast("string").alias("schedule"), F.element_at(F.array(*texts), k + 1).alias("text"))
    acts = spark.createDataFrame([("Crimes Act 1958", "crimes", True), ("Evidence Act 2008", None, False)], "title string, act string, in_force boolean")
    clauses = entries.where("CAST(number AS INT) % 2 = 0").select("doc", "number", "schedule").distinct()
    targets = E.resolve_entries(entries, F.broadcast(acts), clauses, entries.select("doc", F.lit("own").alias("act")).distinct())
    part = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0")
    number = F.when(F.col("p_partkey") % 5 == 0, F.concat(n(F.col("p_partkey") - 1), F.lit("A"))).otherwise(n(F.col("p_partkey")))
    return entries, targets, part.select(F.explode(F.array(F.lit("own"), F.lit("crimes"))).alias("act"), number.alias("number"), F.col("p_partkey").cast("int").alias("position"))


@query(f"WITH {_MEMO} SELECT doc, idx, kind, act, act_title, action, in_force FROM t")
def memorandum_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entry explains: the Act named last, with a section; a clause of the Bill; or nothing."""
    return memorandum(spark, sf_dir)[1].select("doc", "idx", "kind", "act", "act_title", "action", "in_force")


@query(f"""WITH {_MEMO}, ends AS (SELECT doc, idx, act, a, f.position AS lo, g.position AS hi FROM t LEFT JOIN p f USING (act) LEFT JOIN p g USING (act) WHERE k = 1 AND f.number = a::VARCHAR AND g.number = (a + 3)::VARCHAR),
r AS (SELECT doc, idx, act, a::VARCHAR AS number FROM t WHERE k IN (0, 4) UNION ALL SELECT doc, idx, act, '9' FROM t WHERE k = 3 UNION ALL SELECT doc, idx, act, (a + 3)::VARCHAR FROM t WHERE k = 4 UNION ALL SELECT doc, idx, act, (a + 10)::VARCHAR FROM t WHERE k IN (1, 4)
UNION ALL SELECT e.doc, e.idx, e.act, lower(p.number) FROM ends e JOIN p ON p.act = e.act AND p.position BETWEEN e.lo AND e.hi
UNION ALL SELECT doc, idx, act, unnest([a::VARCHAR, (a + 3)::VARCHAR]) FROM t WHERE k = 1 AND (doc, idx) NOT IN (SELECT doc, idx FROM ends))
SELECT DISTINCT doc, idx, act, number FROM r""")
def memorandum_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that entries reach, ranges spread over the provisions that the Act has."""
    _, targets, provisions = memorandum(spark, sf_dir)
    return E.explained(targets, provisions)


@query(f"""WITH {_MEMO}, x AS (SELECT doc, idx, act, unnest(CASE k WHEN 0 THEN [a] WHEN 3 THEN [9] WHEN 4 THEN [a, a + 3, a + 10] WHEN 1 THEN [a, a + 3, a + 10] ELSE [] END)::VARCHAR AS number FROM t),
y AS (SELECT x.*, p.position FROM x LEFT JOIN p ON p.act = x.act AND p.number = x.number UNION ALL SELECT t.doc, t.idx, t.act, lower(p.number), p.position FROM t JOIN p f ON f.act = t.act AND f.number = t.a::VARCHAR JOIN p g ON g.act = t.act AND g.number = (t.a + 3)::VARCHAR JOIN p ON p.act = t.act AND p.position BETWEEN f.position AND g.position WHERE t.k = 1),
b AS (SELECT doc, idx, number FROM (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY coalesce(position, 2147483647), number) AS n FROM y) WHERE n = 1)
SELECT t.doc, t.idx, t.act, t.act_title, CASE WHEN t.kind = 'bill_clause' AND a % 4 = 0 THEN 's' END AS schedule, CASE WHEN t.kind = 'bill_clause' THEN CASE WHEN a % 4 = 0 THEN 'x' || a END WHEN t.act IS NOT NULL THEN b.number END AS number FROM t LEFT JOIN b USING (doc, idx) WHERE kind IS NOT NULL""")
def memorandum_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provision offered for each entry; every second clause of the Bill became one."""
    entries, targets, provisions = memorandum(spark, sf_dir)
    links = entries.where("CAST(number AS INT) % 4 = 0").select("doc", F.col("number").alias("clause"), F.lit(None).cast("string").alias("clause_schedule"), F.lit("s").alias("schedule"), F.concat(F.lit("X"), "number").alias("number")).distinct()
    return E.suggestions(targets, provisions, links)
