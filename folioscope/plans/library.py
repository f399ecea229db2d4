"""Documents as a library over the driver tables: customers are works, orders documents, lines nodes and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import labels as B
from folioscope.operators import library as L
from folioscope.plans import query
from folioscope.session import table

DOCS = "docs AS (SELECT o_orderkey::VARCHAR AS slug, o_custkey AS work, CASE o_orderstatus WHEN 'F' THEN 'act' WHEN 'O' THEN 'bill' ELSE 'em' END AS kind, o_orderkey % 5 <> 0 AS parsed FROM orders)"
KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'inserted' ELSE 'repealed' END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = F.when(F.col("o_orderstatus") == "O", "bill").when(F.col("o_orderstatus") == "P", " em ")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("slug"), F.col("o_custkey").alias("work"), L.document_kind(F.trim(recorded)).alias("kind"), (F.col("o_orderkey") % 5 != 0).alias("parsed"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "changed").when(n % 3 == 1, "inserted").otherwise("repealed")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("piece"), F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_suppkey") % 4).cast("string")).alias("act"), kind.alias("kind"), (F.col("l_partkey") % 40).cast("string").alias("target"))


@query(f"WITH {DOCS} SELECT slug, kind FROM docs WHERE parsed AND kind <> 'bill' AND work IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)")
def published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("work"))
    return L.published(documents(spark, sf_dir), works).select("slug", "kind")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 5 <> 4 AND role <> 'system' AND (trim(text) <> '' OR turn % 2 = 0)")
def indexable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    page = F.when(F.col("turn") % 5 != 4, F.col("turn"))
    n = c.withColumns({"page": page, "type": F.when(F.col("role") == "system", "figure").otherwise("section"), "heading": F.when(F.col("turn") % 2 == 0, "h")})
    return L.indexable(n).select("conv_id", "turn")


@query("SELECT conv_id AS doc, turn AS schedule_idx FROM conversations a WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.turn % 3 = 0)")
def schedule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a user is a Schedule; it is in it what follows, a provision every third turn."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), "role")
    schedules = c.where("role = 'user'").select("doc", "idx", F.lit("schedule").alias("type"), F.lit(None).cast("long").alias("schedule_idx"))
    inside = c.where("idx % 3 = 0").select("doc", "idx", F.lit("section").alias("type"), (F.col("idx") - 1).alias("schedule_idx"))
    return L.pageable_schedules(schedules.unionByName(inside))


@query("""WITH s AS (SELECT o_custkey AS doc, o_orderkey AS idx, (o_orderkey % 6) || CASE WHEN o_orderkey % 4 = 0 THEN 'A' ELSE '' END AS number FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY doc, lower(number) ORDER BY idx) AS n FROM s)
SELECT doc, idx, 's' || lower(number) || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS file, n = 1 AS cross_reference FROM n""")
def section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.concat((k % 6).cast("string"), F.when(k % 4 == 0, "A").otherwise(""))
    return L.file_names(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("idx"), number.alias("number"))).select("doc", "idx", "file", "cross_reference")


@query("SELECT conv_id AS doc, turn AS idx, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS page_idx FROM conversations")
def page_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return L.page_index(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), (F.col("role") == "user").alias("opens_page")))


@query(f"WITH {DOCS} SELECT DISTINCT (l_suppkey % 30)::VARCHAR AS act, kind, slug AS other FROM lineitem JOIN docs ON slug = l_orderkey::VARCHAR WHERE kind <> 'act'")
def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).cast("string").alias("act"), F.col("l_orderkey").cast("string").alias("other"))
    return L.related_documents(documents(spark, sf_dir), links)


@query("""WITH h AS (SELECT (p_partkey % 150)::VARCHAR AS act_no, (1990 + p_size % 5)::VARCHAR AS year, min(p_name) AS work FROM part GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, h.work FROM lineitem LEFT JOIN h ON h.act_no = (l_partkey % 200)::VARCHAR AND h.year = (1990 + l_suppkey % 6)::VARCHAR""")
def held_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).cast("string").alias("act_no"), (1990 + F.col("p_size") % 5).cast("string").alias("year"), F.col("p_name").alias("work"))
    cites = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 200).cast("string").alias("act_no"), (1990 + F.col("l_suppkey") % 6).cast("string").alias("year"))
    return L.held_by_citation(works, cites).select("l_orderkey", "l_linenumber", "work")


@query("""WITH n AS (SELECT l_orderkey::VARCHAR AS slug, count(*) AS nodes, count(*) FILTER (WHERE l_linenumber = 1) AS provisions FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1), p AS (SELECT l_orderkey::VARCHAR AS slug, count(*) FILTER (WHERE l_returnflag = 'N') AS checked, count(*) AS total FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey::VARCHAR AS slug, nodes IS NOT NULL AS parsed, coalesce(nodes, 0) AS nodes, coalesce(provisions, 0) AS provisions, coalesce(checked, 0) AS checked, coalesce(total, 0) AS total FROM orders LEFT JOIN n ON n.slug = o_orderkey::VARCHAR LEFT JOIN p ON p.slug = o_orderkey::VARCHAR""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("doc", F.col("l_orderkey").cast("string"))
    nodes = li.where("l_orderkey % 3 <> 0").select("doc", F.when(F.col("l_linenumber") == 1, "section").otherwise("note").alias("type"))
    progress = li.where("l_orderkey % 2 = 0").groupBy("doc").agg(F.count_if(F.col("l_returnflag") == "N").alias("checked"), F.count("*").alias("total"))
    return L.document_status(documents(spark, sf_dir), nodes, progress)


@query("SELECT conv_id AS doc, role AS type, count(*) AS n, role = 'user' AS is_provision FROM conversations GROUP BY ALL")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("type"))
    return L.node_counts(c, ("user",))


@query("""WITH n AS (SELECT user_id AS doc, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, event_type AS category, count(*) AS n FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc ORDER BY severity, n DESC, category)::INT AS place FROM n""")
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return L.issue_groups(e.select(F.col("user_id").alias("doc"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("warning").alias("severity"), F.col("event_type").alias("category")))


@query("SELECT user_id AS act, count(*) FILTER (WHERE value > 50) AS scanned, count(*) AS total FROM events GROUP BY user_id")
def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("act"), F.col("event_id").alias("unit"), (F.col("value") > 50).alias("done")))


@query("SELECT event_id::VARCHAR AS name, ts AS verified_at FROM events WHERE contains(lower(event_type), 'c') AND event_id % 2 = 0 ORDER BY ts DESC, event_id::VARCHAR LIMIT 20")
def recent_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("name"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("verified_at"), F.col("event_type").alias("text"))
    return L.recent_verified(rows, "C").select("name", "verified_at")


@query("SELECT user_id AS act, count(*) AS rows, max(value) AS newest, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def review_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.review_signature(table(spark, sf_dir, "events").select(F.col("user_id").alias("act"), F.col("event_id").alias("idx"), "value"), "value")


@query(f"""SELECT l_orderkey AS piece, (l_suppkey % 4)::VARCHAR AS act, CASE max(CASE {KIND} WHEN 'repealed' THEN 3 WHEN 'inserted' THEN 2 ELSE 1 END) WHEN 3 THEN 'repealed' WHEN 2 THEN 'inserted' ELSE 'changed' END AS kind FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2""")
def cites_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cites_map(notes(spark, sf_dir))


@query("SELECT (l_partkey % 40)::VARCHAR AS target, array_to_string(list_sort(list(DISTINCT (l_suppkey % 4)::VARCHAR)), ',') AS acts FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1")
def cited_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cited_by_target(notes(spark, sf_dir)).withColumn("acts", F.array_join("acts", ","))


@query("SELECT l_suppkey AS provision, string_agg(l_shipdate::DATE::VARCHAR, '|' ORDER BY l_orderkey * 10 + l_linenumber, l_shipdate::DATE::VARCHAR) AS notes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def loose_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("provision"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note_no"), F.col("l_shipdate").cast("date").cast("string").alias("raw"), F.when(F.col("l_returnflag") != "R", F.lit(1)).alias("idx"))
    return L.loose_notes(rows).withColumn("notes", F.array_join("notes", "|"))


@query("SELECT l_orderkey::VARCHAR AS citation FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 2")
def acts_first_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.acts_first_shown(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("citation"), F.col("l_linenumber").alias("version")), 2)


@query("""WITH n AS (SELECT DISTINCT l_suppkey AS work, (l_partkey % 300)::VARCHAR AS citation FROM lineitem), h AS (SELECT DISTINCT (o_custkey % 300)::VARCHAR AS citation FROM orders WHERE o_custkey % 3 = 0)
SELECT work, count(*) AS needed, count(h.citation) AS held, count(*) - count(h.citation) AS missing FROM n LEFT JOIN h USING (citation) GROUP BY work""")
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("work"), (F.col("l_partkey") % 300).cast("string").alias("citation"))
    held = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select((F.col("o_custkey") % 300).cast("string").alias("citation"))
    return L.fetch_status(needed, held)


@query("SELECT l_orderkey AS doc, l_returnflag AS key FROM lineitem GROUP BY ALL HAVING bool_and(l_quantity > 10 AND l_discount <= 0.08)")
def checked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return L.checked_keys(li.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("key"), F.when(F.col("l_quantity") > 10, "t").alias("verified_at"), F.when(F.col("l_discount") > 0.08, True).alias("needs_followup")))


@query("""WITH c AS (SELECT l_suppkey AS work, l_linenumber AS version, l_orderkey AS key, CASE WHEN l_orderkey % 4 <> 0 THEN 'confirmed' END AS decision FROM lineitem GROUP BY ALL)
SELECT work, version, key, decision, bool_or(decision IS NULL) OVER (PARTITION BY work, version) AS pending FROM c""")
def history_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("work"), F.col("l_linenumber").alias("version"), F.col("l_orderkey").alias("key")).distinct()
    return L.worklist(c, c.where("key % 4 <> 0").withColumn("decision", F.lit("confirmed")))


@query("""WITH a AS (SELECT l_suppkey AS doc, l_partkey AS key, min(l_orderkey * 10 + l_linenumber) AS idx FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), b AS (SELECT l_suppkey AS doc, l_partkey AS key, min(l_orderkey * 10 + l_linenumber) AS idx FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2),
u AS (SELECT doc, key, 0 AS s, idx FROM a UNION ALL SELECT doc, key, 1, idx FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = b.doc AND a.key = b.key))
SELECT doc, key, row_number() OVER (PARTITION BY doc ORDER BY s, idx, key)::INT AS place FROM u""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), "l_linenumber")
    return L.ordered_union(li.where("l_linenumber <= 3").drop("l_linenumber"), li.where("l_linenumber > 2").drop("l_linenumber"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Heading Group' ELSE 'Section' END || ' ' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment ELSE '' END AS page,
'Chapter ' || (c_nationkey % 9) || ' › Part ' || (c_nationkey % 9) || '.2 ' || c_mktsegment AS path, CASE WHEN c_custkey % 2 = 0 THEN '(a)' ELSE '12' END AS number, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'p/' || c_custkey ELSE 's10' END AS relative FROM customer""")
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages and paths, printed numbers, names below a root."""
    c, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    kind = F.when(n % 3 == 0, "heading_group").otherwise("section")
    node = lambda t, number, heading: F.struct(F.lit(t).alias("type"), number.alias("number"), heading.cast("string").alias("heading"))
    chapter = (n % 9).cast("string")
    path = F.array(node("chapter", chapter, F.lit(None)), node("part", F.concat(chapter, F.lit(".2")), F.col("c_mktsegment")))
    number = F.when(k % 2 == 0, "a").otherwise("12")
    level = F.when(k % 2 == 0, "paragraph").otherwise("section")
    name = F.when(k % 3 == 0, "s1").when(k % 3 == 1, F.concat(F.lit("s1/p/"), k.cast("string"))).otherwise("s10")
    return c.select("c_custkey", B.page_label(kind, n.cast("string"), F.when(k % 2 == 0, F.col("c_mktsegment"))).alias("page"), B.breadcrumb_label(path).alias("path"), B.printed_number(level, number).alias("number"), B.relative_name(name, F.lit("s1")).alias("relative"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract(text, '^\s*(\S+)', 1) AS w, text FROM conversations) SELECT conv_id, turn, CASE WHEN w <> '' THEN '^' || regexp_replace(regexp_replace(w, '([\\^$.|?*+()\[\]{}/-])', '\\\1', 'g'), '[0-9]+', '\\d+', 'g') END AS shape,
CASE WHEN turn % 2 = 0 THEN 'Crimes Act 1958' END AS act FROM w""")
def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The openings of lines as patterns, and the Acts that lead-ins name."""
    c = table(spark, sf_dir, "conversations")
    lead = F.concat(F.col("role"), F.when(F.col("turn") % 2 == 0, " an offence under the Crimes Act 1958—").otherwise(" under the Crimes Act 1958 it is so"))
    return c.select("conv_id", "turn", B.line_shape(F.col("text")).alias("shape"), B.lead_in_act(lead).alias("act"))
