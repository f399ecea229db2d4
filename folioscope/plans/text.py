"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import offsets as O
from folioscope.functions import text as T
from folioscope.plans import query
from folioscope.session import table


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest, length(regexp_replace(text, '[ \t]*\n+[ \t]*', ' ', 'g')) AS reflowed FROM documents""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise(F.col("text")).cast("binary"), 256).alias("digest"), F.length(T.reflow(F.col("text"))).cast("long").alias("reflowed"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(regexp_replace(text, '[0-9]', '#', 'g'), '\s+', ' ', 'g')) AS masked FROM documents)
SELECT doc_id, length(slug) AS slug_length, sha256(slug) AS slug, sha256(masked) AS masked FROM s""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts: their slugs and what is left of them with digits masked, as digests beside their lengths."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", T.slugify(t).alias("slug"), T.digit_mask(t).alias("masked"))
    return d.select("doc_id", F.length("slug").cast("long").alias("slug_length"), F.sha2(F.col("slug").cast("binary"), 256).alias("slug"), F.sha2(F.col("masked").cast("binary"), 256).alias("masked"))


@query("SELECT o_orderkey, o_orderdate::DATE AS as_at, 'w' || o_custkey AS work, (o_orderkey % 90)::INT AS version FROM orders")
def front_matter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed days and versioned slugs, made from the orders and read back."""
    o = table(spark, sf_dir, "orders")
    printed = o.select("o_orderkey", F.date_format("o_orderdate", "d MMMM yyyy").alias("printed"), F.concat(F.lit("w"), F.col("o_custkey").cast("string"), F.lit("-v"), (F.col("o_orderkey") % 90).cast("string")).alias("slug"))
    return printed.select("o_orderkey", T.printed_date(F.col("printed")).alias("as_at"), T.work_of(F.col("slug")).alias("work"), T.version_of(F.col("slug")).alias("version"))


@query("SELECT o_orderkey, (o_custkey % 50)::VARCHAR || '|' || (o_custkey % 7 + 60) || 'A' AS numbers FROM orders")
def section_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers a reference names; of a range its first end."""
    o = table(spark, sf_dir, "orders")
    ref = F.concat(F.lit("sections "), (F.col("o_custkey") % 50).cast("string"), F.lit(" to 99 and "), (F.col("o_custkey") % 7 + 60).cast("string"), F.lit("A"))
    return o.select("o_orderkey", F.array_join(T.section_numbers(ref), "|").alias("numbers"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 90) || '/' || year(l_shipdate) || '|' || (l_suppkey % 70 + 100) || '/2001' AS cites, CASE l_linenumber % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'inserted' ELSE 'repealed' END AS kind, 's. ' || l_orderkey || '(' || l_linenumber || ')' AS target FROM lineitem")
def note_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, change and target of margin notes made from the lines."""
    li = table(spark, sf_dir, "lineitem")
    verb = F.when(F.col("l_linenumber") % 3 == 0, "amended").when(F.col("l_linenumber") % 3 == 1, "inserted").otherwise("repealed")
    raw = F.concat(F.lit("S. "), F.col("l_orderkey").cast("string"), F.lit("("), F.col("l_linenumber").cast("string"), F.lit(") "), verb, F.lit(" by Nos "), (F.col("l_partkey") % 90).cast("string"), F.lit("/"), F.year("l_shipdate").cast("string"), F.lit(" s. 3, "), (F.col("l_suppkey") % 70 + 100).cast("string"), F.lit("/2001 s. 5."))
    return li.select("l_orderkey", "l_linenumber", F.array_join(T.citations(raw), "|").alias("cites"), T.change_kind(raw).alias("kind"), T.note_target(raw).alias("target"))


@query("SELECT p_partkey, lower(p_brand) || '|' || lower(p_type) AS terms FROM part WHERE lower(p_brand) <> lower(p_type)")
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.lower("p_brand") != F.lower("p_type"))
    text = F.concat("p_brand", F.lit(" and "), "p_type", F.lit(" means a thing;\nother words"))
    return p.select("p_partkey", F.array_join(T.defined_terms(text), "|").alias("terms"))


@query("SELECT user_id, string_agg(event_id || ' | ' || event_type, chr(10) ORDER BY event_id) AS encoded, count(*) AS n FROM events GROUP BY user_id")
def table_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to lines and back: the decoded count must be the rows'."""
    e = table(spark, sf_dir, "events")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda r: F.array(r["event_id"].cast("string"), r["event_type"]))
    coded = e.groupBy("user_id").agg(T.format_rows(rows).alias("encoded"))
    return coded.select("user_id", "encoded", F.size(T.split_rows(F.col("encoded"))).cast("long").alias("n"))


@query("SELECT c_custkey, (c_custkey % 40) AS n, CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE '' END AS suffix FROM customer")
def natural_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat((F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "A").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", T.natural_number(number)["n"].alias("n"), T.natural_number(number)["suffix"].alias("suffix"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^\([0-9]+[A-Z]*\)') THEN 'subsection' WHEN regexp_matches(t, '^\([a-z]+\)') THEN 'roman_or_letter' WHEN regexp_matches(t, '^\([A-Z]+\)') THEN 'capital' WHEN regexp_matches(t, '^[0-9]+\.[0-9]+') THEN 'decimal' WHEN regexp_matches(t, '^[0-9]+[A-Z]*\b') THEN 'number'
WHEN regexp_matches(t, '^\p{Lu}') THEN 'word_upper' WHEN regexp_matches(t, '^\p{Ll}') THEN 'word_lower' ELSE 'other' END AS opening FROM (SELECT doc_id, trim(text) AS t FROM documents)""")
def opening_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.opening_class(F.col("text")).alias("opening"))


@query("SELECT c_custkey, '/browse/' || lower(c_mktsegment) || '/section/' || c_nationkey || '#s' || c_custkey AS address FROM customer")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators.search import address

    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", address(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.concat(F.lit("s"), F.col("c_custkey").cast("string"))).alias("address"))


@query("SELECT conv_id, turn, left(sha256(role || chr(31) || '' || chr(31) || left(regexp_replace(text, '[ \\t]*\\n+[ \\t]*', ' ', 'g'), 120)), 6) AS digest FROM conversations")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators.review import digests

    nodes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("type"), F.lit("").alias("heading"), "text")
    return digests(nodes).select("conv_id", "turn", "digest")


@query("""SELECT l_orderkey, l_linenumber, 's. ' || l_orderkey || '(' || l_linenumber || ')' || CASE WHEN l_linenumber % 2 = 0 THEN '(a)' ELSE '' END AS label, CASE WHEN l_suppkey % 2 = 0 THEN 'sch 1/' ELSE '-/' END || l_partkey || 'a' AS key,
CASE l_linenumber % 3 WHEN 0 THEN 'provision' WHEN 1 THEN 'provision' ELSE 'part' END AS kind, (l_partkey % 30)::VARCHAR AS base, CASE WHEN l_partkey % 3 = 0 THEN 'AB' ELSE '' END AS suffix FROM lineitem""")
def provision_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, keys and kinds of provisions, and the parts of an inserted number."""
    n, string = F.col("l_linenumber"), lambda c: c.cast("string")
    path = F.struct(string(F.col("l_orderkey")).alias("section"), string(n).alias("subsection"), F.when(n % 2 == 0, "a").alias("paragraph"), F.lit(None).cast("string").alias("subparagraph"))
    key = T.provision_key(F.when(F.col("l_suppkey") % 2 == 0, "Sch 1").otherwise(""), F.concat(string(F.col("l_partkey")), F.lit("A")))
    parts = T.insertion_parts(F.concat(string(F.col("l_partkey") % 30), F.when(F.col("l_partkey") % 3 == 0, "AB").otherwise("")))
    kind = T.provision_kind(F.when(n % 3 == 0, "section").when(n % 3 == 1, "item").otherwise("part"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.provision_label(path).alias("label"), F.concat(F.coalesce(key["schedule"], F.lit("-")), F.lit("/"), key["number"]).alias("key"), kind.alias("kind"), parts["base"].alias("base"), parts["suffix"].alias("suffix"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS field, left(lower(regexp_replace(regexp_replace(p_brand || '.5 ' || p_type, '[^A-Za-z0-9.]+', '-', 'g'), '^-+|-+$', '', 'g')), 40) AS segment,
CASE WHEN p_size % 2 = 0 THEN p_size || '/1990' END AS cite, '"' || p_name || '"-x' AS cleaned, '<mark>' || p_name || '</mark> &lt;&amp;' AS marked, CASE WHEN p_size % 2 = 0 THEN 'Act ' ELSE 'Act' || chr(61472) END AS symbols FROM part""")
def printed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names, name segments, citations of titles, cleaned instructions, marked snippets, symbol fonts."""
    p, even = table(spark, sf_dir, "part"), F.col("p_size") % 2 == 0
    title = F.concat("p_name", F.lit(" Act, No. 1/1985, "), F.when(even, F.concat(F.lit("No. "), F.col("p_size").cast("string"), F.lit("/1990"))).otherwise(""))
    cite = F.when(even, T.title_citation(title))
    return p.select(
        "p_partkey", T.field_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("field"), T.name_slug(F.concat("p_brand", F.lit(".5 "), "p_type")).alias("segment"), cite.alias("cite"),
        T.clean_instruction(F.concat(F.lit("“"), "p_name", F.lit("”—x"))).alias("cleaned"), T.snippet_html(F.concat(F.lit("\x02"), "p_name", F.lit("\x03 <&"))).alias("marked"),
        T.symbol_font_text(F.lit("Act\uf020"), F.when(even, "SymbolMT").otherwise("Times")).alias("symbols"),
    )


@query("""SELECT c_custkey, c_custkey % 3 = 0 AS starts, c_custkey % 2 = 0 AS looks, CASE WHEN c_nationkey % 4 = 0 THEN 'part' WHEN c_nationkey % 4 = 1 THEN 'act' END AS scope, CASE WHEN c_custkey % 3 = 0 THEN 'sch1/cl' || c_nationkey || '/p2' ELSE 'pt1/s' || c_nationkey END AS name FROM customer""")
def definition_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether lines begin and headings announce definitions, for which part of an Act, and canonical names."""
    from folioscope.operators.delta import canonical

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    line = F.when(k % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit(" means a thing"))).otherwise("it is so")
    lead = F.when(n % 4 == 0, "In this Part—").when(n % 4 == 1, "in this act").otherwise("In that Part")
    name = F.when(k % 3 == 0, F.concat(F.lit("sch1/"), F.when(k % 2 == 0, "item").otherwise("s"), n.cast("string"), F.lit("/p2"))).otherwise(F.concat(F.lit("pt1/s"), n.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_definition_start(line).alias("starts"), T.looks_like_definitions(F.when(k % 2 == 0, "Definitions").otherwise("Purposes")).alias("looks"), T.definition_scope(lead).alias("scope"), canonical(name).alias("name"))


@query("""WITH d AS (SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 120)) > 0 AS wide FROM documents),
r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s*\\n\\s*', CASE WHEN wide THEN chr(10) || chr(10) ELSE ' ' END, 'g'), '^\\s+|\\s+$', '', 'g') AS shown FROM d)
SELECT doc_id, md5(shown) AS shown, length(shown) AS n, true AS back, substring(shown, length(shown) // 2 + 1, 1) AS middle FROM r""")
def reflowed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as they are shown; the place of the middle letter is mapped to the stored text and back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", O.reflowed(F.col("text")).alias("m"))
    n = F.length("m.text")
    d = d.withColumn("at", F.floor(n / 2).cast("int")).withColumn("raw", O.to_stored(F.col("m"), F.col("at")))
    back = O.to_shown(F.col("m"), F.col("raw"))
    shown = F.substring(F.col("m.text"), F.col("at") + 1, F.lit(1))
    blank = shown.rlike(r"(?U)^\s$")
    same = F.when(blank, back <= F.col("at")).otherwise((back == F.col("at")) & (F.substring(F.col("text"), F.col("raw") + 1, F.lit(1)) == shown))
    return d.select("doc_id", F.md5("m.text").alias("shown"), n.cast("long").alias("n"), same.alias("back"), shown.alias("middle"))
