"""Documents read and parsed: HTML pages, printed lines, amending instructions. Sequential passes run per document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import amending as A
from folioscope.functions import html as H
from folioscope.operators import parsing as P
from folioscope.operators import statutes as S
from folioscope.plans import query
from folioscope.session import table, texts


@query(None)
def sanitise_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = texts(spark, sf_dir, "pages")
    return p.select("page_id", H.sanitised(F.col("html")).alias("safe")).withColumn("paragraphs", H.paragraph_count(F.col("safe")))


@query(None)
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages").select("page_id", "url", H.main_text_of(F.col("html")).alias("text"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<(?:p|li)[\\s>]'))::INT AS paragraphs FROM pages")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.paragraph_count(F.col("html")).alias("paragraphs"))


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as printed lines: numbers before some, levels by turns, so that the parser has nesting to find."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lead = F.when(F.col("line_no") % 5 == 0, F.concat((F.floor(F.col("line_no") / 5) + 1).cast("string"), F.lit(" "))).when(F.col("line_no") % 5 == 1, F.lit("(1) ")).when(F.col("line_no") % 5 == 2, F.lit("(a) ")).when(F.col("line_no") % 5 == 3, F.lit("(b) ")).otherwise(F.lit(""))
    return d.select(
        F.col("doc_id").alias("doc"), F.col("line_no").cast("int").alias("line_no"), F.concat(lead, "line").alias("text"), (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"),
        F.lit(100.0).alias("x0"), F.lit(500.0).alias("x1"), (F.col("line_no") % 40 * 14).cast("double").alias("y0"), F.lit(12.0).alias("size"), (F.col("line_no") % 5 == 0).alias("bold"),
    )


@query(None)
def line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_lines(printed_lines(spark, sf_dir))


def statute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set as statutes: 26 lines of each kind by turns (headings, lists, definitions, notes, a table, stars,
    penalties, examples, a Schedule), with their places on the page. Every third section's number stands twice."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    k, turn = F.col("line_no") % 26, F.floor(F.col("line_no") / 26)
    n = lambda c: c.cast("string")
    term = F.element_at(F.split(F.lower(F.concat(F.lit("x"), "line")), r"[^a-z]+"), 1)
    shapes = {
        0: F.when(turn % 5 == 4, F.concat(F.lit("Schedule "), n(turn), F.lit("—Forms"))).otherwise(F.concat(F.lit("Part "), n(turn + 1), F.lit("—General"))),
        1: F.concat(n(turn * 2 + 1 - (turn % 3 == 2).cast("int")), F.lit(" Purposes")), 3: F.concat(F.lit("(1) "), "line"), 4: F.concat(F.lit("(a) "), "line"), 5: F.concat(F.lit("(i) "), "line"),
        6: F.concat(F.lit("(ii) "), "line"), 7: F.concat(F.lit("(b) "), "line"), 9: F.lit("Notes"), 10: F.concat(F.lit("1 "), "line"), 11: F.concat(F.lit("2 "), "line"), 12: F.lit("* * * *"),
        13: F.concat(n(turn * 2 + 2), F.lit(" Definitions")), 14: F.lit("In this section—"), 15: F.concat(term, F.lit(" means "), "line"), 16: F.concat(F.lit("(a) "), "line"), 17: F.lit("Penalty: 20 penalty units."),
        18: F.concat(n(turn + 900), F.lit(" Rates")), 19: F.lit("Item"), 20: F.lit("Rate"), 21: F.concat(F.lit("no. "), n(turn)), 22: n(F.length("line")), 23: F.lit("Example"),
    }
    text = F.coalesce(*[F.when(k == i, v) for i, v in shapes.items()], F.when(k.isin(2, 8), F.concat("line", F.lit("—"))), F.col("line"))
    x0 = F.when(k.isin(4, 7, 16), 215.7).when(k.isin(5, 6), 237.2).when(k.isin(20, 22), 330.0).otherwise(190.2)
    row = F.col("line_no") - k.isin(20, 22).cast("int")  # cells beside each other
    y0 = (F.col("line_no") % 52 - (F.col("line_no") - row)) * 14
    return d.select(
        F.col("doc_id").alias("doc"), "line_no", text.alias("text"), (F.floor(F.col("line_no") / 52) + 1).cast("int").alias("page"), x0.alias("x0"), (x0 + F.length(text) * 2).alias("x1"), y0.cast("double").alias("y0"), (y0 + 10).cast("double").alias("y1"),
        F.when(k == 0, 14.0).otherwise(12.0).alias("size"), k.isin(0, 1, 13, 18).alias("bold"), F.when(k == 15, term).alias("lbi"),
    )


@query(None)
def statute_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents read as statutes: nodes with their parents."""
    return S.read_statutes(statute_lines(spark, sf_dir)).select("doc", "idx", "type", "number", "heading", "text", "parent", "first_line", "n_lines")


@query(None)
def statute_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = statute_lines(spark, sf_dir)
    return S.table_rows(S.tag_lines(lines), lines)


@query(None)
def statute_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = statute_lines(spark, sf_dir)
    return S.node_boxes(S.tag_lines(lines), lines)


@query(None)
def parse_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand twice, and provisions without words."""
    lines = statute_lines(spark, sf_dir)
    return P.diagnostics(S.read_statutes(lines), lines)


def amending_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all drafting forms by turns, made of the lines' keys and flags."""
    li = texts(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("o"), F.col("l_linenumber").cast("string").alias("n"), F.lower("l_returnflag").alias("f"), F.lower("l_linestatus").alias("s"))
    forms = [
        "In section {o}({n}) of the Principal Act, for “{f} (b); x” substitute “{s}”.",
        "In section {o} of the Crimes Act 1958— (a) omit “{f}”; and (b) after “{s}” insert “, “{f}” too”.",
        "After section {o}({n})(b) of the Crimes Act 1958 insert— “(ba) a {s} offence;”.",
        "For section {o}({n}) of the Principal Act substitute— “({n}) any {f}.”.",
        "Section {o}({n}) of the Principal Act is repealed.",
        "In the heading to section {o} of the Principal Act, before “{f}” insert “{s}”.",
        "In section {o} of the Principal Act insert the following definition in alphabetical order— “{f} offence means {s};”.",
        "In section {o} of the Principal Act, in the definition of “{f} term”, at the end insert \"{s}\".",
        "In section {o}(1)(a) and (b) of the Principal Act,\n“{f}” is omitted.",
        "After section {o} of the Principal Act insert— “{o}A New {s}”.",
        "In item 2.1 of Schedule {n} to the Principal Act, omit “{f}” (wherever occurring).",
        "In section {o} of the Principal Act, the definition of {f} term is repealed.",
        "At the end of section {o}({n}) of the Principal Act insert— “Note {s}”.",
        "Section {o} of the Principal Act is amended as {f} may direct.",
        "In section {o}({n}) of the Principal Act— (a) in paragraph (c), for “{f}” substitute “{s}”; (b) before paragraph (d) insert— “(ca) {f};”.",
        "The law on {f} and {s} of the Road Rules Act 2009 changes",
    ]
    made = [F.concat(*[F.col(x[1:-1]) if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w\})", form) if x]) for form in forms]
    kind = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(forms))).cast("int")
    return li.select("l_orderkey", "l_linenumber", F.element_at(F.array(*made), kind + 1).alias("text"), F.concat(F.lit("s. "), "n").alias("provision"), F.lit("Road Safety Act 1986").alias("principal"))


_READ = """WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR AS o, l_linenumber::VARCHAR AS n, lower(l_returnflag) AS f, lower(l_linestatus) AS s, (l_orderkey + l_linenumber) % 16 AS k FROM lineitem),
r AS (SELECT l.*, unnest(CASE WHEN k IN (1, 8, 14) THEN [0, 1] ELSE [0] END) AS op_no FROM l),
t AS (SELECT l_orderkey, l_linenumber, op_no, 's. ' || n || CASE WHEN k IN (1, 14) THEN CASE op_no WHEN 0 THEN '(a)' ELSE '(b)' END ELSE '' END AS provision,
CASE WHEN k IN (1, 2) THEN 'Crimes Act 1958' WHEN k = 15 THEN 'Road Rules Act 2009' ELSE 'Road Safety Act 1986' END AS target_act, CASE WHEN k = 10 THEN n END AS schedule,
CASE WHEN k IN (10, 13, 15) THEN NULL WHEN k = 9 THEN o || 'A' ELSE o END AS section,
CASE WHEN k IN (0, 3, 4, 12) THEN n WHEN k = 2 THEN n || '/b' WHEN k = 8 THEN CASE op_no WHEN 0 THEN '1/a' ELSE '1/b' END WHEN k = 10 THEN '2.1' WHEN k = 14 THEN n || CASE op_no WHEN 0 THEN '/c' ELSE '/d' END ELSE '' END AS path,
k = 5 AS heading, CASE WHEN k IN (7, 11) THEN f || ' term' END AS definition,
CASE k WHEN 0 THEN 'substitute' WHEN 1 THEN CASE op_no WHEN 0 THEN 'omit' ELSE 'insert_after' END WHEN 2 THEN 'insert_provision' WHEN 3 THEN 'replace_provision' WHEN 4 THEN 'repeal' WHEN 5 THEN 'insert_before' WHEN 6 THEN 'insert_definition' WHEN 7 THEN 'insert_at_end' WHEN 8 THEN 'omit' WHEN 9 THEN 'insert_section'
WHEN 10 THEN 'omit' WHEN 11 THEN 'repeal' WHEN 12 THEN 'insert_at_end' WHEN 14 THEN CASE op_no WHEN 0 THEN 'substitute' ELSE 'insert_provision' END ELSE 'unparsed' END AS action,
CASE WHEN k = 0 THEN f || ' (b); x' WHEN k = 1 THEN CASE op_no WHEN 0 THEN f ELSE s END WHEN k IN (5, 8, 10) THEN f WHEN k = 14 AND op_no = 0 THEN f END AS old,
CASE WHEN k IN (0, 5, 7) THEN s WHEN k = 1 AND op_no = 1 THEN ', “' || f || '” too' WHEN k = 2 THEN 'a ' || s || ' offence;' WHEN k = 3 THEN 'any ' || f || '.' WHEN k = 6 THEN f || ' offence means ' || s || ';' WHEN k = 9 THEN 'New ' || s WHEN k = 12 THEN 'Note ' || s WHEN k = 14 THEN CASE op_no WHEN 0 THEN s ELSE f || ';' END END AS new,
CASE WHEN k = 2 THEN 'ba' WHEN k = 3 THEN n WHEN k = 9 THEN o || 'A' WHEN k = 14 AND op_no = 1 THEN 'ca' END AS number, k = 14 AND op_no = 1 AS before FROM r)"""


@query(_READ + " SELECT l_orderkey, l_linenumber, op_no::INT AS op_no, provision, target_act, schedule, section, path, heading, definition, action, old, new, number, before FROM t")
def instruction_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of all forms, read back."""
    return A.read_amendments(amending_sentences(spark, sf_dir)).withColumn("path", F.array_join("path", "/")).drop("raw")


@query(_READ + """ SELECT target_act || '|' || CASE WHEN schedule IS NOT NULL THEN 'sch' || schedule ELSE 's' || lower(coalesce(section, '')) END || '|' || coalesce(definition, '') AS key, count(*) AS instructions, array_to_string(list_sort(list(DISTINCT action)), ',') AS actions FROM t WHERE action <> 'unparsed' GROUP BY 1""")
def instruction_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes each provision, and how often."""
    return A.instructions_by_key(A.read_amendments(amending_sentences(spark, sf_dir)))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as printed lines: two turns a page, contents marks on the first pages of some."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn")
    text = F.when((k < 2) & (F.col("conv_id") % 2 == 0), "Contents").when(k == 5, "Endnotes").otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("doc"), k.cast("int").alias("line_no"), text.alias("text"), F.floor(k / 2).cast("int").alias("page"), (k >= 4).alias("bold"), F.when(k % 3 == 2, 16.0).otherwise(12.0).alias("size"), (k * k * 3 % 50).cast("double").alias("y0"), (F.length("text") % 90 + 400).cast("double").alias("x1"))


LINES = """lines AS (SELECT conv_id AS doc, turn AS line_no, CASE WHEN turn < 2 AND conv_id % 2 = 0 THEN 'Contents' WHEN turn = 5 THEN 'Endnotes' ELSE role END AS text, turn // 2 AS page, turn >= 4 AS bold, CASE WHEN turn % 3 = 2 THEN 16.0 ELSE 12.0 END AS size, (turn * turn * 3 % 50)::DOUBLE AS y0, (length(text) % 90 + 400)::DOUBLE AS x1 FROM conversations)"""


@query(f"""WITH {LINES}, p AS (SELECT doc, page, max(CASE WHEN regexp_matches(lower(text), '^\\s*contents\\b') THEN 1 ELSE 0 END) AS toc FROM lines GROUP BY ALL), r AS (SELECT *, min(toc) OVER (PARTITION BY doc ORDER BY page) AS run FROM p)
SELECT doc, coalesce(min(page) FILTER (WHERE run = 0), max(page) + 1)::INT AS page FROM r GROUP BY doc""")
def body_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the leading pages of contents end."""
    return P.body_start(turn_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc, min(page)::INT AS page FROM lines WHERE bold AND size >= 14 AND lower(trim(text)) = 'endnotes' GROUP BY doc")
def endnote_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.endnotes_start(turn_lines(spark, sf_dir))


@query(f"""WITH {LINES}, g AS (SELECT *, y0 - lag(y0) OVER w AS gap, lag(x1) OVER w AS last_x1 FROM lines WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
u AS (SELECT doc, quantile_cont(gap, 0.5) AS median, quantile_cont(x1, 0.9) AS edge FROM g GROUP BY doc)
SELECT doc, line_no::INT AS line_no, gap IS NULL OR gap < 0 OR (gap > 1.4 * median AND last_x1 < edge - 10) AS starts FROM g JOIN u USING (doc)""")
def paragraph_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paragraph_starts(turn_lines(spark, sf_dir)).select("doc", "line_no", "starts")
