"""Learning from labelled rows: proposals, shared conditions, impurity, trees, rule predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import teaching as T
from folioscope.plans import query
from folioscope.session import table


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), (F.col("p_size") > 25).alias("bold"), F.col("p_size").alias("size"), (F.col("p_partkey") % 3).cast("string").alias("parent"))


@query("""SELECT p_brand AS brand, p_type AS type, count(*) AS support, CASE WHEN min(p_size > 25) = max(p_size > 25) THEN max(p_size > 25) END AS bold, min(p_size) AS size_low, max(p_size) AS size_high, array_to_string(list_sort(list(DISTINCT (p_partkey % 3)::VARCHAR)), ',') AS parents FROM part GROUP BY ALL HAVING count(*) >= 3""")
def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.proposals(_failures(spark, sf_dir), ["brand", "type"]).withColumn("parents", F.array_join("parents", ","))


@query("SELECT p_brand AS brand, count(*) AS support FROM part GROUP BY p_brand HAVING count(*) >= 3")
def lesson_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.proposals(_failures(spark, sf_dir), ["brand"]).select("brand", "support")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT source, sum(n) AS t FROM c GROUP BY source)
SELECT source, round(1 - sum((n / t) * (n / t)), 6) AS gini FROM c JOIN t USING (source) GROUP BY source""")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").cast("double").alias("n"))
    return c.groupBy("source").agg(F.round(T.gini(F.collect_list("n")), 6).alias("gini"))


RULES = [
    {"id": "a", "type": "heading", "priority": 2, "pattern": r"^[A-Z]", "ranges": {"words": (1, 40)}},
    {"id": "b", "type": "table", "priority": 1, "pattern": r"\|"},
    {"id": "c", "type": "shout", "priority": 1, "flags": {"shout": True}},
]


@query(r"""WITH d AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS t FROM documents), f AS (SELECT *, len(regexp_extract_all(t, '[^ \t\n\r\f\v]+')) AS words, t = upper(t) AS shout FROM d)
SELECT doc_id, line_no::INT AS line_no, CASE WHEN contains(t, '|') THEN 'table' WHEN shout THEN 'shout' WHEN regexp_matches(t, '^[A-Z]') AND words BETWEEN 1 AND 40 THEN 'heading' END AS recognised FROM f""")
def recognise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by (priority, id): the first that holds names the line; every line of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    f = d.withColumn("words", F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\v]+"), F.lit(0)))).withColumn("shout", F.col("text") == F.upper("text"))
    return T.first_rule(f, RULES).select("doc_id", "line_no", "recognised")


@query(None)
def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree grown on a bounded sample of labelled rows, as one expression over all documents."""
    d = table(spark, sf_dir, "documents")
    feats = d.select("doc_id", F.length("text").cast("double").alias("length"), F.regexp_count("text", F.lit(r"[|*#$%&!]")).cast("double").alias("marks"), (F.upper("text") == F.col("text")).alias("caps"))
    sample = feats.join(table(spark, sf_dir, "labels"), "doc_id").orderBy(F.xxhash64("doc_id")).limit(500).collect()  # a tree's training rows: 500 at most
    tree = T.grow([{k: r[k] for k in ("length", "marks", "caps")} for r in sample], [str(r["quality"]) for r in sample])
    return feats.withColumn("p", T.tree_column(tree)).select("doc_id", F.col("p.label").alias("label"), F.col("p.purity").alias("purity"), F.col("p.support").alias("support"))


@query("""WITH t AS (SELECT doc_id AS line, lang AS type FROM documents), a AS (SELECT doc_id AS line, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS type FROM documents), b AS (SELECT doc_id AS line, CASE WHEN doc_id % 4 = 0 THEN 'fr' ELSE lang END AS type FROM documents),
ga AS (SELECT a.line FROM a JOIN t USING (line, type)), gb AS (SELECT b.line FROM b JOIN t USING (line, type))
SELECT line, 'fixed' AS effect FROM gb WHERE line NOT IN (SELECT line FROM ga) UNION ALL SELECT line, 'broken' FROM ga WHERE line NOT IN (SELECT line FROM gb)""")
def fixed_and_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    of = lambda t: d.select(F.col("doc_id").alias("line"), t.alias("type"))
    return T.fixed_and_broken(of(F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang"))), of(F.when(F.col("doc_id") % 4 == 0, "fr").otherwise(F.col("lang"))), of(F.col("lang")))


@query(r"""WITH l AS (SELECT conv_id, turn, trim(text) AS t, CASE WHEN turn % 3 = 2 THEN 16.0 ELSE 12.0 END AS size, turn * 3.4 AS x0 FROM conversations)
SELECT conv_id, turn, round(size / 10.0, 2) AS size_ratio, round(x0, 0) AS indent, regexp_matches(t, '[.;:—]$') AS ends_clean, len(regexp_extract_all(t, '\S+'))::INT AS words, upper(t) = t AND regexp_matches(t, '\p{L}') AS caps FROM l""")
def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of printed lines."""
    k = F.col("turn")
    seen = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(k % 3 == 2, 16.0).otherwise(12.0).alias("size"), F.lit(10.0).alias("body"), (k * F.lit(3.4)).alias("x0"))
    return T.line_features(seen).select("conv_id", "turn", "size_ratio", "indent", "ends_clean", "words", "caps")


@query(r"""SELECT p_partkey, '1' || ',' || CASE WHEN p_size > 25 THEN '1' ELSE '0' END || ',' || CASE WHEN p_size BETWEEN 10 AND 20 AND p_partkey % 2 = 0 THEN '1' ELSE '0' END AS verdicts FROM part""")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule says of a line."""
    rules = [{"id": "a", "pattern": r"^Brand#"}, {"id": "b", "flags": {"bold": True}}, {"id": "c", "ranges": {"size": (10, 20)}, "parents": ["even"]}]
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.col("p_brand").alias("text"), (F.col("p_size") > 25).alias("bold"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 2 == 0, "even").alias("parent"))
    said = F.transform("verdicts", lambda v: F.when(v["holds"], "1").otherwise("0"))
    return T.explain_rules(rows, rules).select("p_partkey", F.array_join(said, ",").alias("verdicts"))
