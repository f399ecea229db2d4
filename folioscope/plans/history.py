"""Reviewed history and composite reads over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import instructions as I
from folioscope.operators import history as H
from folioscope.operators import linking as K
from folioscope.plans import query
from folioscope.plans.lineage import STATES, states
from folioscope.session import table


@query("""WITH m AS (SELECT o_custkey AS work, o_orderkey AS idx, o_orderkey::VARCHAR AS name, o_orderkey % 3 <> 0 AS shared FROM orders),
w AS (SELECT *, last_value(CASE WHEN shared THEN name END IGNORE NULLS) OVER (PARTITION BY work ORDER BY idx) AS follows FROM m) SELECT work, idx, name, follows FROM w WHERE NOT shared""")
def insertion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work"), F.lit(1).alias("version"), F.col("o_orderkey").alias("idx"), F.col("o_orderkey").cast("string").alias("name"))
    return H.insertion_points(p, p.where("idx % 3 <> 0")).select("work", "idx", "name", "follows")


@query("""SELECT user_id AS work, event_id % 5 AS to_version, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0)), ','), '') AS text_keys,
coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1)), ','), '') AS whole_keys FROM events WHERE value > 10 GROUP BY ALL""")
def confirmed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("work"), (F.col("event_id") % 5).alias("to_version"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 2 == 0, "text").otherwise("whole").alias("piece_kind"), F.when(F.col("value") > 10, "confirmed").alias("decision"))
    return H.confirmed(d).withColumns({c: F.array_join(c, ",") for c in ("text_keys", "whole_keys")})


@query("""WITH c AS (SELECT o_orderkey AS key FROM orders), i AS (SELECT l_orderkey AS key, count(*) AS instructions, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS statuses FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey),
n AS (SELECT l_orderkey AS key, count(*) AS notes FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey)
SELECT key, coalesce(instructions, 0) AS instructions, coalesce(statuses, '') AS statuses, coalesce(notes, 0) AS notes, coalesce(instructions, 0) + coalesce(notes, 0) = 0 AS unexplained FROM c LEFT JOIN i USING (key) LEFT JOIN n USING (key)""")
def evidence_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with the instructions and notes behind them."""
    li = table(spark, sf_dir, "lineitem")
    at = (F.lit("w").alias("work"), F.lit(2).alias("version"))
    c = table(spark, sf_dir, "orders").select(*at, F.col("o_orderkey").alias("key"))
    i = li.where("l_quantity > 25").select(*at, F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("status"))
    n = li.where("l_discount > 0.05").select(*at, F.col("l_orderkey").alias("key"))
    return H.with_evidence(c, i, n).select("key", "instructions", F.array_join("statuses", ",").alias("statuses"), "notes", "unexplained")


@query(f"""WITH {STATES}, m AS (SELECT *, CASE WHEN lag(text_hash) OVER w IS DISTINCT FROM text_hash OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM states WINDOW w AS (PARTITION BY work, key ORDER BY version)),
g AS (SELECT *, sum(c) OVER (PARTITION BY work, key ORDER BY version) AS island FROM m)
SELECT work, key AS piece, island::BIGINT AS island, min(version) AS from_version, max(version) AS to_version, count(*) AS versions, any_value(text_hash) AS text FROM g GROUP BY work, key, island""")
def piece_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.piece_history(states(spark, sf_dir).select("work", F.col("key").alias("piece"), "version", F.col("text_hash").alias("text")))


@query("""WITH n AS (SELECT CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang ELSE source || '/' || lang || '/' || doc_id END AS name, doc_id % 2 = 0 AS f FROM documents),
u AS (SELECT split_part(name, '/', 1) AS name, f FROM n UNION ALL SELECT split_part(name, '/', 1) || '/' || split_part(name, '/', 2), f FROM n WHERE split_part(name, '/', 2) <> '' UNION ALL SELECT name, f FROM n WHERE split_part(name, '/', 3) <> '')
SELECT name, count(*) AS pieces, count(*) FILTER (WHERE f) AS flagged FROM u GROUP BY name""")
def verification_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, F.col("source")).when(d % 3 == 1, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", d.cast("string")))
    return H.subtree_counts(table(spark, sf_dir, "documents").select("doc_id", name.alias("name")), d % 2 == 0)


@query("""WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS rank FROM conversations)
SELECT a.conv_id, a.turn AS idx, a.rank, (SELECT max(b.turn) FROM r b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.rank < a.rank) AS parent FROM r a""")
def unit_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("rank"))
    return H.tree_info(u, "conv_id", "rank", deepest=3)


@query("""WITH u AS (SELECT conv_id AS doc, turn AS idx, turn % 3 AS depth, CASE WHEN role = 'user' THEN nullif(text, '') END AS names FROM conversations),
a AS (SELECT *, last_value(CASE WHEN depth <= 0 THEN {'d': depth, 'n': names} END IGNORE NULLS) OVER w AS a0, last_value(CASE WHEN depth <= 1 THEN {'d': depth, 'n': names} END IGNORE NULLS) OVER w AS a1 FROM u
WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc, idx, coalesce(CASE WHEN depth > 1 AND a1.d = 1 THEN a1.n END, CASE WHEN depth > 0 AND a0.d = 0 THEN a0.n END) AS governed_by FROM a""")
def governing_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return H.scopes(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), (F.col("turn") % 3).alias("depth"), F.when(F.col("role") == "user", F.col("text")).alias("names")), deepest=2)


@query("""WITH g AS (SELECT DISTINCT o_custkey AS k, (o_orderkey % 97)::DOUBLE AS gap FROM orders), l AS (SELECT k, gap, lag(gap) OVER (PARTITION BY k ORDER BY gap) AS was FROM g)
SELECT k, min(gap) FILTER (WHERE gap >= 1.22 * was) AS cut FROM l GROUP BY k""")
def row_gap_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return H.row_gap_cut(o.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 97).cast("double").alias("gap")), "k")


@query("SELECT p_name AS title, p_size AS year FROM part WHERE contains(lower(p_name), 'cold') ORDER BY starts_with(lower(p_name), 'cold') DESC, p_size DESC, p_name LIMIT 20")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.catalogue(table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_size").alias("year")), "cold")


@query("""SELECT c_name AS title, c_nationkey::VARCHAR AS resolved_year, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 0 GROUP BY ALL""")
def amending_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Act to the provisions its notes stand at."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = j.select(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("title"), F.col("c_nationkey").cast("string").alias("resolved_year"), F.col("o_orderkey").cast("string").alias("label"))
    return K.summary_by_act(r).select("title", "resolved_year", "n")


@query("""WITH t AS (SELECT DISTINCT (l_partkey % 300)::VARCHAR AS citation FROM lineitem), f AS (SELECT DISTINCT (o_custkey % 300)::VARCHAR AS citation FROM orders WHERE o_custkey % 3 = 0), n AS (SELECT DISTINCT p_size::VARCHAR AS citation FROM part)
SELECT citation FROM t WHERE citation NOT IN (SELECT citation FROM f) UNION SELECT citation FROM n WHERE citation IN (SELECT citation FROM t)""")
def acts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = lambda t, c: table(spark, sf_dir, t).select(c.cast("string").alias("citation")).distinct()
    in_force = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select((F.col("o_custkey") % 300).cast("string").alias("citation")).distinct()
    return K.acts_between(cite("lineitem", F.col("l_partkey") % 300), in_force, cite("part", F.col("p_size")))


@query("""WITH i AS (SELECT o_orderkey AS id, (o_custkey % 200)::VARCHAR AS section, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'far' || o_orderkey % 7 END AS new FROM orders),
c AS (SELECT s_suppkey::VARCHAR AS section, CASE WHEN s_suppkey % 2 = 0 THEN 'no' ELSE 'yes' END AS before, CASE WHEN s_suppkey % 3 = 0 THEN 'yes yes' ELSE 'no' END AS after FROM supplier)
SELECT id, CASE WHEN bool_or(coalesce(made, false)) THEN 'matched' WHEN any_value(i2.new) = 'yes' AND any_value(elsewhere) THEN 'elsewhere' WHEN bool_or(coalesce(already, false)) THEN 'earlier' ELSE 'not_found' END AS status FROM
(SELECT i.id, i.new, (length(after) - length(replace(after, i.new, ''))) / length(i.new) > (length(before) - length(replace(before, i.new, ''))) / length(i.new) AS made, contains(before, i.new) AS already,
EXISTS (SELECT 1 FROM c x WHERE x.section <> i.section AND contains(x.after, i.new) AND NOT contains(x.before, i.new)) AS elsewhere FROM i LEFT JOIN c USING (section)) i2 GROUP BY id""")
def instruction_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instruction with its best status over the changes of a step."""
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    i = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).cast("string").alias("section"), F.lit("insert_after_words").alias("action"), F.lit(None).cast("string").alias("old"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise(F.concat(F.lit("far"), (F.col("o_orderkey") % 7).cast("string"))).alias("new"))
    k = F.col("s_suppkey")
    c = s.select(k.cast("string").alias("section"), F.when(k % 2 == 0, "no").otherwise("yes").alias("before"), F.when(k % 3 == 0, "yes yes").otherwise("no").alias("after"))
    return I.match_instructions(i, c)
