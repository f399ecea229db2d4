"""Decisions over parsed rows: `labels` are a reviewer's rows, `documents` the parse, `events` a log of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import review as R
from folioscope.plans import query
from folioscope.session import table


@query("""WITH r AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'xx' END AS lang, toxic = 1 AS gone FROM labels)
SELECT d.doc_id, coalesce(r.lang, d.lang) AS lang, r.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN r USING (doc_id) WHERE NOT coalesce(r.gone, false)""")
def overlay_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "xx").alias("lang"), (F.col("toxic") == 1).alias("merged_away"))
    return R.overlay(table(spark, sf_dir, "documents").select("doc_id", "lang"), rows, ["doc_id"], ["lang"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("""SELECT doc_id, quality FROM (SELECT doc_id, quality, 0 AS new FROM labels UNION ALL SELECT doc_id, 9, 1 FROM documents WHERE doc_id % 4 = 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY new DESC) = 1""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(9).alias("quality"))
    return R.upsert(table(spark, sf_dir, "labels").select("doc_id", "quality"), new, ["doc_id"])


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(9).alias("quality"))
    return R.insert_or_ignore(table(spark, sf_dir, "labels").select("doc_id", "quality"), new, ["doc_id"])


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id, 7 FROM documents WHERE doc_id % 3 = 0")
def replace_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(7).alias("quality"))
    return R.replace_all(table(spark, sf_dir, "labels").select("doc_id", "quality"), new, "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang <> 'en'"), ["doc_id"]).select("doc_id", "quality", "toxic")


@query("""WITH u AS (SELECT conv_id, turn // 2 AS unit, bool_and(length(text) > 60) AS approved FROM conversations GROUP BY ALL) SELECT conv_id AS doc, count(*) FILTER (WHERE approved) AS checked, count(*) AS total FROM u GROUP BY conv_id""")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return R.progress(c.select(F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 2).alias("unit"), (F.length("text") > 60).alias("verified")))


@query("""SELECT coalesce(f.term, d.term) AS term, CASE WHEN d.decision = 'remove' THEN 'removed' WHEN f.term IS NULL THEN 'added' WHEN d.decision IS NOT NULL THEN 'confirmed' ELSE 'found' END AS state
FROM (SELECT DISTINCT p_brand AS term FROM part WHERE p_size > 25) f FULL JOIN (SELECT p_brand AS term, CASE WHEN count(*) % 2 = 0 THEN 'remove' ELSE 'add' END AS decision FROM part WHERE p_size <= 25 GROUP BY p_brand) d ON f.term = d.term""")
def definition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    found = p.where("p_size > 25").select(F.col("p_brand").alias("term")).distinct()
    decided = p.where("p_size <= 25").groupBy(F.col("p_brand").alias("term")).agg(F.when(F.count("*") % 2 == 0, "remove").otherwise("add").alias("decision"))
    return R.definition_states(found, decided)


@query("""WITH d AS (SELECT p_brand AS term, p_size::VARCHAR AS section FROM part), gone AS (SELECT DISTINCT p_brand AS term FROM part WHERE p_size = 1), adds AS (SELECT DISTINCT p_brand AS term, p_type AS section FROM part WHERE p_size = 2), ok AS (SELECT DISTINCT p_type AS section FROM part WHERE p_size > 40), more AS (SELECT * FROM adds WHERE section IN (SELECT section FROM ok))
SELECT term, section FROM d WHERE term NOT IN (SELECT term FROM gone) AND term NOT IN (SELECT term FROM more) UNION ALL SELECT term, section FROM more""")
def definition_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    gone = p.where("p_size = 1").select(F.col("p_brand").alias("term"), F.lit(None).cast("string").alias("section"), F.lit("remove").alias("decision")).distinct()
    adds = p.where("p_size = 2").select(F.col("p_brand").alias("term"), F.col("p_type").alias("section"), F.lit("add").alias("decision")).distinct()
    sections = p.where("p_size > 40").select(F.col("p_type").alias("section")).distinct()
    return R.apply_overrides(p.select(F.col("p_brand").alias("term"), F.col("p_size").cast("string").alias("section")), gone.unionByName(adds), sections)


@query("SELECT l_orderkey AS place, l_returnflag AS term, arg_max(l_linenumber, l_linenumber) AS target FROM lineitem GROUP BY ALL")
def definition_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest scope's definition counts."""
    li = table(spark, sf_dir, "lineitem")
    return R.nearest_scope(li.select(F.col("l_orderkey").alias("place"), F.col("l_returnflag").alias("term"), F.col("l_linenumber").alias("depth"), F.col("l_linenumber").alias("target")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE lower(p_brand) = lower(replace(p_type, ' ', ''))) AS type_ok, count(*) FILTER (WHERE (p_size % 7)::VARCHAR = (p_partkey % 7)::VARCHAR) AS number_ok FROM part")
def blind_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return R.agreement(p.select(F.col("p_brand").alias("guess_type"), F.col("p_type").alias("type"), (F.col("p_size") % 7).cast("string").alias("guess_number"), F.concat(F.lit("("), (F.col("p_partkey") % 7).cast("string"), F.lit(")")).alias("number")))


@query(None)
def review_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on the parse of one week carried to a parse in which every fifth node is gone and texts differ."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.col("role").alias("type"), F.lit(None).cast("string").alias("number"), F.substring("text", 1, 30).alias("heading"), "text")
    new = c.where("idx % 5 <> 4").withColumn("text", F.when(F.col("idx") % 2 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return R.remap(c.withColumn("accepted", F.lit(True)), new)


@query(None)
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd turns hung behind the turn two before them."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"))
    edits = c.where("idx % 4 = 3").select("doc", "idx", (F.col("idx") - 2).alias("after_idx"), F.lit(False).alias("deleted"), F.col("idx").alias("seq"))
    return R.document_order(c, edits)


@query(None)
def parse_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.col("role").alias("type"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("heading"), "text")
    return R.parse_fingerprint(c)


@query("SELECT user_id AS doc, array_to_string(list_sort(list(DISTINCT event_id % 20)), ',') AS units FROM events WHERE value > 60 GROUP BY 1")
def finished_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 20).alias("unit"), (F.col("value") > 60).alias("done"))
    return R.finished_units(e).withColumn("units", F.array_join(F.transform("units", lambda u: u.cast("string")), ","))
