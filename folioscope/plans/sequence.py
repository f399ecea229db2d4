"""Ordered passes: `conversations` stands for documents of ordered nodes, `events` for versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import sequence as Q
from folioscope.plans import query
from folioscope.session import table


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("turn", "idx")


def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user opens a unit, system stands alone, assistant continues."""
    return Q.segments(turns(spark, sf_dir), "conv_id", F.col("role") == "user", F.col("role") == "system")


UNITS = """marked AS (SELECT *, role = 'user' AS is_root, last_value(CASE role WHEN 'user' THEN 2 WHEN 'system' THEN 1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_ FROM conversations),
units AS (SELECT *, sum(CASE WHEN role IN ('user', 'system') OR coalesce(last_ <> 2, true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS unit FROM marked)"""


@query(f"WITH {UNITS} SELECT conv_id, turn AS idx, role, unit::BIGINT AS unit, is_root FROM units")
def unit_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_rows(spark, sf_dir).select("conv_id", "idx", "role", "unit", "is_root")


@query(f"WITH {UNITS} SELECT conv_id, unit::BIGINT AS unit, min(turn) AS root_idx, string_agg(CASE WHEN text <> '' THEN text END, ' ' ORDER BY turn) AS text FROM units GROUP BY conv_id, unit")
def unit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unit_texts(unit_rows(spark, sf_dir), ["conv_id"])


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS governing FROM conversations")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators.linking import carry_forward as carried

    c = table(spark, sf_dir, "conversations")
    return carried(c, "conv_id", F.when(F.col("role") == "user", F.col("text")), "turn", "governing").select("conv_id", "turn", "governing")


@query("""WITH m AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w AS i1, sum(CASE WHEN role IN ('system', 'user') THEN 1 ELSE 0 END) OVER w AS i2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn AS idx,
last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS in_chapter,
last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, i1 ORDER BY turn) AS in_part,
last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, i2 ORDER BY turn) AS in_section FROM m""")
def breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels clear when a shallower one changes."""
    kinds = F.when(F.col("role") == "system", "chapter").when(F.col("role") == "user", "part").otherwise("section")
    nodes = turns(spark, sf_dir).withColumn("type", kinds).withColumn("number", F.col("idx").cast("string")).withColumn("heading", F.lit(None).cast("string"))
    out = Q.breadcrumbs(nodes, "conv_id", levels=(("chapter",), ("part",), ("section",)))
    return out.select("conv_id", "idx", *(F.col(c).cast("long").alias(c) for c in ("in_chapter", "in_part", "in_section")))


@query("""WITH n AS (SELECT doc_id, source, split_part(text, ' ', 1) AS name, left(regexp_replace(text, '[ \\t]*\\n+[ \\t]*', ' ', 'g'), 120) AS start FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY doc_id) AS k FROM n),
b AS (SELECT *, CASE WHEN k = 1 THEN name ELSE name || '~' || left(sha256('document' || chr(31) || '' || chr(31) || start), 6) END AS q FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY source, q ORDER BY doc_id) AS m FROM b)
SELECT source, doc_id, CASE WHEN m = 1 THEN q ELSE q || '-' || m END AS node_id FROM c""")
def duplicate_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.element_at(F.split("text", " "), 1).alias("name"), F.lit("document").alias("type"), F.lit("").alias("heading"), "text")
    return Q.unique_names(d, "source", idx="doc_id").select("source", "doc_id", "node_id")


@query("""SELECT source, doc_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || (n - 1) END AS anchor FROM
(SELECT source, doc_id, lang AS slug, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""")
def anchor_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("lang").alias("slug"))
    return Q.slug_names(d, "source", "slug", idx="doc_id").select("source", "doc_id", "anchor")


ISLANDS = """m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m),
s AS (SELECT user_id, island::BIGINT AS island, first(event_type) AS event_type, min(event_id) AS span_from, max(event_id) AS span_to, count(*) AS members FROM g GROUP BY user_id, island)"""


@query(f"WITH {ISLANDS} SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY island) AS ended_by FROM s")
def wording_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.spans(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""WITH r AS (SELECT conv_id, turn, min(CASE WHEN length(text) > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, coalesce(max(CASE WHEN run = 1 THEN turn END), -1) AS resume_at FROM r GROUP BY conv_id""")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.resume_point(turns(spark, sf_dir), "conv_id", F.length("text") > 120)


@query("""WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations)
SELECT conv_id, entry::BIGINT AS entry, min(turn) AS idx, string_agg(text, ' ' ORDER BY turn) AS text FROM m GROUP BY conv_id, entry""")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.merge_blocks(turns(spark, sf_dir), "conv_id", F.col("role") == "user")


@query("SELECT conv_id, turn AS idx, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.neighbours(turns(spark, sf_dir), "conv_id", "role").select("conv_id", "idx", "previous", "next")


@query(r"""WITH l AS (SELECT conv_id, turn // 2 AS page, trim(regexp_replace(regexp_replace(unnest(string_split(role || chr(10) || text, chr(10))), '[0-9]', '#', 'g'), '\s+', ' ', 'g')) AS masked FROM conversations),
p AS (SELECT conv_id, count(DISTINCT page) AS pages FROM l GROUP BY conv_id), s AS (SELECT conv_id, masked, count(DISTINCT page) AS n FROM l GROUP BY conv_id, masked)
SELECT conv_id AS doc, masked FROM s JOIN p USING (conv_id) WHERE pages > 1 AND n >= 0.5 * pages AND masked <> ''""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked lines that stand on half of a document's pages (two turns a page)."""
    from folioscope.operators.parsing import repeated_heads

    c = table(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 2).alias("page"), F.explode(F.split(F.concat("role", F.lit("\n"), "text"), "\n")).alias("text"))
    return repeated_heads(lines)


@query("""WITH l AS (SELECT role, round(length(text) / 10.0, 1) AS size, turn % 4 = 3 AS bold FROM conversations), n AS (SELECT role, size, count(*) AS n FROM l WHERE NOT bold GROUP BY ALL)
SELECT role AS doc, size AS body FROM n QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, size) = 1""")
def rounded_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent size of lines that aren't bold, the smaller on ties."""
    from folioscope.operators.parsing import body_size

    c = table(spark, sf_dir, "conversations")
    return body_size(c.select(F.col("role").alias("doc"), (F.length("text") / F.lit(10.0)).alias("size"), (F.col("turn") % 4 == 3).alias("bold")))
