"""A reviewer's edits over the driver tables: `conversations` are documents, a user's turn opens a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioscope.operators import edit_log as G
from folioscope.operators import edits as E
from folioscope.plans import query
from folioscope.session import table

NODES = "nodes AS (SELECT conv_id AS doc, turn AS idx, role || '/' || turn AS name, role AS type, text, turn // 2 AS unit, turn % 3 AS rank, true AS live FROM conversations)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.concat_ws("/", "role", "turn").alias("name"), F.col("role").alias("type"), "text", F.floor(F.col("turn") / 2).alias("unit"), (F.col("turn") % 3).cast("int").alias("rank"), F.lit(True).alias("live"))


@query(f"""WITH {NODES}, c AS (SELECT DISTINCT doc, unit, unit % 2 = 0 AS verified FROM nodes WHERE doc % 2 = 0)
SELECT doc, idx, CASE WHEN verified THEN 'now' END AS verified_at, NOT verified AS needs_followup, CASE WHEN idx = max(idx) OVER (PARTITION BY doc, unit) THEN unit END AS unit_end FROM nodes JOIN c USING (doc, unit)""")
def committed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    commits = n.where("doc % 2 = 0").select("doc", "unit").distinct().select("doc", "unit", (F.col("unit") % 2 == 0).alias("verified"), F.lit("now").alias("at"))
    return E.committed(n, commits).select("doc", "idx", "verified_at", "needs_followup", "unit_end")


@query(f"WITH {NODES} SELECT doc, idx FROM nodes WHERE unit % 2 = 1 AND idx % 4 <> 2")
def accepted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns a page; every second page is accepted, and some nodes already are."""
    n = nodes(spark, sf_dir).withColumn("page", F.col("unit"))
    return E.accepted_page(n, n.where("idx % 4 = 2"), n.where("unit % 2 = 1").select("doc", "page").distinct())


@query(f"""WITH {NODES}, x AS (SELECT doc, idx, trim(left(text, 10)) AS head, trim(substr(text, 11)) AS tail FROM nodes WHERE idx % 4 = 1 AND length(text) > 10 AND trim(substr(text, 11)) <> ''),
y AS (SELECT doc, idx - 1 AS idx, tail FROM x) SELECT n.doc, n.idx, concat_ws(chr(10), nullif(coalesce(x.head, n.text), ''), y.tail) AS text FROM nodes n LEFT JOIN x USING (doc, idx) LEFT JOIN y ON y.doc = n.doc AND y.idx = n.idx""")
def split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth turn is cut at its tenth letter, the rest goes to the turn before; a cut onto itself is refused."""
    n = nodes(spark, sf_dir)
    cuts = n.where("idx % 4 = 1").select("doc", "idx", F.lit(10).alias("at"), (F.col("idx") - 1).alias("target"))
    return E.split_text(n, cuts.unionByName(n.where("idx % 4 = 3").select("doc", "idx", F.lit(5).alias("at"), F.col("idx").alias("target")))).select("doc", "idx", "text")


@query(f"""WITH {NODES}, ok AS (SELECT doc, idx, trim(text) AS t FROM nodes WHERE idx % 4 = 1)
SELECT n.doc, n.idx, concat_ws(chr(10), nullif(n.text, ''), nullif(o.t, '')) AS text, n.idx % 4 <> 1 AS live FROM nodes n LEFT JOIN ok o ON o.doc = n.doc AND o.idx = n.idx + 1 AND n.idx % 4 = 0""")
def merged_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second piece of every other unit joins the first; merging a piece into itself is refused."""
    n = nodes(spark, sf_dir)
    merges = n.where("idx % 4 = 1").select("doc", (F.col("idx") - 1).alias("target"), F.col("idx").alias("source"))
    return E.merged(n, merges.unionByName(n.where("idx % 4 = 2").select("doc", F.col("idx").alias("target"), F.col("idx").alias("source")))).select("doc", "idx", "text", "live")


@query(f"""WITH {NODES}, m AS (SELECT doc, idx - 2 AS target, idx AS source FROM nodes WHERE idx % 4 = 2), two AS (SELECT doc, 1 AS target, idx AS source FROM nodes WHERE idx IN (2, 4))
SELECT doc, target, 'root with pieces' AS reason FROM (SELECT m.doc, m.target FROM m JOIN nodes n ON n.doc = m.doc AND n.idx = m.source + 1)
UNION ALL SELECT doc, target, 'several units' FROM two GROUP BY doc, target HAVING count(*) > 1
UNION ALL SELECT a.doc, 1, 'root with pieces' FROM (SELECT doc FROM two GROUP BY doc HAVING count(*) = 1) a JOIN nodes n ON n.doc = a.doc AND n.idx = 3""")
def refused_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit's root can't leave while pieces of it stay; pieces of several units can't be merged at once."""
    n = nodes(spark, sf_dir)
    merges = n.where("idx % 4 = 2").select("doc", (F.col("idx") - 2).alias("target"), F.col("idx").alias("source"))
    two = n.where("idx IN (2, 4)").select("doc", F.lit(1).cast("long").alias("target"), F.col("idx").alias("source"))
    return E.merge_refusals(n, merges.unionByName(two))


@query(f"""WITH {NODES} SELECT doc, idx, idx % 3 <> 1 AS live FROM nodes""")
def deleted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three nodes are deleted, one of these restored later."""
    n = nodes(spark, sf_dir)
    gone = n.where("idx % 3 <> 0").select("doc", "idx", F.lit(True).alias("deleted"), F.lit(1).alias("seq"))
    back = n.where("idx % 3 = 2").select("doc", "idx", F.lit(False).alias("deleted"), F.lit(2).alias("seq"))
    return E.tombstones(n, gone.unionByName(back)).select("doc", "idx", "live")


@query(f"""WITH {NODES}, p AS (SELECT a.doc, a.idx AS root, (SELECT min(b.idx) FROM nodes b WHERE b.doc = a.doc AND b.idx > a.idx AND b.rank <= a.rank) AS stop FROM nodes a WHERE a.idx % 2 = 0)
SELECT p.doc, p.root, n.idx FROM p JOIN nodes n ON n.doc = p.doc AND n.idx >= p.root AND (p.stop IS NULL OR n.idx < p.stop)""")
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return E.block_under(n, n.where("idx % 2 = 0").select("doc", "idx"))


@query(f"""WITH {NODES}, m AS (SELECT doc, idx, CASE WHEN idx % 2 = 0 THEN idx - 1 ELSE idx + 1 END AS target FROM nodes)
SELECT m.doc, m.idx, m.target, coalesce(m.target < m.idx AND t.rank <= n.rank, false) AS fits FROM m JOIN nodes n USING (doc, idx) LEFT JOIN nodes t ON t.doc = m.doc AND t.idx = m.target""")
def renest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return E.can_renest(n, n.select("doc", "idx", F.when(F.col("idx") % 2 == 0, F.col("idx") - 1).otherwise(F.col("idx") + 1).alias("target"))).select("doc", "idx", "target", "fits")


@query(f"""WITH u AS (SELECT conv_id AS doc, turn // 4 AS unit, turn AS idx, role AS type, CASE WHEN turn % 4 = 2 THEN '(1)' ELSE '' END AS chain FROM conversations),
l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc, unit ORDER BY idx) = 1 THEN 'SECTION' ELSE coalesce(nullif(chain, ''), upper(type) || ' ' || row_number() OVER (PARTITION BY doc, unit, type ORDER BY idx)) END AS l FROM u)
SELECT doc, idx, CASE WHEN row_number() OVER (PARTITION BY doc, unit, l ORDER BY idx) > 1 THEN l || ' #' || row_number() OVER (PARTITION BY doc, unit, l ORDER BY idx) ELSE l END AS label FROM l""")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).withColumns({"unit": F.floor(F.col("idx") / 4), "chain": F.when(F.col("idx") % 4 == 2, "(1)").otherwise(""), "heading": F.lit("")})
    return E.unit_labels(n).select("doc", "idx", "label")


@query("""WITH u AS (SELECT conv_id AS doc, turn // 2 AS unit, bool_and(length(text) > 60) AS finished FROM conversations GROUP BY ALL)
SELECT doc, (coalesce(min(unit) FILTER (WHERE NOT finished), max(unit) + 1) - min(unit))::BIGINT AS marked FROM u GROUP BY doc""")
def contiguous_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return E.contiguous_units(n.groupBy("doc", "unit").agg(F.bool_and(F.length("text") > 60).alias("finished")))


@query("""SELECT CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS act, count(*) AS rows FROM events GROUP BY 1 UNION ALL SELECT 'refused ' || 'signup', count(*) FROM events WHERE event_type = 'error'""")
def renamed_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rename goes through; one onto a name that holds rows is refused."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("act"), "event_id")
    renames = spark.createDataFrame([("click", "tap"), ("signup", "error")], "old string, new string")
    out, refused = E.renamed({"verified": rows}, renames, ("verified",))
    moved = out["verified"].groupBy("act").agg(F.count("*").alias("rows"))
    return moved.unionByName(refused.select(F.concat(F.lit("refused "), "old").alias("act"), "rows"))


@query(f"""WITH {NODES} SELECT doc, idx, CASE WHEN idx % 5 <> 4 THEN name END AS name FROM nodes""")
def rekeyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by place under names; those whose place has no name are told apart."""
    n = nodes(spark, sf_dir).withColumnRenamed("doc", "act")
    done, unnamed = E.rekeyed(E.with_columns(n.select("act", "idx"), {"flag": "boolean"}), n.where("idx % 5 <> 4"))
    both = done.select("act", "idx", "name").unionByName(unnamed.select("act", "idx", F.lit(None).cast("string").alias("name")))
    return both.withColumnRenamed("act", "doc")


@query(f"""WITH {NODES} SELECT doc, 'old/' || idx AS name, idx FROM nodes WHERE idx % 2 = 0 UNION ALL SELECT doc, name, idx FROM nodes""")
def names_and_former_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    former = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("old/"), F.col("idx").cast("string")))
    return E.name_index(nodes(spark, sf_dir), former)


@query(f"""WITH {NODES}, s AS (SELECT doc, CASE WHEN idx % 7 = 6 THEN 'x' ELSE name END AS name, idx % 50 AS start, idx % 50 + 12 AS stop, CASE WHEN idx % 3 = 2 THEN 'odd' ELSE 'term' END AS label, idx FROM nodes)
SELECT s.doc, s.idx, CASE WHEN label = 'odd' THEN 'label' WHEN n.text IS NULL THEN 'node' WHEN stop > length(n.text) THEN 'range' END AS problem, CASE WHEN label <> 'odd' AND n.text IS NOT NULL AND stop <= length(n.text) THEN substr(n.text, start::INT + 1, 12) END AS text FROM s LEFT JOIN nodes n ON n.doc = s.doc AND n.name = s.name""")
def checked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    start = (F.col("idx") % 50).cast("int")
    spans = n.select("doc", "idx", F.when(F.col("idx") % 7 == 6, "x").otherwise(F.col("name")).alias("name"), start.alias("start"), (start + 12).alias("end"), F.when(F.col("idx") % 3 == 2, "odd").otherwise("term").alias("label"))
    return E.checked_spans(spans, n, ["term"]).select("doc", "idx", "problem", "text")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE text IS DISTINCT FROM trim(text) || CASE WHEN turn % 3 = 0 THEN '.' ELSE '' END) AS changed FROM conversations")
def correction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    human = F.concat(F.trim("text"), F.when(F.col("turn") % 3 == 0, ".").otherwise(""))
    return E.corrections_stats(c.select(F.col("text").alias("parser_output"), human.alias("human_output")))


@query(f"""WITH {NODES} SELECT r.doc, r.name, n.idx FROM (SELECT doc, CASE WHEN idx % 4 = 0 THEN name || '?' ELSE name END AS name FROM nodes) r LEFT JOIN nodes n USING (doc, name)""")
def rows_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified rows to their places; unplaced ones stay."""
    n = nodes(spark, sf_dir)
    rows = n.select("doc", F.when(F.col("idx") % 4 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"))
    return E.placed_by_name(rows, n).select("doc", "name", "idx")


@query(f"""WITH {NODES}, n AS (SELECT doc, count(*) AS n FROM nodes GROUP BY doc), moved AS (SELECT nodes.doc, idx, n FROM nodes JOIN n USING (doc) WHERE idx % 4 = 2 AND idx < n - 1),
p AS (SELECT doc, idx, type, text, idx AS base, 0 AS nth FROM nodes WHERE (doc, idx) NOT IN (SELECT doc, idx FROM moved) AND NOT (idx % 4 = 1 AND doc % 3 = 0)
UNION ALL SELECT m.doc, m.idx, o.type, o.text, -1, row_number() OVER (PARTITION BY m.doc ORDER BY m.idx DESC) + 1 FROM moved m JOIN nodes o ON o.doc = m.doc AND o.idx = m.idx
UNION ALL SELECT doc, 1000, 'insert', 'new', -1, 1 FROM n)
SELECT doc, idx, type, text, row_number() OVER (PARTITION BY doc ORDER BY base, nth) - 1 AS position FROM p""")
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth turn goes to the start, one after the other; one is inserted before them; every fourth is deleted, and
    in two of three documents that is undone."""
    n = nodes(spark, sf_dir).withColumn("number", F.lit(None).cast("string")).withColumn("heading", F.lit(None).cast("string"))
    last = F.max("idx").over(Window.partitionBy("doc"))
    row = lambda df, seq, op, idx, after, of, kind=None, text=None: df.select("doc", seq.cast("long").alias("seq"), F.lit(op).alias("op"), idx.cast("long").alias("idx"), F.lit(after).cast("long").alias("after_idx"), of.cast("long").alias("of"), F.lit(kind).cast("string").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("number", "heading")], F.lit(text).cast("string").alias("text"))
    idx, none = F.col("idx"), F.lit(None)
    moved = n.withColumn("last", last).where("idx % 4 = 2 AND idx < last")
    some = n.where("idx % 4 = 1")
    log = row(moved, idx, "place", idx, -1, none).union(row(n.select("doc").distinct(), F.lit(5000), "insert", F.lit(1000), -1, none, "insert", "new"))
    log = log.union(row(some, idx + 6000, "delete", idx, None, none)).union(row(some.where("doc % 3 <> 0"), idx + 9000, "undo", idx, None, idx + 6000))
    out = G.edited(n, log)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("doc").orderBy("base", "nth")) - 1).select("doc", "idx", "type", "text", "position")
