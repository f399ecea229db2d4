"""Versions and their changes: `events` stands for wordings by version, `orders` and `lineitem` for keyed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import diff as D
from folioscope.operators import delta as X
from folioscope.operators import inheritance as H
from folioscope.operators import lineage as L
from folioscope.plans import query
from folioscope.session import fanout, table

#: Event times dealt to five versions of each user's log.
VERSIONS = 5


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work (user), version (0 to 4 by event_id), key (event_type), text_hash: the last value of the key in the version."""
    e = table(spark, sf_dir, "events").withColumn("version", (F.col("event_id") % VERSIONS).cast("int"))
    last = e.groupBy(F.col("user_id").alias("work"), "version", F.col("event_type").alias("key")).agg(F.max_by(F.floor("value"), "event_id").cast("long").alias("v"))
    return last.withColumn("text_hash", (F.col("v") % 4).cast("string")).drop("v")


STATES = """states AS (SELECT user_id AS work, (event_id % 5)::INT AS version, event_type AS key, (arg_max(floor(value), event_id)::BIGINT % 4)::VARCHAR AS text_hash FROM events GROUP BY ALL)"""


@query(f"WITH {STATES} SELECT * FROM states")
def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir)


@query(f"""WITH {STATES}, o AS (SELECT * FROM states WHERE version = 0), n AS (SELECT * FROM states WHERE version = 1)
SELECT coalesce(n.work, o.work) AS work, coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'inserted' WHEN n.key IS NULL THEN 'repealed' WHEN o.text_hash = n.text_hash THEN 'unchanged' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.work = n.work AND o.key = n.key""")
def version_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    side = lambda v: s.where(F.col("version") == v).select("work", "key", F.col("text_hash").alias("text"), F.lit(0).alias("idx"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("notes"))
    return L.compare(side(0), side(1), ["work", "key"]).select("work", "key", "change")


TIMELINE = f"""{STATES}, v AS (SELECT DISTINCT work, version FROM states), p AS (SELECT work, version, lag(version) OVER (PARTITION BY work ORDER BY version) AS previous FROM v QUALIFY previous IS NOT NULL),
o AS (SELECT p.work, p.version, key, text_hash FROM states JOIN p ON states.work = p.work AND states.version = p.previous),
n AS (SELECT p.work, p.version, key, text_hash FROM states JOIN p ON states.work = p.work AND states.version = p.version)"""


@query(f"""WITH {TIMELINE} SELECT coalesce(n.work, o.work) AS work, coalesce(n.version, o.version) AS version, coalesce(n.key, o.key) AS key,
CASE WHEN o.key IS NULL THEN 'inserted' WHEN n.key IS NULL THEN 'repealed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.work = n.work AND o.version = n.version AND o.key = n.key
WHERE o.text_hash IS DISTINCT FROM n.text_hash""")
def timeline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every adjacent pair of every work's versions, compared in one join."""
    s = states(spark, sf_dir)
    provs = s.select("work", "version", F.lit("provision").alias("kind"), F.lit(None).cast("string").alias("schedule"), F.col("key").alias("number"), F.lit(0).alias("idx"), F.lit("").alias("heading"), F.col("text_hash").alias("text"), F.array().cast("array<string>").alias("notes"))
    return L.timeline(provs).select("work", "version", F.col("number").alias("key"), "change")


@query(f"""WITH {STATES}, grid AS (SELECT k.work, k.key, v.version, s.text_hash FROM (SELECT DISTINCT work, key FROM states) k JOIN (SELECT DISTINCT work, version FROM states) v USING (work) LEFT JOIN states s ON s.work = k.work AND s.key = k.key AND s.version = v.version),
m AS (SELECT *, CASE WHEN lag(text_hash) OVER w IS DISTINCT FROM text_hash OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM grid WINDOW w AS (PARTITION BY work, key ORDER BY version)),
g AS (SELECT *, sum(c) OVER (PARTITION BY work, key ORDER BY version) AS span FROM m),
r AS (SELECT work, key, span::BIGINT AS span, min(version) AS from_version, max(version) AS to_version, count(*) AS members, bool_and(text_hash IS NULL) AS absent, max(text_hash) AS text_hash FROM g GROUP BY work, key, span)
SELECT *, CASE WHEN lead(absent) OVER w IS NULL THEN NULL WHEN lead(absent) OVER w THEN 'repealed' WHEN absent THEN 'inserted' ELSE 'changed' END AS ended_by, lead(from_version) OVER w AS ended_in FROM r WINDOW w AS (PARTITION BY work, key ORDER BY span)""")
def provision_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.wordings(states(spark, sf_dir))


@query(f"""WITH {STATES}, grid AS (SELECT k.work, k.key, v.version, s.text_hash FROM (SELECT DISTINCT work, key FROM states) k JOIN (SELECT DISTINCT work, version FROM states) v USING (work) LEFT JOIN states s ON s.work = k.work AND s.key = k.key AND s.version = v.version),
m AS (SELECT *, lag(text_hash) OVER w AS was, row_number() OVER w AS n FROM grid WINDOW w AS (PARTITION BY work, key ORDER BY version)),
c AS (SELECT *, CASE WHEN n = 1 OR (was IS DISTINCT FROM text_hash AND (was IS NULL OR text_hash IS NULL OR version % 2 = 0)) THEN 1 ELSE 0 END AS c FROM m),
g AS (SELECT *, sum(c) OVER (PARTITION BY work, key ORDER BY version) AS span FROM c)
SELECT work, key, span::BIGINT AS span, min(version) AS from_version, max(version) AS to_version, arg_max(text_hash, version) AS text_hash FROM g GROUP BY work, key, span""")
def confirmed_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only confirmed changes (here: those into even versions) end a wording."""
    s = states(spark, sf_dir)
    return L.wordings(s, s.where("version % 2 = 0").select("work", "version", "key")).select("work", "key", "span", "from_version", "to_version", "text_hash")


@query(f"""WITH {STATES}, m AS (SELECT *, dense_rank() OVER (PARTITION BY work ORDER BY version) AS place FROM states),
c AS (SELECT *, CASE WHEN coalesce(lag(place) OVER w + 1 <> place, true) OR lag(text_hash) OVER w IS DISTINCT FROM text_hash THEN 1 ELSE 0 END AS c FROM m WINDOW w AS (PARTITION BY work, key ORDER BY version)),
g AS (SELECT *, sum(c) OVER (PARTITION BY work, key ORDER BY version) AS run, (work + version) % 3 = 0 AS rev FROM c),
f AS (SELECT *, first_value(CASE WHEN rev THEN version END IGNORE NULLS) OVER (PARTITION BY work, key, run ORDER BY version ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS newer,
last_value(CASE WHEN rev THEN version END IGNORE NULLS) OVER (PARTITION BY work, key, run ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS older, lead(version) OVER (PARTITION BY work, key, run ORDER BY version) AS nxt FROM g)
SELECT work, key, version, CASE WHEN rev THEN 'reviewed' WHEN coalesce(newer, older) IS NOT NULL THEN 'inherits' WHEN nxt IS NOT NULL THEN 'follows' ELSE 'to_review' END AS status,
CASE WHEN rev THEN version ELSE coalesce(newer, older, nxt) END AS source FROM f""")
def nearest_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    return L.review_status(s, s.where("(work + version) % 3 = 0").select("work", "key", "version"))


_REVIEWED = """WITH @STATES@, m AS (SELECT *, dense_rank() OVER (PARTITION BY work ORDER BY version) AS place FROM states),
c AS (SELECT *, CASE WHEN coalesce(lag(place) OVER w + 1 <> place, true) OR lag(text_hash) OVER w IS DISTINCT FROM text_hash THEN 1 ELSE 0 END AS c FROM m WINDOW w AS (PARTITION BY work, key ORDER BY version)),
g AS (SELECT *, sum(c) OVER (PARTITION BY work, key ORDER BY version) AS run, (work + version) % 3 = 0 AS rev FROM c),
f AS (SELECT *, first_value(CASE WHEN rev THEN version END IGNORE NULLS) OVER (PARTITION BY work, key, run ORDER BY version ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS newer,
last_value(CASE WHEN rev THEN version END IGNORE NULLS) OVER (PARTITION BY work, key, run ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS older, lead(version) OVER (PARTITION BY work, key, run ORDER BY version) AS nxt FROM g)
SELECT work, key, version, CASE WHEN rev THEN 'reviewed' WHEN coalesce(newer, older) IS NOT NULL THEN 'inherits' WHEN nxt IS NOT NULL THEN 'follows' ELSE 'to_review' END AS status,
CASE WHEN rev THEN version ELSE coalesce(newer, older, nxt) END AS source FROM f""".replace("@STATES@", STATES)
#: Pieces of a unit: what happened in the version to the work, letter by letter of the unit's key.
PIECES = """pieces AS (SELECT DISTINCT user_id AS work, (event_id % 5)::INT AS version, event_type AS key, (event_id % 3)::VARCHAR AS piece FROM events)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("work"), (F.col("event_id") % 5).cast("int").alias("version"), F.col("event_type").alias("key"), (F.col("event_id") % 3).cast("string").alias("piece")).distinct()


@query(f"""WITH s AS ({_REVIEWED}), {PIECES}, m AS (SELECT work, version, key, array_to_string(list_sort(list(piece)), ',') AS p FROM pieces GROUP BY ALL)
SELECT s.work, s.key, s.version, CASE WHEN r THEN 'to_review' ELSE s.status END AS status, CASE WHEN NOT r THEN s.source END AS source FROM (
SELECT s.*, s.status = 'inherits' AND (a.p IS DISTINCT FROM b.p OR s.work % 7 = 0) AS r FROM s LEFT JOIN m a ON a.work = s.work AND a.version = s.version AND a.key = s.key LEFT JOIN m b ON b.work = s.work AND b.version = s.source AND b.key = s.key) s""")
def inheritance_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews are lent between units of the same pieces alone; every seventh work's units are edited."""
    s, p = nearest_reviewed(spark, sf_dir), pieces(spark, sf_dir)
    return H.guarded(s, p, p.where("work % 7 = 0").select("work", "version", "key"))


@query(f"""WITH {PIECES} SELECT work, version, key, count(*) AS pieces, count(*) FILTER (WHERE (work + version) % 3 = 0 OR piece = '0') AS covered,
count(*) FILTER (WHERE (work + version) % 3 = 0 OR piece = '0') > 0 AND (bool_and((work + version) % 3 = 0 OR piece = '0') OR version = 1) AS reviewed, bool_or(piece = '2' AND work % 2 = 0) AS blocked FROM pieces GROUP BY work, version, key""")
def unit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pieces(spark, sf_dir)
    return H.unit_coverage(p, p.where("(work + version) % 3 = 0 OR piece = '0'"), p.where("version = 1"), p.where("piece = '2' AND work % 2 = 0"))


@query(f"WITH {STATES} SELECT work, max(version) AS version FROM states GROUP BY work")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current_versions(states(spark, sf_dir))


@query(f"WITH {STATES}, c AS (SELECT work, version, count(*) AS n FROM states GROUP BY work, version) SELECT work, version FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY n DESC, version DESC) AS k FROM c) WHERE k = 1")
def base_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.base_versions(states(spark, sf_dir).groupBy("work", "version").agg(F.count("*").alias("rows")))


@query(f"WITH {STATES}, v AS (SELECT DISTINCT work, version FROM states) SELECT work, version, coalesce(lead(version) OVER w, lag(version) OVER w) AS reference, version < max(version) OVER (PARTITION BY work) AS superseded FROM v WINDOW w AS (PARTITION BY work ORDER BY version)")
def reference_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = states(spark, sf_dir).select("work", "version").distinct()
    return L.superseded(L.reference_versions(v))


@query(f"""WITH {STATES}, v AS (SELECT DISTINCT work, version FROM states)
SELECT v.work, v.version, s.key, max(s.version) AS last_version FROM v JOIN states s ON s.work = v.work AND s.version < v.version
WHERE NOT EXISTS (SELECT 1 FROM states x WHERE x.work = v.work AND x.version = v.version AND x.key = s.key) GROUP BY v.work, v.version, s.key""")
def ghost_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ghosts(states(spark, sf_dir))


@query(f"""WITH RECURSIVE {STATES}, links(version, new_key, old_key) AS (VALUES (2, 'click', 'view'), (3, 'view', 'error')),
had AS (SELECT work, version, key FROM states WHERE NOT (work % 2 = 0 AND version = 1)),
ordered AS (SELECT *, dense_rank() OVER (PARTITION BY work ORDER BY version) AS n FROM had),
walk AS (SELECT work, version, key, n, key || '@' || version AS chain_key FROM ordered WHERE n = 1
UNION ALL SELECT s.work, s.version, s.key, s.n, coalesce(w.chain_key, s.key || '@' || s.version) FROM ordered s JOIN (SELECT DISTINCT n FROM walk) p ON s.n = p.n + 1
LEFT JOIN links l ON l.version = s.version AND l.new_key = s.key LEFT JOIN walk w ON w.work = s.work AND w.n = s.n - 1 AND w.key = coalesce(l.old_key, s.key))
SELECT work, version, key, chain_key FROM walk""")
def provision_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys followed through renames; every other work has no version 1, so its chains go from 0 to 2."""
    s = states(spark, sf_dir).where("NOT (work % 2 = 0 AND version = 1)")
    works = s.select("work").distinct()
    renames = spark.createDataFrame([(2, "click", "view"), (3, "view", "error")], "version int, new_key string, old_key string")
    return L.chains(s.select("work", "version", "key"), works.crossJoin(F.broadcast(renames)))  # two renames a work


@query(f"""WITH {STATES}, a AS (SELECT work, list(DISTINCT key || text_hash ORDER BY key || text_hash) AS k FROM states WHERE version = 0 GROUP BY work), b AS (SELECT work, list(DISTINCT key || text_hash ORDER BY key || text_hash) AS k FROM states WHERE version = 1 GROUP BY work)
SELECT b.work, len(list_filter(b.k, lambda x: NOT list_contains(coalesce(a.k, []), x)))::INT AS new_notes FROM b LEFT JOIN a USING (work)""")
def new_notes_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    notes = lambda v, n: s.where(F.col("version") == v).groupBy("work").agg(F.collect_set(F.concat("key", "text_hash")).alias(n))
    j = notes(1, "new").join(notes(0, "old"), "work", "left")
    return j.select("work", F.size(F.array_except("new", F.coalesce("old", F.array().cast("array<string>")))).alias("new_notes"))


@query(f"""WITH {STATES} SELECT n.work, n.key, n.text_hash FROM states n WHERE version = 1 AND NOT EXISTS (SELECT 1 FROM states o WHERE o.version = 0 AND o.work = n.work AND o.key = n.key AND o.text_hash = n.text_hash)""")
def changed_targets_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir).select("work", "key", "text_hash", "version")
    return s.where("version = 1").drop("version").join(s.where("version = 0").drop("version"), ["work", "key", "text_hash"], "left_anti")


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path names of pages: the source, a number, and for every third document a level below another's."""
    d = table(spark, sf_dir, "documents")
    parent = F.concat("source", F.lit("/s"), F.floor(F.col("doc_id") / 3).cast("string"))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, parent).otherwise(F.concat(parent, F.lit("/p"), (F.col("doc_id") % 3).cast("string"))).alias("name"))


PATHS = """paths AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '/s' || (doc_id // 3) ELSE source || '/s' || (doc_id // 3) || '/p' || (doc_id % 3) END AS name FROM documents)"""


@query(f"WITH {PATHS}, d AS (SELECT DISTINCT name FROM paths) SELECT name FROM d WHERE NOT EXISTS (SELECT 1 FROM d m WHERE m.name <> d.name AND starts_with(d.name, m.name || '/'))")
def outermost_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.outermost(path_names(spark, sf_dir).select("name"))


@query(f"WITH {PATHS}, d AS (SELECT DISTINCT name FROM paths) SELECT name, count(*) AS pieces FROM (SELECT d.name FROM d JOIN paths p ON p.name = d.name OR starts_with(p.name, d.name || '/')) GROUP BY name")
def subtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces at or below each name: an equi-join on ancestors, not a prefix scan."""
    from folioscope.functions.text import ancestors

    p = path_names(spark, sf_dir)
    up = p.select("doc_id", F.explode(ancestors(F.col("name"))).alias("name"))
    return up.join(p.select("name").distinct(), "name").groupBy("name").agg(F.count("*").alias("pieces"))


def consecutive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, old): each document with the text of the one before it in its source. Neighbours are found on
    ids alone; texts join after, dealt to all cores: what is done with a pair costs far more than its bytes say."""
    from folioscope.operators.sequence import with_previous

    d = table(spark, sf_dir, "documents")
    ids = with_previous(d.select("source", "doc_id"), "source", "doc_id").where("previous IS NOT NULL").select("doc_id", "previous")
    old = d.select(F.col("doc_id").alias("previous"), F.col("text").alias("old")).repartition(fanout(d), "previous")
    return ids.join(d.select("doc_id", "text"), "doc_id").join(old, "previous").select("doc_id", "text", "old")


@query(None)
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it in its source, whole texts: segments of the difference, counted by kind."""
    pairs = consecutive_texts(spark, sf_dir)
    diff = pairs.withColumn("diff", D.word_diff(F.col("old"), F.col("text")))
    count = lambda op: F.size(F.filter("diff", lambda s: s["op"] == op))
    return diff.select("doc_id", *(count(op).alias(op) for op in ("equal", "delete", "insert")), D.is_reordering(F.col("diff")).alias("reordered"))


@query(f"""WITH {PATHS}, v AS (SELECT name, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS text FROM paths WHERE doc_id % 7 <> 0), n AS (SELECT name, 'old' AS text FROM paths WHERE doc_id % 11 <> 0)
SELECT coalesce(v.name, n.name) AS name, CASE WHEN n.name IS NULL THEN 'inserted' WHEN v.name IS NULL THEN 'removed' ELSE 'words' END AS change FROM v FULL JOIN n ON v.name = n.name WHERE v.text IS DISTINCT FROM n.text""")
def delta_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = path_names(spark, sf_dir)
    version = p.where("doc_id % 7 <> 0").select("name", F.when(F.col("doc_id") % 5 == 0, "new").otherwise("old").alias("text"))
    return X.changed_names(version, p.where("doc_id % 11 <> 0").select("name", F.lit("old").alias("text")))


@query(f"WITH {PATHS} SELECT split_part(name, '/', 1) || '/' || split_part(name, '/', 2) AS doc, name, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS text, (row_number() OVER (PARTITION BY split_part(name, '/', 1) || '/' || split_part(name, '/', 2) ORDER BY doc_id) - 1)::INT AS idx FROM paths WHERE doc_id % 7 <> 0")
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions cut down against their neighbours and put together again are the versions."""
    p = path_names(spark, sf_dir).withColumn("doc", F.substring_index("name", "/", 2))
    version = p.where("doc_id % 7 <> 0").select("doc", "name", F.when(F.col("doc_id") % 5 == 0, "new").otherwise("old").alias("text"), F.col("doc_id").alias("idx"))
    neighbour = p.where("doc_id % 11 <> 0").select("doc", "name", F.lit("old").alias("text"), F.col("doc_id").alias("idx"))
    pieces, removed = X.slim(version, neighbour)
    return X.assemble(neighbour, pieces, removed)
