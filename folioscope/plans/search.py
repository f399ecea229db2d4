"""Search over `documents`: the first line is the heading, the rest the body; `lang` is the kind, `source` the work."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioscope.functions.text import body_of, heading_of, search_tokens, vocabulary_tokens
from folioscope.operators import search as S
from folioscope.plans import query
from folioscope.session import table, texts, work_path
from folioscope.sources import segments, writers

TERMS = ["the", "erst", "zu", "para", "and", "eranea"]
SQL_TERMS = ", ".join(f"('{t}')" for t in TERMS)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("node_id"), heading_of("text").alias("heading"), body_of(F.col("text")).alias("body"), "lang", "source", (F.col("source") != "src0").alias("is_current"))


def stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An index of the nodes, written and opened."""
    root = work_path(spark, "index")
    writers.build_index(nodes(spark, sf_dir), root, "one")
    return writers.open_index(spark, root)


NODES = """nodes AS (SELECT doc_id AS node_id, split_part(text, chr(10), 1) AS heading,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body,
    lang, source, source <> 'src0' AS is_current FROM documents)"""
TOKENS = f"""{NODES}, tok AS (SELECT *, regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}]+') AS ht,
    regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS bt FROM nodes)"""


def bm25_sql(terms: list[str], heading: float = 8.0, body: float = 1.0, asked: str | None = None) -> str:
    """CTEs down to `ranked` (node columns and rank). `asked`: a query that gives the terms, instead of `terms`."""
    values = asked or "VALUES " + ", ".join(f"('{t}')" for t in dict.fromkeys(terms))
    return f"""{TOKENS}, stats AS (SELECT count(*) AS n, avg(len(ht) + len(bt)) AS avgdl FROM tok),
    q(term) AS ({values}),
    tf AS (SELECT node_id, term, len(list_filter(ht, lambda x: x = term)) AS h, len(list_filter(bt, lambda x: x = term)) AS b, len(ht) + len(bt) AS dl FROM tok, q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE h + b > 0 GROUP BY term),
    parts AS (SELECT node_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
        * ({heading} * h + {body} * b) * 2.2 / (({heading} * h + {body} * b) + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part
        FROM tf JOIN df USING (term), stats WHERE h + b > 0),
    ranked AS (SELECT nodes.*, -s AS rank FROM nodes JOIN (SELECT node_id, sum(part) AS s FROM parts GROUP BY node_id) USING (node_id))"""


@query(r"""SELECT w AS term, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS w FROM documents) GROUP BY w""")
def vocab_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary(nodes(spark, sf_dir))


@query(r"""SELECT w AS term, count(*) AS cnt, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY w""")
def vocab_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents").select("doc_id", F.explode(search_tokens(F.col("text"))).alias("term"))
    # Counts of (term, doc) first: the distinct count needs no second shuffle of all words.
    per = d.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("cnt"), F.count("*").alias("docs"))


@query(f"""WITH {bm25_sql(TERMS)} SELECT node_id, round(rank, 6) AS rank FROM ranked ORDER BY round(ranked.rank, 6), node_id LIMIT 20""")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(nodes(spark, sf_dir), TERMS).orderBy(F.round("rank", 6), "node_id").limit(20).select("node_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {bm25_sql(["erst", "para"], 1.0, 1.0)} SELECT node_id, round(rank, 6) AS rank FROM ranked""")
def bm25_unweighted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(nodes(spark, sf_dir), ["erst", "para"], 1.0, 1.0).select("node_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {bm25_sql(TERMS)} SELECT node_id, round(rank, 6) AS rank FROM ranked WHERE is_current AND lang <> 'de' ORDER BY round(ranked.rank, 6), node_id LIMIT 50""")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope filters results; statistics stay those of the whole index."""
    hits = S.bm25(nodes(spark, sf_dir), TERMS).where(S.Scope().condition(F.when(F.col("lang") == "de", "bill").otherwise("act"), F.col("is_current")))
    return hits.orderBy(F.round("rank", 6), "node_id").limit(50).select("node_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {bm25_sql(TERMS)} SELECT node_id, round(rank, 6) AS rank FROM ranked""")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks from a stored index."""
    return S.bm25_stored(stored(spark, sf_dir), TERMS).select("node_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {TOKENS}, both_ AS (SELECT node_id, unnest(ht) AS term, 1 AS h FROM tok UNION ALL SELECT node_id, unnest(bt), 0 FROM tok)
SELECT term, node_id, sum(h)::BIGINT AS tf_heading, sum(1 - h)::BIGINT AS tf_body FROM both_ GROUP BY term, node_id""")
def posting_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(nodes(spark, sf_dir))


@query(f"""WITH {TOKENS} SELECT count(*) AS n_nodes, round(avg(len(ht) + len(bt)), 6) AS avgdl FROM tok""")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_stats(nodes(spark, sf_dir)).select("n_nodes", F.round("avgdl", 6).alias("avgdl"))


@query(f"""WITH {bm25_sql(TERMS)} SELECT count(*) AS matches, count(*) FILTER (WHERE is_current) AS matches_current FROM ranked""")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = nodes(spark, sf_dir), S.Query("", terms=TERMS)
    return spark.createDataFrame([(S.match_count(n, q), S.match_count(n, q, F.col("is_current")))], "matches long, matches_current long")


SPELL_SQL = r"""WITH vocab AS (SELECT w AS term, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS w FROM documents) GROUP BY w),
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM benchmark),
unknown AS (SELECT word, CASE WHEN length(word) < 7 THEN 1 ELSE 2 END AS lim FROM words WHERE length(word) >= 4 AND word NOT IN (SELECT term FROM vocab)),
near AS (SELECT word, term, cnt, levenshtein(LETTERS(word), LETTERS(term)) AS distance FROM unknown JOIN vocab ON substr(word, 1, 1) = substr(term, 1, 1) AND abs(length(word) - length(term)) <= lim AND levenshtein(LETTERS(word), LETTERS(term)) <= lim)
SELECT word, term AS fixed, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, cnt DESC, term) AS n FROM near) WHERE n = 1"""


#: The other engine counts edits in bytes, so letters of two bytes become (otherwise absent) capitals first.
LETTERS = re.compile(r"LETTERS\((\w+)\)")


@query(LETTERS.sub(r"translate(\1, 'äöüßéèêçñíóáúàùâîôûëïœ', 'ABCDEFGHIJKLMNOPQRSTUV')", SPELL_SQL))
def spell_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(vocabulary_tokens(F.col("text"))).alias("word"))
    return S.corrections(words, S.vocabulary(nodes(spark, sf_dir)))


def _typed(raw: str, **more) -> S.Query:
    q = S.analyse(raw)
    return S.Query(**(q.__dict__ | more))


@query(f"""WITH {bm25_sql(["who", "the", "erst"])}, scored AS (SELECT node_id, -rank + CASE WHEN lower(heading) LIKE 'the %' AND list_has_any(regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}]+'), ['of', 'and']) THEN 20.0 ELSE 0.0 END AS score FROM ranked)
SELECT node_id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 6) DESC, node_id LIMIT 40""")
def heading_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that open with the question's word and share a word with its subject are lifted."""
    q = S.Query("", terms=["who", "the", "erst"], subject=["of", "and"], asks="the")
    hits = S.reranked(S.bm25(nodes(spark, sf_dir), q.terms), q)
    return hits.orderBy(F.desc(F.round("score", 6)), "node_id").limit(40).select("node_id", F.round("score", 6).alias("score"))


@query(f"""WITH {TOKENS} SELECT node_id, (lower(heading) LIKE 'meaning of%' OR lower(heading) LIKE 'definition of%' OR lower(heading) LIKE 'definitions of%') AND list_has_all(ht, ['of', 'the']) AS defines,
lower(heading) LIKE 'the %' AND list_has_any(ht, ['and', 'of']) AS answers FROM tok""")
def structural_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.Query("", subject=["of", "the"], asks="the")
    a = S.Query("", subject=["and", "of"], asks="the")
    return nodes(spark, sf_dir).select("node_id", S.defines(F.col("heading"), q).alias("defines"), S.answers(F.col("heading"), a).alias("answers"))


@query(f"""WITH {TOKENS}, t AS (SELECT node_id, ' ' || array_to_string(list_concat(ht, bt), ' ') || ' ' AS s FROM tok)
SELECT node_id FROM t WHERE (contains(s, ' of the ') AND NOT contains(s, ' erst ')) OR contains(s, ' zue')""")
def verbatim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    grammar = S.verbatim_grammar('"of the" NOT erst OR zue*')
    t = S.with_tokens(nodes(spark, sf_dir))
    return t.where(S.verbatim_condition(grammar, F.concat("heading_tokens", "body_tokens"))).select("node_id")


#: Its last word is mistyped: the index's words mend it.
QUESTION = "who can appeal erst and parra"
ASKED = LETTERS.sub(r"translate(\1, 'äöüßéèêçñíóáúàùâîôûëïœ', 'ABCDEFGHIJKLMNOPQRSTUV')", r"""words(word) AS (VALUES ('appeal'), ('erst'), ('parra')),
vocab AS (SELECT w AS term, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS w FROM documents) GROUP BY w),
unknown AS (SELECT word, CASE WHEN length(word) < 7 THEN 1 ELSE 2 END AS lim FROM words WHERE length(word) >= 4 AND word NOT IN (SELECT term FROM vocab)),
near AS (SELECT word, term, cnt, levenshtein(LETTERS(word), LETTERS(term)) AS distance FROM unknown JOIN vocab ON substr(word, 1, 1) = substr(term, 1, 1) AND abs(length(word) - length(term)) <= lim AND levenshtein(LETTERS(word), LETTERS(term)) <= lim),
mended AS (SELECT term FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, cnt DESC, term) AS n FROM near) WHERE n = 1)""")


@query(f"""WITH {ASKED}, {bm25_sql([], asked="SELECT word FROM words UNION SELECT term FROM mended")}, pool AS (SELECT * FROM ranked WHERE is_current ORDER BY ranked.rank, node_id LIMIT 300),
scored AS (SELECT node_id, -rank + CASE WHEN lower(heading) LIKE 'who %' AND list_has_any(regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}]+'), ['appeal', 'erst', 'parra']) THEN 20.0 ELSE 0.0 END AS score FROM pool)
SELECT node_id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, node_id))::INT AS place FROM scored ORDER BY scored.score DESC, node_id LIMIT 20""")
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed question over a stored index: analysis with the index's words, pool, heading rows, re-rank, page."""
    index = stored(spark, sf_dir)
    q = S.analyse(QUESTION, index["word"])
    return S.search(index["node"], q, F.col("is_current"), limit=20, index=index).select("node_id", F.round("score", 6).alias("score"), "place")


@query(None)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline for one question: analysis with the index's words, pool, heading rows, re-rank, vectors,
    fusion, page with snippets."""
    index = stored(spark, sf_dir)
    q = S.analyse("where does the erst annd para", index["word"], {"para": ["eranea"]})
    vectors = table(spark, sf_dir, "embeddings")
    probe = vectors.where("vec_id = 0").first()["embedding"]
    semantic = S.nearest(vectors, [float(x) for x in probe]).select(F.col("vec_id").alias("node_id"), "place")
    page = S.search(index["node"], q, F.col("is_current"), limit=20, semantic=semantic, index=index)
    return page.select("node_id", "place", F.round("score", 6).alias("score"), S.snippet(F.concat_ws(" ", "heading", "body"), q.terms).alias("snippet"))


KNN = """probe AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
scored AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, probe)"""


@query(f"""WITH {KNN} SELECT vec_id, round(s, 6) AS score, (row_number() OVER (ORDER BY s DESC, vec_id))::INT AS place FROM scored ORDER BY s DESC, vec_id LIMIT 40""")
def knn_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    probe = v.where("vec_id = 0").first()["embedding"]
    return S.nearest(v, [float(x) for x in probe]).select("vec_id", F.round("score", 6).alias("score"), "place")


@query(f"""WITH {bm25_sql(TERMS)}, {KNN.replace("scored AS", "near AS")},
lex AS (SELECT node_id, row_number() OVER (ORDER BY round(rank, 6), node_id) AS place FROM ranked QUALIFY place <= 100),
sem AS (SELECT vec_id AS node_id, row_number() OVER (ORDER BY s DESC, vec_id) AS place FROM near QUALIFY place <= 40)
SELECT node_id, round(coalesce(1.0 / (60 + lex.place), 0) + coalesce(1.0 / (60 + sem.place), 0), 6) AS rrf FROM lex FULL JOIN sem USING (node_id)""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.bm25(nodes(spark, sf_dir), TERMS).orderBy(F.round("rank", 6), "node_id").limit(100)
    lex = top.select("node_id", F.row_number().over(Window.orderBy(F.round("rank", 6), "node_id")).alias("place"))  # 100 rows
    v = table(spark, sf_dir, "embeddings")
    probe = v.where("vec_id = 0").first()["embedding"]
    sem = S.nearest(v, [float(x) for x in probe]).select(F.col("vec_id").alias("node_id"), "place")
    return S.fuse(lex, sem).select("node_id", F.round("rrf", 6).alias("rrf"))


MRR = f"""WITH {TOKENS}, stats AS (SELECT count(*) AS n, avg(len(ht) + len(bt)) AS avgdl FROM tok),
both_ AS (SELECT node_id, len(ht) + len(bt) AS dl, unnest(ht) AS term, 1 AS h FROM tok UNION ALL SELECT node_id, len(ht) + len(bt), unnest(bt), 0 FROM tok),
post AS (SELECT term, node_id, dl, sum(h) AS h, sum(1 - h) AS b FROM both_ GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qw AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
parts AS (SELECT item_id, node_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * (8.0 * h + b) * 2.2 / ((8.0 * h + b) + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM qw JOIN post USING (term) JOIN df USING (term), stats),
sums AS (SELECT item_id, node_id, -sum(part) AS rank FROM parts GROUP BY ALL),
ranked AS (SELECT item_id, node_id, row_number() OVER (PARTITION BY item_id ORDER BY round(rank, 6), node_id) AS place FROM sums),
expected AS (SELECT item_id, min(doc_id) AS node_id, item_id % 2 AS grp FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id),
r AS (SELECT grp, expected.item_id, min(ranked.place) AS place FROM expected LEFT JOIN ranked ON expected.item_id = ranked.item_id AND expected.node_id = ranked.node_id AND ranked.place <= 20 GROUP BY grp, expected.item_id)"""


@query(MRR + """ SELECT grp, count(*) AS queries, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr, count(*) FILTER (WHERE place <= 1) AS at_1, count(*) FILTER (WHERE place <= 5) AS at_5, count(*) FILTER (WHERE place IS NULL) AS missed FROM r GROUP BY grp""")
def mrr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a query of all its words against the stored index; the expected hit is the first
    document that holds the passage whole. Passages are found by a join on their first words."""
    index = stored(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    words = b.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("passage")))).alias("term"))
    opening = lambda c: F.array_join(F.slice(c, 1, 4), " ")
    starts = b.withColumn("opening", opening(search_tokens(F.col("passage"))))
    tokens = texts(spark, sf_dir, "documents").select("doc_id", search_tokens(F.col("text")).alias("t"))
    places = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 3, F.lit(1))), lambda i: F.array_join(F.slice("t", i, 4), " "))))
    may = tokens.select("doc_id", places.alias("opening")).join(starts.select("query_id", "opening"), "opening").select("doc_id", "query_id").distinct()
    held = may.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(b, "query_id").where(F.col("text").contains(F.col("passage")))
    expected = held.groupBy("query_id").agg(F.min("doc_id").alias("node_id")).withColumn("grp", F.col("query_id") % 2)
    return S.evaluation(S.ranks_of(S.rank_queries(index, words), expected), ["grp"])


@query(f"""WITH {bm25_sql(TERMS)} SELECT node_id, round(rank, 6) AS rank FROM ranked""")
def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of an index that came in two commits: every tenth node was other at first, and one node too many was
    there; only these were written again."""
    n, root = nodes(spark, sf_dir), work_path(spark, "segments")
    other = n.withColumn("body", F.when(F.col("node_id") % 10 == 3, F.lit("the old words")).otherwise(F.col("body")))
    extra = n.orderBy("node_id").limit(1).withColumn("node_id", F.col("node_id") - 1_000_000)
    segments.update(root, other.unionByName(extra))
    segments.update(root, n.where("node_id % 10 = 3"), extra.select("node_id"))
    return S.bm25_stored(segments.opened(spark, root), TERMS).select("node_id", F.round("rank", 6).alias("rank"))
