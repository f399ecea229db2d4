"""Full-text search: index tables, query analysis, weighted BM25, structural re-ranking, vectors, rank fusion, evaluation.

A node table for search has node_id, heading, body, and whatever columns scopes and results use. Statistics are those
of the whole index, never of a scope. Every ranking ends in node_id, so it is total.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import TRUTHY, search_tokens, vocabulary_tokens
from folioscope.session import materialize, ship

HEADING_WEIGHT, BODY_WEIGHT = 8.0, 1.0
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
POOL = 300
HEADING_POOL = 40
VECTOR_POOL = 40
RRF_K = 60
BOOSTS = {"defining": 25.0, "definition": 18.0, "answering": 20.0}

# Words of questions.
STOPWORDS = tuple(
    "a an and any are as at be by can do does for from how i if in is it may me must my of on or shall that the this to was what when where which who whom why with you your".split()
)
INTERROGATIVES = ("who", "when", "where", "how", "why", "what", "which")
DEFINITION_INTENT = ("definition of", "define", "meaning of", "what is", "what does", "what are")
INTENT_WORDS = ("definition", "define", "defined", "meaning", "means", "mean")
OPERATORS = ("AND", "OR", "NOT", "NEAR")
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Scope:
    """Which documents a search is over: kinds are excluded unless asked for, unknown kinds are let in."""

    explanatory: bool = False
    superseded: bool = False

    EXPLANATORY_KINDS = ("bill", "em")

    @classmethod
    def from_params(cls, params: dict) -> Scope:
        yes = lambda k: str(params.get(k, "")).strip().lower() in TRUTHY
        return cls(yes("explanatory"), yes("superseded"))

    def condition(self, kind: Column, is_current: Column) -> Column:
        keep = F.lit(True)
        if not self.superseded:
            keep &= F.coalesce(is_current, F.lit(False))
        if not self.explanatory:
            keep &= ~F.coalesce(kind.isin(*self.EXPLANATORY_KINDS), F.lit(False))
        return keep


@dataclass
class Query:
    raw: str
    words: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    subject: list[str] = field(default_factory=list)
    corrections: dict[str, str] = field(default_factory=dict)
    wants_definition: bool = False
    asks: str = ""
    verbatim: list | None = None


def looks_verbatim(raw: str) -> bool:
    return '"' in raw or "*" in raw or any(w in OPERATORS for w in raw.split())


def verbatim_grammar(raw: str) -> list:
    """A query in the index's own language as clauses ("phrase", words, prefix) joined by "AND", "OR" and "NOT"."""
    out: list = []
    for token in re.findall(r'"[^"]*"?|\S+', raw):
        joined = out and isinstance(out[-1], str)
        if token in OPERATORS:
            if out and not joined:
                out.append("AND" if token == "NEAR" else token)
            continue
        minus = token.startswith("-") and len(token) > 1
        words = WORD.findall(token.lower())
        if not words or (minus and not out):
            continue
        if out and not joined:
            out.append("NOT" if minus else "AND")
        out.append(("phrase", words, token.endswith("*") and not token.startswith('"')))
    while out and isinstance(out[-1], str):
        out.pop()
    return out


def verbatim_condition(grammar: list, tokens: Column) -> Column:
    """A grammar over a row's token array: NOT binds closest, then AND, then OR."""
    text = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    def clause(c) -> Column:
        _, words, prefix = c
        return text.contains(" " + " ".join(words) + ("" if prefix else " "))

    groups: list[Column] = []
    current: Column | None = None
    op = "AND"
    for c in grammar:
        if isinstance(c, str):
            op = c
            continue
        found = clause(c)
        if current is None:
            current = found
        elif op == "OR":
            groups.append(current)
            current = found
        else:
            current &= ~found if op == "NOT" else found
    if current is not None:
        groups.append(current)
    out = F.lit(False)
    for g in groups:
        out |= g
    return out


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(term, cnt): how often each word of the index occurs."""
    words = F.explode(F.concat(vocabulary_tokens(F.coalesce("heading", F.lit(""))), vocabulary_tokens(F.coalesce("body", F.lit("")))))
    return nodes.select(words.alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))


def corrections(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, fixed, distance) for the words the vocabulary lacks: the nearest term with the same first letter within
    one edit (two from seven letters on), the commoner on ties, then the lesser."""
    limit = F.when(F.length("word") < 7, 1).otherwise(2)
    unknown = words.select("word").distinct().where(F.length("word") >= 4).join(vocab.select(F.col("term").alias("word")), "word", "left_anti").withColumn("limit", limit)
    # An equi-join on first letter and length keeps the comparison to a few candidates a word.
    lengths = F.explode(F.sequence(F.length("word") - F.col("limit"), F.length("word") + F.col("limit")))
    near = unknown.withColumn("len", lengths).withColumn("first", F.substring("word", 1, 1))
    terms = vocab.select("term", "cnt", F.length("term").alias("len"), F.substring("term", 1, 1).alias("first"))
    pairs = near.join(terms, ["first", "len"]).withColumn("distance", F.levenshtein("word", "term", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("limit")))
    best = pairs.groupBy("word").agg(F.min(F.struct("distance", (-F.col("cnt")).alias("neg"), "term")).alias("b"))
    return best.select("word", F.col("b.term").alias("fixed"), F.col("b.distance").alias("distance"))


def analyse(raw: str, vocab: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None) -> Query:
    """What a query says and what it asks for. Corrections only ever add terms, and only for unknown words."""
    if looks_verbatim(raw or ""):
        return Query(raw, words=WORD.findall(raw.lower()), verbatim=verbatim_grammar(raw))
    typed = WORD.findall((raw or "").lower())
    if not typed:
        return Query(raw or "")
    words = [w for w in typed if w not in STOPWORDS] or typed
    fixed: dict[str, str] = {}
    if vocab is not None:
        asked = vocab.sparkSession.createDataFrame([(w,) for w in words], "word string")
        fixed = {r["word"]: r["fixed"] for r in corrections(asked, vocab).collect()}  # a row a query word
    wants = any(p in raw.lower() for p in DEFINITION_INTENT)
    terms = [t for w in words for t in (w, *((fixed[w],) if w in fixed else ()), *(synonyms or {}).get(w, ()))]
    terms += ["meaning", "means", "definition"] if wants else []
    return Query(raw, words, list(dict.fromkeys(terms)), [w for w in words if w not in INTENT_WORDS], fixed, wants, typed[0] if typed[0] in INTERROGATIVES else "")


def with_tokens(nodes: DataFrame) -> DataFrame:
    """Adds `heading_tokens` and `body_tokens`, cut once a row: a generator of one element keeps Catalyst from pushing
    what uses the tokens below their making, where every use would cut the text again."""
    cut = lambda c: search_tokens(F.coalesce(c, F.lit("")))
    both = F.explode_outer(F.array(F.struct(cut("heading").alias("h"), cut("body").alias("b"))))
    return nodes.select("*", both.alias("__tokens")).select(*nodes.columns, F.col("__tokens.h").alias("heading_tokens"), F.col("__tokens.b").alias("body_tokens"))


def postings(nodes: DataFrame) -> DataFrame:
    """(term, node_id, tf_heading, tf_body): the inverted index."""
    t = with_tokens(nodes)
    side = lambda c, h: t.select("node_id", F.explode(c).alias("term"), F.lit(h).alias("h"))
    both = side("heading_tokens", 1).unionByName(side("body_tokens", 0))
    return both.groupBy("term", "node_id").agg(F.sum("h").alias("tf_heading"), F.sum(1 - F.col("h")).alias("tf_body"))


def index_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes and their mean number of tokens."""
    t = with_tokens(nodes)
    return t.agg(F.count("*").alias("n_nodes"), F.avg(F.size("heading_tokens") + F.size("body_tokens")).alias("avgdl"))


def bm25(nodes: DataFrame, terms: list[str], heading: float = HEADING_WEIGHT, body: float = BODY_WEIGHT) -> DataFrame:
    """The nodes with any of `terms`, and their rank (smaller is better).

    One scan gathers every statistic the formula needs, and a second scores: term frequencies are counted inside each
    row, so nothing is exploded or shuffled but one row of sums."""
    own = dict.fromkeys(terms)
    t = with_tokens(nodes)
    tf = lambda c, w: F.size(F.filter(c, lambda x: x == F.lit(w)))
    counted = t.withColumns({f"__h{i}": tf("heading_tokens", w) for i, w in enumerate(own)} | {f"__b{i}": tf("body_tokens", w) for i, w in enumerate(own)} | {"__dl": F.size("heading_tokens") + F.size("body_tokens")})
    stats = counted.agg(F.count("*").alias("n"), F.avg("__dl").alias("avgdl"), *(F.count_if((F.col(f"__h{i}") + F.col(f"__b{i}")) > 0).alias(f"df{i}") for i in range(len(own)))).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    any_ = F.lit(False)
    for i in range(len(own)):
        df = stats[f"df{i}"]
        idf = math.log((n - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else LEAST_IDF
        f = F.col(f"__h{i}") * heading + F.col(f"__b{i}") * body
        score += F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / avgdl))
        any_ |= (F.col(f"__h{i}") + F.col(f"__b{i}")) > 0
    return counted.where(any_).withColumn("rank", -score).drop("heading_tokens", "body_tokens", "__dl", *(f"__{s}{i}" for s in "hb" for i in range(len(own))))


def bm25_from_postings(posting: DataFrame, lengths: DataFrame, terms: list[str], heading: float = HEADING_WEIGHT, body: float = BODY_WEIGHT) -> DataFrame:
    """(node_id, rank) from a stored index: `lengths` has node_id and dl. Only the query's terms are read."""
    spark = posting.sparkSession
    asked = F.broadcast(spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string"))  # the query's words
    hits = posting.join(asked, "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    scored = hits.join(F.broadcast(df), "term").join(lengths, "node_id").crossJoin(F.broadcast(stats))  # both sides a row a term, or one row
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    f = F.col("tf_heading") * heading + F.col("tf_body") * body
    part = F.when(raw > 0, raw).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("node_id").agg((-F.sum(part)).alias("rank"))


_COUNTED = "dl int, runs array<struct<term:string,h:int,b:int>>"


def _runs(batches):
    """Rows (node_id, h, b; arrays of tokens) with their distinct tokens and how often each is in h and in b."""
    for batch in batches:
        h, b = batch.column("h"), batch.column("b")
        sizes = [np.asarray(pc.list_value_length(x)).astype(np.int64) for x in (h, b)]
        words = pa.concat_arrays([h.flatten(), b.flatten()]).dictionary_encode()
        rows = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        most = max(1, len(words.dictionary))
        keys, at = np.unique(rows * most + np.asarray(words.indices), return_inverse=True)
        cut = int(sizes[0].sum())
        counts = [np.bincount(x, minlength=len(keys)).astype(np.int32) for x in (at[:cut], at[cut:])]
        ends = np.searchsorted(keys, np.arange(len(h) + 1) * most).astype(np.int32)
        runs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(keys % most)), *map(pa.array, counts)], names=["term", "h", "b"])
        yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array((sizes[0] + sizes[1]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), runs)], names=["node_id", "dl", "runs"])


def counted(nodes: DataFrame) -> DataFrame:
    """(node_id, dl, runs): each node's number of tokens, and its terms with their counts in the heading (h) and the body
    (b). A row's words are counted inside the row."""
    ship(nodes.sparkSession)
    t = with_tokens(nodes).select("node_id", F.col("heading_tokens").alias("h"), F.col("body_tokens").alias("b"))
    return t.mapInArrow(_runs, f"node_id {nodes.schema['node_id'].dataType.simpleString()}, {_COUNTED}")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "node_id", "dl").agg(F.sum("h").alias("tf_heading"), F.sum("b").alias("tf_body"))


def index_postings(nodes: DataFrame) -> DataFrame:
    """Postings as an index stores them: with each node's number of tokens, so that a query joins nothing."""
    return _summed(counted(nodes).select("node_id", "dl", F.inline("runs")))


def sorted_postings(counts: DataFrame) -> DataFrame:
    """The postings of counted nodes by term and node. Their rows move once: only where an id stands twice are rows of a
    term and a node, which lie in one range, added up."""
    rows = counts.select("node_id", "dl", F.inline("runs")).repartitionByRange("term", "node_id")
    twice = not counts.groupBy("node_id").count().where("count > 1").isEmpty()
    sums = _summed(rows) if twice else rows.select("term", "node_id", "dl", F.col("h").cast("long").alias("tf_heading"), F.col("b").cast("long").alias("tf_body"))
    return sums.sortWithinPartitions("term", "node_id")


def counted_stats(counts: DataFrame) -> DataFrame:
    """The row of `index_stats`, from counted nodes."""
    return counts.agg(F.count("*").alias("n_nodes"), F.avg("dl").alias("avgdl"))


def counted_vocabulary(counts: DataFrame) -> DataFrame:
    """The rows of `vocabulary`, from counted nodes: a word is a run of letters inside one term, so it is cut from each
    distinct term once."""
    terms = counts.select(F.inline("runs")).groupBy("term").agg(F.sum(F.col("h") + F.col("b")).alias("n"))
    return terms.select(F.explode(vocabulary_tokens(F.col("term"))).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("cnt"))


def _part(heading: float, body: float) -> Column:
    """What a posting (df, n, avgdl, dl, tf_heading, tf_body) adds to its node's score."""
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    f = F.col("tf_heading") * heading + F.col("tf_body") * body
    return F.when(raw > 0, raw).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _scored(hits: DataFrame, by: list[str], heading: float, body: float) -> DataFrame:
    """Ranks of `hits` (see `_part`; and the columns `by`)."""
    return hits.groupBy(*by).agg((-F.sum(_part(heading, body))).alias("rank"))


def bm25_stored(index: dict[str, DataFrame], terms: list[str], heading: float = HEADING_WEIGHT, body: float = BODY_WEIGHT) -> DataFrame:
    """(node_id, rank) from a stored index: only the row groups of the query's terms are read."""
    own = list(dict.fromkeys(terms))
    hits = index["posting"].where(F.col("term").isin(own))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    known = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(index["statistics"]))  # a row a term of the query, and one row
    return _scored(known, ["node_id"], heading, body)


#: Pairs of a query and one of its words up to which queries go to the tasks whole, and sums that a task holds at once.
PAIRS, SUMS = 1 << 20, 1 << 21


def _best(pairs: list, top: int):
    """Candidates for the best `top` nodes of each query, from rows (node_id, parts: a word's number and what it adds):
    a range of nodes at a time, all that come within rounding of the range's best. Pairs: query_id, word's number."""
    ids = sorted({q for q, _ in pairs})
    place = {q: i for i, q in enumerate(ids)}
    numbers, queries = (np.array(x, dtype=np.int64) for x in zip(*sorted((no, place[q]) for q, no in pairs)))
    first = np.searchsorted(numbers, np.arange(numbers[-1] + 2))
    step = max(1, SUMS // len(ids))

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, len(whole), step)):
                parts, n = batch.column("parts"), len(batch)
                nodes = np.repeat(np.arange(n), np.asarray(pc.list_value_length(parts)))
                no, part = (np.asarray(x) for x in parts.flatten().flatten())
                each = first[no + 1] - first[no]
                asked = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[no], each)
                sums = np.bincount(queries[asked] * n + np.repeat(nodes, each), np.repeat(part, each), len(ids) * n).reshape(len(ids), n)
                least = np.partition(sums, n - top, axis=1)[:, n - top] if n > top else np.zeros(len(ids))
                q, at = np.nonzero((sums > 0) & (sums >= least[:, None] - 2e-6))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], pa.int64()), batch.column("node_id").take(pa.array(at)), pa.array(-sums[q, at])], names=["query_id", "node_id", "rank"])

    return run


def rank_queries(index: dict[str, DataFrame], queries: DataFrame, top: int = 20, heading: float = HEADING_WEIGHT, body: float = BODY_WEIGHT) -> DataFrame:
    """(query_id, node_id, rank, place) of the best `top` nodes of many queries (query_id, term) at once.

    Postings of the queries' words are put together by node once, and not once a query; beyond PAIRS pairs of a query and
    a word, a row is made for each query and node."""
    ship(queries.sparkSession)
    asked = queries.select("query_id", "term").where("query_id IS NOT NULL AND term IS NOT NULL").distinct()
    kind = asked.schema["query_id"].dataType
    pairs = asked.limit(PAIRS + 1).collect() if kind.typeName() in ("integer", "long") else []  # at most PAIRS and one
    df = index["posting"].join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    if 0 < len(pairs) <= PAIRS:
        numbers = {t: i for i, t in enumerate(sorted({r["term"] for r in pairs}))}
        known = df.join(queries.sparkSession.createDataFrame(list(numbers.items()), "term string, no int"), "term")
        hits = index["posting"].join(F.broadcast(known), "term").crossJoin(F.broadcast(index["statistics"]))  # the queries' words, and one row
        by_node = hits.groupBy("node_id").agg(F.collect_list(F.struct("no", _part(heading, body).alias("part"))).alias("parts"))
        found = by_node.mapInArrow(_best([(r["query_id"], numbers[r["term"]]) for r in pairs], top), f"query_id long, node_id {by_node.schema['node_id'].dataType.simpleString()}, rank double")
        ranked = found.withColumn("query_id", F.col("query_id").cast(kind))
    else:
        ranked = _scored(index["posting"].join(df, "term").join(asked, "term").crossJoin(F.broadcast(index["statistics"])), ["query_id", "node_id"], heading, body)  # one row
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("rank", 6), "node_id"))
    return ranked.withColumn("place", place).where(F.col("place") <= top)


def fetch(nodes: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of `nodes` for a page of at most a few hundred ids, by a filter that reaches the scan."""
    some = ids.select("node_id", *columns).collect()  # a pool, a few hundred rows
    spark = nodes.sparkSession
    found = spark.createDataFrame(some, ids.select("node_id", *columns).schema)
    return nodes.where(F.col("node_id").isin([r["node_id"] for r in some])).join(F.broadcast(found), "node_id")


def answers(heading: Column, query: Query) -> Column:
    """The heading opens with the question's own word and shares a word with its subject."""
    if not query.asks or not query.subject:
        return F.lit(False)
    low = F.lower(F.coalesce(heading, F.lit("")))
    return low.startswith(query.asks + " ") & F.arrays_overlap(search_tokens(low), F.array(*map(F.lit, query.subject)))


def defines(heading: Column, query: Query) -> Column:
    """The heading is "Meaning of ..." or "Definition of ..." and has every word of the subject."""
    if not query.subject:
        return F.lit(False)
    low = F.lower(F.coalesce(heading, F.lit("")))
    lead = low.startswith("meaning of") | low.startswith("definition of") | low.startswith("definitions of")
    return lead & (F.size(F.array_except(F.array(*map(F.lit, query.subject)), search_tokens(low))) == 0)


def reranked(rows: DataFrame, query: Query) -> DataFrame:
    """`score` (larger is better): BM25, lifted where the structure answers the query; nothing is ever pushed down."""
    score = -F.col("rank")
    if query.wants_definition or query.asks:
        defining = defines(F.col("heading"), query) if query.wants_definition else F.lit(False)
        node = F.lit(False)
        if query.wants_definition and query.subject and "ntype" in rows.columns:
            node = (F.col("ntype") == "definition") & (F.size(F.array_except(F.array(*map(F.lit, query.subject)), search_tokens(F.coalesce("heading", F.lit(""))))) == 0)
        score += F.when(defining, BOOSTS["defining"]).when(node, BOOSTS["definition"]).when(answers(F.col("heading"), query), BOOSTS["answering"]).otherwise(0.0)
    return rows.withColumn("score", score)


def heading_rows(nodes: DataFrame, query: Query, top: int = HEADING_POOL, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Nodes whose heading has the question's word and one of its subject, by their own BM25."""
    if not query.asks or not query.subject:
        return nodes.where("false").withColumn("rank", F.lit(0.0))
    if index is not None:
        asked = F.col("term") == query.asks
        in_heading = index["posting"].where(F.col("term").isin([query.asks, *query.subject]) & (F.col("tf_heading") > 0))
        both = in_heading.groupBy("node_id").agg(F.bool_or(asked).alias("a"), F.bool_or(F.col("term").isin(query.subject)).alias("s")).where("a AND s")
        best = bm25_stored(index, [query.asks, *query.subject]).join(both.select("node_id"), "node_id", "left_semi").orderBy("rank", "node_id").limit(top)
        return fetch(nodes, best, ["rank"])
    ranked = bm25(nodes, [query.asks, *query.subject])
    h = search_tokens(F.coalesce("heading", F.lit("")))
    both = F.array_contains(h, query.asks) & F.arrays_overlap(h, F.array(*map(F.lit, query.subject)))
    return ranked.where(both).orderBy("rank", "node_id").limit(top)


def search(nodes: DataFrame, query: Query, scope: Column | None = None, limit: int = 20, offset: int = 0, semantic: DataFrame | None = None, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """The ranked page of a query: node columns with score and place (from 1).

    With a stored `index`, whose nodes `nodes` are, a query reads the postings of its own terms, the columns that the
    scope and order need, and the texts of its pool; without, it counts terms in two scans of all texts.

    A pool of the best lexical rows, current ones first on ties; below it the rows whose heading answers the question;
    the structural re-rank; fusion with `semantic` (node_id, place) where given. Verbatim queries filter by their
    grammar and are neither re-ranked nor fused."""
    keep = scope if scope is not None else F.lit(True)
    terms = query.terms if query.verbatim is None else [w for c in query.verbatim if not isinstance(c, str) for w in c[1]]
    if not terms:
        return nodes.where("false").withColumns({"score": F.lit(0.0), "place": F.lit(0)})
    hits = (bm25(nodes, terms) if index is None else nodes.join(bm25_stored(index, terms), "node_id")).where(keep)
    if query.verbatim is not None:
        # A row may match by a prefix alone, and then has no rank of its own.
        tokens = F.concat(search_tokens(F.coalesce("heading", F.lit(""))), search_tokens(F.coalesce("body", F.lit(""))))
        exact = nodes.where(keep & verbatim_condition(query.verbatim, tokens))
        hits = exact.join(hits.select("node_id", "rank"), "node_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    order = [F.col("rank"), *([F.desc("is_current")] if "is_current" in nodes.columns else []), F.col("node_id")]
    # The pool is a few hundred rows: written once, the steps below don't scan the index again.
    best = hits.orderBy(*order).limit(max(POOL, offset + 3 * limit))
    pool = materialize(best if index is None else fetch(nodes, best, ["rank"]), "pool")
    if query.verbatim is None and query.asks:
        floor = pool.agg(F.max("rank").alias("floor"))
        extra = materialize(heading_rows(nodes, query, index=index), "headings").where(keep).join(pool.select("node_id"), "node_id", "left_anti")
        placed = extra.withColumn("__p", F.row_number().over(Window.orderBy("rank", "node_id"))).crossJoin(F.broadcast(floor))  # at most 40 rows and one
        pool = pool.unionByName(placed.withColumn("rank", F.coalesce("floor", F.lit(0.0)) + 0.001 * F.col("__p")).drop("__p", "floor"))
    scored = reranked(pool, query) if query.verbatim is None else pool.withColumn("score", -F.col("rank"))
    by = Window.orderBy(F.desc("score"), "node_id")  # over the pool, a few hundred rows
    ranked = scored.withColumn("place", F.row_number().over(by))
    if semantic is not None and query.verbatim is None:
        fused = fuse(ranked.select("node_id", "place"), semantic)
        missing = nodes.where(keep).join(F.broadcast(fused), "node_id").join(ranked.select("node_id"), "node_id", "left_anti").select(*nodes.columns)
        full = scored.select(*nodes.columns).unionByName(missing)
        ranked = full.join(fused.withColumnRenamed("rrf", "score"), "node_id").withColumn("place", F.row_number().over(by))
    return ranked.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def match_count(nodes: DataFrame, query: Query, scope: Column | None = None) -> int:
    return bm25(nodes, query.terms).where(scope if scope is not None else F.lit(True)).count() if query.terms else 0


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], top: int = VECTOR_POOL, key: str = "vec_id") -> DataFrame:
    """The rows with the largest inner product, with score and place."""
    scored = vectors.withColumn("score", dot(F.col("embedding"), F.array(*map(F.lit, query)))).orderBy(F.desc("score"), key).limit(top)
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(lexical: DataFrame, semantic: DataFrame, key: str = "node_id") -> DataFrame:
    """Reciprocal rank fusion of two rankings (key, place): positions count, scores don't."""
    l, s = lexical.select(key, F.col("place").alias("lex")), semantic.select(key, F.col("place").alias("sem"))
    both = l.join(s, key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.select(key, (part("lex") + part("sem")).alias("rrf"))


def ranks_of(results: DataFrame, expected: DataFrame, cutoff: int = 20) -> DataFrame:
    """For each expected (query_id, node_id): the place of the hit, null past the cutoff."""
    found = results.where(F.col("place") <= cutoff).select("query_id", "node_id", "place")
    return expected.join(found, ["query_id", "node_id"], "left").groupBy("query_id", *(c for c in expected.columns if c not in ("query_id", "node_id"))).agg(F.min("place").alias("place"))


def evaluation(ranks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean reciprocal rank, hits at 1 and 5, misses."""
    at = lambda k: F.count_if(F.coalesce(F.col("place") <= k, F.lit(False)))
    aggs = [F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr"), at(1).alias("at_1"), at(5).alias("at_5"), F.count_if(F.col("place").isNull()).alias("missed")]
    return ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)


def snippet(text: Column, terms: list[str], width: int = 18) -> Column:
    """A window of `width` tokens with the most query terms (the first, on ties), terms marked, cut ends shown."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))
    wanted = F.array(*map(F.lit, terms))
    hit = lambda t: F.arrays_overlap(search_tokens(t), wanted)
    flags = F.transform(tokens, lambda t: F.when(hit(t), 1).otherwise(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - width + 1))
    sums = F.transform(starts, lambda s: F.struct(F.aggregate(F.slice(flags, s, F.lit(width)), F.lit(0), lambda a, x: a + x).alias("n"), (-s).alias("neg")))
    start = -F.array_max(sums)["neg"]
    marked = F.transform(F.slice(tokens, start, F.lit(width)), lambda t: F.when(hit(t), F.concat(F.lit("\x02"), t, F.lit("\x03"))).otherwise(t))
    body = F.array_join(marked, " ")
    return F.concat(F.when(start > 1, F.lit("… ")).otherwise(F.lit("")), body, F.when(start + width - 1 < F.size(tokens), F.lit(" …")).otherwise(F.lit("")))


def address(slug: Column, page: Column, fragment: Column) -> Column:
    """/browse/slug/section/page#fragment, as far as known."""
    tail = F.when(page.isNotNull(), F.concat(F.lit("/section/"), page)).otherwise(F.lit(""))
    return F.concat(F.lit("/browse/"), slug, tail, F.when(fragment.isNotNull() & (fragment != ""), F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
