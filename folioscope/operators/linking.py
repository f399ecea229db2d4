"""Links between documents: clauses to sections, citations to Acts, entries to targets, boxes to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions import diff as D
from folioscope.functions.text import citations, section_numbers, work_of

MATCH_THRESHOLD = 0.8
BOX_IDS = 1024


def match_clauses(bill: DataFrame, act: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Every clause with the provision of the same number in the same Schedule (both null in the body), the first such
    provision in document order: similarity and status matched, flagged or unmatched.

    Both sides: idx, schedule, number, text."""
    key = F.lower("number")
    first = F.row_number().over(Window.partitionBy("schedule", "__k").orderBy("idx"))
    right = act.withColumn("__k", key).withColumn("__n", first).where("__n = 1")
    left, right = bill.withColumn("__k", key).alias("b"), right.alias("a")
    on = F.col("b.schedule").eqNullSafe(F.col("a.schedule")) & (F.col("b.__k") == F.col("a.__k"))
    joined = left.join(right, on, "left").select(F.col("b.idx").alias("clause_idx"), F.col("b.number").alias("clause_number"), F.col("b.schedule").alias("schedule"), F.col("a.idx").alias("act_idx"), F.col("a.number").alias("act_number"), F.col("a.schedule").alias("act_schedule"), F.col("b.text").alias("bt"), F.col("a.text").alias("at"))
    found = F.col("act_idx").isNotNull()
    score = F.when(found, F.round(D.similarity(F.when(found, F.col("bt")), F.when(found, F.col("at"))), 3))
    out = joined.withColumn("similarity", score)
    return out.withColumn("status", F.when(~found, "unmatched").when(F.col("similarity") >= threshold, "matched").otherwise("flagged")).drop("bt", "at")


def resolve_citations(cites: DataFrame, acts: DataFrame, registry: DataFrame) -> DataFrame:
    """What each citation (act_no, year or null) refers to, in three steps: the document's own table by number and
    year; by number alone where the year agrees or is unstated; the registry where exactly one entry fits.

    acts: act_no, year, title in table order `pos`; registry: act_no, year, title. Unresolved: null source."""
    same_year = F.col("c.year").eqNullSafe(F.col("a.year"))
    first_by = lambda cols: acts.withColumn("__n", F.row_number().over(Window.partitionBy(*cols).orderBy("pos"))).where("__n = 1").drop("__n")
    c = cites.alias("c")
    full = first_by(["act_no", "year"]).alias("a")
    step1 = c.join(full, (F.col("c.act_no") == F.col("a.act_no")) & F.col("c.year").isNotNull() & same_year, "left").select("c.*", F.col("a.title").alias("t1"), F.col("a.year").alias("y1"))
    bare = first_by(["act_no"]).select("act_no", F.col("title").alias("t2"), F.col("year").alias("y2"))
    step2 = step1.join(bare, "act_no", "left").withColumn("t2", F.when(F.col("year").isNull() | F.col("year").eqNullSafe(F.col("y2")), F.col("t2")))
    one = registry.groupBy("act_no", "year").agg(F.count("*").alias("n"), F.first("title").alias("t3"))
    dated = one.where("n = 1").select("act_no", "year", "t3")
    loose = registry.groupBy("act_no").agg(F.count("*").alias("n"), F.first("title").alias("t4"), F.first("year").alias("y4")).where("n = 1").select("act_no", "t4", "y4")
    step3 = step2.join(dated, ["act_no", "year"], "left").join(loose, "act_no", "left").withColumn("t4", F.when(F.col("year").isNull(), F.col("t4")))
    title = F.coalesce("t1", "t2", "t3", "t4")
    source = F.when(F.coalesce("t1", "t2").isNotNull(), "endnotes").when(F.coalesce("t3", "t4").isNotNull(), "registry")
    year = F.when(F.col("t1").isNotNull(), F.col("y1")).when(F.col("t2").isNotNull(), F.col("y2")).when(F.col("t3").isNotNull(), F.col("year")).when(F.col("t4").isNotNull(), F.col("y4"))
    return step3.select(*cites.columns, title.alias("title"), year.alias("resolved_year"), source.alias("source"))


def note_citations(notes: DataFrame, column: str = "raw") -> DataFrame:
    """One row a note and citation: act_no, year (null where unstated)."""
    exploded = notes.withColumn("cite", F.explode(citations(F.col(column))))
    parts = F.split("cite", "/")
    return exploded.withColumn("act_no", F.element_at(parts, 1)).withColumn("year", F.try_element_at(parts, F.lit(2)))


def summary_by_act(resolved: DataFrame) -> DataFrame:
    """Act to the provisions its notes stand at, in order."""
    return resolved.where("title IS NOT NULL").groupBy("title", "resolved_year").agg(F.array_sort(F.collect_set("label")).alias("provisions"), F.countDistinct("label").alias("n"))


def carry_forward(entries: DataFrame, doc: str, named: Column, idx: str = "idx", alias: str = "target") -> DataFrame:
    """As-of: each entry with what was named last, its own name included."""
    return entries.withColumn(alias, F.last(named, ignorenulls=True).over(Window.partitionBy(doc).orderBy(idx)))


def place_figures(nodes: DataFrame, figures: DataFrame) -> DataFrame:
    """Each figure (doc, page, y, figure_id) after the last node printed above it (doc, page, y, idx); of nodes at one height
    the one of the largest idx."""
    both = nodes.select("doc", "page", "y", "idx", F.lit(None).cast("string").alias("figure_id")).unionByName(figures.select("doc", "page", "y", F.lit(None).cast("int").alias("idx"), F.col("figure_id").cast("string")))
    w = Window.partitionBy("doc").orderBy("page", "y", F.col("figure_id").isNotNull(), "idx", "figure_id")
    return both.withColumn("after_idx", F.last("idx", ignorenulls=True).over(w)).where("figure_id IS NOT NULL").select("doc", "figure_id", "page", "y", "after_idx")


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, least_overlap: float = 0.5, band: float = 50.0) -> DataFrame:
    """Lines whose middle lies in a box of their page and which it covers by at least half their width.

    Boxes of one place are compared as one, and their ids dealt to its lines at the end. These places are dealt to
    horizontal bands, so the join is an equi-join on page and band with a filter on top."""
    mid = (F.col("y0") + F.col("y1")) / 2
    l = lines.withColumn("__mid", mid).withColumn("__band", F.floor(mid / band))
    place = ["page", "bx0", "bx1", "by0", "by1"]
    b = boxes.select("box_id", "page", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    # Lists of ids are of about a bounded length, however many boxes share a place.
    lists = b.groupBy(*place).agg(F.ceil(F.count("*") / BOX_IDS).alias("__lists"))
    b = b.join(lists, place).groupBy(*place, F.pmod(F.xxhash64("box_id"), "__lists").alias("__list")).agg(F.collect_list("box_id").alias("__ids"))
    b = b.drop("__list").withColumn("__band", F.explode(F.sequence(F.floor(F.col("by0") / band), F.floor(F.col("by1") / band))))
    overlap = F.least("x1", "bx1") - F.greatest("x0", "bx0")
    inside = (F.col("__mid") >= F.col("by0")) & (F.col("__mid") <= F.col("by1")) & (overlap >= (F.col("x1") - F.col("x0")) * least_overlap)
    found = l.join(b, ["page", "__band"]).where(inside)
    return found.withColumn("box_id", F.explode("__ids")).drop("__mid", "__band", "__ids", *place[1:])


def text_in_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    hit = lines_in_boxes(lines, boxes)
    return hit.groupBy("box_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda r: r["text"]), " ").alias("text"))


def commentary(bill_links: DataFrame, em_links: DataFrame, act_work: str) -> DataFrame:
    """Section to what explains it: the clauses it came from and the memorandum entries that reach it.

    bill_links: bill, act, clause_schedule, clause_number, act_schedule, act_number, similarity, status.
    em_links: em, bill, entry, kind (bill_clause, act_section, reviewed), act, schedule, clause_number, section_ref.
    Of links of one clause to one section the best by (matched, similarity) stays; of a clause's sections the first."""
    low = lambda c: F.lower(c)
    mine = bill_links.where((work_of(F.col("act")) == act_work) & F.col("act_number").isNotNull())
    best = F.row_number().over(Window.partitionBy("bill", low("clause_schedule"), low("clause_number"), low("act_schedule"), low("act_number")).orderBy(F.desc(F.col("status") == "matched"), F.desc("similarity"), "pos"))
    bills = mine.withColumn("__n", best).where("__n = 1")
    rows = bills.select(low("act_schedule").alias("schedule"), low("act_number").alias("number"), F.lit("bill").alias("route"), F.col("bill").alias("source"), F.col("clause_number").alias("entry"), "status", "similarity")
    first = F.row_number().over(Window.partitionBy("bill", low("clause_schedule"), low("clause_number")).orderBy("pos"))
    mapping = mine.withColumn("__n", first).where("__n = 1").select("bill", low("clause_schedule").alias("ms"), low("clause_number").alias("mn"), low("act_schedule").alias("to_schedule"), low("act_number").alias("to_number"))
    em = em_links.where(work_of(F.col("act")) == act_work).alias("e")
    via_clause = em.where("kind = 'bill_clause'").join(mapping.alias("m"), (F.col("e.bill") == F.col("m.bill")) & low("e.schedule").eqNullSafe(F.col("m.ms")) & (low("e.clause_number") == F.col("m.mn"))).select(F.col("to_schedule").alias("schedule"), F.col("to_number").alias("number"), "e.em", "e.entry", "e.kind")
    via_section = em.where("kind = 'act_section'").select(F.lit(None).cast("string").alias("schedule"), F.explode(section_numbers(F.col("section_ref"))).alias("number"), "em", "entry", "kind").withColumn("number", low("number"))
    via_review = em.where("kind = 'reviewed'").select(low("schedule").alias("schedule"), low("section_ref").alias("number"), "em", "entry", "kind")
    ems = via_clause.unionByName(via_section).unionByName(via_review)
    return rows.unionByName(ems.select("schedule", "number", F.col("kind").alias("route"), F.col("em").alias("source"), F.col("entry").cast("string").alias("entry"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("similarity")))


def with_reviewed_links(em_links: DataFrame, reviewed: DataFrame) -> DataFrame:
    """A reviewer's target (em, entry, schedule, section_ref) replaces the guess."""
    r = reviewed.select("em", "entry", F.col("schedule").alias("__s"), F.col("section_ref").alias("__r"), F.lit(True).alias("__set"))
    j = em_links.join(r, ["em", "entry"], "left")
    given = F.coalesce("__set", F.lit(False))
    return j.withColumn("kind", F.when(given, "reviewed").otherwise(F.col("kind"))).withColumn("schedule", F.when(given, F.col("__s")).otherwise(F.col("schedule"))).withColumn("section_ref", F.when(given, F.col("__r")).otherwise(F.col("section_ref"))).drop("__s", "__r", "__set")


def definition_index(nodes: DataFrame) -> DataFrame:
    """Term (lower case) to the first node that defines it."""
    terms = nodes.where(F.col("type") == "definition").select(F.lower(F.trim("heading")).alias("term"), "idx")
    return terms.where("term <> ''").groupBy("term").agg(F.min("idx").alias("idx"))


def resolve_terms(spans: DataFrame, index: DataFrame) -> DataFrame:
    return spans.withColumn("term", F.lower(F.trim("text"))).join(index, "term", "left")


def resolve_act_titles(texts: DataFrame, known: DataFrame, registry: DataFrame) -> DataFrame:
    """Act named by a text: exact title among the known, then in the registry; else a text that ends with a title.

    The suffix step joins on the title's last words, three or as many as it has."""
    norm = lambda c: F.lower(F.trim(c))
    last = lambda c, n: F.array_join(F.slice(F.split(c, " "), F.size(F.split(c, " ")) - n + 1, n), " ")
    words = lambda c: F.size(F.split(c, " "))
    titles = known.select(norm("title").alias("title_key"), F.lit(1).alias("tier")).unionByName(registry.select(norm("title").alias("title_key"), F.lit(2).alias("tier"))).groupBy("title_key").agg(F.min("tier").alias("tier"))
    titles = titles.withColumn("__n", F.least(F.lit(3), words(F.col("title_key")))).withColumn("__tail", last(F.col("title_key"), F.col("__n")))
    t = texts.withColumn("__t", norm("text"))
    ends = t.withColumn("__n", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), words(F.col("__t")))))).withColumn("__tail", last(F.col("__t"), F.col("__n")))
    hit = ends.join(titles, ["__n", "__tail"]).where(F.col("__t").endswith(F.col("title_key"))).drop("__n")
    best = F.row_number().over(Window.partitionBy("text_id").orderBy(F.desc(F.col("__t") == F.col("title_key")), "tier", F.desc(F.length("title_key")), "title_key"))
    return t.join(hit.withColumn("__n", best).where("__n = 1").select("text_id", "title_key", "tier"), "text_id", "left").drop("__t")


def note_targets_changed(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Notes of the newer version that cite an Act which the older one's notes about the same printed target did not.

    Both sides: target, act, kind, and for the newer the piece's name. One row a piece with its strongest change."""
    from folioscope.functions.text import KIND_RANK

    fresh = newer.join(older.select("target", "act").distinct(), ["target", "act"], "left_anti")
    rank = F.create_map(*(F.lit(x) for p in KIND_RANK.items() for x in p))
    return fresh.groupBy("name").agg(F.max_by("kind", rank[F.col("kind")]).alias("kind"), F.array_sort(F.collect_set("act")).alias("acts"))


def acts_between(table: DataFrame, in_force: DataFrame, newly_noted: DataFrame) -> DataFrame:
    """Amending Acts needed between two versions: listed ones not in force at the older, and those noted anew."""
    return table.join(in_force, "citation", "left_anti").unionByName(newly_noted.join(table.select("citation"), "citation", "left_semi").select(*table.columns)).distinct()


def lookup_near(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Join on page and rounded height with a slack of one."""
    k = keys.withColumn("ry", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.round("y").cast("int") + d)))
    return k.join(lines.withColumn("ry", F.round("y0").cast("int")), ["page", "ry"]).drop("ry")
