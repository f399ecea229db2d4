"""What the entries of an explanatory memorandum explain: Acts and sections that a text names, the Act that an earlier
entry named, the Bill's own clauses, and ranges of sections spread over the provisions that a version has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How entries name Acts, sections and actions.
_WORD = r"[A-Z][\w'()-]*"
ACT_NAME = rf"\b({_WORD}(?:\s+(?:{_WORD}|of|the|and|for|in|on|to|by|or)){{0,12}}?\s+Act\s+\d{{4}})\b"
OWN_ACT = r"(?i)\b(?:the\s+principal\s+act|this\s+act|the\s+act)\b"
NUMBER = r"\d\w*(?:\.\w+)*(?:\([\w.]+\))?"
SECTIONS = rf"(?i)\bsections?\s+({NUMBER}(?:\s*(?:,|\bto\b|\band\b)\s*(?:and\s+)?{NUMBER})*)"
ACTION = r"(?i)\b(inserts?|substitutes?|repeals?|amends?)\b"


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt to the session's count of partitions: rows of entries shrink so much in a shuffle that partitions put together
    by their bytes there would be millions of rows in one task's sorts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _place(number: str, schedule: str) -> list[Column]:
    """Join keys of a clause: a missing Schedule equals a missing one."""
    return [F.lower(number).alias("__n"), F.coalesce(F.lower(schedule), F.lit("")).alias("__s"), F.col(schedule).isNull().alias("__bare")]


def read_entries(entries: DataFrame) -> DataFrame:
    """Adds `action`, `act_name`, `own_act` and `section_ref` to entries (doc, idx, number, schedule, text): the first of
    each that the text names; a named Act goes before "this Act"."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    name = _found(plain, ACT_NAME)
    return entries.withColumn("action", F.lower(_found(plain, ACTION))).withColumn("act_name", name).withColumn("own_act", name.isNull() & plain.rlike(OWN_ACT)).withColumn("section_ref", _found(plain, SECTIONS))


def resolve_entries(entries: DataFrame, acts: DataFrame, clauses: DataFrame, own: DataFrame) -> DataFrame:
    """(doc, idx, kind, act, act_title, action, section_ref, number, schedule, in_force) of entries.

    An entry that names an Act, the own Act or a section is about the Act named last, up to itself; before any, about the
    document's own Act (own: doc, act). Else it explains the Bill's clause of its number (clauses: doc, number, schedule),
    if there is one. Acts: title, act (null for an Act that is only known by its title), in_force."""
    read = _dealt(read_entries(entries).drop("text"), "doc")
    now = F.last("act_name", ignorenulls=True).over(Window.partitionBy("doc").orderBy("idx"))
    read = read.withColumn("act_title", now).join(own.select("doc", F.col("act").alias("__own")), "doc", "left")
    known = acts.select(F.col("title").alias("act_title"), F.col("act").alias("__act"), "in_force")
    has = clauses.select("doc", *_place("number", "schedule"), F.lit(True).alias("__clause")).distinct()
    keys = ["doc", "__n", "__s", "__bare"]
    joined = read.join(known, "act_title", "left").select("*", *_place("number", "schedule")).join(has, keys, "left")
    about = F.col("act_name").isNotNull() | F.col("own_act") | F.col("section_ref").isNotNull()
    kind = F.when(about, "act_section").when(F.col("__clause"), "bill_clause")
    act = F.when(about & F.col("act_title").isNotNull(), F.col("__act")).when(kind.isNotNull(), F.col("__own"))
    return joined.select("doc", "idx", kind.alias("kind"), act.alias("act"), F.when(about, F.col("act_title")).alias("act_title"), "action", F.when(about, F.col("section_ref")).alias("section_ref"), "number", "schedule", F.when(about, F.col("in_force")).alias("in_force"))


def references(ref: Column) -> Column:
    """Parts (lo, hi) of a reference in order; hi is null but for a range. Numbers are in small letters, without brackets."""
    bare = F.regexp_replace(F.lower(ref), r"\s*\([\w.]+\)", "")
    parts = F.filter(F.split(bare, r"\s*(?:,|\band\b)\s*"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.element_at(F.split(x, r"\s+to\s+"), 1).alias("lo"), F.try_element_at(F.split(x, r"\s+to\s+"), F.lit(2)).alias("hi")))


_REFERS = "kind = 'act_section' AND section_ref IS NOT NULL"


def reached(targets: DataFrame, provisions: DataFrame) -> DataFrame:
    """(act, section_ref, number): the sections that each reference reaches, once however many targets have it. A range is
    spread over the Act's provisions (act, number, position; one row a number) from its first to its last, by their order
    and not by their numbers, so that inserted ones are in it; a range of which an end is not there counts for its ends."""
    refs = targets.where(_REFERS).select("act", "section_ref").distinct()
    parts = refs.select("act", "section_ref", F.posexplode(references(F.col("section_ref")))).select("act", "section_ref", "pos", "col.lo", "col.hi")
    at = provisions.select("act", F.lower("number").alias("number"), "position")
    # One join finds both ends, and one what lies between: branches of a union would sort side by side in one task.
    said = F.array_compact(F.array("lo", "hi"))
    ends = parts.withColumn("number", F.explode(said)).join(at, ["act", "number"], "left").groupBy("act", "section_ref", "pos", "lo", "hi")
    ends = ends.agg(F.min(F.when(F.col("number") == F.col("lo"), F.col("position"))).alias("__from"), F.max(F.when(F.col("number") == F.col("hi"), F.col("position"))).alias("__to"))
    whole = F.coalesce(F.col("__from") <= F.col("__to"), F.lit(False))
    place = lambda position, number: F.struct(position.cast(at.schema["position"].dataType).alias("position"), number.cast("string").alias("said"))
    # A row for each place inside, so that the range is an equi-join.
    inside = F.when(whole, F.transform(F.sequence("__from", "__to"), lambda x: place(x, F.lit(None)))).otherwise(F.transform(said, lambda x: place(F.lit(None), x)))
    rows = ends.select("act", "section_ref", F.explode(inside).alias("p")).select("act", "section_ref", "p.position", "p.said").join(at, ["act", "position"], "left")
    return rows.select("act", "section_ref", F.coalesce("said", "number").alias("number")).where("number IS NOT NULL").distinct()


def _with_reference(targets: DataFrame, of_refs: DataFrame, how: str) -> DataFrame:
    """Targets with what their Act and reference have (null Acts are equal)."""
    r = of_refs.withColumnsRenamed({"act": "__a", "section_ref": "__ref"})
    return targets.join(r, F.col("act").eqNullSafe(F.col("__a")) & (F.col("section_ref") == F.col("__ref")), how).drop("__a", "__ref")


def explained(targets: DataFrame, provisions: DataFrame) -> DataFrame:
    """(doc, idx, act, number): the sections that act_section targets reach (see `reached`)."""
    named = targets.where(_REFERS).select("doc", "idx", "act", "section_ref")
    return _with_reference(named, reached(targets, provisions), "inner").select("doc", "idx", "act", "number").distinct()


def suggestions(targets: DataFrame, provisions: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, idx, act, act_title, schedule, number): the first provision that each entry's target reaches, offered for
    review; a clause goes to the section that it became (links: doc, clause, clause_schedule, schedule, number). Entries
    that name another Act keep the Act without a provision."""
    order = provisions.select("act", F.lower("number").alias("number"), "position")
    ranked = F.struct(F.coalesce("position", F.lit(2**31 - 1)).alias("position"), "number")
    first = reached(targets, provisions).join(order, ["act", "number"], "left").groupBy("act", "section_ref").agg(F.min(ranked).alias("__first"))
    mine = _with_reference(targets.where("kind IS NOT NULL"), first, "left")
    # Of an entry that several targets have, the first of all of them.
    best = F.when((F.col("kind") == "act_section") & F.col("doc").isNotNull() & F.col("idx").isNotNull(), F.col("__first"))
    t = _dealt(mine, "doc", "idx").withColumn("__number", F.min(best).over(Window.partitionBy("doc", "idx"))["number"])
    went = links.select("doc", *_place("clause", "clause_schedule"), F.col("schedule").alias("__ls"), F.lower("number").alias("__ln"), F.lit("bill_clause").alias("kind"))
    keys = ["doc", "__n", "__s", "__bare", "kind"]
    both = t.select("*", *_place("number", "schedule")).join(went, keys, "left")
    return both.select("doc", "idx", "act", "act_title", F.col("__ls").alias("schedule"), F.when(F.col("kind") == "bill_clause", F.col("__ln")).when(F.col("act").isNotNull(), F.col("__number")).alias("number"))
