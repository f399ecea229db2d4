"""Documents as a library: kinds, status, pages, related documents, notes by what they cite, reports over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import KIND_RANK


def document_kind(recorded: Column) -> Column:
    """act, bill or em as the parse recorded it; an older parse without a record is an Act's."""
    return F.coalesce(F.nullif(F.trim(recorded), F.lit("")), F.lit("act"))


def published(documents: DataFrame, works: DataFrame) -> DataFrame:
    """Documents (slug, work, kind, parsed) that readers see: parsed, of a published work, and no Bill."""
    return documents.where("parsed AND kind <> 'bill'").join(works.select("work"), "work", "left_semi")


def indexable(nodes: DataFrame) -> DataFrame:
    """Nodes that search finds: on a page, no figure, with a heading or text."""
    filled = (F.coalesce(F.trim("heading"), F.lit("")) != "") | (F.coalesce(F.trim("text"), F.lit("")) != "")
    return nodes.where(F.col("page").isNotNull() & (F.col("type") != "figure") & filled)


def level_ranks(order: list[str], aliases: dict[str, str]) -> dict[str, int]:
    """Level to depth, 0 the shallowest; an alias has its level's."""
    ranks = {level: i for i, level in enumerate(order)}
    return ranks | {alias: ranks[level] for alias, level in aliases.items() if level in ranks}


def pageable_schedules(nodes: DataFrame, schedule: str = "schedule", section_types: tuple[str, ...] = ("section", "clause")) -> DataFrame:
    """Schedules (doc, schedule_idx) without a provision of their own below them: they are a page themselves. Nodes
    carry `schedule_idx`, the Schedule they are in."""
    roots = nodes.where(F.col("type") == schedule).select("doc", F.col("idx").alias("schedule_idx"))
    held = nodes.where(F.col("type").isin(*section_types) & F.col("schedule_idx").isNotNull()).select("doc", "schedule_idx")
    return roots.join(held, ["doc", "schedule_idx"], "left_anti")


def file_names(sections: DataFrame) -> DataFrame:
    """Adds `file` and `cross_reference` to sections (doc, idx, number): a number met again has a suffix, and only the
    first is what "section N" means."""
    n = F.row_number().over(Window.partitionBy("doc", F.lower("number")).orderBy("idx"))
    base = F.concat(F.lit("s"), F.regexp_replace(F.lower("number"), r"[^a-z0-9]+", "-"))
    return sections.withColumn("__n", n).withColumn("file", F.concat(base, F.when(F.col("__n") > 1, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise(""), F.lit(".md"))).withColumn("cross_reference", F.col("__n") == 1).drop("__n")


def page_index(nodes: DataFrame) -> DataFrame:
    """(doc, idx, page_idx): every node on the page of the last section or pageable node before it, itself included."""
    w = Window.partitionBy("doc").orderBy("idx")
    return nodes.withColumn("page_idx", F.last(F.when(F.col("opens_page"), F.col("idx")), ignorenulls=True).over(w)).select("doc", "idx", "page_idx")


def related_documents(documents: DataFrame, links: DataFrame) -> DataFrame:
    """(act, kind, other): the Bills and memoranda that links (act, other) tie to each Act's work, each once."""
    others = documents.select(F.col("slug").alias("other"), "kind").where("kind <> 'act'")
    return links.join(others, "other").select("act", "kind", "other").distinct()


def held_by_citation(works: DataFrame, cites: DataFrame) -> DataFrame:
    """Adds `work` to citations (act_no, year): the held work of that number and year, the least on ties."""
    held = works.groupBy("act_no", "year").agg(F.min("work").alias("work"))
    return cites.join(held, ["act_no", "year"], "left")


def document_status(documents: DataFrame, nodes: DataFrame, progress: DataFrame) -> DataFrame:
    """One row a document: parsed, nodes and provisions, units checked and in total."""
    counts = nodes.groupBy(F.col("doc").alias("slug")).agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "section").alias("provisions"))
    j = documents.select("slug").join(counts, "slug", "left").join(progress.withColumnRenamed("doc", "slug"), "slug", "left")
    return j.select("slug", F.col("nodes").isNotNull().alias("parsed"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "provisions", "checked", "total")))


def node_counts(nodes: DataFrame, provision_types: tuple[str, ...] = ("section", "clause")) -> DataFrame:
    """(doc, type, n, is_provision): counts by type."""
    return nodes.groupBy("doc", "type").agg(F.count("*").alias("n")).withColumn("is_provision", F.col("type").isin(*provision_types))


def issue_groups(findings: DataFrame) -> DataFrame:
    """Findings (doc, severity, category, ...) counted by kind, errors first."""
    n = findings.groupBy("doc", "severity", "category").agg(F.count("*").alias("n"))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return n.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(rank, F.desc("n"), "category")))


def scan_progress(scans: DataFrame) -> DataFrame:
    """(act, scanned, total) of units (act, unit, done)."""
    return scans.groupBy("act").agg(F.count_if(F.coalesce("done", F.lit(False))).alias("scanned"), F.count("*").alias("total"))


def recent_verified(rows: DataFrame, word: str = "", limit: int = 20) -> DataFrame:
    """The rows verified last (name, text, verified_at), of those with `word` in name or text."""
    low = word.lower()
    hit = F.lower(F.col("name")).contains(low) | F.lower(F.coalesce("text", F.lit(""))).contains(low)
    return rows.where(F.col("verified_at").isNotNull() & hit).orderBy(F.desc("verified_at"), "name").limit(limit)


def review_signature(rows: DataFrame, stamp: str) -> DataFrame:
    """(act, rows, newest, total): changes whenever a row is added, removed or stamped anew."""
    return rows.groupBy("act").agg(F.count("*").alias("rows"), F.max(stamp).alias("newest"), F.sum("idx").alias("total"))


def pages_of(found: int, offset: int, size: int = 20) -> dict[str, int]:
    """A pager's numbers: pages, the current one, and the offsets of its neighbours (-1: none)."""
    pages = max(1, -(-found // size))
    page = min(offset // size, pages - 1)
    return {"pages": pages, "page": page + 1, "previous": (page - 1) * size if page else -1, "next": (page + 1) * size if page + 1 < pages else -1}


def strongest(kinds: Column) -> Column:
    """Of changes the strongest: repealed before inserted before changed."""
    rank = F.create_map(*(F.lit(x) for p in KIND_RANK.items() for x in p))
    return F.array_max(F.transform(kinds, lambda k: F.struct(rank[k].alias("r"), k.alias("k"))))["k"]


def cites_map(notes: DataFrame) -> DataFrame:
    """(piece, act, kind) of notes (piece, act, kind): the strongest change that each Act made to a piece."""
    return notes.where("act IS NOT NULL").groupBy("piece", "act").agg(strongest(F.collect_set("kind")).alias("kind"))


def cited_by_target(notes: DataFrame) -> DataFrame:
    """(target, acts): the Acts that notes about a printed target cite."""
    return notes.where("target IS NOT NULL AND act IS NOT NULL").groupBy("target").agg(F.array_sort(F.collect_set("act")).alias("acts"))


def loose_notes(notes: DataFrame) -> DataFrame:
    """(provision, notes): notes (provision, note_no, raw, idx) that no node took, by the provision they stand at."""
    rows = F.array_sort(F.collect_list(F.struct("note_no", "raw")))
    return notes.where("idx IS NULL AND provision IS NOT NULL").groupBy("provision").agg(F.transform(rows, lambda r: r["raw"]).alias("notes"))


def acts_first_shown(shown: DataFrame, version: int) -> DataFrame:
    """Citations (citation, version) whose first version is `version`."""
    return shown.groupBy("citation").agg(F.min("version").alias("first")).where(F.col("first") == version).select("citation")


def fetch_status(needed: DataFrame, held: DataFrame) -> DataFrame:
    """(work, needed, held, missing): how many of the Acts a work needs are here."""
    j = needed.distinct().join(held.select("citation", F.lit(True).alias("__h")).distinct(), "citation", "left")
    return j.groupBy("work").agg(F.count("*").alias("needed"), F.count("__h").alias("held")).withColumn("missing", F.col("needed") - F.col("held"))


def checked_keys(nodes: DataFrame) -> DataFrame:
    """(doc, key) of provisions whose every piece (doc, key, verified_at, needs_followup) is accepted and none flagged."""
    good = F.col("verified_at").isNotNull() & ~F.coalesce("needs_followup", F.lit(False))
    return nodes.groupBy("doc", "key").agg(F.bool_and(good).alias("ok")).where("ok").select("doc", "key")


def worklist(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Changes (work, version, key) with their decision, and whether the step they belong to still waits for one."""
    j = changes.join(decisions, ["work", "version", "key"], "left")
    waits = F.bool_or(F.col("decision").isNull()).over(Window.partitionBy("work", "version"))
    return j.withColumn("pending", waits)


def ordered_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, key, place): keys (doc, key, idx) of `a` in their order, then those that only `b` has, in theirs."""
    one = a.withColumn("__s", F.lit(0)).unionByName(b.withColumn("__s", F.lit(1))).groupBy("doc", "key").agg(F.min(F.struct("__s", "idx")).alias("x"))
    return one.select("doc", "key", F.row_number().over(Window.partitionBy("doc").orderBy("x.__s", "x.idx", "key")).alias("place"))
