"""Versions of a work compared and followed: provisions, differences, timelines, wordings, chains, inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioscope.functions import diff as D
from folioscope.functions.text import normalise, provision_kind
from folioscope.operators.sequence import ROOT_TYPES, BOUNDARY_TYPES, enclosing_schedule
from folioscope.session import discard, materialize

CONTAINERS = ("schedule", "chapter", "part", "division", "subdivision")
KEY = ["kind", "schedule", "number"]


def provisions(nodes: DataFrame) -> DataFrame:
    """One row a provision and version: kind, schedule, number, heading, text, notes, idx.

    Nodes need work, version, idx, type, number, heading, text, notes. A provision has a number; its text and notes
    are its own and those of nodes below it, up to the next boundary; of a repeated key the first counts."""
    doc = ["work", "version"]
    w = Window.partitionBy(*doc).orderBy("idx")
    marked = enclosing_schedule(nodes, doc)
    unit = F.sum(F.col("type").isin(*BOUNDARY_TYPES).cast("int")).over(w)
    marked = marked.withColumn("unit", unit)
    pieces = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))))
    rolled = marked.where("unit > 0").groupBy(*doc, "unit").agg(pieces.alias("p"), F.min(F.when(F.col("type").isin(*BOUNDARY_TYPES), F.struct("idx", "type", F.col("number").alias("printed"), "heading", "in_schedule"))).alias("root"))
    text = normalise(F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != ""), " "))
    rows = rolled.select(*doc, F.col("root.idx").alias("idx"), F.col("root.type").alias("type"), F.col("root.printed").alias("printed"), F.col("root.heading").alias("heading"), F.col("root.in_schedule").alias("in_schedule"), text.alias("text"), F.flatten(F.transform("p", lambda x: x["notes"])).alias("notes"))
    kept = rows.where(F.col("type").isin(*ROOT_TYPES, *CONTAINERS) & (F.coalesce("printed", F.lit("")) != ""))
    schedule = F.when(F.col("type") != "schedule", F.lower("in_schedule"))
    keyed = kept.withColumns({"kind": provision_kind(F.col("type")), "schedule": schedule, "number": F.lower("printed")}).drop("in_schedule")
    first = F.row_number().over(Window.partitionBy(*doc, *KEY).orderBy("idx"))
    return keyed.withColumn("__n", first).where("__n = 1").drop("__n")


def compare(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two versions' provisions on null-safe keys, with change and difference.

    Kinds of change: inserted, repealed, unchanged, reordered (the same words moved, heading equal), changed. Equal
    wordings never reach the word difference."""
    o, n = old.alias("o"), new.alias("n")
    cond = F.lit(True)
    for c in on:
        cond &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    joined = o.join(n, cond, "full_outer")
    both = F.col("o.idx").isNotNull() & F.col("n.idx").isNotNull()
    diff = D.word_diff(F.when(both, F.col("o.text")), F.when(both, F.col("n.text")))
    key = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in on]
    notes = F.array_except(F.coalesce("n.notes", F.array().cast("array<string>")), F.coalesce("o.notes", F.array().cast("array<string>")))
    rows = joined.select(*key, F.coalesce("n.idx", "o.idx").alias("idx"), F.col("o.heading").alias("old_heading"), F.col("n.heading").alias("heading"), F.col("o.text").alias("old_text"), F.col("n.text").alias("text"), notes.alias("new_notes"), F.col("o.idx").isNull().alias("__came"), F.col("n.idx").isNull().alias("__went"), diff.alias("diff"))
    same_heading = F.col("old_heading").eqNullSafe(F.col("heading"))
    change = (
        F.when(F.col("__came"), "inserted").when(F.col("__went"), "repealed")
        .when(~D.words_changed(F.col("diff")) & same_heading, "unchanged")
        .when(same_heading & D.is_reordering(F.col("diff")), "reordered").otherwise("changed")
    )
    return rows.withColumn("change", change).drop("__came", "__went")


def version_pairs(versions: DataFrame) -> DataFrame:
    """(work, version, previous) for versions after a work's first."""
    w = Window.partitionBy("work").orderBy("version")
    return versions.select("work", "version").distinct().withColumn("previous", F.lag("version").over(w)).where("previous IS NOT NULL")


def timeline(provs: DataFrame) -> DataFrame:
    """All adjacent versions of all works compared in one join: each row keeps the version it changed in."""
    pairs = version_pairs(provs)
    old = provs.join(pairs.select("work", F.col("previous").alias("version"), F.col("version").alias("step")), ["work", "version"]).drop("version")
    new = provs.join(pairs.select("work", "version"), ["work", "version"]).withColumnRenamed("version", "step")
    return compare(old, new, ["work", "step", *KEY]).where("change NOT IN ('unchanged', 'reordered')").withColumnRenamed("step", "version")


def current_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each work."""
    return versions.groupBy("work").agg(F.max("version").alias("version"))


def base_versions(reviewed: DataFrame) -> DataFrame:
    """Of each work the version with most reviewed rows, the newer on ties."""
    return reviewed.groupBy("work").agg(F.max_by("version", F.struct("rows", "version")).alias("version"))


def wordings(states: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Spans of versions in which a provision reads the same or is absent.

    States: work, version, key, text_hash (present provisions only). With `confirmed` (work, version, key), a change
    counts only where it is confirmed; others continue the span. Each span: from, to, versions, absent, ended_by."""
    every = states.select("work", "key").distinct().join(states.select("work", "version").distinct(), "work")
    grid = every.join(states, ["work", "key", "version"], "left")
    w = Window.partitionBy("work", "key").orderBy("version")
    present = F.col("text_hash").isNotNull()
    was = F.lag("text_hash").over(w)
    first = F.row_number().over(w) == 1
    moved = ~was.eqNullSafe(F.col("text_hash"))
    flips = was.isNull() | F.col("text_hash").isNull()
    counted = grid.withColumn("__moved", moved).withColumn("__flip", flips).withColumn("__first", first)
    if confirmed is not None:
        ok = confirmed.select("work", "version", "key").distinct().withColumn("__ok", F.lit(True))
        counted = counted.join(ok, ["work", "version", "key"], "left")
        starts = F.col("__first") | (F.col("__moved") & (F.col("__flip") | F.coalesce("__ok", F.lit(False))))
    else:
        starts = F.col("__first") | F.col("__moved")
    marked = counted.withColumn("span", F.sum(starts.cast("int")).over(w)).withColumn("absent", ~present)
    rolled = marked.groupBy("work", "key", "span").agg(F.min("version").alias("from_version"), F.max("version").alias("to_version"), F.count("*").alias("members"), F.bool_and("absent").alias("absent"), F.max_by("text_hash", "version").alias("text_hash"))
    nxt = Window.partitionBy("work", "key").orderBy("span")
    after = F.lead("absent").over(nxt)
    return rolled.withColumn("ended_by", F.when(after.isNull(), None).when(after, "repealed").when(F.col("absent"), "inserted").otherwise("changed")).withColumn("ended_in", F.lead("from_version").over(nxt))


def chains(states: DataFrame, links: DataFrame) -> DataFrame:
    """Adds `chain_key`: the key a provision had where its chain began, followed through renames.

    States: work, version, key; links: work, version, new_key, old_key (a rename on the way into the version). A chain
    goes on only where the work's own version before has the provision. Each state points to the one before it, and
    pointers are doubled: so many joins as the largest number of versions of a work has binary digits."""
    before = version_pairs(states)
    came = states.join(links.select("work", "version", F.col("new_key").alias("key"), "old_key"), ["work", "version", "key"], "left").join(before, ["work", "version"], "left")
    came = came.select("work", "version", "key", F.col("previous").alias("up_version"), F.coalesce("old_key", "key").alias("up_key"))
    had = states.select("work", F.col("version").alias("up_version"), F.col("key").alias("up_key"), F.lit(True).alias("__had")).distinct()
    start = came.join(had, ["work", "up_version", "up_key"], "left")
    own = lambda c: F.when(F.col("__had"), F.col(f"up_{c}")).otherwise(F.col(c)).alias(f"up_{c}")
    now = materialize(start.select("work", "version", "key", own("version"), own("key")), "chain")
    most = before.groupBy("work").count().agg(F.max("count")).first()[0] or 0
    for _ in range((most + 1).bit_length()):
        above = now.select("work", F.col("version").alias("up_version"), F.col("key").alias("up_key"), F.col("up_version").alias("__v"), F.col("up_key").alias("__k"))
        further = materialize(now.join(above, ["work", "up_version", "up_key"]).select("work", "version", "key", F.col("__v").alias("up_version"), F.col("__k").alias("up_key")), "chain")
        discard(now)
        now = further
    return now.select("work", "version", "key", F.concat_ws("@", "up_key", F.col("up_version").cast("string")).alias("chain_key"))


def review_status(states: DataFrame, reviewed: DataFrame) -> DataFrame:
    """reviewed, inherits (with its source), follows or to_review for each provision and version.

    States: work, key, version, text_hash; reviewed: work, key, version. A provision inherits along a run of equal
    wording, from the nearest reviewed version, newer before older; an unreviewed one that the next version repeats
    follows it; the rest are to review."""
    w = Window.partitionBy("work", "key").orderBy("version")
    place = F.dense_rank().over(Window.partitionBy("work").orderBy("version"))
    marked = states.withColumn("__place", place)
    gap = (F.lag("__place").over(w) + 1) != F.col("__place")
    starts = F.coalesce(gap, F.lit(True)) | ~F.lag("text_hash").over(w).eqNullSafe(F.col("text_hash"))
    runs = marked.withColumn("__starts", starts.cast("int")).withColumn("run", F.sum("__starts").over(w))
    have = reviewed.select("work", "key", "version").distinct().withColumn("__r", F.lit(True))
    joined = runs.join(have, ["work", "key", "version"], "left").withColumn("__r", F.coalesce("__r", F.lit(False)))
    inside = Window.partitionBy("work", "key", "run").orderBy("version")
    newer = F.first(F.when(F.col("__r"), F.col("version")), ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing))
    older = F.last(F.when(F.col("__r"), F.col("version")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.lead("version").over(inside)
    source = F.when(F.col("__r"), F.col("version")).otherwise(F.coalesce(newer, older))
    out = joined.withColumn("source", source).withColumn("__next", nxt)
    status = F.when(F.col("__r"), "reviewed").when(F.col("source").isNotNull(), "inherits").when(F.col("__next").isNotNull(), "follows").otherwise("to_review")
    return out.select("work", "key", "version", status.alias("status"), F.coalesce("source", "__next").alias("source"))


def reference_versions(versions: DataFrame) -> DataFrame:
    """The version each one is compared with: the next, else the previous."""
    w = Window.partitionBy("work").orderBy("version")
    return versions.withColumn("reference", F.coalesce(F.lead("version").over(w), F.lag("version").over(w)))


def ghosts(states: DataFrame) -> DataFrame:
    """Provisions that a version lacks and an earlier one had: work, version, key, last_version."""
    versions = states.select("work", "version").distinct()
    last = states.groupBy("work", "key").agg(F.min("version").alias("first_version"))
    grid = versions.join(last, "work").where("version > first_version")
    held = grid.select("work", "key", "version").unionByName(last.select("work", "key", F.col("first_version").alias("version"))).join(states.select("work", "version", "key", F.lit(True).alias("__had")), ["work", "version", "key"], "left")
    before = Window.partitionBy("work", "key").orderBy("version")
    seen = held.withColumn("last_version", F.last(F.when(F.col("__had"), F.col("version")), ignorenulls=True).over(before))
    return seen.where("__had IS NULL").select("work", "version", "key", "last_version")


def superseded(versions: DataFrame) -> DataFrame:
    newest = F.max("version").over(Window.partitionBy("work"))
    return versions.withColumn("superseded", F.col("version") < newest)


