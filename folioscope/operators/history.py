"""Reviewed history: changes of each step with their evidence, decisions, wordings of pieces, roll-ups over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import ancestors
from folioscope.operators.sequence import islands


def insertion_points(pieces: DataFrame, shared: DataFrame) -> DataFrame:
    """Where each piece (work, version, idx, name) that the neighbour lacks would follow: the nearest piece before it
    that both have (shared: work, version, name)."""
    s = shared.select("work", "version", "name", F.lit(True).alias("__s"))
    marked = pieces.join(s, ["work", "version", "name"], "left")
    w = Window.partitionBy("work", "version").orderBy("idx")
    follows = F.last(F.when(F.col("__s"), F.col("name")), ignorenulls=True).over(w)
    return marked.withColumn("follows", follows).where("__s IS NULL").drop("__s")


def confirmed(decisions: DataFrame) -> DataFrame:
    """(work, to_version, text_keys, whole_keys): keys of confirmed changes, of words and of whole provisions."""
    keys = lambda kind: F.array_sort(F.collect_set(F.when(F.col("piece_kind") == kind, F.col("key"))))
    return decisions.where("decision = 'confirmed'").groupBy("work", "to_version").agg(keys("text").alias("text_keys"), keys("whole").alias("whole_keys"))


def with_evidence(changes: DataFrame, instructions: DataFrame, notes: DataFrame) -> DataFrame:
    """Changes (work, version, key) with the statuses of instructions and the number of new notes about each."""
    ins = instructions.groupBy("work", "version", "key").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.count("*").alias("instructions"))
    new = notes.groupBy("work", "version", "key").agg(F.count("*").alias("notes"))
    j = changes.join(ins, ["work", "version", "key"], "left").join(new, ["work", "version", "key"], "left")
    zero = {"instructions": 0, "notes": 0}
    return j.fillna(zero).withColumn("statuses", F.coalesce("statuses", F.array().cast("array<string>"))).withColumn("unexplained", F.col("instructions") + F.col("notes") == 0)


def piece_history(texts: DataFrame) -> DataFrame:
    """Wordings of a piece: runs of versions (work, piece, version, text) that read the same, merged."""
    runs = islands(texts, ["work", "piece"], "version", F.col("text"))
    return runs.groupBy("work", "piece", "island").agg(F.min("version").alias("from_version"), F.max("version").alias("to_version"), F.count("*").alias("versions"), F.first("text").alias("text"))


def subtree_counts(nodes: DataFrame, flag: Column) -> DataFrame:
    """(name, pieces, flagged): every name's own and lower nodes, and how many of them hold `flag`."""
    up = nodes.select(F.explode(ancestors(F.col("name"))).alias("name"), flag.cast("int").alias("f"))
    return up.groupBy("name").agg(F.count("*").alias("pieces"), F.sum("f").alias("flagged"))


def tree_info(units: DataFrame, doc: str, rank: str, idx: str = "idx", deepest: int = 9) -> DataFrame:
    """Adds `parent`: the last unit before of a shallower rank (ranks are small numbers, 0 the shallowest)."""
    w = Window.partitionBy(doc).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(rank) == k, F.col(idx)), ignorenulls=True).over(w) for k in range(deepest)]
    parent = F.lit(None).cast(units.schema[idx].dataType)
    for k in range(deepest):
        shallower = F.array_max(F.array(*last[:k])) if k else parent
        parent = F.when(F.col(rank) == k, shallower).otherwise(parent)
    return units.withColumn("parent", parent)


def scopes(units: DataFrame, deepest: int = 9) -> DataFrame:
    """Adds `governed_by` to units (doc, idx, depth, names): the names of the nearest unit above that names an Act.

    Above a unit stand, for each shallower depth, the last unit before of at most that depth, where it has just that
    depth; so one window with a column a depth finds them all (depths are small numbers, 0 the shallowest)."""
    w = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.col("depth")
    above = [F.last(F.when(depth <= k, F.struct(depth.alias("depth"), F.nullif(F.col("names"), F.lit("")).alias("names"))), ignorenulls=True).over(w) for k in range(deepest)]
    named = [F.when((depth > k) & (a["depth"] == k), a["names"]) for k, a in enumerate(above)]
    return units.select("doc", "idx", F.coalesce(*reversed(named)).alias("governed_by"))


def row_gap_cut(gaps: DataFrame, key: str, ratio: float = 1.22) -> DataFrame:
    """(key, cut): the first sorted gap that is `ratio` times the one before it parts rows of a table from lines."""
    sorted_ = gaps.groupBy(key).agg(F.array_sort(F.collect_set("gap")).alias("g"))
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.size("g"), F.lit(2))), lambda i: F.try_element_at("g", i) >= ratio * F.try_element_at("g", i - 1))
    return sorted_.select(key, F.try_element_at("g", F.try_element_at(places, F.lit(1))).alias("cut"))


def catalogue(titles: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Titles with the words, those that begin with them first, then the newest."""
    low = F.lower("title")
    return titles.where(low.contains(prefix.lower())).orderBy(F.desc(low.startswith(prefix.lower())), F.desc("year"), "title").limit(limit)
