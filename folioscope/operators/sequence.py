"""Ordered passes over a document's nodes as windows: units, breadcrumbs, Schedules, names, islands, resume points.

Node tables have a document key, `idx` (document order), `type`, and where needed number, heading, text. A window is
over one document, so no step sees more than a document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import content_digest
from folioscope.session import fanout, materialize

# Node types that open units, close units, and levels in order with those sharing a rank.
ROOT_TYPES = ("section", "clause", "item", "preamble")
BOUNDARY_TYPES = ("schedule", "dictionary", "chapter", "part", "division", "subdivision", "section", "clause", "item", "preamble", "heading_group")
LEVELS = (("schedule", "dictionary"), ("chapter",), ("part",), ("division",), ("subdivision",), ("section", "clause", "item"), ("subsection", "definition"), ("paragraph",), ("subparagraph",), ("sub_subparagraph",))


def in_order(doc: str | list[str], idx: str = "idx"):
    return Window.partitionBy(*([doc] if isinstance(doc, str) else doc)).orderBy(idx)


def segments(nodes: DataFrame, doc: str | list[str], root: Column, boundary: Column, idx: str = "idx") -> DataFrame:
    """Adds `unit` (a number a document, from 1) and `is_root`: a root opens a unit that lasts to the next boundary; a
    boundary or a node outside any unit is a unit of its own."""
    w = in_order(doc, idx)
    last = F.last(F.when(root, 2).when(boundary, 1), ignorenulls=True).over(w)
    opens = root | boundary | F.coalesce(last != 2, F.lit(True))
    return nodes.withColumn("unit", F.sum(opens.cast("int")).over(w)).withColumn("is_root", root)


def units(nodes: DataFrame, doc: str | list[str], idx: str = "idx") -> DataFrame:
    """Review units of typed nodes; the Part of a Dictionary is a unit root too."""
    w = in_order(doc, idx)
    holder = F.last(F.when(F.col("type").isin("dictionary", "schedule"), F.col("type")), ignorenulls=True).over(w)
    marked = nodes.withColumn("__holder", holder)
    root = F.col("type").isin(*ROOT_TYPES) | ((F.col("type") == "part") & F.coalesce(F.col("__holder") == "dictionary", F.lit(False)))
    return segments(marked, doc, root, F.col("type").isin(*BOUNDARY_TYPES), idx).drop("__holder")


def unit_texts(nodes: DataFrame, doc: list[str], idx: str = "idx") -> DataFrame:
    """(doc, unit, root_idx, text): each unit's pieces in order, empty ones left out."""
    pieces = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct(idx, "text"))))
    return nodes.groupBy(*doc, "unit").agg(F.min(idx).alias("root_idx"), F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("text"))


def enclosing_schedule(nodes: DataFrame, doc: str | list[str], idx: str = "idx") -> DataFrame:
    """Adds `in_schedule`: the node's own Schedule where it has one, else the last Schedule or Dictionary before it."""
    own = F.when(F.col("type") == "schedule", F.coalesce("number", F.lit(""))).when(F.col("type") == "dictionary", F.lit("Dictionary"))
    carried = F.nullif(F.last(own, ignorenulls=True).over(in_order(doc, idx)), F.lit(""))
    mine = F.nullif(F.col("schedule"), F.lit("")) if "schedule" in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumn("in_schedule", F.coalesce(mine, carried))


def breadcrumbs(nodes: DataFrame, doc: str | list[str], idx: str = "idx", levels=LEVELS) -> DataFrame:
    """Adds a column a level: the last number (or heading) seen at it since anything shallower was."""
    keys = [doc] if isinstance(doc, str) else doc
    out = nodes
    names = []
    for rank, group in enumerate(levels):
        shallower = [t for g in levels[:rank] for t in g]
        island = f"__island{rank}"
        changed = F.col("type").isin(*shallower).cast("int") if shallower else F.lit(0)
        out = out.withColumn(island, F.sum(changed).over(in_order(keys, idx)))
        value = F.when(F.col("type").isin(*group), F.coalesce("number", "heading", F.lit("")))
        out = out.withColumn(f"in_{group[0]}", F.nullif(F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, island).orderBy(idx)), F.lit("")))
        names.append(island)
    return out.drop(*names)


def unique_names(nodes: DataFrame, doc: str | list[str], name: str = "name", idx: str = "idx") -> DataFrame:
    """Adds `node_id`: the first to claim a name keeps it, later ones get a digest of their wording, and where that
    repeats an ordinal from 2."""
    keys = [doc] if isinstance(doc, str) else doc
    first = F.row_number().over(Window.partitionBy(*keys, name).orderBy(idx))
    digest = content_digest(F.col("type"), F.col("heading"), F.col("text"))
    marked = nodes.withColumn("__n", first).withColumn("__q", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("~"), digest)))
    again = F.row_number().over(Window.partitionBy(*keys, "__q").orderBy(idx))
    return marked.withColumn("__m", again).withColumn("node_id", F.when(F.col("__m") == 1, F.col("__q")).otherwise(F.concat("__q", F.lit("-"), F.col("__m").cast("string")))).drop("__n", "__q", "__m")


def slug_names(rows: DataFrame, doc: str | list[str], slug: str, idx: str = "idx") -> DataFrame:
    """Adds `anchor`: repeated slugs get -1, -2 and so on."""
    keys = [doc] if isinstance(doc, str) else doc
    n = F.row_number().over(Window.partitionBy(*keys, slug).orderBy(idx)) - 1
    return rows.withColumn("anchor", F.when(n == 0, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string"))))


def islands(rows: DataFrame, key: list[str], order: str, value: Column) -> DataFrame:
    """Adds `island`: runs of equal `value` (nulls equal) in order, numbered from 1."""
    w = Window.partitionBy(*key).orderBy(order)
    changed = ~F.lag("__v").over(w).eqNullSafe(F.col("__v")) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("__v", value).withColumn("__c", changed.cast("int"))
    return marked.withColumn("island", F.sum("__c").over(w)).drop("__v", "__c")


def spans(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """One row a run: from, to, members, and the value of the next run (`ended_by`)."""
    runs = islands(rows, key, order, F.col(value)).groupBy(*key, "island").agg(F.first(value).alias(value), F.min(order).alias("span_from"), F.max(order).alias("span_to"), F.count("*").alias("members"))
    return runs.withColumn("ended_by", F.lead(value).over(Window.partitionBy(*key).orderBy("island")))


def resume_point(rows: DataFrame, doc: str, done: Column, idx: str = "idx") -> DataFrame:
    """(doc, resume_at): the end of the leading run of done rows (-1 for none)."""
    running = F.min(done.cast("int")).over(in_order(doc, idx))
    return rows.withColumn("__run", running).groupBy(doc).agg(F.coalesce(F.max(F.when(F.col("__run") == 1, F.col(idx))), F.lit(-1)).alias("resume_at"))


def merge_blocks(blocks: DataFrame, doc: str, opens: Column, text: str = "text", idx: str = "idx") -> DataFrame:
    """Blocks that don't open an entry join the one before, in order."""
    marked = blocks.withColumn("entry", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(in_order(doc, idx)))
    ordered = F.array_sort(F.collect_list(F.struct(idx, text)))
    return marked.groupBy(doc, "entry").agg(F.min(idx).alias(idx), F.array_join(F.transform(ordered, lambda p: p[text]), " ").alias(text))


def neighbours(rows: DataFrame, doc: str, value: str, idx: str = "idx") -> DataFrame:
    w = in_order(doc, idx)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def with_previous(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds `previous`: the value of `order` in the row before, of the same group (null for a group's first).

    A group may hold most of the rows, so none is a task: rows are dealt to sorted ranges, each range looks back inside
    itself, and its first row to the last of the range before (one row a range)."""
    key = F.struct(group, order)
    dealt = rows.repartitionByRange(fanout(rows), group, order).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    ends = dealt.groupBy("__range").agg(F.max(key).alias("__end"))  # one row a range
    ends = ends.select("__range", F.lag("__end").over(Window.orderBy("__range")).alias("__end"))
    inside = F.lag(key).over(Window.partitionBy("__range").orderBy(group, order))
    found = dealt.withColumn("__last", inside).join(F.broadcast(ends), "__range").withColumn("__last", F.coalesce("__last", "__end"))
    previous = F.when(F.col("__last")[group].eqNullSafe(F.col(group)), F.col("__last")[order])
    return found.withColumn("previous", previous).drop("__range", "__last", "__end")
