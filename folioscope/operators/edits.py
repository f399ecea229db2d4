"""The reviewer's edits as rows: each operator gives the tables after an edit, or the rows that say why it is refused.

Nodes: doc, idx, name, type, text, unit, and `live` (not merged away or deleted). Edits come in tables, many documents
at once; a refused edit changes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def committed(nodes: DataFrame, commits: DataFrame) -> DataFrame:
    """Review rows of committed units (doc, unit, verified, at): every live node of the unit, stamped `verified_at`
    or flagged, and the unit's last node marked with its number."""
    rows = nodes.where("live").join(commits, ["doc", "unit"])
    last = F.col("idx") == F.max("idx").over(Window.partitionBy("doc", "unit"))
    return rows.select("doc", "idx", "name", "type", "text", F.when(F.col("verified"), F.col("at")).alias("verified_at"), (~F.col("verified")).alias("needs_followup"), F.when(last, F.col("unit")).alias("unit_end"))


def accepted_page(nodes: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes (doc, idx) of the pages (doc, page) that no review row stands for yet: what accepting the page accepts."""
    return nodes.where("live").join(pages, ["doc", "page"], "left_semi").join(rows.select("doc", "idx"), ["doc", "idx"], "left_anti").select("doc", "idx")


def split_text(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits (doc, idx, at, target): the text from character `at` on goes to the end of the target's text. A split
    with nothing before or after it, onto itself, or onto a node that isn't live changes nothing."""
    live = nodes.where("live")
    cut = splits.join(live.select("doc", "idx", "text"), ["doc", "idx"]).join(live.select("doc", F.col("idx").alias("target")), ["doc", "target"], "left_semi")
    tail = F.trim(F.substr("text", F.col("at") + 1))
    good = cut.where((F.col("at") > 0) & (F.col("at") < F.length("text")) & (F.col("idx") != F.col("target")) & (tail != ""))
    heads = good.select("doc", "idx", F.trim(F.substr("text", F.lit(1), F.col("at"))).alias("__head"))
    tails = good.groupBy("doc", F.col("target").alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("from"), tail.alias("t")))), lambda x: x["t"]), "\n").alias("__tail"))
    out = nodes.join(heads, ["doc", "idx"], "left").join(tails, ["doc", "idx"], "left")
    edited = F.concat_ws("\n", F.nullif(F.coalesce("__head", "text"), F.lit("")), "__tail")
    return out.withColumn("text", F.when(F.coalesce("__head", "__tail").isNotNull(), edited).otherwise(F.col("text"))).drop("__head", "__tail")


def merge_refusals(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """(doc, target, reason) of merges (doc, target, source) that can't be: a piece into itself, pieces of several
    units, or a unit's root while other pieces of it stay."""
    m = merges.join(nodes.select("doc", F.col("idx").alias("source"), "unit"), ["doc", "source"])
    roots = nodes.groupBy("doc", "unit").agg(F.min("idx").alias("root"), F.count_if("live").alias("size"))
    per = m.join(roots, ["doc", "unit"]).join(nodes.select("doc", F.col("idx").alias("target"), F.col("unit").alias("own")), ["doc", "target"])
    inside = F.max((F.col("own") == F.col("unit")).cast("int"))
    per = per.groupBy("doc", "target").agg(F.bool_or(F.col("source") == F.col("target")).alias("self"), F.countDistinct("unit").alias("units"), F.bool_or(F.col("source") == F.col("root")).alias("rooted"), F.count("*").alias("n"), F.max("size").alias("size"), inside.alias("inside"))
    reason = F.when(F.col("self"), "into itself").when(F.col("units") > 1, "several units").when(F.col("rooted") & (F.col("size") - F.col("n") - F.col("inside") > 0), "root with pieces")
    return per.select("doc", "target", reason.alias("reason")).where("reason IS NOT NULL")


def merged(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (doc, target, source): the sources' texts, in order, join the target's, and the sources are merged away.
    Refused merges (see `merge_refusals`) change nothing."""
    ok = merges.join(merge_refusals(nodes, merges), ["doc", "target"], "left_anti")
    texts = ok.join(nodes.select("doc", F.col("idx").alias("source"), F.trim("text").alias("t")), ["doc", "source"]).where("t <> ''")
    more = texts.groupBy("doc", F.col("target").alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "t"))), lambda x: x["t"]), "\n").alias("__more"))
    gone = ok.select("doc", F.col("source").alias("idx"), F.lit(True).alias("__gone")).distinct()
    out = nodes.join(more, ["doc", "idx"], "left").join(gone, ["doc", "idx"], "left")
    joined = F.when(F.col("__more").isNotNull(), F.concat_ws("\n", F.nullif("text", F.lit("")), "__more")).otherwise(F.col("text"))
    return out.withColumn("text", joined).withColumn("live", F.col("live") & F.col("__gone").isNull()).drop("__more", "__gone")


def tombstones(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Deletions and restorations (doc, idx, deleted, seq): the last one of a node counts."""
    last = edits.groupBy("doc", "idx").agg(F.max_by("deleted", "seq").alias("__deleted"))
    return nodes.join(last, ["doc", "idx"], "left").withColumn("live", F.col("live") & ~F.coalesce("__deleted", F.lit(False))).drop("__deleted")


def block_under(nodes: DataFrame, picked: DataFrame, rank: str = "rank") -> DataFrame:
    """(doc, root, idx): each picked node (doc, idx) and the nodes nested under it: those after it up to the next node
    of its own or a shallower rank.

    Ranks may be any numbers; the different ones (a few: one a type of node) are read first, and one window looks ahead
    for each. A node without a rank has nothing under it and ends no block."""
    ranks = sorted(r[0] for r in nodes.select(rank).where(F.col(rank).isNotNull()).distinct().collect())
    ahead = Window.partitionBy("doc").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    after = [F.when(F.col(rank) == k, F.min(F.when(F.col(rank) <= k, F.col("idx"))).over(ahead)) for k in ranks]
    end = F.coalesce(*after, F.when(F.col(rank).isNull(), F.col("idx") + 1))
    last = F.max("idx").over(Window.partitionBy("doc")) + 1
    ends = nodes.withColumn("__end", F.coalesce(end, last)).join(picked, ["doc", "idx"], "left_semi")
    # A row for each place inside, so that the range is an equi-join.
    return ends.select("doc", F.col("idx").alias("root"), F.explode(F.sequence(F.col("idx"), F.col("__end") - 1)).alias("idx")).join(nodes.select("doc", "idx"), ["doc", "idx"]).select("doc", "root", "idx")


def can_renest(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds `fits` to moves (doc, idx, target): the target stands before the node, is live and shallower than what the
    node becomes, and is no heading of the node's own block."""
    n = nodes.select("doc", "idx", "rank")
    t = nodes.where("live").select("doc", F.col("idx").alias("target"), F.col("rank").alias("__above"))
    j = moves.join(n, ["doc", "idx"], "left").join(t, ["doc", "target"], "left")
    return j.withColumn("fits", F.coalesce((F.col("target") < F.col("idx")) & (F.col("__above") <= F.col("rank")), F.lit(False))).drop("rank", "__above")


def unit_labels(nodes: DataFrame) -> DataFrame:
    """Adds `label` to nodes (doc, unit, idx, type, chain, heading): SECTION for a unit's first, the chain of numbers
    where there is one, a definition's term, else a count of its type; a label met again takes the count behind it."""
    first = F.row_number().over(Window.partitionBy("doc", "unit").orderBy("idx"))
    of_type = F.row_number().over(Window.partitionBy("doc", "unit", "type").orderBy("idx"))
    numbered = F.nullif("chain", F.lit(""))
    term = F.when(F.col("type") == "definition", F.nullif(F.trim("heading"), F.lit("")))
    label = F.when(first == 1, "SECTION").otherwise(F.coalesce(F.when(F.col("type") == "continuation", F.concat(numbered, F.lit(" continuation"))), numbered, term, F.concat_ws(" ", F.upper("type"), of_type.cast("string"))))
    named = nodes.withColumn("label", label)
    again = F.row_number().over(Window.partitionBy("doc", "unit", "label").orderBy("idx"))
    return named.withColumn("__n", again).withColumn("label", F.when(F.col("__n") > 1, F.concat("label", F.lit(" #"), F.col("__n").cast("string"))).otherwise(F.col("label"))).drop("__n")


def contiguous_units(units: DataFrame) -> DataFrame:
    """(doc, marked): how many units (doc, unit, finished) from the first on are finished without a gap."""
    run = F.min(F.col("finished").cast("int")).over(Window.partitionBy("doc").orderBy("unit"))
    return units.withColumn("__run", run).groupBy("doc").agg(F.sum("__run").alias("marked"))


def renamed(tables: dict[str, DataFrame], renames: DataFrame, human: tuple[str, ...], derived: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (each with `act`) after renames (old, new), and the refused ones with the rows in their way: a name under
    which a person's work is stored is not merged into. Derived rows of the new name give way."""
    taken = reduce(DataFrame.unionByName, [tables[t].select("act") for t in human]).groupBy(F.col("act").alias("new")).agg(F.count("*").alias("rows"))
    refused = renames.join(taken, "new")
    ok = renames.join(refused.select("old"), "old", "left_anti")
    out = {}
    for name, rows in tables.items():
        kept = rows.join(ok.select(F.col("new").alias("act")), "act", "left_anti") if name in derived else rows
        moved = kept.join(ok.select(F.col("old").alias("act"), F.col("new").alias("__new")), "act", "left")
        out[name] = moved.withColumn("act", F.coalesce("__new", "act")).drop("__new").select(*rows.columns)
    return out, refused


def with_columns(stored: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Stored rows with columns they lack added as nulls, and no column lost."""
    return stored.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in stored.columns})


def rekeyed(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (act, idx, ...) under the names (act, idx, name) of their places, and the rows that no name is known for."""
    j = rows.join(names.select("act", "idx", "name"), ["act", "idx"], "left")
    return j.where("name IS NOT NULL"), j.where("name IS NULL").drop("name")


def placed_by_name(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (doc, name, ...) with the place `idx` of their name; null where the parse has no such name, never dropped."""
    return rows.join(nodes.select("doc", "name", "idx"), ["doc", "name"], "left")


def name_index(names: DataFrame, former: Column) -> DataFrame:
    """(doc, name, idx): places by name, and by a former name where no node is called so now (the last place wins)."""
    now = names.groupBy("doc", "name").agg(F.max("idx").alias("idx"))
    was = names.withColumn("name", former).where("name IS NOT NULL").groupBy("doc", "name").agg(F.min("idx").alias("idx"))
    return now.unionByName(was.join(now.select("doc", "name"), ["doc", "name"], "left_anti"))


def checked_spans(spans: DataFrame, nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Adds `text` and `problem` to spans (doc, name, start, end, label): an unknown label, no such node, or a range
    outside its text; the text is cut only where there is no problem."""
    j = spans.join(nodes.select("doc", "name", F.col("text").alias("__t")), ["doc", "name"], "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("__t"))
    problem = F.when(~F.col("label").isin(*labels), "label").when(F.col("__t").isNull(), "node").when(~inside, "range")
    return j.withColumn("problem", problem).withColumn("text", F.when(F.col("problem").isNull(), F.substr("__t", F.col("start") + 1, F.col("end") - F.col("start")))).drop("__t")


def corrections_stats(log: DataFrame) -> DataFrame:
    """One row: corrections logged, and how many changed something."""
    return log.agg(F.count("*").alias("n"), F.count_if(~F.col("parser_output").eqNullSafe(F.col("human_output"))).alias("changed"))
