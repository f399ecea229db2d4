"""Versions stored as differences: a slim version keeps the changed subtrees and is put together from its neighbour.

Piece tables: name (path with slashes), idx (document order), text and other columns; `doc` where they hold several
documents, whose names then begin with the document's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import ancestors
from folioscope.session import discard, materialize


def canonical(name: Column) -> Column:
    """A name in which a Schedule's entries are clauses, whatever word the parse used."""
    return F.regexp_replace(name, r"(^|/)(sch[^/]*/)(?:item|s)(?=\d)", "$1$2cl")


def within(pieces: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    """The pieces that are one of `names` or inside one (or, with keep=False, the others)."""
    tagged = pieces.select("name").distinct().withColumn("__a", F.explode(ancestors(F.col("name"))))
    hit = tagged.join(names.select(F.col("name").alias("__a")).distinct(), "__a", "left_semi").select("name").distinct()
    return pieces.join(hit, "name", "left_semi" if keep else "left_anti")


def outermost(names: DataFrame) -> DataFrame:
    """The names not inside another of them."""
    own = names.select("name").distinct()
    parents = own.withColumn("__p", F.explode(F.filter(ancestors(F.col("name")), lambda a: a != F.col("name"))))
    inner = parents.join(own.select(F.col("name").alias("__p")), "__p", "left_semi").select("name").distinct()
    return own.join(inner, "name", "left_anti")


def changed_names(version: DataFrame, neighbour: DataFrame) -> DataFrame:
    """(name, change) where the version's pieces differ from its neighbour's: words, inserted, removed."""
    v, n = version.select("name", F.col("text").alias("vt")), neighbour.select("name", F.col("text").alias("nt"))
    j = v.withColumn("__v", F.lit(True)).join(n.withColumn("__n", F.lit(True)), "name", "full_outer")
    change = F.when(F.col("__n").isNull(), "inserted").when(F.col("__v").isNull(), "removed").when(~F.col("vt").eqNullSafe(F.col("nt")), "words")
    return j.select("name", change.alias("change")).where("change IS NOT NULL")


def _doc(pieces: DataFrame) -> list[str]:
    return ["doc"] if "doc" in pieces.columns else []


def slim(version: DataFrame, neighbour: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The version's changed subtrees (with the place each follows) and the names it lacks."""
    changes = changed_names(version, neighbour)
    kept = within(version, outermost(changes.where("change <> 'removed'").select("name")))
    shared = version.join(neighbour.select("name"), "name", "left_semi").join(kept.select("name"), "name", "left_anti")
    w = Window.partitionBy(*_doc(version)).orderBy("idx")
    anchors = version.join(shared.select("name", F.lit(True).alias("__s")), "name", "left")
    placed = anchors.withColumn("after", F.last(F.when(F.col("__s"), F.col("name")), ignorenulls=True).over(w)).select("name", "after")
    return kept.join(placed, "name"), changes.where("change = 'removed'").select("name")


def assemble(neighbour: DataFrame, pieces: DataFrame, removed: DataFrame) -> DataFrame:
    """The whole version again: the neighbour without replaced and removed subtrees, and the version's own pieces each
    after what they follow. `idx` is the new order (from 0)."""
    gone = removed.select("name").unionByName(pieces.select("name"))
    doc = _doc(neighbour)
    base = within(neighbour, gone, keep=False).select(*doc, "name", "text", F.col("idx").alias("__base"), F.lit(-1).alias("__own"))
    places = base.select(F.col("name").alias("after"), F.col("__base").alias("__at"))
    own = pieces.join(places, "after", "left").select(*doc, "name", "text", F.coalesce("__at", F.lit(-1)).alias("__base"), F.col("idx").alias("__own"))
    both = base.unionByName(own)
    return both.withColumn("idx", F.row_number().over(Window.partitionBy(*doc).orderBy("__base", "__own")) - 1).drop("__base", "__own")


def delta_chain(pointers: DataFrame) -> DataFrame:
    """(version, base, steps): each version's way to a base (a version without a pointer); cycles and ways to a version
    that isn't there have no base and no row. Pointers are doubled: as many joins as the longest way has binary digits."""
    bases = pointers.where("toward IS NULL").select(F.col("version").alias("base"))
    now = materialize(pointers.select("version", F.coalesce("toward", "version").alias("base"), F.col("toward").isNotNull().cast("int").alias("steps")), "chain")
    for _ in range(max(1, now.count()).bit_length()):
        above = now.select(F.col("version").alias("base"), F.col("base").alias("__base"), F.col("steps").alias("__steps"))
        further = materialize(now.join(above, "base").select("version", F.col("__base").alias("base"), (F.col("steps") + F.col("__steps")).alias("steps")), "chain")
        discard(now)
        now = further
        if now.join(bases, "base", "left_anti").isEmpty():
            break
    return now.join(bases, "base", "left_semi").select("version", "base", "steps")


def load_order(chain: DataFrame) -> DataFrame:
    return chain.orderBy("base", "steps", "version")
