"""Whether a reviewed unit may lend its review to another version's: what is reviewed, what blocks it, and whether both
have the same pieces. Sets of pieces are compared by signatures (a count and two order-free sums of hashes), so no list
of a unit's pieces is ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNIT = ["work", "version", "key"]


def set_signature(*values: str) -> list[Column]:
    """Aggregates that tell sets of distinct rows apart, whatever their order."""
    h, k = F.xxhash64(*values), F.xxhash64(*values, F.lit("again"))
    return [F.count("*").alias("pieces"), F.sum(h.cast("decimal(38,0)")).alias("sum1"), F.sum(k.cast("decimal(38,0)")).alias("sum2")]


def unit_signatures(pieces: DataFrame) -> DataFrame:
    """(work, version, key, pieces, sum1, sum2) of units' pieces (work, version, key, piece), repeats counted once."""
    return pieces.select(*UNIT, "piece").distinct().groupBy(*UNIT).agg(*set_signature("piece"))


def unit_coverage(pieces: DataFrame, rows: DataFrame, finished: DataFrame, edits: DataFrame) -> DataFrame:
    """(work, version, key, pieces, covered, reviewed, blocked) of units.

    A unit is reviewed when each of its pieces has a row (work, version, key, piece), or when it is finished (work,
    version, key) and a row of it is left, the others having been merged away. An edited piece, or one that an edit goes
    by, blocks it (work, version, key, piece)."""
    own = pieces.select(*UNIT, "piece").distinct()
    mark = lambda df, name: df.select(*UNIT, "piece", F.lit(True).alias(name)).distinct()
    joined = own.join(mark(rows, "__row"), [*UNIT, "piece"], "left").join(mark(edits, "__edit"), [*UNIT, "piece"], "left")
    counted = joined.groupBy(*UNIT).agg(F.count("*").alias("pieces"), F.count("__row").alias("covered"), F.count("__edit").alias("__edits"))
    done = finished.select(*UNIT, F.lit(True).alias("__done")).distinct()
    out = counted.join(done, UNIT, "left")
    reviewed = (F.col("covered") > 0) & ((F.col("covered") == F.col("pieces")) | F.coalesce("__done", F.lit(False)))
    return out.select(*UNIT, "pieces", "covered", reviewed.alias("reviewed"), (F.col("__edits") > 0).alias("blocked"))


def guarded(status: DataFrame, pieces: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Statuses (work, key, version, status, source) in which a unit inherits only from one with the same pieces, so that
    every row has a piece to go to and every piece a row; a blocked unit (work, version, key) inherits nothing. What may
    not inherit is to be reviewed."""
    marks = unit_signatures(pieces)
    own = marks.select(*UNIT, F.struct("pieces", "sum1", "sum2").alias("__own"))
    other = marks.select("work", F.col("version").alias("source"), "key", F.struct("pieces", "sum1", "sum2").alias("__other"))
    joined = status.join(own, UNIT, "left").join(other, ["work", "source", "key"], "left")
    if blocked is not None:
        joined = joined.join(blocked.select(*UNIT, F.lit(True).alias("__blocked")).distinct(), UNIT, "left")
    else:
        joined = joined.withColumn("__blocked", F.lit(None).cast("boolean"))
    refused = (F.col("status") == "inherits") & (~F.col("__own").eqNullSafe(F.col("__other")) | F.coalesce("__blocked", F.lit(False)))
    return joined.select("work", "key", "version", F.when(refused, "to_review").otherwise(F.col("status")).alias("status"), F.when(~refused, F.col("source")).alias("source"))
