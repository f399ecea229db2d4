"""Work that is done once and only where something changed; and, as an extra, wordings over a stream of events."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def stale(stamps: DataFrame, done: DataFrame) -> DataFrame:
    """Works whose stamp (work, stamp) is not the one recorded as done."""
    return stamps.join(done.select("work", "stamp"), ["work", "stamp"], "left_anti")


def refresh(stamps: DataFrame, done: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Stored rows with those of stale works computed anew, and the new record of what is done."""
    changed = stale(stamps, done)
    keep = stored.join(changed.select("work"), "work", "left_anti")
    return keep.unionByName(compute(changed)), stamps


def missing(wanted: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """What a manifest of finished work doesn't have yet: a rerun resumes."""
    return wanted.dropDuplicates(key).join(manifest.select(*key), key, "left_anti")


def batches(rows: DataFrame, order: str, size: int = 10) -> DataFrame:
    """Adds `batch`: fixed-size groups in order within a document."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc").orderBy(order)) - 1) / size))


STATE = "value string, since timestamp, members long"
SPAN = "key string, value string, since timestamp, until timestamp, members long"


def wording_stream(events: DataFrame, key: str, time: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """Spans of equal values of each key, as they end, from an event stream; open spans stay in state.

    Rows within a micro-batch are put in order of time; a row that arrives later than a later one already counted is
    counted into the span open then."""

    def step(k, parts, state):
        value_now, since, n = state.get if state.exists else (None, None, 0)
        out = []
        for r in pd.concat(list(parts)).sort_values("__time").itertuples():
            if n and r[2] == value_now:
                n += 1
                continue
            if n:
                out.append((str(k[0]), value_now, since, r[1], n))
            value_now, since, n = r[2], r[1], 1
        state.update((value_now, since, n))
        yield pd.DataFrame(out, columns=["key", "value", "since", "until", "members"])

    rows = events.withWatermark(time, delay).select(F.col(time).alias("__time"), F.col(value).cast("string").alias("__value"), F.col(key).cast("string").alias("__key"))
    return rows.groupBy("__key").applyInPandasWithState(lambda k, p, s: step(k, (x[["__time", "__value"]] for x in p), s), SPAN, STATE, "append", "NoTimeout")


def throttled(requests: DataFrame, key: str, time: str, every: str = "10 seconds") -> DataFrame:
    """At most one request of a key within the delay."""
    return requests.withWatermark(time, every).dropDuplicatesWithinWatermark([key])
