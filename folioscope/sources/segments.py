"""A search index of immutable segments: a change writes the postings of changed nodes alone.

Each commit adds at most one segment and a list of the node ids that it takes out of earlier segments, and then one small
manifest file with the next number, written aside and renamed. Readers take the manifest with the highest number: they
see a commit whole or not at all, there is never a moment without one, and a crash before the rename leaves only files
that nothing names. Old versions of a segment stay readable to those who opened them. Word counts are kept as
differences, so a reader adds them up; a merge rewrites segments without what is gone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import search as S
from folioscope.session import discard, materialize

#: Segments beyond which a commit should be followed by a merge.
SEGMENTS = 8
_ROW = "no long, path string, gone string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str) -> tuple[int, list[tuple]]:
    """The newest number (0: none) and its rows (number of a commit, its segment, its list of ids gone; each may be null)."""
    fs, folder = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return 0, []
    last = max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)
    rows = spark.read.schema(_ROW).json(f"{root}/manifests/{last}").collect() if last else []  # a row a commit
    return last, sorted(map(tuple, rows))


def _commit(spark: SparkSession, root: str, no: int, rows: list[tuple]) -> None:
    staged = f"{root}/staged-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, _ROW).coalesce(1).write.json(staged)
    fs, target = _fs(spark, f"{root}/manifests/{no}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(_fs(spark, staged)[1], target):
        raise RuntimeError(f"commit {no} of {root} was made by another writer")


def _write(nodes: DataFrame, gone: DataFrame | None, path: str) -> None:
    """A segment's tables; the words of `gone` are taken off."""
    nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.parquet(f"{path}/node")
    # Texts are cut once, into counts that the other tables are made from.
    counts = materialize(S.counted(nodes.sparkSession.read.schema(nodes.schema).parquet(f"{path}/node")), "counted")
    S.sorted_postings(counts).write.parquet(f"{path}/posting")
    counts.select("node_id", "dl").write.parquet(f"{path}/length")
    words = S.counted_vocabulary(counts)
    if gone is not None:
        words = words.union(S.vocabulary(gone).select("term", -F.col("cnt")))
    words.groupBy("term").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0").write.parquet(f"{path}/word")
    discard(counts)


def _read(spark: SparkSession, rows: list[tuple], name: str) -> DataFrame | None:
    """A table over all segments, with the number of the commit."""
    out = None
    for no, path, _ in rows:
        if path is not None:
            part = spark.read.parquet(f"{path}/{name}").withColumn("__no", F.lit(no))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _gone(spark: SparkSession, rows: list[tuple]) -> DataFrame | None:
    """(node_id, __gone): up to which commit a node's rows are gone."""
    out = None
    for no, _, gone in rows:
        if gone is not None:
            part = spark.read.parquet(gone).withColumn("__gone", F.lit(no))
            out = part if out is None else out.unionByName(part)
    return out if out is None else out.groupBy("node_id").agg(F.max("__gone").alias("__gone"))


def _live(spark: SparkSession, rows: list[tuple], name: str) -> DataFrame | None:
    all_, gone = _read(spark, rows, name), _gone(spark, rows)
    if all_ is None or gone is None:
        return all_ if all_ is None else all_.drop("__no")
    on = (F.col("a.node_id") == F.col("g.node_id")) & (F.col("a.__no") < F.col("g.__gone"))
    return all_.alias("a").join(gone.alias("g"), on, "left_anti").drop("__no")


def update(root: str, nodes: DataFrame, removed: DataFrame | None = None) -> int:
    """Commit changed and new nodes (node_id, heading, body, ...; whole rows) and ids to remove (node_id); the number of
    the commit. Only these nodes' texts are cut and written, and the old texts of those that were there are read."""
    spark = nodes.sparkSession
    last, rows = manifest(spark, root)
    no, path = last + 1, f"{root}/s-{uuid.uuid4().hex}"
    ids = nodes.select("node_id")
    ids = ids if removed is None else ids.union(removed.select("node_id"))
    before, gone, old = _live(spark, rows, "node"), None, None
    if before is not None:
        old = before.join(ids.distinct(), "node_id", "left_semi")
        gone = f"{path}/gone"
        old.select("node_id").write.parquet(gone)
    _write(nodes, old, path)
    _commit(spark, root, no, [*rows, (no, path, gone)])
    return no


def merge(spark: SparkSession, root: str) -> int:
    """Rewrite all segments as one without what is gone; the number of the commit. Nothing to merge is no commit."""
    last, rows = manifest(spark, root)
    if sum(path is not None for _, path, _ in rows) < 2:
        return last
    path = f"{root}/s-{uuid.uuid4().hex}"
    words = _read(spark, rows, "word").groupBy("term").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
    words.write.parquet(f"{path}/word")
    for name, by in (("posting", ["term", "node_id"]), ("node", ["node_id"]), ("length", ["node_id"])):
        _live(spark, rows, name).repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{path}/{name}")
    _commit(spark, root, last + 1, [(last + 1, path, None)])
    return last + 1


def opened(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of an index as searches read them (see `writers.open_index`), over all segments."""
    last, rows = manifest(spark, root)
    if not any(path for _, path, _ in rows):
        raise ValueError(f"no index under {root}")
    lengths = _live(spark, rows, "length")
    statistics = lengths.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    words = _read(spark, rows, "word").groupBy("term").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    return {"node": _live(spark, rows, "node"), "posting": _live(spark, rows, "posting"), "statistics": statistics, "word": words}
