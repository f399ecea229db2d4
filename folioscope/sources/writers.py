"""Writers: index tables behind a pointer, review tables as sorted lines, documents as XML and Markdown."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import search as S
from folioscope.session import discard, materialize


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/current")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []


def publish(tables: dict[str, DataFrame | Callable[[str], DataFrame]], root: str, signature: str) -> str:
    """Write tables (or what functions of the new folder make of those before them) under a new version of `root`, then a
    pointer with the next number, written aside and renamed. Readers take the highest number: they see the old or the new, whole, and there is never a moment without one."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{root}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        (df(version) if callable(df) else df).write.parquet(f"{version}/{name}")
    pointer = spark.createDataFrame([(version, signature)], "version string, signature string")
    staged = f"{root}/pointer-{uuid.uuid4().hex}"
    pointer.coalesce(1).write.json(staged)
    while True:
        fs, target = _fs(spark, f"{root}/current/{max(_pointers(spark, root), default=0) + 1}")
        fs.mkdirs(target.getParent())
        if not fs.exists(target) and fs.rename(_fs(spark, staged)[1], target):
            return version


def published(spark: SparkSession, root: str) -> tuple[str, str] | None:
    numbers = _pointers(spark, root)
    if not numbers:
        return None
    r = spark.read.schema("version string, signature string").json(f"{root}/current/{numbers[-1]}").first()
    return r["version"], r["signature"]


def build_index(nodes: DataFrame, root: str, signature: str) -> str:
    """Search tables: nodes by id, postings by term with node lengths, words, one row of statistics. Nothing is done
    where the signature is already published."""
    now = published(nodes.sparkSession, root)
    if now and now[1] == signature:
        return now[0]
    # Terms and ids lie together, so a query reads only the row groups of its own terms and of its page.
    by_id = nodes.repartitionByRange("node_id").sortWithinPartitions("node_id")
    counts = None

    def posting(version: str) -> DataFrame:
        # Texts are cut once, into counts that the other tables are made from.
        nonlocal counts
        counts = materialize(S.counted(nodes.sparkSession.read.schema(nodes.schema).parquet(f"{version}/node")), "counted")
        return S.sorted_postings(counts)

    statistics = lambda _: S.counted_stats(counts).select(F.col("n_nodes").alias("n"), F.coalesce(F.nullif("avgdl", F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    version = publish({"node": by_id, "posting": posting, "statistics": statistics, "word": lambda _: S.counted_vocabulary(counts)}, root, signature)
    discard(counts)
    return version


def open_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    now = published(spark, root)
    if now is None:
        raise ValueError(f"no index under {root}")
    return {t: spark.read.parquet(f"{now[0]}/{t}") for t in ("node", "posting", "statistics", "word")}


def section_texts(nodes: DataFrame) -> DataFrame:
    """One text a document and page, in row order, with the page's label in front (for encoders)."""
    rows = F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(" ", "heading", "body").alias("t"))))
    return nodes.groupBy("doc", "page").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"), F.min_by("label", "idx").alias("label")).withColumn("text", F.concat_ws("\n", "label", "text"))


def build_vectors(texts: DataFrame, encode, root: str, signature: str) -> str:
    """Vectors of texts by an injected encoder (a column function)."""
    return publish({"vectors": texts.withColumn("embedding", encode(F.col("text")))}, root, signature)


def export_review(rows: DataFrame, path: str, key: list[str]) -> None:
    """One folder an act, rows as JSON lines in key order with columns in name order, so that files differ only where
    rows do."""
    columns = sorted(c for c in rows.columns if c != "act")
    ordered = rows.select("act", *columns).repartition("act").sortWithinPartitions("act", *key)
    ordered.write.mode("overwrite").partitionBy("act").option("ignoreNullFields", False).json(path)


def round_trip_differs(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables differ as multisets of rows."""
    b = b.select(*a.columns)
    return not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()


_AKN = "http://docs.oasis-open.org/legaldocml/ns/akn/3.0"
_ELEMENTS = {"chapter": "chapter", "part": "part", "division": "division", "subdivision": "subdivision", "section": "section", "clause": "section", "item": "section", "subsection": "subsection", "paragraph": "paragraph", "subparagraph": "subparagraph", "schedule": "hcontainer"}


def _akn(rows: pd.DataFrame) -> str:
    """Nested elements of a document's nodes: each closes those at its depth and deeper."""
    depth = {k: i for i, k in enumerate(("schedule", "chapter", "part", "division", "subdivision", "section", "subsection", "paragraph", "subparagraph"))}
    depth |= {"clause": depth["section"], "item": depth["section"]}
    out, open_, used = [], [], {}
    for r in rows.sort_values("idx").itertuples():
        element = _ELEMENTS.get(r.type)
        if element is None:
            if r.text:
                out.append(f"<content><p>{escape(r.text)}</p></content>" if open_ else f"<p>{escape(r.text)}</p>")
            continue
        while open_ and depth[open_[-1][0]] >= depth[r.type]:
            out.append(f"</{open_.pop()[1]}>")
        eid = "__".join([*(x[2] for x in open_), f"{element}_{r.number or 'x'}"])
        used[eid] = used.get(eid, 0) + 1
        if used[eid] > 1:
            eid = f"{eid}_{used[eid]}"
        out.append(f"<{element} eId={quoteattr(eid)}>")
        if r.number:
            out.append(f"<num>{escape('(' + r.number + ')' if depth[r.type] > depth['section'] else r.number)}</num>")
        if r.heading:
            out.append(f"<heading>{escape(r.heading)}</heading>")
        if r.text:
            out.append(f"<content><p>{escape(r.text)}</p></content>")
        open_.append((r.type, element, eid.rsplit("__", 1)[-1]))
    out += [f"</{e}>" for _, e, _ in reversed(open_)]
    return f'<?xml version="1.0" encoding="UTF-8"?><akomaNtoso xmlns="{_AKN}"><act name="act"><body>{"".join(out)}</body></act></akomaNtoso>'


def to_akn(nodes: DataFrame) -> DataFrame:
    """(doc, xml): each document's nodes (doc, idx, type, number, heading, text) as Akoma Ntoso."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc": [p.doc.iloc[0]], "xml": [_akn(p.astype(object).where(p.notna(), None))]})

    return nodes.groupBy("doc").applyInPandas(run, f"doc {nodes.schema['doc'].dataType.simpleString()}, xml string")


def to_markdown(units: DataFrame) -> DataFrame:
    """(doc, path, content): a page a unit (doc, unit, label, heading, text) and an index of them."""
    name = F.concat(F.lit("sections/"), F.regexp_replace(F.lower("label"), r"[^a-z0-9]+", "-"), F.lit("-"), F.col("unit").cast("string"), F.lit(".md"))
    pages = units.select("doc", "unit", name.alias("path"), F.concat(F.lit("# "), "label", F.lit(" "), F.coalesce("heading", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"), F.concat(F.lit("- ["), "label", F.lit(" "), F.coalesce("heading", F.lit("")), F.lit("]("), name, F.lit(")")).alias("entry"))
    entries = F.array_sort(F.collect_list(F.struct("unit", "entry")))
    index = pages.groupBy("doc").agg(F.concat(F.lit("# Contents\n\n"), F.array_join(F.transform(entries, lambda e: e["entry"]), "\n"), F.lit("\n")).alias("content")).withColumn("path", F.lit("index.md"))
    return pages.select("doc", "path", "content").unionByName(index)
