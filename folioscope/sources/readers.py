"""Readers. Schemas are given, never inferred; strict readers fail on what they don't know."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from folioscope.functions.text import front_matter, version_of, work_of

LINE = "page int, y0 double, x0 double, x1 double, size double, bold boolean, lbi string, text string"
BODY_LINE = "struct<text:string,x0:double,x1:double,y0:double,y1:double,page_no:int,size:double,bold:boolean,leading_bold_italic:string>"
PAGE = f"page_no int, body string, page_width double, margin_notes array<string>, margin_note_rects array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>, header array<string>, footer array<string>, body_lines array<{BODY_LINE}>"
NODE = "id string, type string, number string, heading string, text string, page_start int, page_end int, path map<string,string>, history array<struct<raw:string,kind:string>>"
LINK = "clause_number string, schedule string, act_section_number string, act_schedule string, similarity double, status string"


def slug_of_path(path):
    """File name without folders and endings."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z.]+)?$", 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Flat line files (<slug>.lines.json, one array a file) as doc, line_no and the line's columns."""
    rows = spark.read.schema(LINE).option("multiLine", True).json(path).select("*", slug_of_path(F.col("_metadata.file_path")).alias("doc"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("doc").orderBy("page", "y0", "x0")) - 1)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted pages as JSON, with their document."""
    return spark.read.schema(PAGE).option("multiLine", True).json(path).select("*", slug_of_path(F.col("_metadata.file_path")).alias("doc"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Pages to the line table the parsers read."""
    flat = pages.select("doc", "page_no", F.posexplode("body_lines").alias("at", "l")).select("doc", F.col("page_no").alias("page"), "at", "l.text", "l.x0", "l.x1", "l.y0", "l.size", "l.bold")
    return flat.withColumn("line_no", F.row_number().over(Window.partitionBy("doc").orderBy("page", "at")) - 1).drop("at")


def read_parses(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents (<work>-vN.json) as nodes: work, version, idx and the node's columns."""
    schema = T.StructType([T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(NODE)))])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    slug = slug_of_path(F.col("_metadata.file_path"))
    rows = doc.select(slug.alias("slug"), F.posexplode("nodes").alias("idx", "n"))
    return rows.select(work_of(F.col("slug")).alias("work"), version_of(F.col("slug")).alias("version"), "idx", "n.*")


def discover_versions(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(slug, work, version, path, modified, length) of the versioned files of a folder, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    named = files.withColumn("slug", slug_of_path(F.col("path"))).withColumn("version", version_of(F.col("slug")))
    return named.where("version IS NOT NULL").withColumn("work", work_of(F.col("slug"))).orderBy("work", "version")


def stamps(versions: DataFrame) -> DataFrame:
    """One content stamp a work, from its files' times and sizes."""
    parts = F.array_sort(F.collect_list(F.struct("version", F.col("modified").cast("string"), "length")))
    return versions.groupBy("work").agg(F.sha2(F.to_json(parts).cast("binary"), 256).alias("stamp"))


def read_front_matter(texts: DataFrame) -> DataFrame:
    """(doc, version, as_at, ...) of first pages (doc, text)."""
    return texts.select("doc", front_matter(F.col("text")).alias("f")).select("doc", "f.*")


def read_review(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Review tables (act=<act>/<table>.jsonl): a malformed line or a column that the schema lacks is an error."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    names = F.json_object_keys("value")
    known = F.array(*(F.lit(f.name) for f in T.StructType.fromDDL(schema)))
    bad = F.when(names.isNull(), F.raise_error(F.concat(F.lit("malformed row: "), F.col("value")))).when(F.size(F.array_except(names, known)) > 0, F.raise_error(F.concat(F.lit("unknown column in: "), F.col("value")))).otherwise(F.lit(True))
    rows = raw.where(bad)
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), *(["act"] if "act" in raw.columns else [])).select("r.*", *(["act"] if "act" in raw.columns else []))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link documents; unreadable files are skipped."""
    doc = spark.read.schema(f"bill_slug string, em_slug string, act_slug string, links array<struct<{LINK.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return doc.where("links IS NOT NULL")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Act registry: one row a title, later rows win."""
    rows = spark.read.schema("title string, act_no string, year string, in_force boolean, pos long").json(path)
    return rows.groupBy("title").agg(F.max_by(F.struct("act_no", "year", "in_force"), "pos").alias("r")).select("title", "r.*")


def read_yaml(text: str, required: dict[str, type], optional: dict[str, type] | None = None) -> dict:
    """A small settings file on the driver; unknown and missing keys, and values of a wrong kind, are errors."""
    import yaml

    loaded = yaml.safe_load(text) or {}
    allowed = required | (optional or {})
    for key, value in loaded.items():
        if key not in allowed:
            raise ValueError(f"unknown key {key!r}")
        if not isinstance(value, allowed[key]):
            raise ValueError(f"{key!r} is not a {allowed[key].__name__}")
    missing = sorted(set(required) - set(loaded))
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return loaded


def read_evaluation(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Judged queries: each row has query, doc and page, and may have a group."""
    for r in rows:
        if not all(r.get(k) for k in ("query", "doc", "page")):
            raise ValueError(f"incomplete row: {r}")
    return spark.createDataFrame([(r["query"], r["doc"], str(r["page"]), r.get("group", "core")) for r in rows], "query string, doc string, page string, grp string")


def registry_rows(lines: DataFrame, cuts: list[float]) -> DataFrame:
    """Cells of a printed table by fixed column edges: doc, row (by height), cells in columns."""
    column = F.lit(0)
    for c in cuts:
        column = column + (F.col("x0") >= c).cast("int")
    cells = lines.withColumn("col", column).withColumn("row", F.round("y0").cast("int"))
    joined = cells.groupBy("doc", "page", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("cell"))
    return joined.groupBy("doc", "page", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("cell"))).alias(f"c{k}") for k in range(len(cuts) + 1)))


def safe_slug(slug: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", slug) or ".." in slug:
        raise ValueError(f"not a slug: {slug!r}")
    return slug
