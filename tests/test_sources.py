import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioscope.sources import readers as IN
from folioscope.sources import writers as OUT
from folioscope.streaming import incremental as INC


def test_lines_and_versions(spark, tmp_path):
    row = {"page": 1, "y0": 5.0, "x0": 1.0, "x1": 2.0, "size": 12.0, "bold": True, "lbi": None, "text": "x"}
    (tmp_path / "evidence-act-v13.lines.json").write_text(json.dumps([row, row | {"y0": 1.0, "text": "first"}]))
    lines = IN.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["doc"], r["text"]) for r in lines] == [("evidence-act-v13", "first"), ("evidence-act-v13", "x")]
    (tmp_path / "notes.txt").write_text("")
    v = IN.discover_versions(spark, str(tmp_path))
    assert [(r["work"], r["version"]) for r in v.collect()] == [("evidence-act", 13)] and IN.stamps(v).count() == 1


def test_parses(spark, tmp_path):
    (tmp_path / "a-v2.json").write_text(json.dumps({"nodes": [{"type": "section", "number": "1"}, {"type": "note", "text": "t"}]}))
    got = IN.read_parses(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["work"], r["version"], r["idx"], r["type"]) for r in got] == [("a", 2, 0, "section"), ("a", 2, 1, "note")]


def test_review_is_strict(spark, tmp_path):
    rows = spark.createDataFrame([("x", "n2", 1), ("x", "n1", 2), ("y", "n1", None)], "act string, node string, v int")
    path = str(tmp_path / "review")
    OUT.export_review(rows, path, ["node"])
    back = IN.read_review(spark, path, "node string, v int")
    assert not OUT.round_trip_differs(rows, back)
    text = next((tmp_path / "review" / "act=x").glob("*.json")).read_text()
    assert text.index("n1") < text.index("n2")
    for bad in ('{"node": "a", "other": 1}', "{nope"):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception, match="unknown column|malformed"):
            IN.read_review(spark, str(tmp_path / "bad.jsonl"), "node string, v int").collect()


def test_yaml():
    assert IN.read_yaml("a: x", {"a": str}) == {"a": "x"}
    for text in ("b: 1", "a: [1]", ""):
        with pytest.raises(ValueError):
            IN.read_yaml(text, {"a": str})
    for slug in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            IN.safe_slug(slug)


def test_index_is_swapped_whole(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "Who", "may appeal")], "node_id int, heading string, body string")
    root = str(tmp_path / "index")
    assert OUT.published(spark, root) is None
    first = OUT.build_index(nodes, root, "s1")
    assert OUT.build_index(nodes, root, "s1") == first and OUT.build_index(nodes, root, "s2") != first
    assert {r["term"] for r in OUT.open_index(spark, root)["posting"].collect()} == {"who", "may", "appeal"}


def test_documents_out(spark):
    import xml.etree.ElementTree as ET

    nodes = spark.createDataFrame([(1, 0, "section", "1", "Purposes", "a < b"), (1, 1, "subsection", "1", None, "x"), (1, 2, "note", None, None, "n"), (1, 3, "section", "1", None, "again")], "doc int, idx int, type string, number string, heading string, text string")
    root = ET.fromstring(OUT.to_akn(nodes).first()["xml"])
    assert [e.get("eId") for e in root.iter() if e.get("eId")] == ["section_1", "section_1__subsection_1", "section_1_2"]
    units = spark.createDataFrame([(1, 1, "Section 1", "Purposes", "text")], "doc int, unit int, label string, heading string, text string")
    assert {r["path"] for r in OUT.to_markdown(units).collect()} == {"sections/section-1-1.md", "index.md"}


def test_refresh(spark):
    stamps = spark.createDataFrame([("a", "1"), ("b", "2")], "work string, stamp string")
    done = spark.createDataFrame([("a", "1"), ("b", "1")], "work string, stamp string")
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "work string, v int")
    rows, _ = INC.refresh(stamps, done, stored, lambda w: w.select("work", F.lit(9).alias("v")))
    assert {tuple(r) for r in rows.collect()} == {("a", 1), ("b", 9)}


def test_wording_stream(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [("u", day + datetime.timedelta(minutes=i), v) for i, v in enumerate("aabba")]
    spark.createDataFrame(rows, "k string, ts timestamp, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v string").parquet(str(tmp_path / "in"))
    q = INC.wording_stream(stream, "k", "ts", "v").writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["value"], r["members"]) for r in spark.table("spans").orderBy("since").collect()] == [("a", 2), ("b", 2)]
