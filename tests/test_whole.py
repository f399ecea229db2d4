"""Queries over whole texts and all rows: nothing is cut off before the work."""

import difflib

import pytest

from folioscope import plans

LONG = " ".join(f"w{i % 900}" for i in range(2000))
TEXTS = [(1, "a", "one two"), (2, "a", LONG), (3, "a", LONG + " tail"), (4, "b", None), (5, "b", "x y"), (6, "b", None), (7, "b", None), (8, "a", "one two three")]
PAIRS = {2: ("one two", LONG), 3: (LONG, LONG + " tail"), 8: (LONG + " tail", "one two three"), 5: ("", "x y"), 6: ("x y", ""), 7: ("", "")}


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def counted(a, b):
    """Equal, deleted and inserted runs of words, by the standard library's opcodes."""
    tags = [t for t, *_ in difflib.SequenceMatcher(None, a.split(), b.split()).get_opcodes()]
    return [sum(t == "equal" for t in tags), sum(t in ("delete", "replace") for t in tags), sum(t in ("insert", "replace") for t in tags)]


def test_word_diff_takes_long_texts(spark, folder):
    got = {r["doc_id"]: [r[op] for op in ("equal", "delete", "insert")] for r in plans.QUERIES["word_diff"](spark, folder).collect()}
    assert got == {i: counted(a, b) for i, (a, b) in PAIRS.items()}


def test_text_similarity_is_of_whole_texts(spark, folder):
    got = {r["doc_id"]: r["similarity"] for r in plans.QUERIES["text_similarity"](spark, folder).collect()}
    assert got == {i: round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for i, (a, b) in PAIRS.items()} and got[3] < 1
