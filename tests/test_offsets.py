"""Offset maps both ways against a map letter by letter, and the guard of inherited reviews."""

import random
import re
import time

from pyspark.sql import functions as F

from folioscope.functions import offsets as O
from folioscope.operators import inheritance as H


def brute(text):
    """The shown text, and for each of its places (and the end) the stored place."""
    text = text or ""
    wide = any(len(x) > 120 for x in text.split("\n"))
    chars, pos = [], 0
    for m in re.finditer(r"\s*\n\s*", text):
        chars += [(text[j], j) for j in range(pos, m.start())]
        bullet = m.end() < len(text) and text[m.end()] in "•▪●◦"
        inner = m.start() > 0 and m.end() < len(text)
        chars += [(c, m.start()) for c in ("\n" if inner and bullet else "\n\n" if inner and wide else " ")]
        pos = m.end()
    chars += [(text[j], j) for j in range(pos, len(text))]
    ends = [*[o for _, o in chars], len(text)]
    a, b = 0, len(chars)
    while a < b and chars[a][0].isspace():
        a += 1
    while b > a and chars[b - 1][0].isspace():
        b -= 1
    return "".join(c for c, _ in chars[a:b]), ends[a:b] + [ends[b]]


def test_maps_letter_by_letter(spark):
    rnd = random.Random(2)
    pool = ["word", "é", " ", "\n", "\n\n", " \n ", "• point", "x" * 130, "end.", "\t", "▪"]
    texts = [None, "", "\n a \n", "\n\n", "• a\n• b", "accused\nmeans a person"] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "id int, text string").withColumn("m", O.reflowed(F.col("text")))
    shown = {r["id"]: (r["t"], r["places"], r["back"]) for r in d.select("id", F.col("m.text").alias("t"), F.transform(F.sequence(F.lit(0), F.length("m.text")), lambda p: O.to_stored(F.col("m"), p)).alias("places"), F.transform(F.sequence(F.lit(0), F.coalesce(F.length("text"), F.lit(0))), lambda p: O.to_shown(F.col("m"), p)).alias("back")).collect()}
    for i, text in rows:
        expected, offsets = brute(text)
        got, places, back = shown[i]
        assert got == expected
        # The end: where the text ends, or where the white space behind it begins.
        assert places[:-1] == offsets[:-1] and places[-1] >= (offsets[-2] if len(offsets) > 1 else 0)
        for at, raw in enumerate(places[:-1]):
            if at == 0 or places[at - 1] != raw:
                assert back[raw] == at, (text, at, raw)
    spans = d.where("id = 5").select(O.stored_span(F.col("m"), F.lit(8), F.lit(13)).alias("s"), O.stored_span(F.col("m"), F.lit(3), F.lit(3)).alias("none")).first()
    assert tuple(spans["s"]) == (8, 13) and spans["none"] is None


def test_guard(frame):
    pieces = frame([("w", v, "k", p) for v, ps in ((1, "ab"), (2, "ba"), (3, "abc"), (4, "aab")) for p in ps] + [("w", 2, "j", "x")], "work string, version int, key string, piece string")
    status = frame([("w", "k", v, s, f) for v, s, f in ((1, "inherits", 2), (2, "reviewed", 2), (3, "inherits", 2), (4, "inherits", 2), (5, "inherits", 2), (6, "follows", 7))], "work string, key string, version int, status string, source int")
    got = {r["version"]: (r["status"], r["source"]) for r in H.guarded(status, pieces).collect()}
    assert got == {1: ("inherits", 2), 2: ("reviewed", 2), 3: ("to_review", None), 4: ("inherits", 2), 5: ("to_review", None), 6: ("follows", 7)}
    blocked = H.guarded(status, pieces, frame([("w", 1, "k"), ("w", 2, "k")], "work string, version int, key string"))
    assert {r["version"]: r["status"] for r in blocked.collect()}[1] == "to_review"
    rows = frame([("w", 1, "k", "a"), ("w", 2, "k", "b"), ("w", 2, "k", "a"), ("w", 9, "k", "a")], "work string, version int, key string, piece string")
    cover = H.unit_coverage(pieces, rows, frame([("w", 1, "k"), ("w", 3, "k")], "work string, version int, key string"), frame([("w", 3, "k", "c")], "work string, version int, key string, piece string"))
    assert {(r["version"], r["key"]): (r["pieces"], r["covered"], r["reviewed"], r["blocked"]) for r in cover.collect()} == {(1, "k"): (2, 1, True, False), (2, "k"): (2, 2, True, False), (3, "k"): (3, 0, False, True), (4, "k"): (2, 0, False, False), (2, "j"): (1, 0, False, False)}


def test_a_long_text_costs_what_its_lines_cost(spark):
    """A text of several blocks of lines equals the brute force; many lines don't cost their square."""
    text = "".join(f"{'• ' if i % 7 == 0 else ''}line {i} {'é' * (i % 5)} \n" for i in range(4000))
    began = time.perf_counter()
    got = spark.createDataFrame([(text,)], "text string").select(O.reflowed(F.col("text")).alias("m")).select("m.text", F.size("m.map").alias("n"), O.to_stored(F.col("m"), F.lit(30000)).alias("at")).first()
    assert time.perf_counter() - began < 15
    expected, offsets = brute(text)
    assert got["text"] == expected and got["at"] == offsets[30000] and got["n"] == 8000
