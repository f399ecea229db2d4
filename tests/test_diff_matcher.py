"""The matcher of differences against the standard library's."""

import difflib
import random
import time

from folioscope.functions import diff as D


def test_blocks_are_the_librarys():
    rnd = random.Random(4)
    for size in (0, 1, 5, 40, 150, 250, 900):
        for letters in (2, 12, 60, 400):
            for junk in (True, False):
                a = [rnd.randrange(letters) for _ in range(size)]
                b = [x for x in a if rnd.random() < 0.8] + [rnd.randrange(letters) for _ in range(rnd.randint(0, 60))]
                for old, new in ((a, b), (b, a), ("".join(chr(97 + x) for x in a), "".join(chr(97 + x) for x in b))):
                    lib, own = difflib.SequenceMatcher(None, old, new, autojunk=junk), D.Matcher(old, new, junk)
                    assert own.get_opcodes() == lib.get_opcodes() and own.ratio() == lib.ratio()


def test_beyond_the_pairs_held(monkeypatch):
    monkeypatch.setattr(D, "MOST_PAIRS", 3)
    own = D.Matcher("abcabc", "xabcab")
    assert own.pairs is None and own.get_opcodes() == difflib.SequenceMatcher(None, "abcabc", "xabcab").get_opcodes()


def test_long_texts_cost_less_than_the_librarys_walk():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("etaoinshrdlucmfwygpbvk") for _ in range(rnd.randint(2, 9)))
    pairs = [[" ".join(f"{word()}{chr(rnd.randint(200, 400))}" for _ in range(600)) for _ in "ab"] for _ in range(8)]

    def seconds(find):
        began = time.process_time()
        found = [find(a, b) for a, b in pairs]
        return time.process_time() - began, found

    (own, got), (lib, expected) = seconds(lambda a, b: D.Matcher(a, b).ratio()), seconds(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())
    assert got == expected and own < 0.6 * lib


def test_words_are_cut_once_a_text(spark):
    """A difference of many segments costs no cutting of the text a segment."""
    from pyspark.sql import functions as F

    old, new = (" ".join(f"w{i}" if i % 2 else f"{side}{i}" for i in range(12000)) for side in "xy")
    began = time.perf_counter()
    got = spark.createDataFrame([(old, new)], "old string, new string").select(D.word_diff(F.col("old"), F.col("new")).alias("d")).select(F.size("d").alias("n"), *(D.side_text(F.col("d"), side).alias(side) for side in ("old", "new"))).first()
    assert (got["n"], got["old"], got["new"]) == (18000, old, new) and time.perf_counter() - began < 20
