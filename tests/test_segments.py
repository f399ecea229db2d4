"""An index of segments equals one that is built anew, after every commit."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search as S
from folioscope.sources import segments as G

NODE = "node_id long, heading string, body string"


def rebuilt(nodes, terms):
    ranks = {r["node_id"]: round(r["rank"], 9) for r in S.bm25(nodes, terms).collect()}
    return ranks, {r["term"]: r["cnt"] for r in S.vocabulary(nodes).collect()}


def test_commits_equal_a_rebuild(spark, tmp_path):
    rnd, root = random.Random(3), f"file://{tmp_path}/index"
    words = ["court", "act", "law", "judge", "é", "of"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))
    held = {}
    with pytest.raises(ValueError):
        G.opened(spark, root)
    for step in range(5):
        new = {i: (rnd.choice([None, text()]), text()) for i in rnd.sample(range(14), 5)}
        gone = rnd.sample(range(20), 3) if step else []
        held = {i: v for i, v in held.items() if i not in gone} | new
        frame = lambda d: spark.createDataFrame([(i, *v) for i, v in d.items()], NODE)
        removed = spark.createDataFrame([(i,) for i in gone if i not in new], "node_id long")
        before = G.opened(spark, root) if step else None
        assert G.update(root, frame(new), removed) == step + 1 + (step > 3)
        if step == 3:
            assert G.merge(spark, root) == 5 and G.merge(spark, root) == 5 and len(G.manifest(spark, root)[1]) == 1
        index = G.opened(spark, root)
        ranks, counts = rebuilt(frame(held), ["court", "law"])
        assert {r["node_id"]: round(r["rank"], 9) for r in S.bm25_stored(index, ["court", "law"]).collect()} == ranks
        assert {r["term"]: r["cnt"] for r in index["word"].collect()} == counts
        assert {r["node_id"]: (r["heading"], r["body"]) for r in index["node"].collect()} == held
        if before is not None:
            before["node"].count()  # what was opened before stays readable
    with pytest.raises(RuntimeError):
        G._commit(spark, root, 2, [(2, None, None)])
