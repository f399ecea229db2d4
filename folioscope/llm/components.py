"""Connected components of a link table by hooking, pointer doubling and contraction, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.session import discard, materialize


def _ups(edges: DataFrame) -> DataFrame:
    """(node, up, open): the least of a node and its neighbours. A node is open if it has a lesser neighbour and others
    beside it; where none is open, every component is a star around its least node."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("w")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("w")))
    near = both.groupBy("node").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return near.select("node", F.least("lo", "node").alias("up"), F.expr("lo < node AND lo < hi").alias("open"))


def _doubled(ups: DataFrame) -> DataFrame:
    """(node, up, open): four steps up at once; open where they lead higher than two."""
    above = lambda x: x.select(F.col("node").alias("up"), F.col("up").alias("top"))
    two = ups.select("node", "up").join(above(ups), "up").select("node", F.col("top").alias("up"))
    return two.join(above(two), "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("open"))


def _any_open(ups: DataFrame) -> bool:
    return bool(ups.agg(F.max("open")).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node reachable.

    In a round each node hooks onto the least node next to it, the trees are flattened, and the links between trees are
    the next round's. A node onto which nothing hooks has only lesser neighbours a round later, so nodes fall to half in
    two rounds at least. Rounds end as soon as all components are stars, which the minima show. Centres with any number of
    links are handled by pre-aggregated minima and joins of tables, which can be split; steps go to the shared folder."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), "edges")
    out = None
    while True:
        ups = materialize(_ups(now), "ups")
        last = not _any_open(ups)
        if not last:
            while True:
                new = materialize(_doubled(ups), "ups")
                discard(ups)
                ups = new
                if not _any_open(ups):
                    break
        root = lambda x, name: ups.select(F.col("node").alias(x), F.col("up").alias(name))  # noqa: B023, E731
        if out is None:
            out = ups.select("node", F.col("up").alias("component"))
            kept = ups
        else:
            new = materialize(out.join(root("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
            discard(kept)
            out = kept = new
        if not last:
            between = now.join(root("u", "x"), "u").join(root("v", "y"), "v").where("x <> y")
            new = materialize(between.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
            last = new.isEmpty()
        discard(now)
        if ups is not kept:
            discard(ups)
        if last:
            return out
        now = new
