"""Exact similarity join of documents in the metric space of Jaccard distances.

d(x, y) = 1 - |x & y| / |x | y| is a metric, and documents link within a radius r. Sets that are equal are one class.

Pivots and regions. Documents within r of each other share some of their rarest shingles (as many as a set can lose and
still reach the similarity, and a few more), and their sizes are within a step. Of the documents of two neighbouring steps
with a rare shingle the least is its pivot, and a pivot's region are the documents that it is a pivot of: every link lies
in a region, and documents that share no rare shingle with one of about their size lie in none. As linked sets share
more than a few, a document leaves the regions in which it has only a few shingles by chance. Distances of a region's documents to the pivot are exact; those within r are links.

Windows. By the triangle inequality d(x, y) >= |d(x, p) - d(y, p)|, and d(x, y) >= 1 - min / max of the sizes. A region is
cut into cells by rings of width r around its pivot and by steps of size; documents are at home in one cell and are
replicated into the cells before it that their windows reach.

Recursion. A cell with many documents at home gets several pivots of its own. Each document is at home in the Voronoi
region of the nearest pivot q, and is replicated to a pivot p where d(x, p) <= d(x, q) + 2 r: a partner y with home p has
d(x, p) <= d(y, p) + r <= d(y, q) + r <= d(x, q) + 2 r. The regions are cells again, until they are small or no longer
shrink; then all pairs with a document at home are compared on full sets, in blocks of bounded size.

Links are wanted up to connectedness: what earlier links join is not compared again, and a cell whose documents are all
joined is done. No pairs are emitted but links and distances to pivots, and no link that joins components is lost.

Rare means: by counts of shingles over all documents, kept in a fixed number of buckets. They only order shingles, so
rounding them costs work and never a link. Sets are compared as 64-bit hashes of shingles (a polynomial modulo 2**64,
mixed): chance collisions don't matter at any size of corpus, but texts built to collide could pass as equal.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.llm.components import components
from folioscope.llm.memory import free_shuffles, trimmed
from folioscope.llm.shingles import mix, shingle_sets
from folioscope.session import discard, materialize

WIDTH = 4
PERCENT = 85
#: Buckets of shingle counts (one byte each when shared out).
COUNTERS = 1 << 22
#: A task tells only of buckets with so many holders and so many times its mean.
LEAST_COUNT, TIMES_MEAN = 8, 4
#: Rare shingles beyond those that a set can lose, in percent of it: so many that linked sets share more than a few.
SPARE = 5
#: Documents that meet one copy of their cell's anchors.
CHUNK = 256
#: A cell is small, and a block complete, with so many documents at home and so many shingles in them.
HOME_ROWS = 128
HOME_SHINGLES = 1_000_000
#: Pivots a large cell gets, about.
PIVOTS = 12
#: A cell that keeps more than this share of the cell it comes from is not cut again.
SHRINK = 0.8
#: Hashes of ids that are broadcast to leave out texts before a join.
BUCKETS = 1 << 20
#: Distances are rounded; windows are wider by this.
SLACK = 1e-9


def _count(width: int):
    """(bucket, n): how many documents of the task have shingles of each bucket, where it stands out."""

    def run(batches):
        counts, total = np.zeros(COUNTERS, np.uint32), 0
        for b in batches:
            for _, sets in shingle_sets(b.column("text"), width):
                flat = np.concatenate(sets)
                np.add.at(counts, (flat >> np.uint64(64 - 22)).astype(np.int64), 1)
                total += len(flat)
        many = np.flatnonzero(counts >= LEAST_COUNT + TIMES_MEAN * total // COUNTERS)
        for lo in range(0, len(many), 1 << 16):
            part = many[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part].astype(np.int64))], names=["bucket", "n"])

    return run


def _ranks(docs: DataFrame, width: int) -> bytes:
    """A compressed table of a rank for each bucket, at most one byte each: how often its shingles stand, by powers of two."""
    counted = docs.select("text").mapInArrow(trimmed(_count(width)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counted.select("bucket", F.floor(F.log2("n")).cast("int").alias("rank")).toPandas()
    table = np.zeros(COUNTERS, np.uint8)
    table[rows["bucket"].to_numpy()] = np.minimum(rows["rank"].to_numpy(), 63)
    return zlib.compress(table.tobytes(), 1)


def spare(n: int) -> int:
    """How many rare shingles a set shares at least with another that it links with and that is no smaller."""
    return max(1, n * SPARE // 100)


def _sketch(width: int, percent: int, packed: bytes):
    """A row a document: the size and 128-bit sum of its set, and its rarest shingles."""

    def run(batches):
        ranks = np.frombuffer(zlib.decompress(packed), np.uint8)
        for b in batches:
            for start, sets in shingle_sets(b.column("text"), width):
                n = np.array([len(s) for s in sets], np.int64)
                k1, k2, rare = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), []
                for i, s in enumerate(sets):
                    k1[i], k2[i] = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
                    order = ranks[(s >> np.uint64(64 - 22)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6)
                    most = len(s) - (percent * len(s) + 99) // 100 + spare(len(s)) if len(s) else 0
                    rare.append(np.sort(np.partition(order, most - 1)[:most] if 0 < most < len(order) else order).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(n)), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(rare, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "k1", "k2", "rare"])

    return run


class _Anchors:
    """Sets that all others of a cell's chunk are compared with at once."""

    def __init__(self):
        self.ids, self.comps, self.sets, self.index = [], [], [], None

    def add(self, id_: int, comp: int, set_: np.ndarray) -> None:
        self.ids.append(id_)
        self.comps.append(comp)
        self.sets.append(set_)

    def shared(self, x: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of `x` with each anchor."""
        if self.index is None:
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            self.index = flat[order], owner[order]
            self.n, self.ids, self.comps = np.array([len(s) for s in self.sets]), np.array(self.ids), np.array(self.comps)
        keys, owner = self.index
        lo, hi = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
        n = hi - lo
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else lo
        return np.bincount(owner[first + np.arange(len(first))], minlength=len(self.n))


def _meet(width: int, percent: int, links_only: bool):
    """Rows (cell, chunk, role, class, comp, text), sorted: a chunk's anchors (role 0), then the documents that meet them
    (1: at home as well, 2: replicas). All distances (cell, class, anchor, d, linked), or the links between components."""

    def run(batches):
        at, anchors = None, None
        for b in batches:
            cells, chunks, roles, classes, comps = (b.column(c).to_pylist() for c in ("cell", "chunk", "role", "class", "comp"))
            out: list[list] = [[], [], [], [], []]
            for first, sets in shingle_sets(b.column("text"), width):
                for i, x in enumerate(sets, first):
                    if (cells[i], chunks[i]) != at:
                        at, anchors = (cells[i], chunks[i]), _Anchors()
                    if roles[i] == 0:
                        anchors.add(classes[i], comps[i], x)
                        continue
                    if not anchors.sets:
                        continue
                    both = anchors.shared(x)
                    union = anchors.n + len(x) - both
                    linked = 100 * both >= percent * union
                    if links_only:
                        some = np.flatnonzero(linked & (anchors.comps != comps[i]) & ((anchors.ids < classes[i]) | (roles[i] == 2)))
                        some = some[np.unique(anchors.comps[some], return_index=True)[1]]
                    else:
                        some = np.arange(len(both))
                    for to, values in zip(out, ([cells[i]] * len(some), [classes[i]] * len(some), anchors.ids[some].tolist(), (1 - both[some] / union[some]).tolist(), linked[some].tolist())):
                        to += values
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["cell", "class", "anchor", "d", "linked"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int, home_rows: int, pivots: int):
        self.spark, self.width, self.percent, self.home_rows, self.pivots = docs.sparkSession, width, percent, home_rows, pivots
        self.radius = 1 - percent / 100
        self.source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def texts_of(self, classes: DataFrame) -> DataFrame:
        """(class, text): the distinct texts of the classes named.

        Texts that no class can have stay where they are: hashes of the classes, of which there are BUCKETS at most, are
        broadcast first."""
        own = classes.select(F.col("class").alias("doc_id")).distinct()
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        some = self.source.withColumn("__bucket", bucket).join(F.broadcast(own.select(bucket.alias("__bucket")).distinct()), "__bucket", "left_semi").drop("__bucket")
        named = some.join(own, "doc_id", "left_semi")
        return materialize(named.groupBy(F.col("doc_id").alias("class"), F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h"), "texts")

    def meet(self, anchors: DataFrame, others: DataFrame, texts: DataFrame, links_only: bool) -> DataFrame:
        """Anchors (cell, class, comp) meet others (cell, role, class, comp) on full sets; anchors travel once a chunk."""
        chunks = materialize(others.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
        a = anchors.join(chunks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "class", "comp")
        o = others.join(chunks, "cell").select("cell", F.pmod(F.xxhash64("class"), "chunks").cast("int").alias("chunk"), "role", "class", "comp")
        rows = a.union(o).join(texts, "class").select("cell", "chunk", "role", "class", "comp", "text")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        rows = rows.repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk", "role")
        met = materialize(rows.mapInArrow(trimmed(_meet(self.width, self.percent, links_only)), "cell long, class long, anchor long, d double, linked boolean"), "met")
        discard(chunks)
        return met

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """Every row's set (doc_id, n_shingles, k1, k2), and the distinct sets (class, k1, k2, n_shingles, rare)."""
        rare = _sketch(self.width, self.percent, _ranks(self.source, self.width))
        sketch = materialize(self.source.mapInArrow(trimmed(rare), "doc_id long, n_shingles long, k1 long, k2 long, rare array<long>"), "sketch")
        filled = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
        unique = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("class"), F.first("rare").alias("rare"), F.first("n_shingles").alias("n_shingles"))
        unique = materialize(unique, "unique")
        slim = materialize(sketch.drop("rare"), "sets")
        discard(sketch)
        free_shuffles(self.spark)
        return slim, unique

    def step(self) -> Column:
        """A number for each size of a set; sets that link differ by one at most."""
        return F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(self.percent / 100) + SLACK).cast("int")

    def regions(self, unique: DataFrame) -> DataFrame:
        """(cell, class, n_shingles): the documents of each pivot's region (cell: the pivot), without the pivot.

        A rare shingle's documents are first parted by size: a step's documents and the next step's have a pivot."""
        tokens = unique.select("class", "n_shingles", F.explode("rare").alias("token"))
        shared = materialize(tokens.groupBy("token").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("token"), "shared")
        sized = tokens.join(shared, "token").select("token", "class", "n_shingles", F.explode(F.array(self.step(), self.step() - 1)).alias("step"))
        sized = materialize(sized, "sized")
        discard(shared)
        pivots = materialize(sized.groupBy("token", "step").agg(F.min("class").alias("pivot"), F.max("class").alias("last")).where("pivot < last").drop("last"), "pivots")
        counted = sized.join(pivots, ["token", "step"]).groupBy("pivot", "step", "class").agg(F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
        # Linked sets share at least `least` rare shingles. Each gives up its smallest regions while these have less than
        # half of that, so that one shared shingle's region at least is kept by both. A pivot keeps its own.
        smaller = F.ceil(F.col("n_shingles") * self.percent / 100).cast("long")
        least = F.greatest(F.lit(1), F.floor(smaller * SPARE / 100))
        ordered = Window.partitionBy("class", "step").orderBy((F.col("class") == F.col("pivot")), "n", "pivot")
        kept = counted.withColumn("sum", F.sum("n").over(ordered)).where((F.col("class") == F.col("pivot")) | (2 * F.col("sum") >= least))
        held = kept.where("class <> pivot").groupBy(F.col("pivot").alias("cell"), "class").agg(F.max("n_shingles").alias("n_shingles"))
        held = materialize(held, "regions")
        for used in (pivots, sized):
            discard(used)
        free_shuffles(self.spark)
        return held

    def cells(self, members: DataFrame) -> DataFrame:
        """Cells (cell, class, home, comp, n_shingles, was) of regions (cell, class, comp, n_shingles, d).

        Documents none of whose windows has another component are done and left out."""
        placed = members.withColumn("ring", F.floor(F.col("d") / (self.radius + SLACK)).cast("int")).withColumn("step", self.step())
        seen = placed.groupBy("cell", "ring", "step").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        at = lambda pairs: F.array(*[F.struct((F.col("ring") + i).alias("ring"), (F.col("step") + j).alias("step")) for i, j in pairs])
        around = seen.select("cell", F.explode(at(near)).alias("at"), "lo", "hi").groupBy("cell", "at.ring", "at.step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
        around = materialize(around.drop("lo", "hi"), "around")
        open_ = placed.join(around, ["cell", "ring", "step"])
        # Each pair of neighbouring cells is looked at in one of them.
        before = [(0, 0), (0, -1), (-1, 1), (-1, 0), (-1, -1)]
        spread = open_.select("cell", "class", "comp", "n_shingles", F.posexplode(at(before)))
        return spread.select(F.xxhash64("cell", "col.ring", "col.step").alias("cell"), "class", (F.col("pos") == 0).alias("home"), "comp", "n_shingles", F.lit(None).cast("long").alias("was"))

    def within(self, cells: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Links found in the cells, and the cells that their large ones were cut into (None: there were none)."""
        h = F.col("home").cast("long")
        stats = cells.groupBy("cell").agg(F.sum(h).alias("homes"), F.sum(h * F.col("n_shingles")).alias("weight"), F.count("*").alias("rows"), F.max("was").alias("was"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        blocks = F.greatest(F.ceil(F.col("homes") / self.home_rows), F.ceil(F.col("weight") / HOME_SHINGLES)).cast("int")
        large = (F.col("blocks") > 1) & (F.col("homes") > 2 * self.pivots) & (F.col("was").isNull() | (F.col("rows") < SHRINK * F.col("was")))
        stats = stats.where("homes > 0 AND rows > 1 AND lo < hi").withColumn("blocks", blocks).select("cell", "homes", "rows", "blocks", large.alias("large"))
        stats = materialize(stats, "stats")
        all_ = materialize(cells.drop("was").join(stats, "cell"), "cells")
        texts = self.texts_of(all_)
        # Small cells: all pairs with a document at home.
        small = all_.where("NOT large")
        own = F.pmod(F.xxhash64("class"), "blocks").cast("int")
        anchors = small.where("home").select(F.xxhash64("cell", own).alias("cell"), "class", "comp")
        others = small.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.when(F.col("home"), 1).otherwise(2).alias("role"), "class", "comp").select(F.xxhash64("cell", "block").alias("cell"), "role", "class", "comp")
        found = self.meet(anchors, others, texts, True)
        links = found.select(F.col("class").alias("a"), F.col("anchor").alias("b"))
        # Large cells: Voronoi regions of their own pivots.
        rest, new = all_.where("large"), None
        if not rest.isEmpty():
            first = rest.where("home").groupBy("cell").agg(F.min("class").alias("first"))
            chosen = F.pmod(F.xxhash64("class", "cell"), F.greatest(F.lit(1), F.floor(F.col("homes") / self.pivots))) == 0
            pivots = materialize(rest.where("home").join(first, "cell").where(chosen | (F.col("class") == F.col("first"))).select("cell", "class", "comp"), "chosen")
            dist = self.meet(pivots, rest.select("cell", F.lit(1).alias("role"), "class", "comp"), texts, False)
            links = links.union(dist.where("linked AND class <> anchor").select(F.col("class").alias("a"), F.col("anchor").alias("b")))
            # A class of several texts is as near as its nearest.
            nearest = dist.groupBy("cell", "class", "anchor").agg(F.min("d").alias("d")).groupBy("cell", "class").agg(F.sort_array(F.collect_list(F.struct("d", "anchor"))).alias("to"))
            reach = F.filter("to", lambda x: x["d"] <= F.col("to")[0]["d"] + 2 * self.radius + SLACK)
            placed = nearest.select("cell", "class", F.posexplode(reach))
            new = placed.join(rest, ["cell", "class"]).select(F.xxhash64("cell", "col.anchor").alias("cell"), "class", (F.col("home") & (F.col("pos") == 0)).alias("home"), "n_shingles", F.col("rows").alias("was"))
            new = materialize(new, "regions")
            discard(pivots)
        for used in (texts, all_, stats):
            discard(used)
        return links, new


def similar_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, home_rows: int = HOME_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text).

    Documents link where 100 * intersection >= percent * union of their sets of `width`-word shingles; component_id is
    the least doc_id reachable. Null texts and texts without words have an empty set and link with nothing. Rows that
    repeat a doc_id are one document, linked where any of its texts is. Rows with a null doc_id have a null component.
    Other columns of `docs` are ignored; an empty table gives an empty result."""
    join = _Join(docs, width, percent, home_rows, pivots)
    sketch, unique = join.classes()
    members = join.regions(unique)
    texts = join.texts_of(members.select("class").union(members.select(F.col("cell").alias("class"))))
    pivots_ = members.select("cell", F.col("cell").alias("class"), F.col("cell").alias("comp")).distinct()
    stars = join.meet(pivots_, members.select("cell", F.lit(1).alias("role"), "class", F.col("class").alias("comp")), texts, False)
    discard(texts)
    free_shuffles(docs.sparkSession)
    links = stars.where("linked").select(F.col("class").alias("a"), F.col("anchor").alias("b"))
    # A doc_id that repeats with several sets joins their classes.
    filled = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "k1", "k2")
    repeated = filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    own = filled.join(repeated, "doc_id").distinct().join(unique.select("k1", "k2", "class"), ["k1", "k2"])
    links = links.union(own.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b")))
    comp = components(links)

    def with_comp(rows: DataFrame, column: str = "class", name: str = "comp") -> DataFrame:
        return rows.join(comp.select(F.col("node").alias(column), "component"), column, "left").withColumn(name, F.coalesce("component", column)).drop("component")

    distances = stars.groupBy("cell", "class").agg(F.min("d").alias("d"))
    cells = join.cells(with_comp(members.join(distances, ["cell", "class"])))
    while cells is not None:
        more, cells = join.within(cells)
        more = materialize(with_comp(with_comp(more, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "more")
        if not more.isEmpty():
            # New links join components: a small graph, whose components take in the old ones.
            above = materialize(components(more), "above").select(F.col("node").alias("component"), F.col("component").alias("__top"))
            old = comp.join(above, "component", "left").select("node", F.coalesce("__top", "component").alias("component"))
            new = above.select(F.col("component").alias("node"), F.col("__top").alias("component")).join(comp.select("node"), "node", "left_anti")
            comp = materialize(old.union(new), "components")
        if cells is not None:
            cells = with_comp(cells)
    final = comp
    named = unique.select("k1", "k2", "class").join(final.withColumnRenamed("node", "class"), "class", "left").select("k1", "k2", F.coalesce("component", "class").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), cut AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' '))) END AS s FROM words
), sets AS (SELECT doc_id, s, len(s) AS n FROM cut
), classes AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s, any_value(n) AS n FROM sets WHERE n > 0 GROUP BY list_sort(s)
), shingles AS (SELECT doc_id, n, unnest(s) AS x FROM classes
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), copies AS (SELECT s.doc_id AS a, c.doc_id AS b FROM sets s JOIN classes c ON list_sort(s.s) = c.s WHERE s.doc_id <> c.doc_id
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, b FROM copies UNION SELECT b, a FROM copies
), reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), least_of AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN least_of l ON l.node = s.doc_id
"""
