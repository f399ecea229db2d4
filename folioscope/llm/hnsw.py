"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph a shard.

Rows are dealt to shards of bounded size by a hash. A shard's graph is built layer by layer from the top: each layer
holds a share of the nodes below it, nodes enter in batches, each batch finds its neighbours by beam search from the
layer above (and among itself), and a neighbour is kept if it is nearer to the node than to the neighbours kept before
it. Vectors get one more component that gives all of a shard the same length, so that the largest inner product is
the least distance. A shard is stored as flat arrays: vectors, and for each layer its nodes and their neighbours.
Equal vectors are one node with several row ids. Blocks of queries visit every shard, all queries of a block in step,
and the shards' results are merged by exact inner products in double precision.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.llm.memory import trimmed
from folioscope.session import fanout, materialize

SHARD_ROWS = 8192
LINKS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 160
BATCH = 256
STEP = 4
ENTRIES = 8
QUERY_BLOCK = 512


class Layer:
    """Nodes of a layer and their neighbours, as a flat array of rows padded with -1."""

    def __init__(self, nodes: np.ndarray, width: int, total: int):
        self.nodes = nodes
        self.neighbours = np.full((len(nodes), width), -1, np.int32)
        self.row = np.full(total, -1, np.int32)
        self.row[nodes] = np.arange(len(nodes), dtype=np.int32)


def beam(vectors: np.ndarray, layer: Layer, queries: np.ndarray, entries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The `size` nearest nodes found for each query (ids with -1 for none, similarities), nearest first.

    All queries advance in step; each expands its nearest few open nodes at a time until none in its beam is open."""
    b = len(queries)
    rows = np.arange(b)
    seen = np.zeros((b, len(layer.nodes)), bool)
    ids = np.full((b, size), -1, np.int32)
    sims = np.full((b, size), -np.inf, np.float32)
    done = np.ones((b, size), bool)
    new = entries
    live = rows
    while True:
        at = np.where(new >= 0, layer.row[new], 0)
        fresh = (new >= 0) & ~seen[live[:, None], at]
        near = np.einsum("bkd,bd->bk", vectors[np.where(fresh, new, 0)], queries[live])
        near[~fresh] = -np.inf
        # A node can come from several expanded nodes: only its first place counts.
        order = np.argsort(new, axis=1, kind="stable")
        ranked = np.take_along_axis(new, order, 1)
        again = np.zeros_like(fresh)
        np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        near[again] = -np.inf
        r, c = np.nonzero(fresh)
        seen[live[r], at[r, c]] = True
        all_ids = np.concatenate([ids[live], new], axis=1)
        all_sims = np.concatenate([sims[live], near], axis=1)
        all_done = np.concatenate([done[live], np.zeros_like(fresh)], axis=1)
        best = np.argpartition(-all_sims, size - 1, axis=1)[:, :size]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1) | np.isneginf(sims[live])
        live = live[~done[live].all(axis=1)]
        if not len(live):
            break
        open_sims = np.where(done[live], -np.inf, sims[live])
        k = min(STEP, size)
        pick = np.argpartition(-open_sims, k - 1, axis=1)[:, :k]
        some = ~np.take_along_axis(done[live], pick, 1)
        done[live[:, None], pick] = True
        chosen = np.where(some, np.take_along_axis(ids[live], pick, 1), -1)
        new = np.where((chosen >= 0)[:, :, None], layer.neighbours[layer.row[np.maximum(chosen, 0)]], -1).reshape(len(live), -1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(np.isneginf(sims), -1, np.take_along_axis(ids, order, 1)), sims


def choose(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates (sorted by falling similarity, -1 for none): first those nearer to the
    row's own node than to any kept before, then the nearest others."""
    v = vectors[np.maximum(ids, 0)]
    between = v @ v.transpose(0, 2, 1)
    valid = ids >= 0
    blocked, kept, count = ~valid, np.zeros_like(valid), np.zeros(len(ids), np.int64)
    for c in range(ids.shape[1]):
        take = ~blocked[:, c] & (count < most)
        kept[:, c] = take
        count += take
        blocked |= take[:, None] & (between[:, c, :] > sims)
    rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(valid, ids, -1), rank, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def _sorted_top(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _link_back(vectors: np.ndarray, layer: Layer, source: np.ndarray, links: np.ndarray) -> None:
    """Offer each new link's source to its target, which keeps the best of old and new neighbours."""
    width = layer.neighbours.shape[1]
    u, v = np.repeat(source, links.shape[1]), links.reshape(-1)
    u, v = u[v >= 0], v[v >= 0]
    if not len(u):
        return
    sim = np.einsum("kd,kd->k", vectors[u], vectors[v])
    order = np.lexsort((-sim, v))
    u, v = u[order], v[order]
    targets, first, n = np.unique(v, return_index=True, return_counts=True)
    place = np.arange(len(v)) - np.repeat(first, n)
    fits = place < width
    offered = np.full((len(targets), min(width, int(n.max()))), -1, np.int32)
    offered[np.repeat(np.arange(len(targets)), n)[fits], place[fits]] = u[fits]
    for a in range(0, len(targets), 512):
        t = targets[a : a + 512]
        at = layer.row[t]
        ids = np.concatenate([layer.neighbours[at], offered[a : a + 512]], axis=1)
        ranked = np.sort(ids, axis=1)
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
        sims = np.einsum("bkd,bd->bk", vectors[np.maximum(ranked, 0)], vectors[t])
        sims[ranked < 0] = -np.inf
        layer.neighbours[at] = choose(vectors, *_sorted_top(ranked, sims, ids.shape[1]), width)


class Graph:
    """A shard's index over distinct vectors."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]):
        self.vectors, self.layers = vectors, layers  # layers from the top; vectors with the added component

    @staticmethod
    def build(points: np.ndarray, seed: int = 0) -> Graph:
        length = np.einsum("nd,nd->n", points, points, dtype=np.float64)
        extra = np.sqrt(np.maximum(length.max() - length, 0))
        vectors = np.concatenate([points, extra[:, None]], axis=1).astype(np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS)).astype(int), 12)
        layers: list[Layer] = []
        for k in range(int(level.max()), -1, -1):
            # Nodes of the layer above come first, so that every entry point is already linked.
            nodes = np.flatnonzero(level >= k)
            nodes = nodes[np.argsort(-level[nodes], kind="stable")].astype(np.int32)
            layer = Layer(nodes, LINKS * 2 if k == 0 else LINKS, n)
            graph = Graph(vectors, layers)
            at = 0
            while at < len(nodes):
                new = nodes[at : at + max(1, min(BATCH, at))]
                links = np.zeros((len(new), 0), np.int32)
                sims = np.zeros((len(new), 0), np.float32)
                if at:
                    entry = graph.entries(vectors[new]) if layers else np.full((len(new), 1), nodes[0], np.int32)
                    entry = np.where((entry >= 0) & (layer.row[entry] < at), entry, nodes[0])
                    links, sims = beam(vectors, layer, vectors[new], entry, BUILD_BEAM)
                among = vectors[new] @ vectors[new].T
                np.fill_diagonal(among, -np.inf)
                links = np.concatenate([links, np.broadcast_to(new, (len(new), len(new)))], axis=1)
                links, sims = _sorted_top(links, np.concatenate([sims, among], axis=1), BUILD_BEAM)
                kept = choose(vectors, np.where(np.isneginf(sims), -1, links), sims, LINKS)
                layer.neighbours[layer.row[new], :LINKS] = kept
                _link_back(vectors, layer, new, kept)
                at += len(new)
            layers.append(layer)
        return Graph(vectors, layers)

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Nodes found nearest in the lowest layer there is so far, a few a query (-1 for none)."""
        entry = np.full((len(queries), 1), self.layers[0].nodes[0], np.int32)
        for layer in self.layers:
            entry = beam(self.vectors, layer, queries, entry, ENTRIES)[0]
        return entry

    def search(self, queries: np.ndarray, least: int, size: int = SEARCH_BEAM) -> np.ndarray:
        """Ids of the nodes found nearest to each query (-1 for none), `least` of them if there are so many.

        Where links lead to fewer (a small group of near vectors may link to itself alone), the search starts again
        from all nodes of the layer above, and then from all nodes."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        upper, base, n = Graph(self.vectors, self.layers[:-1]), self.layers[-1], len(self.vectors)
        entry = upper.entries(q) if upper.layers else np.full((len(q), 1), base.nodes[0], np.int32)
        size = min(max(size, least), n)
        out = beam(self.vectors, base, q, entry, size)[0]
        for start in [x.nodes for x in upper.layers[-1:]] + [base.nodes]:
            few = np.flatnonzero(np.count_nonzero(out >= 0, axis=1) < min(least, n))
            for a in range(0, len(few), 16):
                some = few[a : a + 16]
                out[some] = beam(self.vectors, base, q[some], np.broadcast_to(start, (len(some), len(start))), size)[0]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"vectors": self.vectors} | {f"nodes{i}": x.nodes for i, x in enumerate(self.layers)} | {f"neighbours{i}": x.neighbours for i, x in enumerate(self.layers)}

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> Graph:
        layers = []
        while f"nodes{len(layers)}" in arrays:
            i = len(layers)
            layer = Layer(arrays[f"nodes{i}"], 1, len(arrays["vectors"]))
            layer.neighbours = arrays[f"neighbours{i}"]
            layers.append(layer)
        return Graph(arrays["vectors"], layers)


def _matrix(column) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, embedding (doubles) of the rows that take part."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & some).select("vec_id", F.size("embedding").alias("dim"), "embedding")


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """A table of shards (dim, shard, index) over every usable row, and the number of shards a dimension."""
    rows = usable(vectors)
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    # The position spreads a vec_id that repeats.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def build(key, part):
        dim, shard = (k.as_py() for k in key)
        ids = part.column("vec_id").combine_chunks().to_numpy()
        points = _matrix(part.column("embedding").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        _, first, of = np.unique(points, axis=0, return_index=True, return_inverse=True)
        of = of.reshape(-1)
        # Rows of a node, by rising vec_id.
        by_node = np.argsort(of, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(of))])
        graph = Graph.build(points[first], seed=shard)
        blob = _pack(points=points[first], rows=ids[by_node], starts=starts, **graph.arrays())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "index": pa.array([blob], pa.binary())})

    built = dealt.repartition(max(shards, fanout(vectors)), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, index binary")
    return materialize(built, "hnsw"), shards


def _blocks(batches):
    """Blocks of queries of one dimension."""
    for b in batches:
        dims = b.column("dim").to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == d))
            for a in range(0, part.num_rows, QUERY_BLOCK):
                x = part.slice(a, QUERY_BLOCK)
                blob = _pack(ids=x.column("vec_id").to_numpy(zero_copy_only=False), points=_matrix(x.column("embedding")))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([blob], pa.binary())], names=["dim", "block"])


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = 20, size: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found for each usable row of `queries`."""
    asked = usable(queries).groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding"))
    blocks = materialize(asked.select("vec_id", "dim", "embedding").mapInArrow(trimmed(_blocks), "dim int, block binary"), "queries")
    visits = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def visit(batches):
        held = None
        for b in batches:
            for j in range(b.num_rows):
                key = b.column("dim")[j].as_py(), b.column("shard")[j].as_py()
                if held is None or held[0] != key:
                    arrays = dict(np.load(io.BytesIO(b.column("index")[j].as_py())))
                    held = key, arrays, Graph.of(arrays)
                asked = np.load(io.BytesIO(b.column("block")[j].as_py()))
                ids, points, arrays = asked["ids"], asked["points"], held[1]
                q, v, s = [], [], []
                for a in range(0, len(ids), BATCH):
                    found = held[2].search(points[a : a + BATCH], k + 1, size)
                    for i, nodes in enumerate(found, a):
                        nodes = nodes[nodes >= 0]
                        score = arrays["points"][nodes] @ points[i]
                        order = np.argsort(-score, kind="stable")
                        # Equal scores at the cut: all their nodes take part, so that the smaller vec_id wins.
                        cut = score[order[min(k, len(order) - 1)]]
                        take_v, take_s = [np.zeros(0, np.int64)], [np.zeros(0)]
                        for at in order[score[order] >= cut].tolist():
                            first, last = arrays["starts"][nodes[at]], arrays["starts"][nodes[at] + 1]
                            rows = np.unique(arrays["rows"][first:last])[: k + 1]
                            take_v.append(rows)
                            take_s.append(np.full(len(rows), score[at]))
                        vs, ss = np.concatenate(take_v), np.concatenate(take_s)
                        other = vs != ids[i]
                        vs, ss = vs[other], ss[other]
                        best = np.lexsort((vs, -ss))[:k]
                        q.append(np.full(len(best), ids[i]))
                        v.append(vs[best])
                        s.append(ss[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, v, s)], names=["query_id", "vec_id", "score"])

    met = visits.join(index, ["dim", "shard"]).select("dim", "shard", "block", "index")
    found = met.mapInArrow(trimmed(visit), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The `k` nearest other rows of each row whose vec_id is divisible by `every`.

    Vectors null, zero, or with null or non-finite components take no part, nor do null vec_ids. Only vectors of the
    query's dimension are compared. A vec_id that repeats is one candidate with its best score, never a neighbour of
    itself, and one query (by the least of its vectors). Ties go to the smaller vec_id. Other columns are ignored; an
    empty table gives an empty result."""
    index, shards = build_index(vectors, shard_rows)
    return search_index(index, shards, vectors.where(F.col("vec_id") % every == 0), k)
