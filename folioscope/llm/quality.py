"""Quality scores from document statistics: random Fourier features, ridge regression and isotonic calibration.

Random Fourier features of standardised statistics approximate a Gaussian kernel. Each partition sums its part of the
normal equations; the sums meet on the driver (one small matrix a training partition, whose number is fixed) and give
the ridge weights. Scores are calibrated by isotonic regression on training rows that the ridge fit left out.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed
from folioscope.llm.shingles import SEPARATOR, slices, string_buffers, word_hashes
from folioscope.session import discard, materialize

#: Documented bound: at most about this many labelled rows train the model, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
FEATURES = 256
TRAIN_PARTITIONS = 12
THRESHOLD = 0.3

_CLASSES = ("lower", "upper", "digit", "space", "newline", "high", "stop", "comma", "mark", "bar", "symbol", "bracket")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), np.int64)
    for name, chars in (
        ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", bytes(range(48, 58))), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"),
        ("high", bytes(range(128, 256))), ("stop", b"."), ("comma", b",;:'\"-"), ("mark", b"!?"), ("bar", b"|"), ("bracket", b"()[]{}<>"),
    ):
        table[list(chars)] = _CLASSES.index(name)
    return table


CLASS = _class_table()
N_STATS = len(_CLASSES) + 12


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]] (empty: 0)."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text (rows x N_STATS); an empty text has zeros."""
    n = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    text, cut = data[lo:hi], offsets - lo
    size = np.diff(cut).astype(np.float64)
    safe = np.maximum(size, 1)
    out = np.zeros((n, N_STATS))
    kinds = CLASS[text].astype(np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(cut))
    counts = np.bincount(row * len(_CLASSES) + kinds, minlength=n * len(_CLASSES)).reshape(n, -1)[:n]
    out[:, : len(_CLASSES)] = np.sqrt(counts / safe[:, None])
    # Words: length, repetition, and what they start and end with.
    words, word_at = word_hashes(data, offsets)
    n_words = np.diff(word_at).astype(np.float64)
    safe_words = np.maximum(n_words, 1)
    inside = ~SEPARATOR[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = cut[:-1][cut[:-1] < len(text)]
    begins[first] = inside[first]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    stop = np.flatnonzero(ends)
    length = (stop - start + 1).astype(np.float64)
    mean = _row_sums(length, word_at) / safe_words
    var = np.maximum(_row_sums(length**2, word_at) / safe_words - mean**2, 0)
    upper, symbol = kinds == _CLASSES.index("upper"), kinds >= _CLASSES.index("mark")
    k = len(_CLASSES)
    out[:, k] = np.log1p(n_words)
    out[:, k + 1] = np.log1p(mean)
    out[:, k + 2] = np.sqrt(var) / np.maximum(mean, 1)
    out[:, k + 3] = _row_sums(symbol[stop], word_at) / safe_words
    out[:, k + 4] = _row_sums(upper[start], word_at) / safe_words
    out[:, k + 5] = _row_sums(upper[start] & upper[stop], word_at) / safe_words
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist())], np.float64)
    out[:, k + 6] = distinct / safe_words
    out[:, k + 7] = _row_sums(length == 1, word_at) / safe_words
    out[:, k + 8] = _row_sums(length > 12, word_at) / safe_words
    # Lines.
    lines = counts[:, _CLASSES.index("newline")] + 1.0
    out[:, k + 9] = np.log1p(size / lines)
    # Adjacent bytes: how often the kind changes, and how often a byte repeats.
    change = np.zeros(len(text), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    same = np.zeros(len(text), bool)
    same[1:] = text[1:] == text[:-1]
    change[first] = same[first] = False  # a text's first byte follows none
    out[:, k + 10] = _row_sums(change, cut) / safe
    out[:, k + 11] = np.sqrt(_row_sums(same, cut) / safe)
    out[size == 0] = 0
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale, self.projection, self.phase)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def fourier(x: np.ndarray, projection: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    z = np.cos(x @ projection + phase) * np.sqrt(2 / len(phase))
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing least-squares fit (pool adjacent violators; equal x pooled first)."""
    knots, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    means = np.bincount(inverse, y) / n
    stack: list[list[float]] = []  # mean, weight, first, last
    for i, (m, w) in enumerate(zip(means.tolist(), n.tolist())):
        stack.append([m, w, i, i])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            m2, w2, _, last = stack.pop()
            m1, w1, first, _ = stack[-1]
            stack[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last]
    xs = [knots[k] for s in stack for k in ((s[2], s[3]) if s[3] > s[2] else (s[2],))]
    ys = [s[0] for s in stack for _ in range(2 if s[3] > s[2] else 1)]
    return np.array(xs), np.array(ys)


def held_out(doc_id, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def below(hashed, share):
    """Whether a 64-bit hash lies among the least `share` (0 to 1, number or column) of all values; exact enough for
    shares far below one in a million, and everything at 1."""
    share = share if hasattr(share, "cast") else F.lit(float(share))
    return (share >= 1) | (hashed.cast("double") < share * float(1 << 64) - float(1 << 63))


def _stats_batches(batches, extra: list[str]):
    for b in batches:
        data, offsets = string_buffers(b.column("text"))
        for lo, hi in slices(offsets):
            yield statistics(data, offsets[lo : hi + 1]), [b.column(c).slice(lo, hi - lo) for c in extra], b.slice(lo, hi - lo)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES, ridge: float = 1e-3, seed: int = 7, excluded: tuple[int, int] = (5, 0)) -> QualityModel:
    """Fit on labelled rows whose crc32(doc_id) mod excluded[0] is not excluded[1].

    At most `rows` labelled rows are used: about so many doc_ids with the least hashes (the share follows from a
    count), and of the documents with those ids, which may repeat without bound, distinct ones with the least hashes.
    Every fifth of them, by another hash, is left for calibration. Rows whose labels disagree count with each; null
    labels don't count. Without labels, or with one label only, all scores are that label's share (or 0.5)."""
    spark = docs.sparkSession
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(~held_out("doc_id", *excluded)).dropDuplicates()
    n, positive = usable.agg(F.count("*"), F.sum("quality")).first()
    share = min(1.0, rows / n) if n else 1.0
    sampled = usable.where(below(F.xxhash64("doc_id", F.lit(seed)), share))
    # The sample's size is bounded by `rows`, so it may be broadcast.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sampled), "doc_id")

    def describe(batches):
        for stats, (ids, quality), _ in _stats_batches(batches, ["doc_id", "quality"]):
            yield pa.RecordBatch.from_arrays([ids, quality, pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "quality", "stats"])

    rows_of = text.mapInArrow(trimmed(describe), "doc_id long, quality double, stats array<double>").distinct()
    described = materialize(rows_of.orderBy(F.xxhash64("doc_id", "stats", F.lit(seed)), "doc_id", "quality", "stats").limit(rows), "quality-train")
    moments = described.select("quality", *(F.col("stats")[i].alias(f"s{i}") for i in range(N_STATS))).agg(F.count("*").alias("n"), *(f(f"s{i}") for i in range(N_STATS) for f in (F.avg, F.stddev_pop))).first()
    rng = np.random.default_rng(seed)
    projection, phase = rng.normal(size=(N_STATS, features)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, features)
    if not moments[0]:
        zero = np.zeros(features + 1)
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), projection, phase, zero, np.array([0.0]), np.array([positive / n if n else 0.5]))
    mean = np.array([moments[1 + 2 * i] for i in range(N_STATS)])
    scale = np.array([moments[2 + 2 * i] for i in range(N_STATS)])
    scale[scale < 1e-9] = 1.0
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5))
    parts = described.withColumn("__fold", part).repartition(TRAIN_PARTITIONS, "doc_id")

    def sums(batches):
        size = features + 1
        gram, moment = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            fit = b.column("__fold").to_numpy(zero_copy_only=False) != 0
            x = np.array(b.column("stats").flatten().to_numpy(zero_copy_only=False)).reshape(-1, N_STATS)[fit]
            z = fourier((x - mean) / scale, projection, phase)
            gram += z.T @ z
            moment += z.T @ b.column("quality").to_numpy(zero_copy_only=False)[fit]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], names=["gram", "moment"])

    size = features + 1
    gram, moment = np.zeros((size, size)), np.zeros(size)
    for r in parts.mapInArrow(trimmed(sums), "gram binary, moment binary").toLocalIterator():
        gram += np.frombuffer(r["gram"]).reshape(size, size)
        moment += np.frombuffer(r["moment"])
    penalty = np.full(size, ridge * max(gram[-1, -1], 1.0))
    penalty[-1] = 1e-9
    weights = np.linalg.solve(gram + np.diag(penalty), moment)
    model = QualityModel(mean, scale, projection, phase, weights, np.array([0.0]), np.array([0.5]))
    # The calibration rows, a fifth of the bounded sample.
    left = described.withColumn("__fold", part).where("__fold = 0").select("quality", "stats").collect()
    if not left:
        left = described.limit(rows).select("quality", "stats").collect()
    x, y = model.raw(np.array([r["stats"] for r in left])), np.array([r["quality"] for r in left])
    knots, values = isotonic(x, y)
    # Isotonic ends of 0 and 1 are certain only up to the rows seen.
    tail = 1 / (len(y) + 2)
    model.knots, model.values = knots, np.clip(values, tail, 1 - tail)
    discard(described)
    return model


def _packed(model: QualityModel) -> bytes:
    return pickle.dumps(model)


def score_documents(docs: DataFrame, model: QualityModel, excluded: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`; null text is empty; other columns are ignored."""
    packed = docs.sparkSession.sparkContext.broadcast(_packed(model))

    def run(batches):
        own = pickle.loads(packed.value)
        for stats, (ids, held), _ in _stats_batches(batches, ["doc_id", "held_out"]):
            score = own.score(stats)
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out("doc_id", *excluded))
    return rows.select("doc_id", "held_out", "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `threshold`, with all their columns.

    Null and empty texts are scored as empty ones; repeated rows stay or go together; columns of any name pass
    through; an empty table gives an empty result."""
    packed = docs.sparkSession.sparkContext.broadcast(_packed(model))

    def run(batches):
        own = pickle.loads(packed.value)
        for stats, _, batch in _stats_batches(batches, []):
            yield batch.filter(pa.array(own.score(stats) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
