"""Language of texts by a convolutional network over bytes, trained and run in numpy.

Filters of two, three and four bytes slide over fixed-length windows of a text (one-hot bytes, so a filter is a table
of byte values a position), each keeps its largest response in the window (max pooling, then a rectifier), and a
softmax layer turns the pooled responses into languages. For prediction, filter tables are summed into tables of byte
pairs. All windows of a text count, by their bytes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed
from folioscope.llm.quality import below, held_out
from folioscope.llm.shingles import slices, string_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documented bound of training: at most about this many labelled documents (one of each language at least), evenly
#: over the languages.
TRAIN_DOCS = 8_000
#: Steps of training for up to so many languages; more languages train in proportion longer.
STEPS, STEP_LANGS = 700, 32
BATCH = 64
UND = "und"
CHUNK = 96
_STRIDE = WINDOW - max(WIDTHS) + 1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class LangModel:
    langs: list[str]
    filters: list[np.ndarray]  # a width x 256 x FILTERS table for each width
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, tables by byte pairs (and a last single byte) whose rows add up to the response."""
        out = []
        for f in self.filters:
            f = f.astype(np.float32)
            tables = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(f) - 1, 2)]
            out.append(tables + ([f[-1]] if len(f) % 2 else []))
        return out

    def logits(self, windows: np.ndarray, tables=None) -> np.ndarray:
        tables = tables or self.pair_tables()
        pooled = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(windows), CHUNK):
            x = windows[a : a + CHUNK].astype(np.int32)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            for i, (w, parts) in enumerate(zip(WIDTHS, tables)):
                n = WINDOW - w + 1
                total = parts[0].take(pairs[:, :n], axis=0)
                for k, t in enumerate(parts[1:], 1):
                    total += t.take(pairs[:, 2 * k : 2 * k + n] if 2 * k + 1 < w else x[:, 2 * k : 2 * k + n], axis=0)
                pooled[a : a + CHUNK, i * FILTERS : (i + 1) * FILTERS] = total.max(axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.offset


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (zero-padded), the text of each, and the bytes each adds; empty texts have none."""
    size = np.diff(offsets)
    n = np.where(size > 0, np.maximum(-(-(size - (WINDOW - _STRIDE)) // _STRIDE), 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    start = (np.arange(len(text)) - first[text]) * _STRIDE
    real = np.minimum(size[text] - start, WINDOW)
    at = (offsets[:-1][text] + start)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < real[:, None]
    out = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((0, WINDOW), np.uint8)
    return out.astype(np.uint8), text, np.minimum(real, _STRIDE).astype(np.float64)


def fit(windows: np.ndarray, target: np.ndarray, langs: list[str], seed: int = 11, steps: int = STEPS) -> LangModel:
    """Train by Adam on windows; gradients reach each filter only at its largest response."""
    rng = np.random.default_rng(seed)
    n_lang, units = len(langs), len(WIDTHS) * FILTERS
    p = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS] + [np.full(units, 0.1), rng.normal(0, 1 / np.sqrt(units), (units, n_lang)), np.zeros(n_lang)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    by_lang = [np.flatnonzero(target == k) for k in range(n_lang)]
    for step in range(1, steps + 1):
        y = rng.integers(0, n_lang, BATCH)
        x = windows[[rng.choice(by_lang[k]) for k in y]].astype(np.int64)
        # Some windows are cut short, as short texts are.
        cut = np.where(rng.random(BATCH) < 0.4, rng.integers(6, WINDOW, BATCH), WINDOW)
        x[np.arange(WINDOW) >= cut[:, None]] = 0
        pooled, peaks = [], []
        for f, w in zip(p, WIDTHS):
            n = WINDOW - w + 1
            r = f[0][x[:, :n]]
            for k in range(1, w):
                r += f[k][x[:, k : k + n]]
            at = r.argmax(axis=1)
            peaks.append(at)
            pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
        h = np.concatenate(pooled, axis=1) + p[-3]
        a = np.maximum(h, 0)
        z = a @ p[-2] + p[-1]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(BATCH), y] -= 1
        q /= BATCH
        back = (q @ p[-2].T) * (h > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            g = np.zeros_like(p[i])
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(w):
                np.add.at(g[k], (np.take_along_axis(x, peaks[i] + k, 1), np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        grads += [back.sum(axis=0), a.T @ q, q.sum(axis=0)]
        rate = 0.02 * (1 - step / (steps + 1))
        for i, g in enumerate(grads):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return LangModel(langs, [x.astype(np.float32) for x in p[:3]], p[3].astype(np.float32), p[4].astype(np.float32), p[5].astype(np.float32))


def train(docs: DataFrame, rows: int = TRAIN_DOCS, excluded: tuple[int, int] = (4, 2), seed: int = 11) -> LangModel | None:
    """Fit on documents with text and lang whose crc32(doc_id) mod excluded[0] is not excluded[1].

    Every lang value is learned (one row each is gathered). Each lends about the same number of documents, those with
    the least hashes of doc_id and text, so that a repeated doc_id neither fills nor empties the sample; of each
    document at most two windows at hashed places, equal ones once. None where there is nothing to learn from."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").where(~held_out("doc_id", *excluded))
    counts = own.groupBy("lang").count().collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    each = max(1, rows // len(langs))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, __share double")
    ordered = F.xxhash64("doc_id", "text", F.lit(seed))
    sampled = own.join(F.broadcast(shares), "lang").where(below(ordered, F.col("__share"))).select("lang", "doc_id", "text")

    def cut(batches):
        for b in batches:
            lang, windows = [], []
            for k, doc, text in zip(b.column("lang").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                raw = text.as_py().encode()
                spare = len(raw) - WINDOW
                starts = [0] if spare <= 0 else sorted({(doc or 0) * 7919 % (spare + 1), (doc or 0) * 104729 % (spare + 1)})
                lang += [k] * len(starts)
                windows += [raw[s : s + WINDOW] for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    # The few languages whose expected sample is a handful may miss it by chance: their least hash is taken as well.
    windows_of_rows = sampled.mapInArrow(trimmed(cut), "lang string, window binary").distinct()
    got = windows_of_rows.orderBy(F.xxhash64("lang", "window"), "lang", "window").limit(4 * max(rows, len(langs))).collect()
    place = {k: i for i, k in enumerate(langs)}
    missing = sorted(set(langs).difference(r["lang"] for r in got))
    if missing:
        rest = own.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in missing], "lang string")), "lang")
        least = rest.groupBy("lang").agg(F.min_by(F.struct("doc_id", "text"), ordered).alias("x"))
        got += least.select("lang", "x.doc_id", "x.text").mapInArrow(trimmed(cut), "lang string, window binary").collect()
    # One order whatever the tasks' order.
    pairs = sorted((place[r["lang"]], bytes(r["window"])) for r in got)
    if not pairs:
        return None
    windows = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    target = np.array([k for k, _ in pairs])
    seen = np.unique(target)
    return fit(windows, np.searchsorted(seen, target), [langs[k] for k in seen], seed, STEPS * -(-len(seen) // STEP_LANGS))


class Predictor:
    def __init__(self, model: LangModel | None):
        self.model = model
        self.tables = model.pair_tables() if model else None

    def __call__(self, column) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of an Arrow column."""
        data, offsets = string_buffers(column)
        lang, score = [UND] * len(column), np.zeros(len(column))
        if self.model is None:
            return lang, score
        for lo, hi in slices(offsets, 1 << 20):
            part = offsets[lo : hi + 1]
            base = part[0]
            own = data[base : part[-1]]
            letters = np.concatenate([[0], np.cumsum(_LETTER[own])])
            has = letters[part[1:] - base] > letters[part[:-1] - base]
            for i in np.flatnonzero(~has & (np.diff(part) > 0)):
                has[i] = any(c.isalpha() for c in own[part[i] - base : part[i + 1] - base].tobytes().decode())
            windows, text, weight = windows_of(own, part - base)
            if not len(windows):
                continue
            z = self.model.logits(windows, self.tables).astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
            total = np.zeros((hi - lo, z.shape[1]))
            np.add.at(total, text, z * weight[:, None])
            total /= np.maximum(np.bincount(text, weight, minlength=hi - lo), 1)[:, None]
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i in np.flatnonzero(has).tolist():
                lang[lo + i] = self.model.langs[best[i]]
                score[lo + i] = p[i, best[i]]
        return lang, score


_PREDICTORS: dict[int, Predictor] = {}


def _predictor(packed) -> Predictor:
    """One predictor a worker and model."""
    key = hash(packed)
    if key not in _PREDICTORS:
        _PREDICTORS.clear()
        _PREDICTORS[key] = Predictor(pickle.loads(packed))
    return _PREDICTORS[key]


def predict(docs: DataFrame, model: LangModel | None, excluded: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs`; `und` with score 0 for null texts, texts without a
    letter, and where nothing could be learned. Repeated rows repeat results; other columns are ignored."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        own = _predictor(packed.value)
        for b in batches:
            lang, score = own(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out("doc_id", *excluded))
    return rows.select("doc_id", "held_out", "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: LangModel | None, least: float = 0.5, langs: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is known with at least the score `least` (and is one
    of `langs`, where given).

    Null texts and texts without a letter go (their language is `und`), and so does every row where nothing could be
    learned; repeated rows stay or go together; columns of any name pass through; an empty table gives an empty
    result."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        own = _predictor(packed.value)
        for b in batches:
            lang, score = own(b.column("text"))
            yield b.filter(pa.array([k != UND and s >= least and (not langs or k in langs) for k, s in zip(lang, score.tolist())], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
