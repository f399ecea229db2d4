"""Differences of wordings. Words are cut and segments put together by column expressions; only the matching itself, the
standard library's, runs in Python, on arrays of words or keys and giving spans of numbers."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from folioscope.functions.offsets import held


def _struct(**kinds) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in kinds.items()]))


#: Pairs of equal values that are held at once, about 150 MB while they are sorted; beyond, the library's own index serves.
MOST_PAIRS = 2 << 20
_INT = T.IntegerType()
_SPAN = _struct(same=T.BooleanType(), i=_INT, m=_INT, j=_INT, n=_INT)
_ALIGNED = _struct(old=_INT, new=_INT, found=_SPAN)


class Matcher(difflib.SequenceMatcher):
    """The standard library's matcher, with its very blocks, for sequences without junk of the caller's own: the pairs of
    equal values and the length of the run that ends in each are found once, and a call looks at those of its range."""

    def __init__(self, old, new, junk: bool = True):
        self.pairs = _pairs(*_codes(old, new), junk)
        if self.pairs is None:
            super().__init__(None, old, new, autojunk=junk)
        else:
            self.a, self.b, self.matching_blocks, self.opcodes = old, new, None, None

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        if self.pairs is None:
            return super().find_longest_match(alo, ahi, blo, bhi)
        a, b, (first, at, other, runs) = self.a, self.b, self.pairs
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        i, j, n, part = alo, blo, 0, slice(first[alo], first[ahi])
        if part.start < part.stop:
            inside = np.minimum(np.minimum(runs[part], at[part] - (alo - 1)), other[part] - (blo - 1))
            inside[other[part] >= bhi] = 0
            best = int(inside.argmax())  # of equal ones the first in a, then in b
            if inside[best] > 0:
                n = int(inside[best])
                i, j = int(at[part.start + best]) - n + 1, int(other[part.start + best]) - n + 1
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        return difflib.Match(i, j, n)


def _codes(old, new) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of two texts or lists, equal for equal values."""
    if isinstance(old, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for x in (old, new))
    numbers: dict = {}
    return tuple(np.fromiter((numbers.setdefault(x, len(numbers)) for x in side), np.int64, len(side)) for side in (old, new))


def _pairs(a: np.ndarray, b: np.ndarray, junk: bool) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray] | None:
    """Pairs of places with equal values, by place in a, then in b, and the length of the run of pairs that ends in each;
    before them, where each place of a begins. With `junk`, values that make up over a hundredth of a long b pair with
    nothing, as in the library. None where the pairs would fill too much memory."""
    if not len(a) or not len(b):
        return [0] * (len(a) + 1), *[np.zeros(0, np.int32)] * 3
    values, counts = np.unique(b, return_counts=True)
    by_value, starts = np.argsort(b, kind="stable"), np.cumsum(counts) - counts
    value = np.minimum(np.searchsorted(values, a), len(values) - 1)
    n = np.where(values[value] == a, counts[value], 0)
    if junk and len(b) >= 200:
        n[n > len(b) // 100 + 1] = 0
    first = np.concatenate([[0], np.cumsum(n)])
    if first[-1] > MOST_PAIRS:
        return None
    at = np.repeat(np.arange(len(a)), n)
    other = by_value[np.repeat(starts[value] - first[:-1], n) + np.arange(first[-1])]
    order = np.argsort((other - at) * (len(a) + 1) + at, kind="stable")
    goes_on = (np.diff((other - at)[order], prepend=len(b) + 1) == 0) & (np.diff(at[order], prepend=-2) == 1)
    k = np.arange(len(order))
    runs = np.empty(len(order), np.int32)
    runs[order] = k - np.maximum.accumulate(np.where(goes_on, 0, k)) + 1
    return first.tolist(), at.astype(np.int32), other.astype(np.int32), runs


def spans(old: list[str], new: list[str], junk: bool = True) -> list[tuple[bool, int, int, int, int]]:
    """Alternating spans that are the same or not: (same, first and number in old, first and number in new). `junk`
    lets the matcher pass over words that make up over a hundredth of long texts."""
    ops = Matcher(old, new, junk).get_opcodes()
    return [(tag == "equal", i0, i1 - i0, j0, j1 - j0) for tag, i0, i1, j0, j1 in ops]


def _rows(found) -> list[dict]:
    return [dict(zip(("same", "i", "m", "j", "n"), s)) for s in found]


@F.pandas_udf(_SPAN)
def _matched(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for olds, news in parts:
        yield pd.Series([None if a is None else _rows(spans(list(a), list(b))) for a, b in zip(olds, news)], dtype=object)


def alignment(old_keys: list[str], new_keys: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places that belong together, in both orders; a place without a partner stands alone."""
    for same, i, m, j, n in spans(old_keys, new_keys, False):
        if same:
            yield from zip(range(i, i + m), range(j, j + n))
        else:
            yield from ((x, None) for x in range(i, i + m))
            yield from ((None, x) for x in range(j, j + n))


@F.pandas_udf(_ALIGNED)
def _aligned(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch in parts:
        out = []
        for old_keys, old, new_keys, new in zip(*batch):
            words = lambda side, at: [] if at is None else list(side[at])
            out.append([{"old": i, "new": j, "found": _rows(spans(words(old, i), words(new, j)))} for i, j in alignment(list(old_keys), list(new_keys))])
        yield pd.Series(out, dtype=object)


@F.pandas_udf(T.DoubleType())
def _ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([1.0 if (x or "") == (y or "") else Matcher(x or "", y or "").ratio() for x, y in zip(a, b)])


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def _segments(found: Column, old: Column, new: Column) -> Column:
    """Segments of spans over two arrays of words: what differs is a deletion, then an insertion."""
    cut = lambda op, words, at, n: F.struct(F.lit(op).alias("op"), F.array_join(F.slice(words, at + 1, n), " ").alias("text"))
    both = lambda s: F.array(cut("delete", old, s["i"], s["m"]), cut("insert", new, s["j"], s["n"]))
    parts = F.transform(found, lambda s: F.when(s["same"], F.array(cut("equal", old, s["i"], s["m"]))).otherwise(both(s)))
    return F.filter(F.flatten(parts), lambda x: x["text"] != "")


def word_diff(old: Column, new: Column) -> Column:
    """Segments of two wordings; equal ones never reach Python."""
    a, b = _words(old), _words(new)
    differ = ~a.eqNullSafe(b)
    found = _matched(F.when(differ, a), F.when(differ, b))
    same = F.filter(F.array(F.struct(F.lit("equal").alias("op"), F.array_join(a, " ").alias("text"))), lambda x: x["text"] != "")
    cut = held(F.struct(found.alias("found"), a.alias("old"), b.alias("new")), lambda t: _segments(t["found"], t["old"], t["new"]))
    return F.when(differ, cut).otherwise(same)


def node_diff(old_keys: Column, old_texts: Column, new_keys: Column, new_texts: Column) -> Column:
    """Pieces (op, old, new, diff) of two lists of (key, normal text): aligned by key, words compared where keys align;
    `changed` where an aligned piece's words differ."""
    old, new = F.transform(old_texts, _words), F.transform(new_texts, _words)
    none = F.array().cast("array<string>")
    of = lambda side, at: F.when(at.isNull(), none).otherwise(F.get(side, at))
    piece = lambda t: lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new"), held(F.struct(of(t["old"], p["old"]).alias("old"), of(t["new"], p["new"]).alias("new")), lambda w: _segments(p["found"], w["old"], w["new"])).alias("diff"))
    with_diff = held(F.struct(_aligned(old_keys, old, new_keys, new).alias("found"), old.alias("old"), new.alias("new")), lambda t: F.transform(t["found"], piece(t)))
    kind = lambda p: F.when(p["old"].isNull(), "insert").when(p["new"].isNull(), "delete").when(words_changed(p["diff"]), "changed").otherwise("equal")
    return F.transform(with_diff, lambda p: F.struct(kind(p).alias("op"), p["old"].alias("old"), p["new"].alias("new"), p["diff"].alias("diff")))


def similarity(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def words_of(diff: Column, op: str) -> Column:
    """The words of a difference's segments of one kind."""
    texts = F.transform(F.filter(diff, lambda s: s["op"] == op), lambda s: s["text"])
    return _words(F.array_join(texts, " "))


def is_reordering(diff: Column) -> Column:
    """The same words deleted as inserted, and at least one."""
    gone, come = F.array_sort(words_of(diff, "delete")), F.array_sort(words_of(diff, "insert"))
    return (F.size(gone) > 0) & (gone == come)


def words_changed(diff: Column) -> Column:
    return F.exists(diff, lambda s: s["op"] != "equal")


def side_text(diff: Column, side: str) -> Column:
    """The words of one side (`old` or `new`) of a difference."""
    gone = {"old": "insert", "new": "delete"}[side]
    return F.array_join(F.transform(F.filter(diff, lambda s: s["op"] != gone), lambda s: s["text"]), " ")


def diff_markup(diff: Column) -> Column:
    """A difference as HTML: deletions in <del>, insertions in <ins>, text escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = lambda s, op, tag: F.when(s["op"] == op, F.concat(F.lit(f"<{tag}>"), safe(s["text"]), F.lit(f"</{tag}>")))
    return F.array_join(F.transform(diff, lambda s: F.coalesce(mark(s, "delete", "del"), mark(s, "insert", "ins"), safe(s["text"]))), " ")
