"""Texts shown otherwise than they are stored, with a map between the places of both: piecewise, both ways, as columns.

A map is a list of pieces (at, raw, n, same) in rising order: n characters from `at` of the shown text are those from
`raw` of the stored one (`same`), or stand for the break at `raw`. Maps are plain columns, so that a selection made in a
shown text becomes a place of the stored text inside one plan, and a chain of texts is mapped step by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Signs that open a line of their own, and the widest printed line.
BULLETS = "•▪●◦"
LINE = 120
# Lines whose pieces are put together at once.
BLOCK = 64
_WRAP = r"(?U)\s*\n\s*"
_EDGE = r"(?U)^\s+"
PIECES = "array<struct<at:int,raw:int,n:int,same:boolean>>"


def reflowed(c: Column) -> Column:
    """(text, map, lead, raw_end) of a stored text: line wraps become spaces; where a stretch is longer than any printed
    line, breaks part paragraphs and become blank lines; a bullet keeps a line of its own. White space around the text
    goes. A null text is an empty one."""
    cut = lambda c: F.struct(c.alias("all"), F.split(c, _WRAP).alias("parts"), F.regexp_extract_all(c, F.lit(_WRAP), F.lit(0)).alias("breaks"), F.exists(F.split(c, "\n"), lambda x: F.length(x) > LINE).alias("wide"))
    return held(held(held(F.coalesce(c, F.lit("")), cut), _signed), _shown)


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it (inside lambdas too)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _signed(t: Column) -> Column:
    """Adds what is shown for each break; nothing behind the last part."""
    parts, breaks = t["parts"], t["breaks"]
    bullet = lambda part: F.coalesce(F.length(part) > 0, F.lit(False)) & F.substring(part, 1, 1).isin(*BULLETS)

    def sign(i: Column) -> Column:
        part = F.get(parts, i + 1)
        inside = ((i > 0) | (F.length(F.get(parts, F.lit(0))) > 0)) & ((i + 2 < F.size(parts)) | (F.length(part) > 0))
        shown = F.when(inside & bullet(part), "\n").when(inside & t["wide"], "\n\n").otherwise(" ")
        return F.when(F.get(breaks, i).isNull(), "").otherwise(shown)

    return F.struct(t["all"].alias("all"), parts.alias("parts"), breaks.alias("breaks"), F.transform(parts, lambda part, i: sign(i)).alias("signs"))


def _shown(t: Column) -> Column:
    parts, breaks, signs = t["parts"], t["breaks"], t["signs"]
    none = F.array().cast(PIECES)

    def step(s: Column, i: Column) -> Column:
        n, wrap, m = F.length(F.get(parts, i)), F.length(F.get(breaks, i)), F.length(F.get(signs, i))
        own = F.struct(s["at"].alias("at"), s["raw"].alias("raw"), n.alias("n"), F.lit(True).alias("same"))
        other = F.struct((s["at"] + n).alias("at"), (s["raw"] + n).alias("raw"), m.alias("n"), F.lit(False).alias("same"))
        return F.struct((s["at"] + n + m).alias("at"), (s["raw"] + n + F.coalesce(wrap, F.lit(0))).alias("raw"), F.concat(s["map"], F.filter(F.array(own, other), lambda p: p["n"] > 0)).alias("map"))

    def block(s: Column, first: Column) -> Column:
        # Pieces grow inside a block of lines, blocks inside the whole: no list as long as the text is copied for a line.
        lines = F.sequence(first, F.least(first + BLOCK, F.size(parts)) - 1)
        start = F.struct(s["at"].alias("at"), s["raw"].alias("raw"), none.alias("map"))
        added = lambda e: F.struct(e["at"].alias("at"), e["raw"].alias("raw"), F.concat(s["maps"], F.array(e["map"])).alias("maps"))
        return F.aggregate(lines, start, step, added)

    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("raw"), F.array().cast(f"array<{PIECES}>").alias("maps"))
    pieces = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(BLOCK)), first, block, lambda s: F.flatten(s["maps"]))
    whole = F.array_join(F.zip_with(parts, signs, lambda part, sign: F.concat(part, sign)), "")
    both = held(whole, lambda w: F.struct(F.length(w).alias("n"), F.regexp_replace(w, _EDGE, "").alias("left")))
    text = lambda b: F.struct(F.regexp_replace(b["left"], r"(?U)\s+$", "").alias("text"), pieces.alias("map"), (b["n"] - F.length(b["left"])).alias("lead"), F.length(t["all"]).alias("raw_end"))
    return held(both, text)


def to_stored(m: Column, at: Column) -> Column:
    """The place in the stored text of a place in the shown one (past its end: the stored text's end)."""
    p = at + m["lead"]
    held = F.filter(m["map"], lambda x: (x["at"] <= p) & (p < x["at"] + x["n"]))
    piece = F.get(held, F.lit(0))
    return F.coalesce(F.when(piece["same"], piece["raw"] + p - piece["at"]).otherwise(piece["raw"]), m["raw_end"])


def to_shown(m: Column, raw: Column) -> Column:
    """The first place in the shown text that stands at a place of the stored one or behind it; inside the text shown."""
    after = F.transform(m["map"], lambda x: F.when(x["same"] & (raw < x["raw"] + x["n"]), x["at"] + F.greatest(raw - x["raw"], F.lit(0))).when(~x["same"] & (raw <= x["raw"]), x["at"]))
    least = F.array_min(F.filter(after, lambda x: x.isNotNull()))
    return F.greatest(F.lit(0), F.least(F.coalesce(least - m["lead"], F.length(m["text"])), F.length(m["text"])))


def stored_span(m: Column, start: Column, stop: Column) -> Column:
    """(start, stop) in the stored text of a selection in the shown one; a selection of nothing is null."""
    a, b = to_stored(m, start), to_stored(m, stop)
    return F.when((stop > start) & (b > a), F.struct(a.alias("start"), b.alias("stop")))
