"""Links in texts: defined terms, sections, Parts, Divisions and Acts that a text mentions, as joins and spans.

Terms of a document are put together in lists of a bounded length, so that a text meets each list once, however many terms
hold there. A text is read once a list, word by word: the words that open a term or another mention are tried against the
text. The leftmost mention counts, at one place a term before others and the longer term before the shorter, and mentions
don't overlap; where a document has several lists, what they found is folded in one pass over sorted rows. A mention is
looked up in the document itself, or in the Act that a lead-in above has handed it to; one that leads nowhere stays text.
Mentions are tried on the 4096 characters from their first word on, which a mention and what it looks ahead to must fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# How mentions are written.
_WORD = r"[A-Z][\w'()-]*"
ACT_SPAN = rf"{_WORD}(?:\s+(?:{_WORD}|of|the|and|for|in|on|to|by|or))*\s+(?:Act|Bill)\s+(?:18|19|20)\d{{2}}\b"
#: Kinds but Acts: the words that open them, in small letters, and what follows. EDGE: a word's end.
MENTIONS = {
    "section": (("section", "sections"), r"sections?\s+\d+[A-Za-z]*EDGE(?!(?:\s*\([^)]*\))?(?:\s+and\s+\d+[A-Za-z]*)?\s+of\s+(?:the|that|any)EDGE)"),
    "part": (("part",), r"Part\s+(?:[IVXLCDM]+|\d+[A-Za-z]*)EDGE"),
    "division": (("division",), r"Division\s+\d+[A-Za-z]*EDGE"),
}
# A run of words that an Act's title can be made of is taken whole: a year isn't one of them, so a run has one Act at most.
ACT_RUN = rf"{_WORD}(?:\s+(?:{_WORD}|of|the|and|for|in|on|to|by|or))*+"
ACT_YEAR = r"\s+(?:18|19|20)\d{2}EDGE"
LEAD_IN = rf"(?i:of|in|under)\s+(?i:the)\s+({ACT_SPAN})\s*[—–:-]\s*$"
ORDER = ["term", *MENTIONS, "act"]
WINDOW = 4096
#: Terms of a list, and rows that are given back at once.
TERMS, OUT_ROWS = 1024, 4096
_U = "(?U)"


@cache
def _patterns() -> tuple[re.Pattern, list[tuple[int, tuple[str, ...], re.Pattern]], re.Pattern, re.Pattern]:
    """Words as Java's (?U)\\w+ finds them; mentions but Acts by their place in ORDER; runs and years of Acts. Spaces, digits
    and letters of mentions are ASCII, and a word ends for them where no letter, digit, mark or underscore follows."""
    word, edge = [], []
    for i in (*range(0x40000), *range(0xE0000, 0xE1000)):  # planes with assigned characters
        kind = unicodedata.category(chr(i))
        if kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or 0x24B6 <= i <= 0x24E9 or 0x1F130 <= i <= 0x1F149 or 0x1F150 <= i <= 0x1F169 or 0x1F170 <= i <= 0x1F189 or i in (0x200C, 0x200D):
            word.append(i)
        if kind[0] == "L" or kind in ("Nd", "Mn") or i == 0x5F:
            edge.append(i)

    def among(points: list[int]) -> str:
        first = [i for n, i in enumerate(points) if not n or points[n - 1] != i - 1]
        last = [i for n, i in enumerate(points) if n + 1 == len(points) or points[n + 1] != i + 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))

    end = f"(?![{among(edge)}])"
    others = [(n, opens, re.compile(p.replace("EDGE", end), re.A | re.I)) for n, (opens, p) in enumerate(MENTIONS.values(), 1)]
    # Classes above U+FFFF are slow to try, so they are asked only there.
    low, high = among([i for i in word if i <= 0xFFFF]), among([i for i in word if i > 0xFFFF])
    return re.compile(f"(?:[{low}]+|(?=[\\U00010000-\\U0010ffff])[{high}])+"), others, re.compile(ACT_RUN, re.A), re.compile(ACT_YEAR.replace("EDGE", end), re.A)


def _fits(text: str, terms: list[str]) -> Iterator[tuple[int, int, str]]:
    """(at, order, said) of all that can be mentioned in a text, by place, order and length; they may overlap."""
    word, others, run, year = _patterns()
    starts: dict[str, list[str]] = {}
    for t in sorted(terms, key=len, reverse=True):
        starts.setdefault(word.match(t)[0], []).append(t)
    opens = {w: (n, p) for n, words, p in others for w in words}
    act, upto, last, stop = len(ORDER) - 1, 0, 0, 0
    dated = year.search(text) is not None
    for m in word.finditer(text):
        at, said = m.start(), m[0]
        low = said.lower()
        for t in starts.get(low, ()):
            end = at + len(t)
            # A word's edge on one side only.
            if text[at:end].lower() == t and (word.match(t[-1]) is None) != (word.match(text, end, end + 1) is None):
                yield at, 0, text[at:end]
        if low in opens and (found := opens[low][1].match(text, at, at + WINDOW)):
            yield at, opens[low][0], found[0]
        if dated and "A" <= said[0] <= "Z":
            if at >= upto:  # a run that an earlier word began holds for its later words
                upto = run.match(text, at).end()
                last = upto - (3 if text.endswith("Act", at, upto) else 4 if text.endswith("Bill", at, upto) else upto)
                found = year.match(text, upto) if last > at and text[last - 1].isspace() else None
                stop = found.end() if found else 0
            if at < last and stop and stop - at <= WINDOW:
                yield at, act, text[at:stop]


def _apart(fits: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Those that begin where the one before has ended."""
    end = 0
    for at, order, said in fits:
        if at >= end:
            end = at + len(said)
            yield at, order, said


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([batch.schema.field("doc"), batch.schema.field("idx"), ("at", pa.int32()), ("order", pa.int32()), ("said", pa.string())])
        columns = [batch.column(c).to_pylist() for c in ("doc", "idx", "text", "terms", "lists")]
        yield from _batches(((d, i, *x) for d, i, text, terms, n in zip(*columns) for x in (_fits(text, terms) if n and n > 1 else _apart(_fits(text, terms or [])))), schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, end = None, 0
    for batch in batches:
        keep = []
        for n, (d, i, at, said) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "idx", "at", "said")))):
            if (d, i) != here:
                here, end = (d, i), 0
            if at >= end:
                end = at + len(said)
                keep.append(n)
        yield batch.take(pa.array(keep, pa.int64()))


def mentions(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, idx, at, kind, said): mentions in texts (doc, idx, text) that don't overlap, in order; terms: doc, term.

    Terms are met in any case of letters, from word to word; empty terms and terms that open with no word are none."""
    known = terms.select("doc", F.lower("term").alias("term")).where(F.col("term").rlike(rf"^{_U}\w")).distinct()
    sizes = known.groupBy("doc").agg(F.ceil(F.count("*") / TERMS).alias("lists"))
    lists = known.join(sizes, "doc").groupBy("doc", "lists", F.pmod(F.xxhash64("term"), "lists").alias("list")).agg(F.collect_list("term").alias("terms")).drop("list")
    both = texts.where("doc IS NOT NULL AND idx IS NOT NULL AND text IS NOT NULL").select("doc", "idx", "text").join(lists, "doc", "left")
    doc, idx = (texts.schema[c].dataType.simpleString() for c in ("doc", "idx"))
    found = both.mapInArrow(_read, f"doc {doc}, idx {idx}, at int, order int, said string")
    dealt = found.repartition("doc", "idx").sortWithinPartitions("doc", "idx", "at", "order", F.desc(F.length("said")))
    rows = dealt.mapInArrow(_fold, found.schema)
    return rows.select("doc", "idx", "at", F.element_at(F.array(*map(F.lit, ORDER)), F.col("order") + 1).alias("kind"), "said")


def governing_act(text: Column) -> Column:
    """The Act that a text hands what stands under it to: "... of the Crimes Act 1958—" at its very end."""
    return F.nullif(F.regexp_extract(text, LEAD_IN, 1), F.lit(""))


def resolved(found: DataFrame, targets: DataFrame, scopes: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Adds `target` to mentions (null: none). Targets: owner, kind, key, target, where the owner of terms and of a
    document's own sections, Parts and Divisions is the document, of an Act's its title in small letters, and of Acts
    themselves empty. Scopes (doc, idx, scope): the Act that governs a text. Own (doc, title): an Act doesn't link to
    itself, nor is it governed by itself."""
    m = found.withColumn("__own", F.lit(None).cast("string")) if own is None else found.join(own.select("doc", F.lower("title").alias("__own")), "doc", "left")
    m = m.withColumn("__scope", F.lit(None).cast("string")) if scopes is None else m.join(scopes.select("doc", "idx", F.lower("scope").alias("__scope")), ["doc", "idx"], "left")
    scope = F.when(~F.col("__scope").eqNullSafe(F.col("__own")), F.col("__scope"))
    number = F.lower(F.regexp_extract("said", r"\s(\S+)$", 1))
    title = F.regexp_replace(F.lower("said"), r"^the\s+", "")
    key = F.when(F.col("kind") == "term", F.lower("said")).when(F.col("kind") == "act", F.when(~title.eqNullSafe(F.col("__own")), title)).otherwise(number)
    owner = F.when(F.col("kind") == "act", "").when(F.col("kind") == "term", F.col("doc").cast("string")).otherwise(F.coalesce(scope, F.col("doc").cast("string")))
    return m.withColumn("owner", owner).withColumn("key", key).join(targets.select("owner", "kind", "key", "target"), ["owner", "kind", "key"], "left").drop("owner", "key", "__own", "__scope")


def linked(texts: DataFrame, links: DataFrame, markdown: bool = False) -> DataFrame:
    """(doc, idx, linked): texts with their links (doc, idx, at, said, target; no overlaps) written as HTML or Markdown.
    A link whose target is the text's own place (`here`, if `texts` has it) stays text."""
    has = "here" in texts.columns
    good = links.where("target IS NOT NULL").groupBy("doc", "idx").agg(F.array_sort(F.collect_list(F.struct("at", "said", "target"))).alias("links"))
    esc = (lambda c: c) if markdown else (lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    whole = texts.join(good, ["doc", "idx"], "left")
    links_ = F.coalesce("links", F.array().cast("array<struct<at:int,said:string,target:string>>"))
    kept = F.filter(links_, lambda x: ~x["target"].eqNullSafe(F.col("here"))) if has else links_
    one = lambda x: F.concat(F.lit("["), x["said"], F.lit("]("), x["target"], F.lit(")")) if markdown else F.concat(F.lit('<a href="'), F.replace(esc(x["target"]), F.lit('"'), F.lit("&quot;")), F.lit('">'), esc(x["said"]), F.lit("</a>"))
    whole = whole.withColumn("__k", kept)
    end = lambda i: F.when(i < 0, 0).otherwise(F.get("__k", i)["at"] + F.length(F.get("__k", i)["said"]))
    pieces = F.transform("__k", lambda x, i: F.concat(esc(F.substring(F.col("text"), end(i - 1) + 1, x["at"] - end(i - 1))), one(x)))
    tail = esc(F.substring(F.col("text"), end(F.size("__k") - 1) + 1, F.length("text")))
    return whole.select("doc", "idx", F.concat(F.array_join(pieces, ""), tail).alias("linked"))
