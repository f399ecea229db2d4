"""Printed lines of statutes to nodes, by a pushdown reader whose state is a value.

The plan: lines get their shapes in the JVM (patterns, ends, marks), documents are cut into ranges of pages, and each
range is read by a small reader in Python that starts from a state and tells the state it ends in. So a long book is
many tasks. States of ranges behind the first are guessed at first: a range read from an empty state tells which open
levels it closes and which it leaves open, and these effects are put together in order. What is read from the guesses
is then compared with them, and ranges whose guess was wrong are read again, until none is; the result is that of one
pass, whatever the ranges. The reader only says what each line is (one row a line); nodes, tables and boxes are grouped
from these rows by Spark.

Lines: doc, line_no, text, page, and, where known, x0, x1, y0, y1, size, bold, lbi (the bold italic run it opens with).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.session import discard, fanout, materialize, ship

# Shapes of the lines of an Act or Bill, and the order of its levels.
PATTERNS = {
    "schedule": r"^Schedule\s+(\d+[A-Za-z]*)\s*[—–-]+\s*(.+)$",
    "chapter": r"(?i)^Chapter\s+(\d+[A-Z]*)\s*[—–-]\s*(.+)$",
    "part": r"(?i)^Part\s+([A-Z0-9]+[A-Z]?)\s*[—–-]\s*(.+)$",
    "division": r"(?i)^Division\s+(\d+[A-Z]*)\s*[—–-]\s*(.+)$",
    "subdivision": r"^Subdivision\s+(\w+)\s*[—–-]\s*(.+)$",
    "section": r"^(\d+[A-Za-z]*)\s+(.+)$",
    "bracket": r"^\((\d+[A-Za-z]*|[a-z]{1,3}|[ivxlcdm]+|[A-Z]{1,3})\)\s*(.*)$",
    "bare_schedule": r"(?i)^Schedule\s+(\d+[A-Za-z]*)()$",
    "bare_number": r"^(\d+[A-Za-z]*)()$",
    "dotted": r"^(\d+[A-Z]*\.\d+[A-Z]*)\s+(\S.*)$",
    "item": r"^(\d+[A-Z]*)\.?\s+(\S.*)$",
}
MARKS = {"note": r"^Notes?[—–:]?$", "example": r"^Examples?[—–:]?$", "penalty": r"^Penalt(?:y|ies)\s*:", "stars": r"^\*(?:\s*\*){2,}$", "star": r"^\*$", "rule": r"^[═─]{3,}$", "preamble": r"^Preamble$", "dictionary": r"^Dictionary$"}
TESTS = {
    "clean": r"(?:[.;:—–*]|;\s*(?:or|and|and/or))\s*$",
    "stop": r"[.;:!?]\s*$",
    "comma": r",\s*$",
    "midway": r"(?i)\b(?:of|the|a|an|to|in|by|with|as|from|under)\s*$",
    "wordish": r"[\w),]\s*$",
    "verb": r"^(?:\([^)]*\)\s*)?(?i:means?\b|has\b|have\b|includes?\b)",
    "defining": r"(?i)^[A-Za-z][\w \"',()/-]{0,80}?\s+(?:means?\b|has\b|have\b|includes?\b)|[—-]\s*see\s+section\b",
    "lead_in": r"(?i)^(?:\(\S{1,6}\)\s*)?In\s+(?:th(?:is|e)\s+(?:Act|section|subsection|Division|Part|Subdivision|Chapter|Schedule)\b|(?:sub)?sections?\s+\(|paragraphs?\s+\()[^.;]{0,60}[—:]\s*$",
    "hangs": r"^Sections?\s+\d[\dA-Z()\s,]*\.?$",
    "amending": r"(?i)\bamendments\b|(?:^|—|–|-)\s*(?:consequential\s+)?amendment\s+of\b",
    "definitions": r"(?i)\b(?:definitions?|interpretation|dictionary)\b",
    "topic": r"^(?=[A-Z])(?!.*[—–]\s*$)(?:\S++\s*+){1,8}+$",  # possessive: up to eight words, in one way
    "sentence": r"(?i)^(?:\(\w+\)\s*)?(?:in|if|sections?|subsection|where|for|when|unless|notwithstanding|despite|subject|this|that|an?|the|any|every|no|nothing|who(?:so)?ever)\b",
    "bullet": r"^[•▪●]",
    "colon": r"[—–:]\s*$",
}
ENACTING = r"^The Parliament of Victoria (?:therefore )?enacts(?: as follows)?:?\s*$|(?i)\(that is to say\):?\s*$"
LEVELS = ["schedule", "chapter", "part", "division", "subdivision", "section", "subsection", "paragraph", "subparagraph", "sub_subparagraph"]
ALIKE = {"dictionary": "schedule", "clause": "section", "item": "section", "preamble": "section", "definition": "subsection", "subclause": "subsection", "subitem": "subsection"}
INDENT, BASELINE, COLUMN_GAP, COLUMN = 3.0, 3.0, 40.0, 4.0
CAPTION = 60
WRAP_RATIO = 1.22
BOX_GAP = 1.8

RANGE_PAGES = 100
_FLAGS = list(TESTS)
_SHAPES = list(PATTERNS)
_LINE = "text string, page int, x0 double, x1 double, y0 double, y1 double, size double, bold boolean, lbi string"
TAG = "doc long, range int, line_no long, node long, opens boolean, type string, number string, heading string, text string, hang string, rank double, parent long, cell int, learned string"
_TAG_FIELDS = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in (TAG + ", state string").split(", "))])


@dataclass(frozen=True)
class Profile:
    """What one collection's documents look like: patterns that differ, levels, the word for a numbered provision."""

    patterns: dict = field(default_factory=dict)
    levels: tuple = tuple(LEVELS)
    provision: str = "section"
    item_schedules: tuple = ()
    learned: tuple = ()

    def __post_init__(self):
        for name, pattern in self.patterns.items():
            if name not in PATTERNS:
                raise ValueError(f"no such pattern: {name}")
            if re.compile(pattern).groups < 2:
                raise ValueError(f"{name}: a pattern needs a number's and a heading's group")

    def ranks(self) -> dict[str, int]:
        own = {level: i for i, level in enumerate(self.levels)}
        return own | {name: own[level] for name, level in ALIKE.items() if level in own}


# --- shapes of lines, in the JVM ---------------------------------------------------------------------------------


def _whole(lines: DataFrame) -> DataFrame:
    """Lines with every column a line may have."""
    kinds = dict(x.split() for x in _LINE.split(", "))
    more = {name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in lines.columns}
    return lines.withColumns(more).select("doc", F.col("line_no").cast("long").alias("line_no"), *kinds)


def shaped(lines: DataFrame, profile: Profile) -> DataFrame:
    """Lines that are not blank, with what their text shows by itself: `shapes` (number, rest of each pattern), `mark`,
    `flags` and `rules` (the learned rules whose conditions on the line hold)."""
    lines = _whole(lines)
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = lines.withColumn("text", t).where("text <> ''")
    patterns = PATTERNS | profile.patterns
    found = lambda p: F.when(F.col("text").rlike(p), F.array(F.regexp_extract("text", p, 1), F.trim(F.regexp_extract("text", p, 2))))
    mark = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(m)) for m, p in MARKS.items()])
    rules = F.filter(F.array(*[F.when(_holds(r), F.struct(F.lit(i).alias("rule"), F.regexp_extract("text", r.get("pattern") or "^", min(1, re.compile(r.get("pattern") or "^").groups)).alias("number"))) for i, r in enumerate(profile.learned)]), lambda x: x.isNotNull()) if profile.learned else F.lit(None).cast("array<struct<rule:int,number:string>>")
    return lines.select("doc", "line_no", *[n.split()[0] for n in _LINE.split(", ")], F.array(*[found(patterns[k]) for k in _SHAPES]).alias("shapes"), mark.alias("mark"), F.array(*[F.col("text").rlike(TESTS[k]) for k in _FLAGS]).alias("flags"), rules.alias("rules"))


def _holds(rule: dict) -> Column:
    """A learned rule's conditions on the line alone; its `parents` are tested where the open node is known."""
    ok = F.lit(True)
    if rule.get("pattern"):
        ok = ok & F.col("text").rlike(rule["pattern"])
    for name, value in (rule.get("flags") or {}).items():
        ok = ok & (F.coalesce(F.col(name), F.lit(False)) == value)
    for name, (lo, hi) in (rule.get("ranges") or {}).items():
        ok = ok & F.col(name).between(lo, hi)
    return F.coalesce(ok, F.lit(False))


def without_front(lines: DataFrame) -> DataFrame:
    """Lines after a document's first enacting words, and a preamble printed before them; all where there are none."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    enacted = lines.where(text.rlike(ENACTING)).groupBy("doc").agg(F.min("line_no").alias("__enacted"))
    marked = lines.join(enacted, "doc", "left")
    preamble = marked.where((text == "Preamble") & (F.col("line_no") < F.col("__enacted"))).groupBy("doc").agg(F.max("line_no").alias("__preamble"))
    kept = F.col("__enacted").isNull() | (F.col("line_no") > F.col("__enacted")) | ((F.col("line_no") >= F.col("__preamble")) & (F.col("line_no") < F.col("__enacted")))
    return marked.join(preamble, "doc", "left").where(F.coalesce(kept, F.lit(False))).drop("__enacted", "__preamble")


def measures(lines: DataFrame) -> DataFrame:
    """(doc, body, right): the usual size of lines that aren't bold, and where lines end on even and on odd pages (at
    95 of 100 of them)."""
    sizes = lines.where("NOT coalesce(bold, false) AND size > 0").groupBy("doc", F.round("size", 1).alias("s")).agg(F.count("*").alias("n"))
    body = sizes.groupBy("doc").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))
    edge = lambda parity: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY x1) FILTER (WHERE page % 2 = {parity})")
    right = lines.groupBy("doc").agg(F.array(edge(0), edge(1)).alias("right"))
    return right.join(body, "doc", "left").select("doc", F.coalesce("body", F.lit(12.0)).alias("body"), "right")


# --- numbers that follow each other ------------------------------------------------------------------------------


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def _place(token: str) -> int:
    n = 0
    for c in token:
        n = n * 26 + ord(c) - 96
    return n


class _Run:
    """One way of numbering: tokens made of a base, counted up, and of a suffix for what was inserted behind it."""

    def __init__(self, base: str, count, spell):
        self.base, self.count, self.spell = re.compile(base), count, spell

    def split(self, token: str) -> tuple[int | None, str]:
        m = self.base.match(token)
        return (self.count(m[0]), token[m.end() :]) if m else (None, token)

    def follows(self, last: str, token: str) -> bool:
        """Is `token` the next: the base counted up, a first insertion behind `last`, or the next insertion?"""
        n, suffix = self.split(last)
        if n is None or not token:
            return False
        if token == self.spell(n + 1):
            return True
        if not suffix:
            return token[:-1] == last and token[-1:].isalpha()
        return token == last[: len(last) - len(suffix)] + _letters(_place(suffix) + 1)

    def later(self, last: str, token: str, reach: int = 8) -> bool:
        n, m = self.split(last)[0], self.split(token)[0]
        return n is not None and m is not None and n < m <= n + reach


def _run_of_letters() -> _Run:
    return _Run("[a-z]", _place, _letters)


def _run_of_romans() -> _Run:
    from folioscope.operators.parsing import int_to_roman, roman_to_int

    return _Run("[ivxlcdm]+", roman_to_int, int_to_roman)


# --- the reader ---------------------------------------------------------------------------------------------------

EMPTY = {"stack": [], "cut": 99.0, "prev": None, "block": None, "stars": [], "table": None, "terms": False, "term_rank": None, "term_line": None, "group": False, "head_x0": None, "item": None, "gap": False, "repeal": False, "note_x0": None, "seen": False}
_NO_LINE = {"line_no": None, "x0": None, "bold": False, "flags": [False] * len(_FLAGS)}
#: Places in an open node's list.
KIND, NUMBER, NODE, X0, RANK, TEXT, AMEND = range(7)


class Reader:
    """Reads lines one by one. Everything it knows between two lines is in `self.s`, which is plain data."""

    def __init__(self, profile: Profile, state: dict, body: float, right: list, ahead: dict | None):
        self.p, self.s, self.body, self.right, self.ahead = profile, state, body, right, ahead
        self.line = None
        self.rank = profile.ranks()
        self.letters, self.romans = _run_of_letters(), _run_of_romans()
        self.headed = {k for k, r in self.rank.items() if r <= self.rank["section"]}

    # what a line is

    def read(self, lines: list[dict]) -> list[dict]:
        self.lines, out = lines, []
        for i, line in enumerate(lines):
            self.i, self.line, self.tags = i, line, out
            self._read()
            flags = line["flags"]
            if self.s["table"] is None and line["mark"] not in ("note", "example", "star", "rule"):
                self.s["prev"] = {k: flags[_FLAGS.index(k)] for k in ("stop", "comma", "midway", "wordish")}
            self.s["above"] = {"x1": line["x1"], "page": line["page"], "bold": bool(line["bold"]), "size": line["size"], "clean": flags[0], "marker": line["mark"] in ("note", "example"), "line": line["line_no"]}
            self.s["seen"] = True
        return out

    def end(self) -> list[dict]:
        self.tags = []
        self._stars_over()
        return self.tags

    def _read(self) -> None:
        line, s = self.line, self.s
        if s["table"] is not None and self._cell():
            return
        self._leave_table()
        if not s["stars"] and self._learned():
            return
        if self._table_begins():
            return
        mark = line["mark"]
        if mark == "rule":
            return self._tag(None)
        if mark == "star":
            s["stars"].append({"line": line["line_no"], "page": line["page"], "y0": line["y0"]})
            return
        self._stars_over()
        if mark == "stars":
            return self._repealed([line["line_no"]], line["text"])
        if mark == "preamble" and not s["seen"]:
            return self._open("preamble", None, "Preamble")
        if mark in ("note", "example"):
            s["block"] = {"kind": mark, "node": None, "number": None, "colon": False, "style": None, "x0": None}
            return self._tag(self._top(NODE))
        if mark == "penalty":
            s["block"] = {"kind": "penalty", "node": line["line_no"], "number": None, "colon": False, "style": None, "x0": None}
            return self._loose("penalty", None, line["text"])
        if s["block"] and self._in_block():
            return
        after_group, s["group"] = s["group"], False
        for rule in (self._dotted, self._listed, self._heading, self._hangs, self._term, self._bracketed, self._bold):
            if rule(after_group):
                break
        else:
            self._go_on()
        if self._is("lead_in") and s["stack"]:
            top = s["stack"][-1]
            s["terms"], s["term_rank"] = True, None if top[KIND] in (self.p.provision, "clause", "item") else top[RANK] + 1

    # what is asked of lines

    def _is(self, flag: str, line: dict | None = None) -> bool:
        return bool((line or self.line)["flags"][_FLAGS.index(flag)])

    def _shape(self, name: str):
        return self.line["shapes"][_SHAPES.index(name)]

    def _next(self) -> dict | None:
        return self.lines[self.i + 1] if self.i + 1 < len(self.lines) else self.ahead

    def _prev(self, flag: str) -> bool:
        return bool(self.s["prev"] and self.s["prev"][flag])

    def _top(self, what: int):
        return self.s["stack"][-1][what] if self.s["stack"] else None

    def _fresh(self, after_group: bool) -> bool:
        """Nothing before, a sentence's end before, or a heading before that has no text yet."""
        return self.s["prev"] is None or after_group or self._prev("stop") or (self._top(KIND) in self.headed and not self._top(TEXT))

    def _large(self) -> bool:
        return self.line["size"] is not None and round(self.line["size"], 1) > self.body

    def _wraps(self) -> bool:
        """Would the line's first word have been too long for the line above, which ends inside a sentence?"""
        a, line = self.s.get("above"), self.line
        if a is None or a["clean"] or a["marker"] or line["x0"] is None or line["x1"] is None or a["x1"] is None:
            return False
        if a["bold"] and (a["size"] is None or round(a["size"], 1) >= self.body):
            return False
        edge = self.right[a["page"] % 2] if self.right and a["page"] is not None else None
        letter = (line["x1"] - line["x0"]) / max(1, len(line["text"]))
        return edge is not None and a["x1"] + (len(line["text"].split()[0]) + 1) * letter > edge

    def _schedule(self):
        return next((f for f in reversed(self.s["stack"]) if f[KIND] in ("schedule", "dictionary")), None)

    def _provision(self) -> str:
        f = self._schedule()
        if f is None:
            return self.p.provision
        items = f[KIND] == "schedule" and (f[NUMBER] in self.p.item_schedules or f[AMEND])
        return "item" if items else "clause"

    # what is said of them

    def _tag(self, node, **more) -> None:
        self.tags.append({"line_no": self.line["line_no"], "node": node, "opens": False, **more})

    def _loose(self, kind: str, number, text: str | None, heading: str | None = None, **more) -> None:
        """A node that nothing nests in: it stands beside what is open."""
        self._tag(self.line["line_no"], type=kind, number=number, text=text, heading=heading, rank=None, parent=self._top(NODE), **{"opens": True} | more)

    def _open(self, kind: str, number, heading=None, text=None, rank=None, **more) -> None:
        s, line = self.s, self.line
        rank = float(self.rank[kind] if rank is None else rank)
        s["repeal"] = False
        s["cut"] = min(s["cut"], rank)
        while s["stack"] and s["stack"][-1][RANK] >= rank:
            s["stack"].pop()
        dictionary = any(f[KIND] == "dictionary" for f in s["stack"])
        if kind in (self.p.provision, "clause", "item") or (kind == "part" and dictionary):
            s["terms"], s["term_rank"] = bool(heading) and self._is("definitions"), None
        if kind in ("schedule", "dictionary"):
            s["item"], s["gap"] = None, False
        elif kind in ("clause", "item") and self._schedule():
            s["item"], s["gap"] = number, False
        if kind in (self.p.provision, "clause", "item") and line["bold"] and heading:
            s["head_x0"] = line["x0"]
        self._tag(line["line_no"], type=kind, number=number, heading=heading, text=text, rank=rank, parent=self._top(NODE), **{"opens": True} | more)
        s["stack"].append([kind, number, line["line_no"], line["x0"], rank, bool(text), kind == "schedule" and bool(heading) and self._is("amending")])

    def _add(self, text=None, heading=None) -> None:
        """To what is open; the first text of all gets a holder."""
        if not self.s["stack"]:
            return self._open("part" if "part" in self.rank else self.p.levels[0], None, "Preliminary", text)
        f = self.s["stack"][-1]
        f[TEXT] = f[TEXT] or bool(text)
        f[AMEND] = f[AMEND] or bool(f[KIND] == "schedule" and heading and self._is("amending"))
        self._tag(f[NODE], text=text, heading=heading)

    # rows of stars, tables, learned rules

    def _repealed(self, lines: list[int], text: str) -> None:
        for k, n in enumerate(lines):
            self.tags.append({"line_no": n, "node": lines[0], "opens": k == 0, "type": "repealed" if k == 0 else None, "text": text if k == 0 else None, "parent": self._top(NODE)})
        if self._schedule():
            self.s["gap"] = True
        if self._top(KIND) in ("paragraph", "subparagraph"):
            self.s["repeal"] = True

    def _stars_over(self) -> None:
        run, self.s["stars"] = self.s["stars"], []
        rows: list[list[dict]] = []
        for star in run:
            beside = rows and star["page"] == rows[-1][0]["page"] and star["y0"] is not None and rows[-1][0]["y0"] is not None and abs(star["y0"] - rows[-1][0]["y0"]) < 2
            if beside:
                rows[-1].append(star)
            else:
                rows.append([star])
        if len(run) >= 3 and all(len(r) < 3 for r in rows):
            rows = [run]
        for row in rows:
            if len(row) >= 3:
                self._repealed([x["line"] for x in row], " ".join("*" for _ in row))
            else:
                for x in row:
                    here, self.line = self.line, {**(self.line or _NO_LINE), "line_no": x["line"]}
                    self._add("*")
                    self.line = here

    def _columns(self, i: int) -> tuple[list[float], dict | None] | None:
        """Where the cells of the row that begins at line i stand, and the line after the row; null if it is no row."""
        first, xs, k = self.lines[i], [], i
        if first["bold"] or first["mark"] == "star" or first["y0"] is None or first["x0"] is None:
            return None
        while k < len(self.lines):
            line = self.lines[k]
            if line["bold"] or line["mark"] == "star" or line["page"] != first["page"] or line["y0"] is None or abs(line["y0"] - first["y0"]) > BASELINE:
                break
            xs.append(line["x0"])
            k += 1
        xs.sort()
        if len(xs) < 2 or any(b - a < COLUMN_GAP for a, b in zip(xs, xs[1:])):
            return None
        return xs, self.lines[k] if k < len(self.lines) else self.ahead

    def _column(self, line: dict | None, columns: list[float]) -> int | None:
        if line is None or line["bold"]:
            return None
        if line["mark"] == "star":
            return 0
        return next((k for k, x in enumerate(columns) if line["x0"] is not None and abs(line["x0"] - x) <= COLUMN), None)

    def _table_begins(self) -> bool:
        line, caption = self.line, None
        row = self._columns(self.i)
        if row is None and line["bold"] and len(line["text"]) <= CAPTION and self.i + 1 < len(self.lines) and self.lines[self.i + 1]["page"] == line["page"]:
            row, caption = self._columns(self.i + 1), line["text"]
        if row is None or self._column(row[1], row[0]) is None:
            return False  # one row is a coincidence
        self._stars_over()
        self.s["block"] = None
        self.s["table"] = {"node": line["line_no"], "columns": row[0]}
        if caption is not None:
            self._loose("table", None, None, caption)
        else:
            self._loose("table", None, line["text"], cell=self._column(line, row[0]))
        return True

    def _cell(self) -> bool:
        at = self._column(self.line, self.s["table"]["columns"])
        if at is None:
            return False
        self._tag(self.s["table"]["node"], text=self.line["text"], cell=at)
        return True

    def _leave_table(self) -> None:
        self.s["table"] = None

    def _learned(self) -> bool:
        for hit in self.line["rules"] or ():
            rule = self.p.learned[hit["rule"]]
            if rule.get("parents") and self._top(KIND) not in rule["parents"]:
                continue
            then = rule["then"]
            if then.get("continue"):
                if self.s["block"] and self.s["block"]["node"] is not None:
                    self._tag(self.s["block"]["node"], text=self.line["text"])
                else:
                    self._go_on()
                return True
            kind = then.get("open")
            if kind not in self.rank and kind not in ("note", "example"):
                continue
            number = hit["number"] if then.get("number") and hit["number"] and re.compile(rule["pattern"]).groups else None
            rest = re.sub(rule["pattern"], "", self.line["text"], count=1).strip() if number is not None else self.line["text"]
            if kind in ("note", "example"):
                self.s["block"] = {"kind": kind, "node": self.line["line_no"], "number": number, "colon": False, "style": None, "x0": None}
                self._loose(kind, number, rest, learned=rule["id"])
            else:
                self.s["block"] = None
                self._open(kind, number, None, rest or None, learned=rule["id"])
            return True
        return False

    # notes, examples, penalties

    def _example(self, block: dict) -> tuple[str, str] | None:
        """Number and text, where the line opens an example of its own: the next number, a bullet of a list of bullets,
        or the next letter of a list that the block announced."""
        line, style, last = self.line, block["style"], block["number"]
        if line["bold"] or self._wraps():
            return None
        m = re.match(r"(\d{1,2})\.?(?:\s+(.*))?$", line["text"])
        begun = block["node"] is not None
        if m and (style == "numbered" or not begun) and int(m[1]) == (int(last) if str(last or "").isdigit() else 0) + 1:
            block["style"] = "numbered"
            return m[1], m[2] or ""
        if self._is("bullet") and (style == "bullets" or not begun):
            block["style"] = "bullets"
            return str(int(last or 0) + 1), line["text"].lstrip("•▪● ")
        m = re.match(r"\(([a-z])\)\s+(.*)$", line["text"])
        if m and begun and style in (None, "lettered") and block["x0"] is not None and line["x0"] is not None and abs(line["x0"] - block["x0"]) <= INDENT:
            if (m[1] == "a" and last is None and block["colon"]) or (style == "lettered" and last is not None and ord(m[1]) == ord(last) + 1):
                block["style"] = "lettered"
                return m[1], m[2]
        return None

    def _in_block(self) -> bool:
        line, block = self.line, self.s["block"]
        kind, numbered = block["kind"], None
        if kind == "example":
            numbered = self._example(block)
        elif kind == "note":
            column, inside = self.s["note_x0"], block["node"] is not None
            own = inside and block["number"] is not None and column is not None and line["x0"] is not None
            if own and line["x0"] < column - INDENT:
                self.s["block"] = None
                return False
            shape, wraps = self._shape("section"), self._wraps()
            digits = shape and shape[0].isdigit() and not wraps
            alone = line["text"].isdigit() and len(line["text"]) <= 3 and not wraps
            if (digits or line["text"].isdigit()) and inside and column is not None and line["x0"] is not None and line["x0"] > column + INDENT:
                self._block_text(block)
                return True
            if (digits or alone) and not line["bold"]:
                numbered = tuple(shape) if digits else (line["text"], "")
                self.s["note_x0"] = line["x0"]
        if numbered is not None:
            block |= {"node": line["line_no"], "number": numbered[0], "colon": self._is("colon")}
            self._loose(kind, numbered[0], numbered[1])
            return True
        if self._block_ends(block):
            self.s["block"] = None
            return False
        if block["node"] is None:
            block |= {"node": line["line_no"], "colon": self._is("colon"), "x0": line["x0"]}
            self._loose(kind, None, line["text"])
        else:
            self._block_text(block)
        return True

    def _block_text(self, block: dict) -> None:
        block["colon"] = self._is("colon")
        self._tag(block["node"], text=self.line["text"])

    def _block_ends(self, block: dict) -> bool:
        line = self.line
        if self._wraps():
            return False
        bracket = self._shape("bracket") is not None
        term = bool(self.s["terms"] and line["lbi"])
        if block["kind"] == "penalty" and not line["bold"]:
            return bracket or term
        structural = bracket or any(self._shape(k) is not None for k in ("schedule", "chapter", "part", "division", "subdivision", "section", "bare_schedule"))
        column = self.s["note_x0"]
        in_note = block["kind"] == "note" and block["number"] is not None and column is not None and line["x0"] is not None and line["x0"] > column + INDENT
        return structural or (term and not in_note) or bool(line["bold"] and (line["size"] is None or round(line["size"], 1) >= self.body))

    # provisions

    def _dotted(self, _) -> bool:
        shape = self._shape("dotted")
        if shape is None or not self._schedule():
            return False
        entry = next((f for f in reversed(self.s["stack"]) if f[KIND] in ("clause", "item")), None)
        if entry is None or not entry[NUMBER] or not shape[0].startswith(entry[NUMBER] + "."):
            return False
        self._open("subitem" if entry[KIND] == "item" else "subclause", shape[0], None, shape[1])
        return True

    def _listed(self, _) -> bool:
        """The next of a Schedule's numbered list, set in from the headings."""
        shape, line, x = self._shape("item"), self.line, self.s["head_x0"]
        if shape is None or not self._schedule() or x is None or line["x0"] is None or (line["bold"] and line["x0"] <= x + 3 * INDENT):
            return False
        m, last = re.match(r"(\d+)([A-Z]*)$", shape[0]), re.match(r"(\d+)([A-Z]*)$", self.s["item"] or "")
        n, base = int(m[1]), int(last[1]) if last else 0
        if self.s["gap"]:
            ok = base < n <= base + 30
        elif last is None:
            ok = shape[0] == "1"
        else:
            inserted = _letters(_place(last[2].lower()) + 1).upper()
            ok = (n, m[2]) in ((base + 1, ""), (base, inserted))
        if ok:
            self._open(self._provision(), shape[0], None, shape[1])
        return ok

    def _term_wraps(self) -> bool:
        line, nxt = self.line, self._next()
        return bool(self.s["terms"] and line["lbi"] and line["lbi"].strip() == line["text"] and nxt and nxt["lbi"] and nxt["x0"] is not None and line["x0"] is not None and nxt["x0"] > line["x0"] + INDENT)

    def _heading(self, after_group: bool) -> bool:
        line = self.line
        if not line["bold"] or self._term_wraps():
            return False
        if line["mark"] == "dictionary" and self._large() and "schedule" in self.rank:
            self._open("dictionary", None, "Dictionary")
            return True
        fresh = self._fresh(after_group)
        for kind in ("schedule", "chapter", "part", "division", "subdivision"):
            shape = self._shape(kind)
            if shape is not None and kind in self.rank:
                self._open(kind, *shape)
                return True
        shape = self._shape("section")
        if shape is not None:
            year_or_tail = re.fullmatch(r"(?:1[6-9]|20)\d{2}", shape[0]) or not shape[1][:1].isupper()
            if fresh or not year_or_tail:
                self._open(self._provision(), *shape)
                return True
        shape = self._shape("bracket")
        if shape is not None and shape[0][0].isdigit() and shape[1] and fresh and not self._is("defining") and not self._is("sentence"):
            self._open("subdivision", *shape)
            return True
        shape = self._shape("bare_schedule")
        if shape is not None and "schedule" in self.rank:
            self._open("schedule", shape[0])
            return True
        shape = self._shape("bare_number")
        if shape is not None and fresh:
            self._open(self._provision(), shape[0])
            return True
        return False

    def _hangs(self, _) -> bool:
        f = self.s["stack"][-1] if self.s["stack"] else None
        if f is None or f[KIND] not in ("schedule", "dictionary") or f[TEXT] or self.line["bold"] or not self._is("hangs"):
            return False
        self._tag(f[NODE], hang=f"({self.line['text']})")
        return True

    def _topical(self, after_group: bool) -> bool:
        nxt = self._next()
        return self._is("topic") and not self._is("defining") and not (nxt and self._is("verb", nxt)) and self._fresh(after_group)

    def _term(self, after_group: bool) -> bool:
        """A term set bold and italic where terms are being defined opens a definition."""
        s, line, term = self.s, self.line, self.line["lbi"]
        if not (s["terms"] and term) or not line["text"].startswith(term) or self._large():
            return False
        dictionary = any(f[KIND] == "dictionary" for f in s["stack"])
        if line["bold"] and not dictionary and not self._term_wraps() and self._topical(after_group):
            return False
        rest = line["text"][len(term) :].strip()
        f = s["stack"][-1] if s["stack"] else None
        above = s.get("above")
        if f and f[KIND] == "definition" and not f[TEXT] and above and above["line"] == s["term_line"]:
            self._add(rest or None, term)
            s["term_line"] = line["line_no"]
            return True
        if f and f[TEXT] and self._prev("wordish") and not (rest[:1] in (",", "(") or re.match(r"(?i)(?:means?|has|have|includes?)\b", rest)):
            return False
        if self._prev("midway"):
            return False
        self._open("definition", None, term, rest or None, rank=s["term_rank"])
        s["term_line"] = line["line_no"]
        return True

    def _level(self, token: str) -> str:
        """The level of a bracketed token: the run it continues, else a new list under what is open."""
        if token[0].isdigit():
            return "subsection"
        if token.isupper():
            return "sub_subparagraph"
        gap = self.s["repeal"]
        open_ = next((f for f in reversed(self.s["stack"]) if f[KIND] != "sub_subparagraph"), None)
        kind, last = (open_[KIND], open_[NUMBER] or "") if open_ else (None, "")
        if kind == "paragraph":
            goes_on = self.letters.follows(last, token) or (gap and self.letters.later(last, token))
            return "paragraph" if goes_on else "subparagraph"
        if kind == "subparagraph":
            goes_on = self.romans.follows(last, token) or (gap and self.romans.later(last, token))
            return "subparagraph" if goes_on else "paragraph"
        return "paragraph"

    def _bracketed(self, after_group: bool) -> bool:
        shape = self._shape("bracket")
        if shape is None or self._wraps() or self._prev("comma"):
            return False
        level = self._level(shape[0])
        if level == "subsection" and self.line["bold"] and not shape[1] and self._fresh(after_group):
            level = "subdivision"
        self._open(level, shape[0], None, shape[1] or None)
        return True

    def _bold(self, after_group: bool) -> bool:
        """What is bold and nothing else: a heading's next line, a topic, or stress inside a text."""
        if not self.line["bold"]:
            return False
        text, size = self.line["text"], self.line["size"]
        if self._top(KIND) in self.headed and not self._top(TEXT):
            self._add(None, text)
        elif self._large() or ((size is None or round(size, 1) == self.body) and self._topical(after_group)):
            self._loose("heading_group", None, None, text)
            self.s["group"] = True
        else:
            self._add(text)
        return True

    def _go_on(self) -> None:
        """Text of what is open; a line that stands further out than a list takes up the words before the list."""
        stack, x, closed = self.s["stack"], self.line["x0"], False
        floor = self.rank["subsection"]
        while x is not None and len(stack) > 1 and stack[-1][RANK] >= floor and stack[-1][X0] is not None and x < stack[-1][X0] - INDENT:
            self.s["cut"] = min(self.s["cut"], stack[-1][RANK])
            stack.pop()
            closed = True
        if closed and stack[-1][TEXT] and stack[-1][KIND] != "continuation":
            self.rank.setdefault("continuation", 0)
            self._open("continuation", None, None, self.line["text"], rank=stack[-1][RANK] + 1)
        else:
            self._add(self.line["text"])


def after(state: dict | None, effect: dict) -> dict:
    """The state behind a range that came from `state`, of which only its effect from an empty state is known."""
    if state is None:
        return effect
    kept = [f for f in state["stack"] if f[RANK] < effect["cut"]]
    return effect | {"stack": kept + effect["stack"], "cut": min(state["cut"], effect["cut"])}


# --- ranges -------------------------------------------------------------------------------------------------------

_HEAD = "struct<state:string,body:double,right:array<double>,ahead:string>"


def _rows(batch: pa.RecordBatch):
    """A batch's rows as dicts. Of nested columns only what is there is made: most lines have few shapes, and no head."""
    n = len(batch)
    columns = {}
    for name in batch.schema.names:
        c = batch.column(name)
        if c.null_count == n:
            columns[name] = [None] * n
        elif name in ("shapes", "flags"):
            there = np.flatnonzero(np.asarray(c.is_valid()))
            inner, rows = c.flatten(), [None] * n
            size = len(inner) // len(there)
            if name == "flags":
                made = np.asarray(inner).reshape(-1, size).tolist()
            else:
                made = [[None] * size for _ in there]
                at = np.flatnonzero(np.asarray(inner.is_valid()))
                for k, value in zip(at.tolist(), inner.take(pa.array(at)).to_pylist()):
                    made[k // size][k % size] = value
            for i, value in zip(there.tolist(), made):
                rows[i] = value
            columns[name] = rows
        elif name in ("head", "rules"):
            rows = [None] * n
            at = np.flatnonzero(np.asarray(c.is_valid()))
            for i, value in zip(at.tolist(), c.take(pa.array(at)).to_pylist()):
                rows[i] = value
            columns[name] = rows
        else:
            columns[name] = c.to_pylist()
    names = list(columns)
    for values in zip(*columns.values()):
        yield dict(zip(names, values))


def _reads(profile: Profile, tags: bool):
    """Reads ranges: rows sorted by (doc, range, kind, line_no), a range's head (kind 0) before its lines."""

    def run(batches):
        key, reader, lines, last = None, None, [], True
        out: list[dict] = []

        def close():
            if key is not None and reader is not None:
                found = reader.read(lines)
                if last:
                    found += reader.end()
                if tags:
                    out.extend({"doc": key[0], "range": key[1], **t} for t in found)
                out.append({"doc": key[0], "range": key[1], "state": json.dumps(reader.s)})

        for b in batches:
            for row in _rows(b):
                if (row["doc"], row["range"]) != key:
                    close()
                    key, reader, lines = (row["doc"], row["range"]), None, []
                if row["kind"] == 0:
                    head = row["head"]
                    ahead = json.loads(head["ahead"]) if head["ahead"] else None
                    last = ahead is None
                    reader = Reader(profile, json.loads(head["state"]), head["body"], head["right"], ahead)
                else:
                    lines.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_TAG_FIELDS)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_TAG_FIELDS)

    return run


def _composed(rows):
    """States of one document's ranges: known ones as they are, the others by effects (a few rows a document)."""
    rows = rows.sort_values("range")
    states, now = [], json.dumps(EMPTY)
    for effect, entry, exit_, sure in zip(rows["effect"], rows["entry"], rows["exit"], rows["sure"]):
        states.append(now)
        if sure and entry == now:
            now = exit_
        else:
            now = json.dumps(after(json.loads(now), json.loads(effect)))
    return rows.assign(entry=states)[["doc", "range", "entry"]]


def tag_lines(lines: DataFrame, profile: Profile | None = None, range_pages: int = RANGE_PAGES) -> DataFrame:
    """What each line is: one row a line (see TAG), blank lines left out. A range is so many pages of a document; lines
    without a page are taken as of the first. The result doesn't depend on the ranges."""
    ship(lines.sparkSession)
    profile = profile or Profile()
    rows = shaped(lines, profile).withColumn("range", F.floor(F.coalesce("page", F.lit(0)) / range_pages).cast("int"))
    rows = materialize(rows, "shaped")
    first = rows.groupBy("doc", "range").agg(F.min(F.struct("line_no", F.struct("text", "page", "x0", "y0", "bold", "lbi", "mark", "flags").alias("line"))).alias("f"))
    order = Window.partitionBy("doc").orderBy("range")  # a row a range
    heads = first.select("doc", "range", F.lead(F.to_json("f.line", {"ignoreNullFields": "false"})).over(order).alias("ahead"), F.count("*").over(Window.partitionBy("doc")).alias("ranges")).join(measures(rows), "doc")
    heads = materialize(heads, "heads")
    parts = fanout(rows)

    def read(entries: DataFrame, tags: bool) -> DataFrame:
        head = entries.join(heads, ["doc", "range"]).select("doc", "range", F.lit(0).alias("kind"), F.struct(F.col("entry").alias("state"), "body", "right", "ahead").cast(_HEAD).alias("head"))
        body = rows if entries is whole else rows.join(entries.select("doc", "range"), ["doc", "range"], "left_semi")
        both = body.select("doc", "range", F.lit(1).alias("kind"), F.lit(None).cast(_HEAD).alias("head"), *[c for c in rows.columns if c not in ("doc", "range")]).unionByName(head, allowMissingColumns=True)
        sorted_ = both.repartition(parts, "doc", "range").sortWithinPartitions("doc", "range", "kind", "line_no")
        return materialize(sorted_.mapInArrow(_reads(profile, tags), TAG + ", state string"), "tags")

    empty = F.lit(json.dumps(EMPTY))
    whole = heads.select("doc", "range", empty.alias("entry"))
    several = heads.where("ranges > 1").select("doc", "range", empty.alias("entry"))
    if several.isEmpty():
        return read(whole, True).where("line_no IS NOT NULL").drop("state")
    guess = read(several, False)
    effects = guess.where("state IS NOT NULL").select("doc", "range", F.col("state").alias("effect"))
    known = effects.withColumn("entry", F.lit("")).withColumn("exit", F.lit("")).withColumn("sure", F.lit(False))
    entries = known.groupBy("doc").applyInPandas(_composed, "doc long, range int, entry string")
    whole = materialize(heads.where("ranges = 1").select("doc", "range", empty.alias("entry")).union(entries), "entries")
    tags = read(whole, True)
    entries = whole
    while True:
        exits = tags.where("state IS NOT NULL").select("doc", "range", F.col("state").alias("exit"))
        known = effects.join(entries, ["doc", "range"]).join(exits, ["doc", "range"]).withColumn("sure", F.lit(True))
        again = known.groupBy("doc").applyInPandas(_composed, "doc long, range int, entry string").alias("n").join(entries.alias("o"), ["doc", "range"]).where(F.col("n.entry") != F.col("o.entry")).select("doc", "range", F.col("n.entry").alias("entry"))
        again = materialize(again, "again")
        if again.isEmpty():
            break
        new = read(again, True)
        keep = lambda old: old.join(again.select("doc", "range"), ["doc", "range"], "left_anti")
        tags = materialize(keep(tags).unionByName(new), "tags")
        entries = materialize(keep(entries).unionByName(again), "entries")
    discard(rows)
    return tags.where("line_no IS NOT NULL").drop("state")


# --- nodes, tables, boxes -----------------------------------------------------------------------------------------

_JOIN = "CASE WHEN i = 0 THEN '' WHEN x.t RLIKE '^\\\\s*[•▪●]' THEN '\\n' WHEN p[i - 1].t RLIKE '[A-Za-z0-9]-$' AND x.t RLIKE '^[a-z0-9]' THEN '' ELSE ' ' END"


def nodes_of(tags: DataFrame, lines: DataFrame) -> DataFrame:
    """Nodes (doc, idx, node, type, number, heading, text, rank, parent, page_start, page_end, first_line, n_lines) in
    the order they open. Parts of a text are joined once: a hyphen closes up, a bullet keeps its line."""
    placed = tags.where("node IS NOT NULL").join(_whole(lines).select("doc", "line_no", "page"), ["doc", "line_no"])
    part = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("t")))))
    own = lambda c: F.first(F.when(F.col("opens"), F.col(c)), ignorenulls=True).alias(c)
    grouped = placed.groupBy("doc", "node").agg(*[own(c) for c in ("type", "number", "rank", "parent", "learned")], part("text").alias("p"), part("heading").alias("h"), part("hang").alias("g"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))
    text = F.expr(f"array_join(transform(p, (x, i) -> concat({_JOIN}, x.t)), '')")
    words = F.array_join(F.concat(F.transform("h", lambda x: x["t"]), F.transform("g", lambda x: x["t"])), " ")
    plain = grouped.select("doc", "node", "type", "number", F.nullif(words, F.lit("")).alias("heading"), text.alias("text"), "rank", "parent", "learned", "page_start", "page_end", "first_line", "n_lines")
    told = plain.join(table_texts(tags, lines).withColumnRenamed("text", "__table"), ["doc", "node"], "left").withColumn("text", F.when(F.col("type") == "table", F.coalesce("__table", F.lit(""))).otherwise(F.col("text"))).drop("__table")
    return told.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("first_line")) - 1)


def table_rows(tags: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, node, row, cells): rows of tables. Steps between baselines come in two sizes, a wrapped cell's and a new
    row's; the first jump between sorted steps parts them, and without one each baseline is a row. Column headings that
    a new page repeats are left out."""
    cells = tags.where("cell IS NOT NULL").join(_whole(lines).select("doc", "line_no", "page", "y0"), ["doc", "line_no"])
    w = Window.partitionBy("doc", "node").orderBy("line_no")
    apart = F.coalesce((F.lag("page").over(w) != F.col("page")) | (F.abs(F.col("y0") - F.lag("y0").over(w)) > BASELINE), F.lit(True))
    based = cells.withColumn("__new", apart).withColumn("base", F.sum(F.col("__new").cast("int")).over(w))
    bases = based.where("__new").select("doc", "node", "base", "page", "y0")
    b = Window.partitionBy("doc", "node").orderBy("base")
    step = F.when(F.lag("page").over(b) == F.col("page"), F.col("y0") - F.lag("y0").over(b))
    bases = bases.withColumn("step", step).withColumn("__first", F.lag("page").over(b).isNull() | (F.lag("page").over(b) != F.col("page")))
    s = Window.partitionBy("doc", "node").orderBy("step")
    jumps = bases.where("step IS NOT NULL").withColumn("__up", F.lead("step").over(s)).where((F.col("step") <= 0) & F.col("__up").isNotNull() | (F.col("__up") / F.col("step") >= WRAP_RATIO))
    wrap = jumps.groupBy("doc", "node").agg(F.min("step").alias("wrap"))
    opened = F.col("__first") | F.col("wrap").isNull() | (F.col("step") > F.col("wrap"))
    numbered = bases.join(wrap, ["doc", "node"], "left").withColumn("row", F.sum(opened.cast("int")).over(b))
    width = cells.groupBy("doc", "node").agg((F.max("cell") + 1).alias("width"))
    texts = based.join(numbered.select("doc", "node", "base", "row"), ["doc", "node", "base"]).groupBy("doc", "node", "row", "cell").agg(F.sort_array(F.collect_list(F.struct("line_no", F.col("text").alias("t")))).alias("p"))
    texts = texts.withColumn("t", F.expr(f"array_join(transform(p, (x, i) -> concat({_JOIN}, x.t)), '')"))
    rows = texts.groupBy("doc", "node", "row").agg(F.map_from_entries(F.collect_list(F.struct("cell", "t"))).alias("m")).join(width, ["doc", "node"])
    rows = rows.select("doc", "node", F.col("row").cast("int").alias("row"), F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("cells"))
    # A repeat of the first row, and what follows it as the rows after the first.
    r = Window.partitionBy("doc", "node").orderBy("row")
    marked = rows.withColumn("__at", F.row_number().over(r)).withColumn("__head", F.max(F.when(F.col("cells") == F.first("cells").over(r), F.col("__at"))).over(r))
    marked = marked.withColumn("__like", F.col("__at") - F.col("__head") + 1)
    model = marked.select("doc", "node", F.col("__at").alias("__like"), F.col("cells").alias("__cells"))
    same = marked.join(model, ["doc", "node", "__like"], "left").withColumn("__same", F.coalesce(F.col("cells") == F.col("__cells"), F.lit(False)))
    run = Window.partitionBy("doc", "node", "__head").orderBy("__at")
    return same.withColumn("__again", (F.col("__head") > 1) & (F.min(F.col("__same").cast("int")).over(run) == 1)).where("NOT __again").select("doc", "node", "row", "cells")


def table_texts(tags: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, node, text): tables as text, a line a row, cells parted by bars."""
    rows = table_rows(tags, lines)
    return rows.groupBy("doc", "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", F.array_join("cells", " | ").alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def node_boxes(tags: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, node, box, page, x0, y0, x1, y1): a box for each run of a node's lines that follow each other on a page."""
    at = tags.where("node IS NOT NULL").select("doc", "line_no", "node").join(_whole(lines).select("doc", "line_no", "page", "x0", "x1", "y0", "y1"), ["doc", "line_no"])
    w = Window.partitionBy("doc", "node").orderBy("line_no")
    near = (F.lag("page").over(w) == F.col("page")) & (F.col("y0") - F.lag("y1").over(w) <= (F.col("y1") - F.col("y0")) * BOX_GAP)
    runs = at.withColumn("__new", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("box", F.sum("__new").over(w))
    return runs.groupBy("doc", "node", "box").agg(F.first("page").alias("page"), *[F.round(f(c), 1).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def read_statutes(lines: DataFrame, profile: Profile | None = None, range_pages: int = RANGE_PAGES) -> DataFrame:
    """Nodes of documents from their printed lines (front matter left out)."""
    body = materialize(without_front(lines), "lines")
    return nodes_of(tag_lines(body, profile, range_pages), body)
