"""Printed lines: numbers, pages, rows, paragraphs, memoranda and endnotes, and the nodes of plain lines. The reader of
whole statutes is `statutes`. Input lines: doc, line_no, text, page, x0, x1, y0, size, bold."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

_ROMAN = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))


def int_to_roman(n: int) -> str:
    out = ""
    for sign, value in _ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def roman_to_int(s: str) -> int | None:
    """Value of a roman number in lower case; null for anything that isn't one."""
    value, i = 0, 0
    for sign, v in _ROMAN:
        while s.startswith(sign, i):
            value, i = value + v, i + len(sign)
    return value if i == len(s) and value and int_to_roman(value) == s else None


def next_letter(s: str) -> str:
    """a to b, z to aa, az to ba."""
    n = 0
    for c in s:
        n = n * 26 + ord(c) - 96
    n, out = n + 1, ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def bracket_level(content: str, open_: dict[str, str]) -> str:
    """Level of a bracketed number: digits are subsections, capitals the deepest; of small letters that are also roman,
    the one that continues an open run, and "i" under an open letter begins the romans."""
    if content[0].isdigit():
        return "subsection"
    if content.isupper():
        return "sub_subparagraph"
    roman = roman_to_int(content)
    if roman is None:
        return "paragraph"
    last_letter, last_roman = open_.get("paragraph"), open_.get("subparagraph")
    if last_roman is not None and roman == (roman_to_int(last_roman) or 0) + 1:
        return "subparagraph"
    if last_letter is not None and content == next_letter(last_letter):
        return "paragraph"
    return "subparagraph" if roman == 1 and last_letter is not None else "paragraph"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Flat typed nodes in document order from words and boldness alone (`statutes` also reads the lines' places). A
    line belongs to one node at most; blank lines to none."""
    from folioscope.operators.statutes import nodes_of, tag_lines

    plain = lines.select("doc", "line_no", "text", "page", "bold")
    n = nodes_of(tag_lines(plain), plain)
    return n.select(F.col("doc").cast("long").alias("doc"), F.col("idx").cast("int").alias("idx"), "type", "number", "heading", F.coalesce("text", F.lit("")).alias("text"), "page_start", "page_end", F.col("first_line").cast("int").alias("first_line"), F.col("n_lines").cast("int").alias("n_lines"))


def diagnostics(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings (doc, severity, category, message, idx): unread lines are errors, repeated numbers and empty provisions
    warnings."""
    read = nodes.groupBy("doc").agg(F.sum("n_lines").alias("read"))
    had = lines.where(F.trim("text") != "").groupBy("doc").agg(F.count("*").alias("had"))
    lost = had.join(read, "doc", "left").where("coalesce(read, 0) <> had").select("doc", F.lit("error").alias("severity"), F.lit("incomplete").alias("category"), F.concat(F.coalesce(F.col("read"), F.lit(0)).cast("string"), F.lit(" of "), F.col("had").cast("string"), F.lit(" lines read")).alias("message"), F.lit(None).cast("int").alias("idx"))
    w = Window.partitionBy("doc", "type", "number").orderBy("idx")
    again = nodes.where("type = 'section'").withColumn("n", F.row_number().over(w)).where("n > 1").select("doc", F.lit("warning").alias("severity"), F.lit("duplicate_number").alias("category"), F.concat(F.lit("section "), "number", F.lit(" again")).alias("message"), "idx")
    nothing = nodes.where("coalesce(text, '') = '' AND coalesce(heading, '') = '' AND type <> 'repealed'").select("doc", F.lit("warning").alias("severity"), F.lit("empty").alias("category"), F.col("type").alias("message"), "idx")
    return lost.unionByName(again).unionByName(nothing)


def body_size(lines: DataFrame) -> DataFrame:
    """(doc, body): most frequent size of lines that aren't bold, the smaller on ties."""
    n = lines.where("NOT bold").groupBy("doc", F.round("size", 1).alias("size")).agg(F.count("*").alias("n"))
    return n.groupBy("doc").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("neg"))).alias("body"))


def body_start(lines: DataFrame) -> DataFrame:
    """(doc, page): first page after the leading run of pages with a contents mark in their first ten lines."""
    top = F.row_number().over(Window.partitionBy("doc", "page").orderBy("line_no"))
    pages = lines.withColumn("n", top).where("n <= 10").groupBy("doc", "page").agg(F.max(F.col("text").rlike(r"(?i)^\s*(table of provisions|contents|(section|clause)\s+page)\b").cast("int")).alias("toc"))
    run = F.min("toc").over(Window.partitionBy("doc").orderBy("page"))
    return pages.withColumn("run", run).groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("run") == 0, F.col("page"))), F.max("page") + 1).alias("page"))


def endnotes_start(lines: DataFrame) -> DataFrame:
    """(doc, page): page of the first large bold "Endnotes"."""
    return lines.where(F.col("bold") & (F.col("size") >= 14) & F.lower(F.trim("text")).isin("endnotes")).groupBy("doc").agg(F.min("page").alias("page"))


def repeated_heads(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc, masked): lines that, digits masked, stand on at least `share` of a document's pages."""
    from folioscope.functions.text import digit_mask

    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    seen = lines.withColumn("masked", digit_mask(F.col("text"))).groupBy("doc", "masked").agg(F.countDistinct("page").alias("on"))
    return seen.join(pages, "doc").where((F.col("pages") > 1) & (F.col("on") >= F.col("pages") * share) & (F.col("masked") != "")).select("doc", "masked")


ROW = "doc long, row_no int, texts array<string>"


def visual_rows(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines that stand side by side: a row takes what is within `tolerance` of its first line's height, left to right."""

    def rows(p: pd.DataFrame) -> pd.DataFrame:
        out, anchor = [], None
        for r in p.sort_values(["page", "y0", "x0"]).itertuples():
            if anchor is None or r.page != anchor[0] or abs(r.y0 - anchor[1]) > tolerance:
                anchor = r.page, r.y0
                out.append([])
            out[-1].append((r.x0, r.text))
        return pd.DataFrame({"doc": p.doc.iloc[0], "row_no": range(len(out)), "texts": [[t for _, t in sorted(x, key=lambda c: c[0])] for x in out]})

    return lines.groupBy("doc").applyInPandas(rows, ROW)


def paragraph_starts(lines: DataFrame) -> DataFrame:
    """Adds `starts`: a gap over 1.4 of the median one, after a line that ends well short of the usual right edge."""
    w = Window.partitionBy("doc").orderBy("line_no")
    gaps = lines.withColumn("gap", F.col("y0") - F.lag("y0").over(w)).withColumn("last_x1", F.lag("x1").over(w))
    usual = gaps.groupBy("doc").agg(F.percentile("gap", 0.5).alias("median"), F.percentile("x1", 0.9).alias("edge"))
    short = F.col("last_x1") < F.col("edge") - 10
    starts = F.col("gap").isNull() | (F.col("gap") < 0) | ((F.col("gap") > 1.4 * F.col("median")) & short)
    return gaps.join(usual, "doc").withColumn("starts", starts).drop("gap", "last_x1", "median", "edge")


def parse_memorandum(lines: DataFrame) -> DataFrame:
    """Clause notes of an explanatory memorandum (doc, entry, clause, schedule, text): a bold "Clause 4" or a number no
    more than 30 past the last opens one."""

    def entries(p: pd.DataFrame) -> pd.DataFrame:
        out, schedule, last = [], None, 0
        for r in p.sort_values("line_no").itertuples():
            text = (r.text or "").strip()
            if m := re.match(r"^Schedule\s+(\d+)", text):
                if r.bold:
                    schedule, last = m[1], 0
                    continue
            m = re.match(r"^(?:Clause\s+)?(\d+)[A-Z]*\b\s*(.*)$", text)
            if m and r.bold and 0 < int(m[1]) - last <= 30:
                last = int(m[1])
                out.append([m[1], schedule, m[2]])
            elif out:
                out[-1][2] = f"{out[-1][2]} {text}".strip()
        frame = pd.DataFrame(out, columns=["clause", "schedule", "text"])
        frame.insert(0, "entry", range(len(frame)))
        frame.insert(0, "doc", p.doc.iloc[0])
        return frame

    return lines.select("doc", "line_no", "text", "bold").groupBy("doc").applyInPandas(entries, "doc long, entry int, clause string, schedule string, text string")


def parse_endnotes(lines: DataFrame) -> DataFrame:
    """Table of Amendments (doc, pos, title, act_no, year, fields): a title with "No. n/yyyy" opens a record, "label:
    value" lines fill it."""

    def records(p: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in p.sort_values("line_no").itertuples():
            text = (r.text or "").strip()
            cite = re.findall(r"No\.? ?(\d+)/(\d{4})", text)
            if cite and ":" not in text:
                out.append({"title": re.sub(r",?\s*No\.? ?\d+/\d{4}.*$", "", text), "act_no": cite[-1][0], "year": cite[-1][1], "fields": {}})
            elif out and ":" in text:
                label, value = text.split(":", 1)
                out[-1]["fields"][re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_")] = value.strip()
        frame = pd.DataFrame(out, columns=["title", "act_no", "year", "fields"])
        frame.insert(0, "pos", range(len(frame)))
        frame.insert(0, "doc", p.doc.iloc[0])
        return frame

    return lines.select("doc", "line_no", "text").groupBy("doc").applyInPandas(records, "doc long, pos int, title string, act_no string, year string, fields map<string,string>")


def attach_notes(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """Margin notes to nodes: notes (doc, note_no, section, path, kind), nodes with section and levels (array). The
    exact level array wins, then the nearest open level, then the section; a repeal note takes the first repealed row
    of its section that no other note took. `idx` is null for notes that attach to nothing."""

    def attach(n: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        by_section: dict[str, list] = {}
        for r in n.sort_values("idx").itertuples():
            by_section.setdefault(r.section, []).append(r)
        for r in m.sort_values("note_no").itertuples():
            here = by_section.get(r.section, [])
            path, target, how = list(r.path) if r.path is not None else [], None, None
            if r.kind == "repealed":
                free = [x for x in here if x.type == "repealed" and x.idx not in taken]
                if free:
                    target, how = free[0].idx, "repealed_row"
                    taken.add(target)
            while target is None and here:
                hit = [x for x in here if list(x.levels if x.levels is not None else []) == path]
                if hit:
                    target, how = hit[0].idx, "exact" if len(path) == len(r.path if r.path is not None else []) else "parent"
                elif not path:
                    target, how = here[0].idx, "section"
                path = path[:-1]
            out.append((r.doc, r.note_no, target, how))
        return pd.DataFrame(out, columns=["doc", "note_no", "idx", "confidence"]).astype({"idx": "Int64"})

    return nodes.groupBy("doc").cogroup(notes.groupBy("doc")).applyInPandas(attach, "doc long, note_no long, idx long, confidence string")
