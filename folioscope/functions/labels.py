"""Labels and small text forms: how nodes, pages and rows are called and printed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Levels whose numbers are printed in brackets.
BRACKETED = ("subsection", "paragraph", "subparagraph", "sub_subparagraph")


def _joined(*parts: Column) -> Column:
    """What is there of some parts, with single spaces."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def kind_name(kind: Column) -> Column:
    """A type as a reader sees it: heading_group is Heading Group."""
    return F.initcap(F.replace(F.coalesce(kind, F.lit("")), F.lit("_"), F.lit(" ")))


def page_label(kind: Column, number: Column, heading: Column) -> Column:
    """Section 242 Committal proceeding, as far as known."""
    return _joined(kind_name(kind), number, heading)


def breadcrumb_label(ancestors: Column) -> Column:
    """Labels of nodes (type, number, heading) from the outermost on."""
    labels = F.transform(ancestors, lambda a: page_label(a["type"], a["number"], a["heading"]))
    return F.array_join(F.filter(labels, lambda x: x != ""), " › ")


def printed_number(kind: Column, number: Column) -> Column:
    """(a) for bracketed levels and an example's letters, else the number as it is."""
    letters = (kind == "example") & number.rlike(r"^\p{L}+$")
    return F.when(kind.isin(*BRACKETED) | letters, F.concat(F.lit("("), number, F.lit(")"))).otherwise(number)


def relative_name(name: Column, root: Column) -> Column:
    """A path name below `root`: empty for the root itself, names elsewhere as they are."""
    below = F.startswith(name, F.concat(root, F.lit("/")))
    return F.when(name == root, "").when(below, F.substr(name, F.length(root) + 2)).otherwise(name)


def rule_signature(when: Column, then: Column) -> Column:
    """Twelve hex digits of what a rule says, whenever and from whatever it was learned (both: JSON with sorted keys)."""
    return F.substring(F.sha1(F.concat(F.lit('{"then": '), then, F.lit(', "when": '), when, F.lit("}")).cast("binary")), 1, 12)


def line_shape(text: Column) -> Column:
    """A line's opening word as a pattern: digits as any digits, all else as printed."""
    word = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\S+)", 1)
    literal = F.regexp_replace(word, r"([\\^$.|?*+()\[\]{}/-])", r"\\$1")
    return F.when(word != "", F.concat(F.lit("^"), F.regexp_replace(literal, r"[0-9]+", r"\\d+")))


def lead_in_act(text: Column) -> Column:
    """The Act that a lead-in names: "... of the Crimes Act 1958—" at the very end; null elsewhere."""
    found = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"(?i)(?:of|in|under) the ((?-i:[A-Z])[\w'()&-]*(?: [\w'()&-]+)* (?:Act|Bill) (?:18|19|20)\d{2})\s*[—–:-]\s*$", 1)
    return F.nullif(found, F.lit(""))


def definition_clauses(text: Column, starts) -> Column:
    """A text as one clause a definition (`starts`: whether a line begins one), lines of a clause joined; what comes
    before the first definition is a clause of its own."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x != "")
    opened = F.aggregate(lines, F.array().cast("array<string>"), lambda done, x: F.when((F.size(done) == 0) | starts(x), F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", F.get(done, F.size(done) - 1), x)))))
    return opened


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table whose first row is the header; null without rows."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)), "\n"))
