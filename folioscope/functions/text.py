"""Text as columns: tokens, normal forms, keys, dates, citations, tables and names. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Citation verbs and the kind of change each one states.
CHANGE_VERBS = {"inserted": "inserted", "repealed": "repealed", "amended": "changed", "substituted": "changed", "renumbered": "changed", "re-numbered": "changed", "new": "inserted", "revoked": "repealed", "expired": "repealed"}
KIND_RANK = {"changed": 1, "inserted": 2, "repealed": 3}
TRUTHY = ("1", "on", "true", "yes")


def search_tokens(c: Column) -> Column:
    """Letters and digits of the lower-cased text, in order (accents kept)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def vocabulary_tokens(c: Column) -> Column:
    """Words of two letters and more; digits and marks split them."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{2,}"), F.lit(0))


def diff_tokens(c: Column) -> Column:
    """Words as two wordings are compared: runs without white space, punctuation kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def heading_of(c: Column) -> Column:
    return F.element_at(F.split(c, "\n", 2), 1)


def body_of(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(c, "\n", 2), F.lit(2)), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def reflow(c: Column) -> Column:
    """Line wraps to one space."""
    return F.regexp_replace(c, r"[ \t]*\n+[ \t]*", " ")


def reflow_keeping_bullets(c: Column) -> Column:
    """Line wraps to one space, but a line that opens with a bullet stays a line."""
    parts = F.split(c, r"\n(?=[ \t]*[•\-\*] )")
    return F.array_join(F.transform(parts, lambda part: reflow(part)), "\n")


def join_printed_lines(lines: Column) -> Column:
    """One text of printed lines: a hyphen at an end closes up, a bullet line keeps its break, others get a space."""

    def add(text: Column, line: Column) -> Column:
        return (
            F.when(text == "", line)
            .when(line.rlike(r"^\s*•"), F.concat(text, F.lit("\n"), line))
            .when(text.rlike(r"\p{L}-$") & line.rlike(r"^\p{Ll}"), F.concat(text, line))
            .otherwise(F.concat(text, F.lit(" "), line))
        )

    return F.aggregate(lines, F.lit(""), add)


def unmap_symbols(c: Column) -> Column:
    """Private-use code points of symbol fonts (U+F020 to U+F07E) to the ASCII they stand for."""
    codes = range(0x20, 0x7F)
    return F.translate(c, "".join(chr(0xF000 + i) for i in codes), "".join(map(chr, codes)))


def symbol_font_text(text: Column, font: Column) -> Column:
    return F.when(font.contains("Symbol"), unmap_symbols(text)).otherwise(text)


def normalise(c: Column) -> Column:
    """A wording as versions are compared on: no wraps, no symbol-font code points, single spaces."""
    return collapse(unmap_symbols(reflow(F.coalesce(c, F.lit("")))))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")


def digit_mask(c: Column) -> Column:
    """A printed line as it repeats from page to page: digits masked, spaces single."""
    return collapse(F.regexp_replace(c, r"\d", "#"))


def work_of(slug: Column) -> Column:
    """The work of a document slug, without its version."""
    return F.regexp_replace(slug, r"-v\d+$", "")


def version_of(slug: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(slug, r"-v(\d+)$", 1), F.lit("")), F.lit("999999")).cast("int")


def document_slug(work: Column, version: Column) -> Column:
    return F.concat(work, F.lit("-v"), version.cast("string"))


def printed_date(c: Column) -> Column:
    """A printed day ("1 July 2026", "1 Jul 2026") as a date; null where it is none."""
    day = F.regexp_extract(c, r"(\d{1,2} \p{L}+ \d{4})", 1)
    return F.coalesce(F.try_to_date(day, "d MMMM yyyy"), F.try_to_date(day, "d MMM yyyy"))


def front_matter(c: Column) -> Column:
    """Version, date, title, number and year as a document's first pages state them; null where unstated."""
    text = reflow(c)

    def grab(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    printed = grab(r"(?i)incorporating amendments as at\s+(\d{1,2} \p{L}+ \d{4})")
    return F.struct(
        grab(r"(?i)Version No\.?\s*(\d{1,4})").cast("int").alias("version"),
        printed_date(printed).alias("as_at"),
        printed.alias("as_at_printed"),
        F.trim(grab(r"(?i)\d\s+(\p{Lu}[\p{L}\p{N}' ,()-]*? Act \d{4})")).alias("title"),
        grab(r"(?i)No\. (\d+) of \d{4}").alias("act_no"),
        grab(r"(?i)No\. \d+ of (\d{4})").cast("int").alias("year"),
    )


def citations(c: Column) -> Column:
    """Citations "no/year" (or a bare number after "No." or "Nos") of a note, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?:(?<=Nos? )|(?<=Nos?\. )|(?<=, )|(?<=and ))(\d{1,5}(?:/\d{4})?)(?= ?(?:,|ss?\.|$|\.|and|\(|Sch|rr?\.))"), F.lit(1))
    return F.array_distinct(found)


def change_kind(c: Column) -> Column:
    """The change the last verb of a text states: inserted, repealed or changed."""
    verbs = F.regexp_extract_all(F.lower(c), F.lit(r"\b(" + "|".join(sorted(CHANGE_VERBS, key=len, reverse=True)) + r")\b"), F.lit(1))
    last = F.try_element_at(verbs, F.lit(-1))
    mapping = F.create_map(*(F.lit(x) for pair in CHANGE_VERBS.items() for x in pair))
    return F.coalesce(mapping[last], F.lit("changed"))


def note_target(c: Column) -> Column:
    """What a note says it is about: the words before its first verb, in lower case."""
    head = F.regexp_extract(c, r"(?is)^(.*?)(?:\b(?:" + "|".join(CHANGE_VERBS) + r")\b|$)", 1)
    return F.lower(F.regexp_replace(collapse(head), r"^[ .,;]+|[ .,;]+$", ""))


def section_numbers(c: Column) -> Column:
    """Section numbers a reference names; of a range, its first end."""
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+[A-Z]*)(?:\s*(?:-|–|to)\s*\d+[A-Z]*)?"), F.lit(1))
    return F.array_distinct(parts)


def provision_key(schedule: Column, number: Column) -> Column:
    """How a provision is told apart across documents: its Schedule (null in the body) and number, in lower case."""
    return F.struct(F.lower(F.nullif(schedule, F.lit(""))).alias("schedule"), F.lower(F.coalesce(number, F.lit(""))).alias("number"))


def provision_kind(node_type: Column) -> Column:
    """Sections, clauses, items and preambles are one kind; containers are their own."""
    return F.when(node_type.isin("section", "clause", "item", "preamble"), F.lit("provision")).otherwise(node_type)


def sub_path(c: Column) -> Column:
    """Bracketed levels "(1)(a)" as an array."""
    return F.regexp_extract_all(c, F.lit(r"\(([^()]+)\)"), F.lit(1))


def natural_number(c: Column) -> Column:
    """Sort key of a provision number: 7 before 7A before 8."""
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(0)).alias("n"), F.regexp_extract(c, r"^\d*(.*)$", 1).alias("suffix"))


def insertion_parts(c: Column) -> Column:
    """ "26AB" as base and suffix."""
    return F.struct(F.regexp_extract(c, r"^(\d+)", 1).alias("base"), F.regexp_extract(c, r"^\d+([A-Z]*)$", 1).alias("suffix"))


def format_rows(rows: Column) -> Column:
    """Rows of cells as "a | b" lines."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def split_rows(c: Column) -> Column:
    """Lines of "a | b" as rows of cells."""
    return F.transform(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), lambda x: F.transform(F.split(x, r"\|"), lambda cell: F.trim(cell)))


def name_slug(c: Column) -> Column:
    """A number or heading as part of a name; dots stay."""
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9.]+", "-"), r"^-+|-+$", "")), 1, 40)


def content_digest(node_type: Column, heading: Column, text: Column) -> Column:
    """Six hex digits of a piece's type, heading and first 120 characters."""
    parts = [F.coalesce(node_type, F.lit("")), F.coalesce(heading, F.lit("")), F.substring(reflow(F.coalesce(text, F.lit(""))), 1, 120)]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 6)


def ancestors(name: Column) -> Column:
    """A path name and all its prefixes at slashes, longest last."""
    parts = F.split(name, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def is_definition_start(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*[\p{L}\p{N}][\p{L}\p{N} ,'()-]*? (?:means|includes|has the (?:same )?meaning)\b")


def looks_like_definitions(heading: Column) -> Column:
    return heading.rlike(r"(?i)\b(definition|interpretation)")


def defined_terms(c: Column) -> Column:
    """Terms that a text's lines define ("T1, T2 and T3 means ..."), in order."""
    heads = F.regexp_extract_all(c, F.lit(r"(?m)^\s*([^\n—]{1,120}?) (?:means|includes)\b"), F.lit(1))
    terms = F.flatten(F.transform(heads, lambda h: F.split(h, r",\s*|\s+and\s+|\s+or\s+")))
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def definition_scope(c: Column) -> Column:
    """Act, chapter, part, division, schedule or section of a lead-in "In this ..."."""
    return F.lower(F.nullif(F.regexp_extract(c, r"(?i)\bin this (act|chapter|part|division|subdivision|schedule|section|clause)\b", 1), F.lit("")))


def opening_class(c: Column) -> Column:
    """What a line opens with."""
    rules = (("subsection", r"^\(\d+[A-Z]*\)"), ("roman_or_letter", r"^\([a-z]+\)"), ("capital", r"^\([A-Z]+\)"), ("decimal", r"^\d+\.\d+"), ("number", r"^\d+[A-Z]*\b"), ("word_upper", r"^\p{Lu}"), ("word_lower", r"^\p{Ll}"))
    out = F.lit("other")
    for name, pattern in reversed(rules):
        out = F.when(F.trim(c).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def provision_label(path: Column) -> Column:
    """ "s. 28(1)(b)" of a struct (section, subsection, paragraph, subparagraph)."""
    level = lambda k: F.when(path[k].isNotNull(), F.concat(F.lit("("), path[k], F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("s. "), path["section"], level("subsection"), level("paragraph"), level("subparagraph"))


def snippet_html(c: Column, start: str = "\x02", stop: str = "\x03") -> Column:
    """Escaped text with its marks as elements."""
    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(safe, F.lit(start), F.lit("<mark>")), F.lit(stop), F.lit("</mark>"))


def clean_instruction(c: Column) -> Column:
    """Typographic quotes, dashes and spaces to plain ones."""
    return collapse(F.translate(c, "‘’“”–— ", "''\"\"-- "))


def field_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def title_citation(c: Column) -> Column:
    """The last "No. n/yyyy" of a title."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"No\.? ?(\d+/\d{4})"), F.lit(1)), F.lit(-1))
