"""The grammar of amending provisions, as columns: what a sentence tells an Act to do.

Quoted words are taken out of a sentence first (a mark of the depth of quotes at each sign, so that quotes inside quotes
stay together) and stand in it as numbered marks. What is left is split and matched by plain patterns in the JVM: no
word that is being inserted can pass for a part of the grammar. Marks are put back at the end. One row an instruction:
a sentence has one for each item of its list and each of its further targets; a sentence that fits no form is kept,
unparsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How places, Acts and operations are written.
ACT_TITLE = r"[A-Z][\w ,()'-]*? Act \d{4}"
PLACE = r"\([0-9A-Za-z.]+\)"
TARGET = rf"(the heading to )?(?:[Ss]ection|[Cc]lause|[Ii]tem) (\d+[A-Z]*(?:\.\d+[A-Z]*)?)((?:{PLACE})*)((?:(?:,| and) (?:{PLACE})+)*)(?: (?:of|in|to) Schedule (\d+[A-Z]*))?"
TERM = r"‹\d+›|[\w ]+?"
SENTENCE = rf"(?s)^(?:(In|For|After|Before|At the end of) )?(?:the definition of ({TERM}) in )?{TARGET}(?: (?:of|to) the (Principal Act|{ACT_TITLE}))?(.*)$"
EVERY = r"(?:\s*\((?:wherever|where \w+) occurring\))?"
MARK = "‹\\d+›"
#: Operations on words: action, pattern, which group is old and which is new (0: none), in the order they are tried.
OPERATIONS = [
    ("substitute", rf"^for ({MARK}){EVERY} substitute ({MARK})$", 1, 2),
    ("insert_after", rf"^after ({MARK}) insert ({MARK})$", 1, 2),
    ("insert_before", rf"^before ({MARK}) insert ({MARK})$", 1, 2),
    ("omit", rf"^omit ({MARK}){EVERY}$", 1, 0),
    ("omit", rf"^({MARK}) (?:is|are) omitted$", 1, 0),
    ("insert_at_end", rf"^at the end (?:of the paragraph |of the subsection )?insert ({MARK})$", 0, 1),
    ("insert_definition", r"(?s)^insert the following definitions?(?: in (?:the appropriate )?alphabetical order)?\s*—?\s*(.+)$", 0, 1),
    ("replace_definition", r"(?s)^for the definition of (?:.+?) substitute\s*—?\s*(.+)$", 0, 1),
]
ITEM = r"(?:^|;\s*(?:and\s+)?|—\s*)\(([a-z]{1,3})\)\s+"
NARROW = rf"^in (?:sub)?(?:section|paragraph|subparagraph|clause) ((?:{PLACE})+),?\s*"
WHOLE = rf"(?s)^(after|before|for) (?:sub)?(?:section|paragraph|subparagraph|clause) ((?:{PLACE})+) (?:insert|substitute)\s*—?\s*(.+)$"
IN_DEFINITION = rf"^in the definition of ({TERM})\s*(?:—|,)\s*"
OWN_NUMBER = r"^(?:\(([0-9A-Za-z]+)\)\s*|(\d+[A-Z]*)\s+)"


def plain(c: Column) -> Column:
    """One way of writing dashes and spaces; quotes keep their sides."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "–‘’", "-''"), r"(?U)\s+", " "))


def masked(c: Column) -> Column:
    """(text, quoted): the text with a mark in the place of each outermost quotation, and the quotations.

    “ opens and ” closes; a straight sign opens where nothing is open and closes what it opened. An open end runs to the
    end of the text."""
    parts = F.regexp_extract_all(c, F.lit('[“”"]|[^“”"]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("text"), F.array().cast("array<string>").alias("own"), F.array().cast("array<string>").alias("quoted"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"]
        sign = x.isin("“", "”", '"')
        opens = (x == "“") | ((x == '"') & (depth == 0))
        closes = sign & ~opens
        inside = (depth > 0) & ~(closes & (depth == 1))
        last = closes & (depth == 1)
        mark = F.concat(F.lit("‹"), F.size(s["quoted"]).cast("string"), F.lit("›"))
        outside = (depth == 0) & ~opens & ~sign
        return F.struct(
            F.when(opens, depth + 1).when(closes, F.greatest(depth - 1, F.lit(0))).otherwise(depth).alias("depth"),
            F.when(outside, F.array_append(s["text"], x)).when(last, F.array_append(s["text"], mark)).otherwise(s["text"]).alias("text"),
            F.when(last, F.array().cast("array<string>")).when(inside, F.array_append(s["own"], x)).otherwise(s["own"]).alias("own"),
            F.when(last, F.array_append(s["quoted"], F.array_join(s["own"], ""))).otherwise(s["quoted"]).alias("quoted"),
        )

    def finish(s: Column) -> Column:
        open_ = s["depth"] > 0
        mark = F.concat(F.lit("‹"), F.size(s["quoted"]).cast("string"), F.lit("›"))
        return F.struct(F.array_join(F.when(open_, F.array_append(s["text"], mark)).otherwise(s["text"]), "").alias("text"), F.when(open_, F.array_append(s["quoted"], F.array_join(s["own"], ""))).otherwise(s["quoted"]).alias("quoted"))

    return F.aggregate(parts, start, step, finish)


def unmasked(text: Column, quoted: Column, sign: str = "") -> Column:
    """Marks back to what was quoted, with a sign around it."""
    parts = F.regexp_extract_all(text, F.lit(f"{MARK}|[^‹]+|‹"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{MARK}$"), F.concat(F.lit(sign), F.coalesce(F.try_element_at(quoted, F.regexp_extract(p, r"\d+", 0).cast("int") + 1), F.lit("")), F.lit(sign))).otherwise(p)), "")


def places(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\(([^()]+)\)"), F.lit(1))


def style(c: Column) -> Column:
    """How a place is numbered: digits, small romans, small letters, capitals."""
    return F.when(c.rlike(r"\d"), "digits").when(c.rlike("^[ivxl]+$"), "romans").when(c.rlike("^[a-z]"), "letters").when(c.rlike("^[A-Z]"), "capitals").otherwise("other")


def targets(path: Column, also: Column) -> Column:
    """The path and those of further targets: "(2)(b)(ii) and (iii)". A further one takes the place of the last part that is
    numbered in its style, or stands under the whole."""

    def further(group: Column) -> Column:
        extra = places(group)
        same = F.filter(F.sequence(F.lit(0), F.size(path) - 1), lambda i: (F.size(path) > 0) & (style(F.try_element_at(path, F.greatest(i, F.lit(0)) + 1)) == style(F.element_at(extra, 1))))
        at = F.coalesce(F.array_max(same), F.size(path))
        return F.concat(F.slice(path, F.lit(1), at), extra)

    groups = F.regexp_extract_all(F.coalesce(also, F.lit("")), F.lit(rf"(?:,| and) ((?:{PLACE})+)"), F.lit(1))
    return F.concat(F.array(path), F.transform(groups, further))


def items(c: Column) -> Column:
    """Operations (item, op) of a sentence's list; one without a letter where there is no list."""
    body = F.regexp_replace(F.trim(c), r"\.\s*$", "")
    letters = F.regexp_extract_all(body, F.lit(ITEM), F.lit(1))
    parts = F.slice(F.split(body, ITEM), F.lit(2), F.greatest(F.size(letters), F.lit(1)))
    ends = F.transform(F.arrays_zip(letters.alias("item"), parts.alias("op")), lambda x: F.struct(x["item"].alias("item"), F.regexp_replace(F.trim(x["op"]), r"\s*;\s*$", "").alias("op")))
    return F.when(F.size(letters) > 0, ends).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("item"), F.trim(body).alias("op"))))


def _group(c: Column, pattern: str, k: int) -> Column:
    """A group of a match, null where there is no match or nothing in it."""
    return F.nullif(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k)), F.lit(""))


_SEP = "\x01"


def _groups(c: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern that matches the whole of a text, from one match: an array, empty where there is no match.
    Texts that hold the separating sign themselves are matched once a group."""
    cut = F.split(F.regexp_replace(c, pattern, _SEP + _SEP.join(f"${k}" for k in range(1, n + 1))), _SEP)
    none = F.array().cast("array<string>")
    each = F.when(c.rlike(pattern), F.array(*[F.regexp_extract(c, pattern, k) for k in range(1, n + 1)])).otherwise(none)
    return F.when(c.contains(_SEP), each).when(F.size(cut) > 1, F.slice(cut, 2, n)).otherwise(none)


def _block(c: Column, quoted: Column) -> tuple[Column, Column]:
    """Number and words of a provision that is given whole."""
    body = F.regexp_replace(F.trim(c), r"\.?\s*$", "")
    words = F.trim(F.when(body.rlike(f"^{MARK}$"), unmasked(body, quoted)).otherwise(unmasked(body, quoted, '"')))
    number = F.nullif(F.coalesce(F.nullif(F.regexp_extract(words, OWN_NUMBER, 1), F.lit("")), F.regexp_extract(words, OWN_NUMBER, 2)), F.lit(""))
    return number, F.when(number.isNotNull(), F.trim(F.regexp_replace(words, OWN_NUMBER, ""))).otherwise(words)


def read_amendments(rows: DataFrame, text: str = "text", provision: str = "provision", principal: str = "principal") -> DataFrame:
    """Instructions of amending provisions: `rows` (with a text, how the provision is cited, and the Act that "the Principal
    Act" means there) by their other columns, `op_no` and what the operation is.

    action: substitute, insert_after, insert_before, omit, insert_at_end, insert_definition, replace_definition,
    replace_provision, insert_provision, insert_section, repeal or unparsed. Null and empty texts give one unparsed row."""
    others = [c for c in rows.columns if c not in (text, provision, principal)]
    whole = rows.select(*others, F.col(provision).alias("__by"), F.col(principal).alias("__principal"), plain(F.col(text)).alias("__raw"))
    m = whole.withColumn("__m", masked(F.col("__raw"))).withColumn("__t", F.col("__m.text")).withColumn("__q", F.col("__m.quoted"))
    t, q = F.col("__t"), F.col("__q")
    # What several columns need is a column first: each pattern is tried once a row.
    names = ("lead", "term", "heading", "section", "path", "also", "schedule", "act", "rest")
    m = m.withColumn("__parts", _groups(t, SENTENCE, len(names)))
    m = m.select("*", *[F.nullif(F.get("__parts", F.lit(k)), F.lit("")).alias(f"__{n}") for k, n in enumerate(names)])
    rest = F.coalesce("__rest", F.lit(""))
    m = m.withColumn("__ops", F.regexp_extract(rest, r"(?s)^\s*[,—]?\s*(.+)$", 1))
    lead, ops = F.col("__lead"), F.col("__ops")
    m = m.withColumn("__gone", F.regexp_extract(ops, rf"^the definition of ({TERM}) is repealed\.?$", 1))
    gone = F.col("__gone")
    block = F.coalesce(_group(rest, r"(?s)^ substitute\s*—?\s*(.+)$", 1), _group(rest, r"(?s)^ insert\s*—?\s*(.+)$", 1))
    form = (
        F.when(F.col("__section").isNull(), "none")
        .when((lead == "In") & (gone != ""), "gone")
        .when((lead == "In") & (ops != ""), "list")
        .when((lead == "For") & rest.rlike("^ substitute"), "for")
        .when(lead.isin("After", "Before", "At the end of") & rest.rlike("^ insert"), "at")
        .when(lead.isNull() & rest.rlike(r"^ (?:is|are) repealed\.?$"), "repeal")
        .otherwise("none")
    )
    in_all = F.nullif(F.regexp_extract(ops, IN_DEFINITION, 1), F.lit(""))
    m = m.withColumn("__form", form)
    form = F.col("__form")
    m = m.withColumn("__block", F.when(form.isin("for", "at"), block)).withColumn("__all", F.when(form == "list", in_all))
    m = m.withColumn("__ops", F.when(F.col("__all").isNotNull(), F.regexp_replace(ops, IN_DEFINITION, "")).otherwise(ops))
    path = F.concat(F.when(F.col("__schedule").isNotNull(), F.array("__section")).otherwise(F.array().cast("array<string>")), F.coalesce(places(F.col("__path")), F.array().cast("array<string>")))
    one = F.array(F.struct(F.lit(None).cast("string").alias("item"), F.lit("").alias("op")))
    m = m.withColumn("__path", path).withColumn("__items", F.when(F.col("__form") == "list", items(F.col("__ops"))).otherwise(one))
    m = m.withColumn("__to", F.when(F.col("__form") == "list", targets(F.col("__path"), F.col("__also"))).otherwise(F.array("__path")))
    # The targets in turn, each with all operations.
    each = F.flatten(F.transform("__to", lambda p: F.transform("__items", lambda i: F.struct(p.alias("path"), i["item"].alias("item"), i["op"].alias("op")))))
    m = m.select("*", F.posexplode(each)).withColumnRenamed("pos", "op_no")
    m = m.select("*", F.col("col.path").alias("__p"), F.col("col.item").alias("__item"), F.col("col.op").alias("__op"))

    op = F.col("__op")
    term = F.nullif(F.regexp_extract(op, IN_DEFINITION, 1), F.lit(""))
    m = m.withColumn("__term2", term).withColumn("__op1", F.when(term.isNotNull(), F.regexp_replace(op, IN_DEFINITION, "")).otherwise(op))
    narrow = F.regexp_extract("__op1", NARROW, 1)
    m = m.withColumn("__p", F.concat("__p", places(narrow))).withColumn("__op2", F.regexp_replace("__op1", NARROW, ""))
    op = F.col("__op2")
    form = F.col("__form")
    is_list = form == "list"
    which = F.coalesce(*[F.when(op.rlike(p), F.lit(i)) for i, (_, p, _, _) in enumerate(OPERATIONS)])  # at most one fits: they begin or end with words of their own
    m = m.withColumn("__at", F.regexp_extract(op, WHOLE, 1)).withColumn("__which", F.when(is_list, which))
    at_place, place = F.col("__at"), F.when(F.col("__at") != "", F.regexp_extract(op, WHOLE, 2)).otherwise("")
    fits = lambda value: F.coalesce(*[F.when(F.col("__which") == i, value(*x)) for i, x in enumerate(OPERATIONS)])
    listed = F.coalesce(F.when(at_place == "for", "replace_provision").when(at_place != "", "insert_provision"), fits(lambda a, p, o, n: F.lit(a)), F.lit("unparsed"))
    m = m.withColumn("__listed", listed).withColumn("__new", fits(lambda a, p, o, n: F.regexp_extract(op, p, n) if n else F.lit(None).cast("string")))
    old = fits(lambda a, p, o, n: F.regexp_extract(op, p, o) if o else F.lit(None).cast("string"))
    listed, new = F.col("__listed"), F.col("__new")
    number, words = _block(F.when(at_place != "", F.regexp_extract(op, WHOLE, 3)).otherwise(F.col("__block")), q)
    m = m.withColumn("__number", number).withColumn("__words", words)
    number, words = F.col("__number"), F.col("__words")
    given = is_list & (at_place != "")
    defined = is_list & listed.isin("insert_definition", "replace_definition")
    section_new = (form == "at") & (F.size("__p") == 0) & F.col("__schedule").isNull() & number.rlike(r"^\d")
    action = (
        F.when(is_list, listed).when(form.isin("gone", "repeal"), "repeal").when(form == "for", "replace_provision")
        .when(section_new, "insert_section").when((form == "at") & (lead == "At the end of") & number.isNull(), "insert_at_end").when(form == "at", "insert_provision")
        .otherwise("unparsed")
    )
    replaced = _group(op, r"^for the definition of (.+?) substitute", 1)
    named = F.coalesce(F.when(is_list, replaced), F.col("__term2"), F.col("__all"), F.nullif("__gone", F.lit("")), F.col("__term"))
    item = F.when(is_list, F.col("__item"))
    somewhere = F.nullif(F.regexp_extract("__t", rf" (?:of|to) the ({ACT_TITLE})", 1), F.lit(""))
    act = F.coalesce(F.nullif("__act", F.lit("Principal Act")), F.when(form == "none", somewhere), F.col("__principal"))
    known = form != "none"
    out = m.select(
        *others, "op_no",
        F.when(item.isNotNull(), F.concat("__by", F.lit("("), item, F.lit(")"))).otherwise(F.col("__by")).alias("provision"),
        act.alias("target_act"), F.when(known, F.col("__schedule")).alias("schedule"), F.when(section_new, number).when(known & F.col("__schedule").isNull(), F.col("__section")).alias("section"),
        F.when(known, F.when(given, F.concat("__p", places(place))).otherwise(F.col("__p"))).otherwise(F.array().cast("array<string>")).alias("path"),
        F.when(known, F.col("__heading").isNotNull()).otherwise(False).alias("heading"), F.when(known, F.trim(unmasked(named, q))).alias("definition"), action.alias("action"),
        F.when(is_list & ~given, unmasked(old, q)).alias("old"),
        F.when(given | form.isin("for", "at"), words).when(defined, _block(new, q)[1]).when(is_list, unmasked(new, q)).alias("new"),
        F.when(given | form.isin("for", "at"), number).alias("number"), F.when(given, at_place == "before").when(form == "at", (lead == "Before") & ~section_new).otherwise(False).alias("before"),
        F.when(is_list & (action == "unparsed"), unmasked(F.col("__op2"), q, '"')).otherwise(F.col("__raw")).alias("raw"),
    )
    return out


def amending_provisions(nodes: DataFrame) -> DataFrame:
    """(doc, provision, principal, text, first): the provisions of amending Acts that may hold instructions, each with
    its paragraphs as items, and the Act that "the Principal Act" means there.

    Nodes: doc, idx, type, number, heading, text. A Part headed "Amendment of the X Act" or the words "Principal Act means
    the X Act" say which Act it is; a Schedule's items are cited by the section that enacts the Schedule."""
    title = F.coalesce(F.nullif(F.regexp_extract("heading", rf"Amendment of (?:the )?({ACT_TITLE})", 1), F.lit("")), F.nullif(F.regexp_extract("text", rf"Principal Act means the ({ACT_TITLE})", 1), F.lit("")))
    w = Window.partitionBy("doc").orderBy("idx")
    kept = lambda c: F.last(c, ignorenulls=True).over(w)
    kind = F.col("type")
    outer = kind.isin("part", "division", "schedule", "schedule_act", "heading_group")
    principal = F.coalesce(F.when(kind == "schedule_act", F.col("heading")), title)
    sections = nodes.withColumn("principal", kept(principal)).withColumn("__section", kept(F.when(kind == "section", F.col("number"))))
    sections = sections.withColumn("__schedule", kept(F.when(kind == "schedule", F.coalesce("number", F.lit(""))).when(kind == "section", "")))
    enacts = sections.where(F.col("text").rlike(r"\bSchedule \d+[A-Z]*\b[^.]*?\b(?:are|is) amended as set out")).select("doc", "idx", F.col("__section").alias("__enacted"), F.explode(F.regexp_extract_all("text", F.lit(r"\bSchedule (\d+[A-Z]*)\b[^.]*?\b(?:are|is) amended as set out"), F.lit(1))).alias("__schedule"))
    enacts = enacts.groupBy("doc", "__schedule").agg(F.max_by("__enacted", "idx").alias("__enacted"))
    joined = sections.join(enacts, ["doc", "__schedule"], "left")
    cite = (
        F.when((kind == "section") & F.col("number").isNotNull(), F.concat(F.lit("s. "), "number"))
        .when((kind == "subsection") & F.col("__section").isNotNull(), F.concat(F.lit("s. "), "__section", F.lit("("), "number", F.lit(")")))
        .when((kind == "item") & (F.col("__schedule") != ""), F.concat(F.lit("s. "), F.coalesce("__enacted", F.lit("")), F.lit("(Sch. "), "__schedule", F.lit(" item "), "number", F.lit(")")))
    )
    begins = joined.withColumn("__begin", F.when(cite.isNotNull() | outer, F.col("idx"))).withColumn("__cite", cite)
    grouped = begins.withColumn("__of", F.last("__begin", ignorenulls=True).over(w))
    marked = F.when(kind.isin("paragraph", "subparagraph") & F.col("number").isNotNull(), F.concat(F.lit("("), "number", F.lit(") "), "text")).otherwise(F.col("text"))
    part = F.when(~outer & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.struct("idx", marked.alias("t")))
    out = grouped.groupBy("doc", F.col("__of").alias("first")).agg(F.first("__cite", ignorenulls=True).alias("provision"), F.max_by("principal", "idx").alias("principal"), F.sort_array(F.collect_list(part)).alias("p"))
    return out.where("provision IS NOT NULL AND size(p) > 0").select("doc", "first", "provision", "principal", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def read_acts(nodes: DataFrame) -> DataFrame:
    """Instructions of whole amending Acts. Sentences without an Act, and those that only say which Act is the Principal
    Act, are no instructions."""
    found = read_amendments(amending_provisions(nodes))
    return found.where(~((F.col("action") == "unparsed") & (F.col("target_act").isNull() | F.col("raw").contains("Principal Act means the"))))


def instruction_key(act: Column, schedule: Column, section: Column, definition: Column) -> Column:
    """The provision an instruction changes, as instructions are looked up: Act, Schedule or section, and term."""
    return F.concat_ws("|", F.coalesce(act, F.lit("")), F.when(schedule.isNotNull(), F.concat(F.lit("sch"), schedule)).otherwise(F.concat(F.lit("s"), F.lower(F.coalesce(section, F.lit(""))))), F.lower(F.coalesce(definition, F.lit(""))))


def instructions_by_key(instructions: DataFrame) -> DataFrame:
    """(key, instructions, actions): how many instructions change each provision, and what they do."""
    key = instruction_key(F.col("target_act"), F.col("schedule"), F.col("section"), F.col("definition"))
    # Counted, not filtered first: a filter on the action would be pushed below the steps that find it and find it again.
    parsed = F.col("action") != "unparsed"
    counts = instructions.groupBy(key.alias("key")).agg(F.count_if(parsed).alias("instructions"), F.array_join(F.sort_array(F.collect_set(F.when(parsed, F.col("action")))), ",").alias("actions"))
    return counts.where("instructions > 0")
