"""Spelling variants of words: an even-partition pigeonhole join finds all words one edit apart.

Words are counted over all texts. A word of length l is cut into two even segments; one edit leaves one of them as it
is, so the words near it have its first segment at their start or its second segment at their end: words of the same
length at the same place, words one longer shifted by one. Each word is looked up by two segments of its own length
(which is also the index) and by two of the next shorter length. What both words share besides the segment is the open
middle, and the edit lies there; so a segment that very many words have is cut again inside the middle, by the same
rule, until its group is small or the middle is one letter. Pairs are verified in the join, and deduplicated.

All of it is DataFrame operations; a group's pairs leave the join only where they are one edit apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.session import discard, materialize

#: Runs of these are words. The range is one of code points; it has a multiplication and a division sign in it.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many (by checksum) loses a letter.
NOISE = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form has at least so many times the occurrences of its variant.
DOMINANCE = 2
#: Groups of more rows are cut again.
GROUP_ROWS = 512
KEY = ["l", "pre", "post"]


def count_words(docs: DataFrame, noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least `least_length` code points with at least `least_count` occurrences.

    A run whose checksum (with its document's id) `noise` divides loses one code point first. Null texts have no
    words; a null doc_id is written as nothing in the checksum. Repeated rows count as often as they stand."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.where(F.length("run") >= least_length).select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row (l, pre, mid, post, longer, ...) by its two segments: what is fixed grows, the open middle shrinks."""
    rest = [c for c in rows.columns if c not in ("pre", "mid", "post")]
    half = "CAST((length(mid) - longer) DIV 2 AS INT)"
    left = f"struct(concat(pre, substring(mid, 1, {half})) AS pre, substring(mid, {half} + 1) AS mid, post AS post)"
    right = f"struct(pre AS pre, substring(mid, 1, {half} + longer) AS mid, concat(substring(mid, {half} + longer + 1), post) AS post)"
    return rows.select(*rest, F.explode(F.expr(f"array({left}, {right})")).alias("s")).select(*rest, "s.*")


def near_words(vocabulary: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, other, other_n), both ways, of all words of `vocabulary` (word, n; distinct) exactly one edit apart."""
    whole = vocabulary.select("word", "n", F.length("word").alias("l"), F.lit("").alias("pre"), F.col("word").alias("mid"), F.lit("").alias("post"))
    rows = _cut(whole.withColumn("longer", F.lit(0)).union(whole.select("word", "n", F.col("l") - 1, "pre", "mid", "post", F.lit(1))))
    found, used = [], []
    while True:
        rows = materialize(rows, "segments")
        used.append(rows)
        # A middle of one letter has as many words as there are letters at most: no need to cut further.
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("rows"), F.max(F.length("mid") - F.col("longer")).alias("open"), F.min("longer").alias("none"))
        sizes = materialize(sizes.where("none = 0 AND rows > 1").select(*KEY, ((F.col("rows") > group_rows) & (F.col("open") > 1)).alias("large")), "groups")
        used.append(sizes)
        sized = rows.join(sizes, KEY)
        small = sized.where("NOT large")
        a, b = small.where("longer = 0").alias("a"), small.alias("b")
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY]
        one = ((F.col("b.longer") == 1) | (F.col("a.word") < F.col("b.word"))) & (F.levenshtein("a.mid", "b.mid", 1) == 1)
        found.append(a.join(b, [*on, one]).select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n")))
        if sizes.where("large").isEmpty():
            break
        rows = _cut(sized.where("large").drop("large"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = materialize(pairs.distinct(), "near")
    for x in used:
        discard(x)
    return pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n")).union(pairs.select("y", "x", "x_n"))


def spelling_groups(docs: DataFrame, noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dominance: int = DOMINANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs` (doc_id, text).

    A word's form is its near word of most occurrences (ties: the first in code-point order), if it has at least
    `dominance` times the word's own; its root is the last form. As occurrences grow from form to form, chains are short
    and never close. Other columns are ignored; an empty table gives an empty result."""
    vocabulary = materialize(count_words(docs, noise, least_length, least_count), "vocabulary")
    near = near_words(vocabulary, group_rows).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    enough = -F.col("best.n") >= dominance * F.col("n")
    forms = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    forms = materialize(forms, "forms")
    hops = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # twice as far each time
        on = hops.alias("a").join(hops.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        hops = materialize(on.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        if hops.where("moved").isEmpty():
            break
        hops = hops.drop("moved")
    discard(vocabulary)
    return forms.join(hops.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len({hex}) // 2), lambda i: [('0x' || substring({hex}, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END)"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes."""
    return f"xor({_CRC.format(hex=f'hex(encode({text}))')}, 4294967295::BIGINT)"


SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run
), hashed AS (SELECT run, k, {crc32_sql("id || ':' || run")} AS h FROM counted
), words AS (
  SELECT CASE WHEN h % {NOISE} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
), vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), gaps AS (SELECT DISTINCT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS gap FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN vocabulary b ON a.gap = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN vocabulary b ON a.gap = b.word
), best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS top FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.top[1] >= {DOMINANCE} * v.n THEN b.top[2] END AS form, CASE WHEN -b.top[1] >= {DOMINANCE} * v.n THEN -b.top[1] END AS form_n
  FROM vocabulary v LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM forms f JOIN chain c ON f.form = c.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word)
"""
