"""Whether a change of wording is what an amending instruction asks for (the instructions are read by `amending`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def made(action: Column, old: Column, new: Column, before: Column, after: Column) -> Column:
    """Whether the wording `after` has the operation made on `before`."""
    count = lambda s, x: F.when(F.length(x) > 0, (F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(x)).otherwise(0)
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    came, went = count(a, new) > count(b, new), count(a, old) < count(b, old)
    return (
        F.when(action.isin("substitute_words", "substitute"), came & went)
        .when(action.isin("insert_after_words", "insert_before_words", "insert_after", "insert_before"), came)
        .when(action.isin("omit_words", "omit"), went)
        .when(action == "insert_at_end", came if new is not None else F.lit(False))
        .when(action == "repeal", (F.length(b) > 0) & (F.length(a) == 0))
        .when(action.isin("insert_provision", "substitute_provision", "replace_provision", "insert_section"), b != a)
        .otherwise(F.lit(False))
    )


def match_instructions(instructions: DataFrame, changes: DataFrame) -> DataFrame:
    """Each instruction (id, section, action, old, new) with its best status over the changes (section, before,
    after): matched, elsewhere (made in another section), earlier (already so before), not_found."""
    here = instructions.alias("i").join(changes.alias("c"), "section", "left")
    done = made(F.col("action"), F.col("old"), F.col("new"), F.col("before"), F.col("after"))
    before = F.coalesce(F.col("new").isNotNull() & F.col("before").contains(F.col("new")), F.lit(False))
    rank = F.when(F.coalesce(done, F.lit(False)), 3).when(before, 1).otherwise(0)
    best = here.groupBy("id").agg(F.max(rank).alias("rank"))
    # Words made elsewhere: texts that share the first word of what is inserted (an equi-join), then the whole of it.
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    texts = changes.where("after IS NOT NULL").select(F.col("section").alias("other"), "before", "after", F.explode(F.array_distinct(word(F.col("after")))).alias("__word"))
    asked = instructions.where("new IS NOT NULL").select("id", "section", "new", F.try_element_at(word(F.col("new")), F.lit(1)).alias("__word"))
    elsewhere = F.col("after").contains(F.col("new")) & ~F.coalesce(F.col("before").contains(F.col("new")), F.lit(False)) & (F.col("other") != F.col("section"))
    met = asked.alias("q").join(texts.alias("t"), (F.col("q.__word") == F.col("t.__word")) & elsewhere, "left_semi")
    loose = met.select("id", F.lit(True).alias("__else"))
    out = best.join(loose, "id", "left")
    return out.select("id", F.when(F.col("rank") == 3, "matched").when(F.col("__else"), "elsewhere").when(F.col("rank") == 1, "earlier").otherwise("not_found").alias("status"))
