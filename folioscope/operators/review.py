"""Human decisions over parsed text: overlays, upserts as overwrites, remapping after a new parse, document order."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import content_digest


def latest(edits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last edit of each key; a log of appends read as upserts."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return edits.withColumn("__n", n).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace stored ones of the same key (null keys equal)."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new")))
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", n).where("__n = 1").drop("__n", "__new")


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti"))


def replace_all(stored: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """All stored rows of the scopes that `new` has give way to it."""
    return stored.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new)


def overlay(nodes: DataFrame, rows: DataFrame, key: list[str], columns: list[str], dropped: str = "merged_away") -> DataFrame:
    """A human row's columns win over the parser's; nodes it merged away go."""
    r = rows.select(*key, *(F.col(c).alias(f"__{c}") for c in columns), F.coalesce(dropped, F.lit(False)).alias("__gone"), F.lit(True).alias("__has"))
    j = nodes.join(r, key, "left").where(~F.coalesce("__gone", F.lit(False)))
    return j.withColumns({c: F.coalesce(f"__{c}", c) for c in columns} | {"reviewed": F.coalesce("__has", F.lit(False))}).drop(*(f"__{c}" for c in columns), "__gone", "__has")


def orphans(rows: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Human rows whose node is gone: kept apart, never dropped."""
    return rows.join(nodes.select(*key), key, "left_anti")


def finished_units(markers: DataFrame) -> DataFrame:
    """(doc, units): the units that carry a commit marker."""
    return markers.where("done").groupBy("doc").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def approved_units(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "unit").agg(F.bool_and(F.coalesce("verified", F.lit(False))).alias("approved"))


def progress(rows: DataFrame) -> DataFrame:
    u = approved_units(rows)
    return u.groupBy("doc").agg(F.count_if("approved").alias("checked"), F.count("*").alias("total"))


def node_identity() -> Column:
    """Type, number, heading and the start of the wording."""
    return F.struct(F.coalesce("type", F.lit("")).alias("type"), F.coalesce("number", F.lit("")).alias("number"), F.coalesce("heading", F.lit("")).alias("heading"), F.substring(F.coalesce("text", F.lit("")), 1, 120).alias("start"))


def parse_fingerprint(nodes: DataFrame) -> DataFrame:
    """(doc, fingerprint): a digest of all identities in order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", node_identity().alias("i"))))
    return nodes.groupBy("doc").agg(F.sha2(F.to_json(F.transform(ordered, lambda x: x["i"])).cast("binary"), 256).alias("fingerprint"))


def _doc_type(df: DataFrame) -> str:
    return df.schema["doc"].dataType.simpleString()


def remap(rows: DataFrame, nodes: DataFrame, keep_accepted: bool = False) -> DataFrame:
    """Review rows carried to a new parse, document by document.

    rows: doc, idx, type, number, heading, text, accepted; nodes: doc, idx, type, number, heading, text. A row goes to
    a free node with the same identity, the nearest by position; else to one of the same type and number, then of the
    same type and heading. Where the wording differs an acceptance is withdrawn. The rest are orphans."""

    def match(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = lambda v: "" if v is None or v != v else str(v)
        tiers = (lambda r: (text(r.type), text(r.number), text(r.heading), text(r.text)[:120]), lambda r: (text(r.type), text(r.number)) if text(r.number) else None, lambda r: (text(r.type), text(r.heading)) if text(r.heading) else None)
        left, right = left.sort_values("idx"), right.sort_values("idx")
        wording = dict(zip(right.idx, right.text))
        free, out = set(right.idx), {}
        for tier, of in enumerate(tiers):
            places = defaultdict(list)
            for r in right.itertuples():
                if of(r) is not None:
                    places[of(r)].append(r.idx)
            for r in left.itertuples():
                if r.idx in out or of(r) is None:
                    continue
                open_ = [i for i in places[of(r)] if i in free]
                if open_:
                    best = min(open_, key=lambda i: (abs(i - r.idx), i))
                    free.discard(best)
                    same = text(wording[best]) == text(r.text)
                    out[r.idx] = best, "kept" if same or keep_accepted or not r.accepted else "withdrawn"
        doc = key[0]
        return pd.DataFrame([(doc, i, *(out.get(i) or (None, "orphan"))) for i in left.idx], columns=["doc", "old_idx", "new_idx", "outcome"]).astype({"new_idx": "Int64"})

    return rows.groupBy("doc").cogroup(nodes.groupBy("doc")).applyInPandas(lambda key, a, b: match(key, a, b), f"doc {_doc_type(rows)}, old_idx long, new_idx long, outcome string")


def document_order(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, idx, position): parsed order with inserted and moved nodes after their anchors, later edits of an anchor
    nearer to it, deleted ones left out. edits: doc, idx, after_idx (-1: at the start), deleted, seq."""

    def order(key, parsed: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        gone = set(e[e.deleted].idx)
        moves = {r.idx: r.after_idx for r in e[~e.deleted].sort_values("seq").itertuples()}
        for start in moves:  # an anchor that leads back to its node can't be followed
            seen, at = set(), start
            while at in moves:
                if at in seen:
                    raise ValueError(f"anchors of {key[0]} form a circle at {at}")
                seen.add(at)
                at = moves[at]
        hang = defaultdict(list)
        for i, a in moves.items():
            hang[a].insert(0, i)
        out: list[int] = []
        stack = [*reversed([-1, *sorted(set(parsed.idx) - set(moves))])]
        while stack:
            at = stack.pop()
            if at != -1 and at not in gone:
                out.append(at)
            stack += reversed(hang[at])
        return pd.DataFrame({"doc": key[0], "idx": out, "position": range(len(out))})

    return nodes.select("doc", "idx").groupBy("doc").cogroup(edits.groupBy("doc")).applyInPandas(lambda key, a, b: order(key, a, b), f"doc {_doc_type(nodes)}, idx long, position long")


def definition_states(found: DataFrame, decided: DataFrame) -> DataFrame:
    """Terms found and decided on: found, added, removed or confirmed."""
    j = found.select("term", F.lit(True).alias("f")).join(decided.select("term", "decision"), "term", "full_outer")
    return j.select("term", F.when(F.col("decision") == "remove", "removed").when(F.col("f").isNull(), "added").when(F.col("decision").isNotNull(), "confirmed").otherwise("found").alias("state"))


def apply_overrides(definitions: DataFrame, overrides: DataFrame, sections: DataFrame) -> DataFrame:
    """Removals win everywhere; additions count where their section exists. All: term, section."""
    gone = overrides.where("decision = 'remove'").select("term")
    more = overrides.where("decision = 'add'").join(sections.select("section"), "section", "left_semi").select("term", "section")
    return definitions.join(gone, "term", "left_anti").join(more.select("term"), "term", "left_anti").unionByName(more)


def nearest_scope(definitions: DataFrame) -> DataFrame:
    """Of a term's definitions in force at a place (place, term, depth, target), the deepest scope's."""
    return definitions.groupBy("place", "term").agg(F.max_by("target", "depth").alias("target"))


def digests(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("digest", content_digest(F.col("type"), F.col("heading"), F.col("text")))


def agreement(guesses: DataFrame) -> DataFrame:
    """Blind guesses against the parse, bracket- and case-blind."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[()\s]", ""))
    return guesses.agg(F.count("*").alias("n"), F.count_if(plain("guess_type") == plain("type")).alias("type_ok"), F.count_if(plain("guess_number") == plain("number")).alias("number_ok"))
