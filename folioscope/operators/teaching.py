"""Rules and trees learned from reviewed lines: features, predicates, proposals, decision trees, recognition rules."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MAX_DEPTH, MIN_LEAF, MAX_CUTS = 6, 3, 24
LEAST_SUPPORT = 3


def gini(counts: Column) -> Column:
    """1 - sum of squared shares of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, 1 - F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x / total) * (x / total))).otherwise(0.0)


def line_features(seen: DataFrame) -> DataFrame:
    """Measures of a printed line: text, size, bold, x0, above (gap), body (size of the text body), parent."""
    from folioscope.functions.text import opening_class

    t = F.trim(F.coalesce("text", F.lit("")))
    return seen.withColumns({
        "opening": opening_class(t), "size_ratio": F.round(F.col("size") / F.col("body"), 2), "indent": F.round("x0", 0),
        "ends_clean": t.rlike(r"[.;:—]$"), "words": F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))), "caps": (F.upper(t) == t) & t.rlike(r"\p{L}"),
    })


def rule_condition(rule: dict) -> Column:
    """A learned rule as a predicate: pattern, booleans, [low, high] ranges, a set of parents; all that it names."""
    keep = F.lit(True)
    if rule.get("pattern"):
        keep &= F.col("text").rlike(rule["pattern"])
    for name, value in (rule.get("flags") or {}).items():
        keep &= F.coalesce(F.col(name) == F.lit(bool(value)), F.lit(False))
    for name, (low, high) in (rule.get("ranges") or {}).items():
        keep &= F.coalesce(F.col(name).between(low, high), F.lit(False))
    if rule.get("parents"):
        keep &= F.coalesce(F.col("parent").isin(*rule["parents"]), F.lit(False))
    return keep


def first_rule(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds `recognised`: the type of the first rule, by (priority, id), that holds."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (r["priority"], r["id"]), reverse=True):
        out = F.when(rule_condition(r), F.lit(r["type"])).otherwise(out)
    return rows.withColumn("recognised", out)


def explain_rules(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds `verdicts`: each rule's id and whether it holds."""
    return rows.withColumn("verdicts", F.array(*(F.struct(F.lit(r["id"]).alias("rule"), rule_condition(r).alias("holds")) for r in rules)))


def proposals(failures: DataFrame, group: list[str], least: int = LEAST_SUPPORT) -> DataFrame:
    """Groups of like failures with enough support, and the conditions their lines share."""
    same = lambda c: F.when(F.min(c) == F.max(c), F.max(c))
    rolled = failures.groupBy(*group).agg(F.count("*").alias("support"), same(F.col("bold")).alias("bold"), F.min("size").alias("size_low"), F.max("size").alias("size_high"), F.array_sort(F.collect_set("parent")).alias("parents"))
    return rolled.where(F.col("support") >= least).orderBy(F.desc("support"), *group)


@dataclass
class Tree:
    label: str
    support: int
    purity: float
    test: tuple | None = None
    yes: Tree | None = None
    no: Tree | None = None


def _impurity(labels: list) -> float:
    n = len(labels)
    return 1 - sum((c / n) ** 2 for c in Counter(labels).values()) if n else 0.0


def _holds(test: tuple, x: dict) -> bool:
    name, op, value = test
    v = x.get(name)
    return v == value if op == "=" else v is not None and v <= value


def _tests(xs: list[dict]):
    """Equality for texts and booleans, thresholds between (at most MAX_CUTS) values for numbers."""
    for name in sorted({k for x in xs for k in x}):
        values = sorted({x[name] for x in xs if x.get(name) is not None}, key=lambda v: (str(type(v)), v))
        if all(isinstance(v, (bool, str)) for v in values):
            yield from ((name, "=", v) for v in values)
        else:
            step = max(1, len(values) // MAX_CUTS)
            yield from ((name, "<=", (a + b) / 2) for a, b in list(zip(values, values[1:]))[::step])


def grow(xs: list[dict], ys: list[str], depth: int = 0) -> Tree:
    """A classification tree by Gini impurity over labelled feature rows (a reviewer's examples, on the driver)."""
    label, n = min(Counter(ys).items(), key=lambda kv: (-kv[1], kv[0]))
    node = Tree(label, len(ys), n / len(ys))
    if depth == MAX_DEPTH or n == len(ys):
        return node
    best, base = None, _impurity(ys)
    for test in _tests(xs):
        side = [_holds(test, x) for x in xs]
        yes, no = [y for y, s in zip(ys, side) if s], [y for y, s in zip(ys, side) if not s]
        if min(len(yes), len(no)) < MIN_LEAF:
            continue
        gain = base - (len(yes) * _impurity(yes) + len(no) * _impurity(no)) / len(ys)
        if best is None or gain > best[0] + 1e-12:
            best = gain, test, side
    if best and best[0] > 0:
        _, node.test, side = best
        node.yes = grow([x for x, s in zip(xs, side) if s], [y for y, s in zip(ys, side) if s], depth + 1)
        node.no = grow([x for x, s in zip(xs, side) if not s], [y for y, s in zip(ys, side) if not s], depth + 1)
    return node


def tree_column(tree: Tree) -> Column:
    """A tree as one expression: struct of label, purity, support. No Python runs on the executors."""
    if tree.test is None:
        return F.struct(F.lit(tree.label).alias("label"), F.lit(tree.purity).alias("purity"), F.lit(tree.support).alias("support"))
    name, op, value = tree.test
    ok = F.col(name) == F.lit(value) if op == "=" else F.col(name) <= F.lit(value)
    return F.when(F.coalesce(ok, F.lit(False)), tree_column(tree.yes)).otherwise(tree_column(tree.no))


def disagreements(rows: DataFrame, tree: Tree, purity: float = 0.85, support: int = 8) -> DataFrame:
    """Rows whose recorded type a sure leaf contradicts."""
    p = rows.withColumn("predicted", tree_column(tree))
    return p.where((F.col("predicted.label") != F.col("type")) & (F.col("predicted.purity") >= purity) & (F.col("predicted.support") >= support))


def held_out_accuracy(examples: list[tuple[str, dict, str]]) -> dict[str, float]:
    """Share right for each group when a tree is grown on the others. Examples: (group, features, label)."""
    out = {}
    for g in sorted({e[0] for e in examples}):
        train, test = [e for e in examples if e[0] != g], [e for e in examples if e[0] == g]
        if train and test:
            tree = grow([e[1] for e in train], [e[2] for e in train])
            out[g] = sum(predict(tree, e[1]).label == e[2] for e in test) / len(test)
    return out


def predict(tree: Tree, x: dict) -> Tree:
    while tree.test is not None:
        tree = tree.yes if _holds(tree.test, x) else tree.no
    return tree


def fixed_and_broken(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """Examples (line, type) that a changed parse sets right or wrong."""
    b = before.join(truth, ["line", "type"], "left_semi").select("line")
    a = after.join(truth, ["line", "type"], "left_semi").select("line")
    return a.join(b, "line", "left_anti").withColumn("effect", F.lit("fixed")).unionByName(b.join(a, "line", "left_anti").withColumn("effect", F.lit("broken")))
