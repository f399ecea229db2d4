"""The metric join, the prefix trie and the spelling join against brute force, with edge rows, ties and hot groups."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import metric_join, spelling, trie


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width=4, percent=85):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and (i == j or 100 * len(a & b) >= percent * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((str(i), len(s), None if i is None else find(i)) for i, s in sets), key=str)


def family(rnd, base, n, changes, start):
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, changes)):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10**6)}"
        out.append((start + k, " ".join(words)))
    return out


@pytest.mark.parametrize(("home_rows", "pivots"), [(128, 12), (2, 1)])
def test_metric_join(spark, monkeypatch, home_rows, pivots):
    monkeypatch.setattr(metric_join, "CHUNK", 8)
    rnd = random.Random(home_rows)
    common = " ".join(f"c{i}" for i in range(30))
    rows = family(rnd, [f"a{i}" for i in range(60)], 40, 4, 100) + family(rnd, [f"b{i}" for i in range(24)], 30, 2, 300)
    rows += [(500 + k, common + " " + " ".join(f"u{k}_{i}" for i in range(rnd.randint(0, 20)))) for k in range(40)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "One two"), (9, "one  TWO"), (5, "one"), (6, "ä Ä ö Ü é"), (7, "Ä Ä ö Ü é"), (None, "one"), (7, "one two"), (700, "hot hot hot hot hot " * 300), (701, "hot " * 4000)]
    rows += [(800 + i, "the very same words in all of these") for i in range(25)] + [(800, "the very same words in all of these")] * 25
    docs = spark.createDataFrame([(i, t, "c", 1.0) for i, t in rows], "doc_id long, text string, class string, component double").repartition(5)
    got = metric_join.similar_classes(docs, home_rows=home_rows, pivots=pivots).collect()
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows)


def test_metric_join_of_nothing(spark):
    assert metric_join.similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(3, "alone with these five words")], "doc_id long, text string")
    assert [tuple(r) for r in metric_join.similar_classes(one).collect()] == [(3, 2, 3)]


def test_cut_cells_recurse(spark, monkeypatch):
    """Voronoi regions of regions are entered, and find what brute force finds."""
    rounds = []
    within = metric_join._Join.within
    monkeypatch.setattr(metric_join._Join, "within", lambda self, cells: rounds.append(1) or within(self, cells))
    rnd = random.Random(3)
    rows, at = [], 0
    for _ in range(12):  # twelve families that share a passage: one region, many Voronoi regions
        base = [f"p{i}" for i in range(30)] + [f"f{at}_{i}" for i in range(40)]
        rows += family(rnd, base, 12, 3, at)
        at += 100
    got = metric_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), home_rows=3, pivots=2).collect()
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows) and len(rounds) > 1


def test_long_documents_with_chance_shingles(spark):
    """Few words, so that documents of one length share rare shingles by chance; families near the threshold."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(9)]
    rows = []
    for k in range(14):
        base = [rnd.choice(words) for _ in range(rnd.choice([300, 500, 900]))]
        for j in range(5):
            own = list(base)
            for _ in range(rnd.randint(0, len(base) // 40)):
                own[rnd.randrange(len(own))] = rnd.choice([*words, f"n{rnd.randint(0, 99)}"])
            rows.append((k * 10 + j, " ".join(own[: len(own) - rnd.randint(0, len(own) // 20)])))
    got = metric_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = brute_components(rows)
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got), key=str) == expected
    assert 14 < len({c for *_, c in expected}) < 60


def test_anchors_count_shared():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 50, n).astype(np.uint64)) for n in (1, 5, 40, 80)]
    anchors = metric_join._Anchors()
    for k, s in enumerate(sets):
        anchors.add(k, k, s)
    for x in [*sets, np.array([999], np.uint64)]:
        assert anchors.shared(x).tolist() == [len(np.intersect1d(x, s)) for s in sets]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn, digest, (role, text)))
    own = {c: [t for *_, t in sorted(v, key=lambda x: x[:3] if x[0] else (False, 0, x[2]))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        leaves = sum(not any(len(r) > len(q) and r[: len(q)] == q for r in below) for q in below)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(seed, n, alphabet=3, most=5):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(10 * n), n):
        for t in range(rnd.randint(1, most)):
            rows.append((c, rnd.choice([t, t, None, 1]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi there", "", None, "a  b\tc", "é"][:alphabet])))
    return rows


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 4), (4, 30)])
def test_trie(spark, seed, parts):
    rows = random_conversations(seed, 60) + [(None, 0, "user", "no id")]
    rows += [(2000 + k, 0, "user", "all the same") for k in range(1, 40)] + [(3000 + k, t, "user", f"long {t}") for k in range(3) for t in range(90)]
    rows += [(k, 0, "user", "again")  for k in (5000, 5000, 5000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(3)
    got = sorted((tuple(r) for r in trie.conversation_trie(frame, parts).collect()), key=str)
    assert got == brute_trie(rebuilt(rows))


def test_trie_of_nothing_and_of_empty_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(empty).count() == 0
    # A conversation whose turns are all replaced by the absent ones of a base that isn't there is turnless.
    c = next(c for c in range(21, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "user", "one"), (c, 1, "user", "two")]
    got = [tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, empty.schema)).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute_trie(rebuilt(rows))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(rows, noise=97):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: best[w] for w in best if n[best[w]] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=str)


@pytest.mark.parametrize(("noise", "group_rows"), [(97, 512), (3, 1)])
def test_spelling_groups(spark, noise, group_rows):
    rnd = random.Random(noise)
    stems = ["strasse", "Häuser", "kontor", "aaaaaa", "aaaaab", "abcabc", "×÷ÿÀé", "international", "internatoinal", "ßßßßß"]
    words = stems + [s[:k] + rnd.choice("abÖx") + s[k + rnd.randint(0, 1) :] for s in stems for k in range(len(s))]
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([" ", "1", "-", "Ā"]).join(rnd.choices(words, k=40))) for _ in range(80)]
    rows += [(4, None), (5, ""), (6, "kontor " * 3000), (7, "x" * 5000 + " " + "y" * 5000)] * 3
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted((tuple(r) for r in spelling.spelling_groups(docs, noise=noise, group_rows=group_rows).collect()), key=str)
    assert got == brute_groups(rows, noise) and any(r[1] for r in got)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
