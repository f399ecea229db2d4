"""Operators as Spark jobs: edge rows, clashing columns, repeated rows, empty tables, brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import hnsw, langid, line_dedup, minhash, packing, quality, sharding, token_files, webp, bpe
from folioscope.llm.components import components
from folioscope.session import materialize
from tests.llm.test_small import shingle_set

DOCS = "doc_id long, text string, lang string, score double, class string, kept boolean"
LONG = " ".join(f"w{i % 700}" for i in range(60_000))
ROWS = [(5, "alpha beta gamma delta epsilon zeta"), (1, None), (2, ""), (7, "Alpha beta gamma delta  epsilon zeta"), (3, LONG), (7, "Alpha beta gamma delta  epsilon zeta"), (9, "einé zwei"), (4, "123 !?"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, "c", True) for i, t in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_sharding(docs, none):
    rows = sharding.shard_by_rows(docs, 4).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 16 for _, t in ROWS)
    for k in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((t or "").encode()) for _, t in ROWS} and {r["law"] for r in rows} == {"rows"}
    again = sharding.shard_by_rows(docs.repartition(1), 4).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, again), key=key)
    assert sharding.shard_by_rows(none).count() == 0


def test_token_files(docs, none):
    rows = sorted(token_files.token_digests(docs, WORD, length=32).collect(), key=lambda r: r["start"])
    tokenizer = token_files.encoder(WORD).tokenizer
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0]))
    start = 0
    for r, (i, t) in zip(rows, ordered):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(ROWS) and token_files.token_digests(none, WORD).count() == 0


def test_bpe(docs, none):
    got = sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in bpe.bpe_digests(docs, BYTE, public_tokenizers.PATTERN).collect())
    assert got == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert bpe.bpe_digests(none, BYTE, public_tokenizers.PATTERN).count() == 0


def test_media(docs, none):
    for r in webp.media_digests(docs).collect():
        t = next((t or "").encode() for i, t in ROWS if i == r["doc_id"])
        payload = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    pixels = webp.decode_column(webp.encode_column(docs.where("doc_id = 9"))).first()["pixels"]
    assert bytes(pixels).rstrip(b"\0") == "einé zwei".encode() and webp.media_digests(none).count() == 0


def test_quality(spark, docs, none):
    good, bad = [f"{w} house stands here and waits for rain." for w in "the a one my our".split()], ["X!! Y!! Z!!", "a | b | c |", "$$$ %% ***"]
    rnd = random.Random(0)
    rows = [(i, " ".join(rnd.choice(good if i % 3 else bad) for _ in range(5))) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (900, None)], "doc_id long, quality int")
    model = quality.train(train, labels)
    scored = quality.score_documents(train, model).collect()
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(docs, model).collect())
    assert quality.keep_good(docs, model).columns == docs.columns and quality.score_documents(none, model).count() == 0
    empty = quality.train(none, labels.where("false"))
    assert {r["score"] for r in quality.score_documents(docs, empty).collect()} == {0.5}


def test_language(spark, docs, none):
    rows = [(i, ("the and of " if i % 2 else "der und die ") * (3 + i % 5), "en" if i % 2 else "de") for i in range(120)]
    train = spark.createDataFrame([*rows, (500, None, "en"), (501, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    got = {r["doc_id"]: r for r in langid.predict(train, model).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["score"] > 0.5 for i, _, k in rows) and got[500]["lang_pred"] == "und"
    edge = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert edge[1] == edge[2] == edge[4] == "und" and edge[9] in ("en", "de")
    assert langid.keep_languages(docs, model).columns == docs.columns
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_quality_against_a_direct_solve(spark, monkeypatch):
    """The partitions' summed normal equations give the weights of a ridge regression on all rows at once."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["rain", "Sun!", "|", "12", "of the", "X"]) for _ in range(rnd.randint(1, 30)))) for i in range(150)]
    labels = [(i, i % 3 % 2) for i, _ in rows]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"))
    fold = {r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(5)) == 0).collect()}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    raw = [t.encode() for _, t in train]
    stats = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    scale = stats.std(axis=0)
    scale[scale < 1e-9] = 1
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, scale)
    fit = np.array([i not in fold for i, _ in train])
    z = np.concatenate([np.cos(((stats - model.mean) / model.scale)[fit] @ model.projection + model.phase) * np.sqrt(2 / len(model.phase)), np.ones((fit.sum(), 1))], axis=1)
    y = np.array([dict(labels)[i] for i, _ in train], float)[fit]
    penalty = np.full(z.shape[1], 1e-3 * fit.sum())
    penalty[-1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y), atol=1e-7)


def test_samples_are_bounded(spark):
    """Hot ids, null ids and tiny shares leave a bounded sample with every class in it."""
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the rain falls on "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    others = spark.createDataFrame([(None, "der Regen", "de"), (None, "der Regen", "de"), *((1000 + i, f"word{i} " * 9, f"l{i:02}") for i in range(65))], "doc_id long, text string, lang string")
    docs = hot.union(others)
    model = langid.train(docs, rows=130)
    assert model.langs == sorted({"en", "de", *(f"l{i:02}" for i in range(65) if zlib.crc32(str(1000 + i).encode()) % 4 != 2)} - ({"en"} if zlib.crc32(b"7") % 4 == 2 else set()))
    assert quality.train(docs, spark.createDataFrame([(7, 1), (1001, 0)], "doc_id long, quality int"), rows=50).weights.shape == (quality.FEATURES + 1,)
    ids = spark.range(200_000)
    share = 2.0**-12
    assert 20 <= ids.where(quality.below(F.xxhash64("id"), share)).count() <= 90
    assert ids.where(quality.below(F.xxhash64("id"), 1.0)).count() == 200_000 and ids.where(quality.below(F.xxhash64("id"), 2.0**-40)).count() == 0


def test_line_dedup(spark, none):
    block = "one two three four five\nsix seven eight nine ten"
    rows = [(1, f"start of it\n{block}\nend"), (2, f"other words here\n\n{block}\nmore"), (3, block), (4, "one two three four five"), (5, None), (6, ""), (7, f"x\n{block}"), (7, f"x\n{block}"), (None, block), (8, "end")]
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, lines string")
    out = sorted(((r["doc_id"], r["text"]) for r in line_dedup.remove_repeated_lines(d).collect()), key=str)
    assert out == sorted([(1, rows[0][1]), (2, "other words here\n\nmore"), (4, "one two three four five"), (5, None), (6, ""), (7, "x"), (7, "x"), (None, block), (8, "end")], key=str)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(d, drop_emptied=False).collect()}
    assert kept[3] == "" and line_dedup.remove_repeated_lines(d).columns == d.columns
    assert line_dedup.remove_repeated_lines(none).count() == 0


def brute_repeats(texts, least=8):
    """Numbers of the lines of each document in a block of `least` words that an earlier document has."""
    lines = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in texts.items()}
    out = {}
    for b, y in lines.items():
        gone = set()
        for a, x in lines.items():
            for i in range(len(x) if a < b else 0):
                for j in range(len(y)):
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n][1] == y[j + n][1]:
                        n += 1
                    if sum(len(line.split()) for _, line in y[j : j + n]) >= least:
                        gone |= {k for k, _ in y[j : j + n]}
        if gone:
            out[b] = sorted(gone)
    return out


def test_hot_lines(spark):
    """Lines that many documents have, also twice or in another order, leave every later document."""
    hot = ["a hot line of nine words that all have", "another hot line that has nine words as well"]
    texts = {1: f"{hot[0]}\nx\n{hot[0]}\ny\n{hot[1]}"} | {i: f"own {i}\n{hot[i % 2]}\nown\n{hot[1 - i % 2]}\n{i}" for i in range(2, 9)}
    rnd = random.Random(3)
    pool = ["one two three four five", "six seven eight", "nine ten eleven twelve", *hot]
    texts |= {i: "\n".join(rnd.choice([*pool, f"own line {i}", ""]) for _ in range(rnd.randint(1, 9))) for i in range(10, 50)}
    got = {r["doc_id"]: r["lines"] for r in line_dedup.repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_repeats(texts) and got[2] == [1, 3]


def test_other_holders_bring_nothing_back(spark):
    """A block that stands whole in two documents leaves the later one, whoever else has its lines scattered."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(7)) for x in "abc")
    texts = {1: f"{a}\nx\n{b}\ny\n{c}", 2: f"p\n{a}\n{b}\n{c}\nq", 3: f"r\n{a}\n{b}\n{c}\ns"} | {i: f"{c}\n{i}\n{a}\n{i}\n{b}" for i in (10, 11, 12)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for some in (d, d.where("doc_id < 10")):
        got = {r["doc_id"]: r["lines"] for r in line_dedup.repeated_lines(some).collect()}
        assert got[3] == [1, 2, 3] and got == brute_repeats({i: t for i, t in texts.items() if some is d or i < 10})


def test_short_lines(spark):
    """A passage of one or two words a line leaves the later documents, and only whole blocks do."""
    verse = "\n".join(f"v{i} x" if i % 3 else f"v{i}" for i in range(40))
    texts = {1: f"first\n{verse}\nend", 2: f"{verse}\nsecond", 3: "v0\nv1 x\nv2 x\nthird", 4: f"fourth\n\n{verse}"}
    got = {r["doc_id"]: r["lines"] for r in line_dedup.repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {2: [*range(40)], 4: [*range(2, 42)]} == brute_repeats(texts)


def test_alignment_decides(spark, monkeypatch):
    """All that patience diff of any two documents aligns leaves, all blocks leave, and without alignment nothing does."""
    rnd = random.Random(9)
    lines = [" ".join(f"l{k}w{i}" for i in range(rnd.choice([2, 4, 9]))) for k in range(14)]
    texts = {i: "\n".join(rnd.choice(lines) if rnd.random() < 0.8 else f"own {i} {j}" for j in range(rnd.randint(1, 12))) for i in range(40)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["lines"] for r in line_dedup.repeated_lines(d).collect()}
    assert got == brute_repeats(texts)
    cut = {i: t.split("\n") for i, t in texts.items()}
    for b in cut:
        for a in range(b):
            assert {*line_dedup.common_lines(cut[a], cut[b], [len(x.split()) for x in cut[b]])} <= {*got.get(b, [])}
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.named_runs(["x"] * 9, ["x"] * 9, [1] * 9, [(0, 8)]) == []


def test_named_runs():
    a, b = list("pqrsXYZ"), list("XYZpqrs")
    assert line_dedup.common_lines(a, b, [2] * 7) == [3, 4, 5, 6]
    assert line_dedup.named_runs(a, b, [2] * 7, [(0, 2), (3, 6)], 6) == [0, 1, 2, 3, 4, 5, 6]
    assert line_dedup.named_runs(a, b, [2] * 7, [], 6) == [3, 4, 5, 6]


def test_packing(docs, none):
    rows = packing.pack_documents(docs, WORD, (16, 32, 64)).collect()
    own = token_files.encoder(WORD)
    ids = {i: [*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in ROWS}
    bins, by_doc = {}, {}
    for r in rows:
        bins.setdefault((r["bin"], r["capacity"]), []).append((r["bin_offset"], r["length"]))
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and capacity == min(s for s in (16, 32, 64) if s >= at)
    assert by_doc[3] == len(ids[3]) and by_doc[1] == 1 and by_doc[7] == 2 * len(ids[7]) and len({b for b, _ in bins}) == len(bins)
    filled = packing.fill([(r["bin"], r["capacity"], r["bin_offset"], r["length"], np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])) for r in rows])
    assert len(filled) == len(bins) and sum(int((owner > 0).sum()) for _, owner in filled.values()) == sum(len(ids[i]) for i, _ in ROWS)
    assert packing.pack_documents(none, WORD).count() == 0


def brute_components(texts):
    ids, sets, parent = list(texts), {i: shingle_set(t or "") for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, none):
    rnd = random.Random(1)
    vocab = [f"v{i}" for i in range(3000)]
    texts = {}
    for g in range(4):  # groups whose members are near the threshold to each other
        base = [rnd.choice(vocab) for _ in range(120)]
        for k in range(45):
            w = list(base)
            for _ in range(g + 2):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts[g * 100 + k] = " ".join(w)
    texts |= {900: None, 901: " ", 902: "Few Words", 903: "few  words", 904: texts[0]}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d).collect()}
    assert got == brute_components(texts)
    edge = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(x for x in edge if x[0] == 7) == [(7, 2, 5, False)] * 2 and (None, 1, None, True) in edge and (1, 0, 1, True) in edge
    assert minhash.near_duplicates(none).count() == 0


def test_small_sets_link(spark):
    """Short texts whose estimate falls below the margin by a chance collision are confirmed on their full sets."""
    long = [" ".join(f"s{i}x{k}" for k in range(8)) for i in range(6000)]
    short = [t.rsplit(" ", 1)[0] for t in long]  # 3 of 4 shingles: exactly 0.75
    sets = [[s for _, some in minhash.shingle_sets(pa.array(x)) for s in some] for x in (long, short)]
    low = np.flatnonzero(minhash.estimate(*(minhash.signatures(x) for x in sets)) < 0.75 - minhash.MARGIN)
    assert len(low) > 5
    texts = {2 * k + side: x[i] for k, i in enumerate(low) for side, x in enumerate((long, short))}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(d).collect()} == {(i, i // 2 * 2) for i in texts}


def test_repeated_ids_join_components(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (8, b)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(d).collect()} == {(1, 1), (5, 1), (8, 1)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160))


def test_components_take_few_steps(spark, monkeypatch):
    """A step is a stage over all shuffle partitions, however few the links: stars need no round at all, others a few."""
    steps = []
    monkeypatch.setattr("folioscope.llm.components.materialize", lambda df, name: (steps.append(name), materialize(df, name))[1])
    rnd = random.Random(3)
    path = rnd.sample(range(150), 150)
    cases = [
        ([(100, k) for k in range(101, 160)] + [(7, k) for k in range(8, 20)] + [(100, 101)] * 3, 2),
        ([(rnd.randrange(200), rnd.randrange(200)) for _ in range(160)] + [(300, k) for k in range(210, 250)], 24),
        (list(zip(path, path[1:])), 24),
    ]
    for edges, most in cases:
        steps.clear()
        parent = {x: x for e in edges for x in e if e[0] != e[1]}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        got = [(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert sorted(got) == sorted((x, find(x)) for x in parent)
        assert len(steps) <= most


def test_near_duplicates_join_components_once(spark, monkeypatch):
    """Links that blocks find join the components of the stars; the links of the stars are not gone through again."""
    seen = []
    monkeypatch.setattr(minhash, "components", lambda edges: (seen.append(edges.count()), components(edges))[1])
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    texts = {}
    for g in range(6):  # near the threshold to each other, so that stars miss links
        base = [rnd.choice(vocab) for _ in range(120)]
        for k in range(40):
            w = list(base)
            for _ in range(rnd.choice((1, 2, 2, 3))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts[g * 100 + k] = " ".join(w)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d).collect()} == brute_components(texts)
    assert len(seen) == 2 and 0 < seen[1] < seen[0]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x[50:90] = x[50]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1020, [1.0, 2.0]), (20, x[20].tolist())]
    v = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in hnsw.nearest(v, 20, 20, shard_rows=150).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        truth = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({i for _, i, _ in found}) == 20
        assert all(sc == pytest.approx(s[i], abs=1e-12) for _, i, sc in found)
        hits += len(set(truth) & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.95
    assert [i for _, i, _ in sorted(got[60])] == [i for i in range(50, 71) if i != 60]
    few = hnsw.nearest(v.where("vec_id < 3 OR vec_id > 900"), 20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2] and hnsw.nearest(v.where("false")).count() == 0


def test_pipeline(spark):
    import os

    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("__fs_id", F.lit(1)).withColumn("score", F.lit("x"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert sorted(out.columns) == sorted(docs.columns), name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert 0.5 * before < docs.count() < before and corpus_pipeline.run(spark, data).count() > 0
