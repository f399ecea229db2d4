"""Formats, codes and models on small cases, without Spark."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from folioscope.llm import bpe, hnsw, langid, line_dedup, minhash, packing, quality, sharding, shingles, token_files, webp

PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "'s", "'", "'l", "l", "1", "23", "the", "ing", "!!", ",", ".", "|", "<|endoftext|>", "\x1c", "\u0301", "\xa0", "Σ", "İ", "</w>"]


def texts(seed, n, most=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_feistel_is_a_permutation(n):
    image = [sharding.permute(i, n, 3) for i in range(n)]
    assert sorted(image) == list(range(n)) and [sharding.unpermute(p, n, 3) for p in image] == list(range(n))
    assert sharding.permute_array(np.arange(n), n, 3).tolist() == image


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_is_tiktoken(codec):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in [*texts(1, 800), "", "a" * 3000, "tion" * 500]:
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_edits_keep_the_encoding_exact(codec):
    rnd = random.Random(5)
    for text in texts(2, 150, 20):
        e = bpe.EditableText(codec, text)
        for more in texts(rnd.random(), 4, 4):
            start = rnd.randint(0, len(e.text))
            e.replace(start, rnd.randint(start, min(len(e.text), start + 4)), more)
            assert e.ids() == codec.encode(e.text)
        e.append("'ll")
        assert e.ids() == codec.encode(e.text)


def test_word_cache_is_the_library(monkeypatch, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = token_files.WordCachedEncoder(path)
    some = [*texts(3, 800), "", None, "The DON'T; x|", "ÀB ß.", "x" * 200 + " y", "\xa0a \u2003b\x85c", " \u0301a"]
    expected = [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in some]

    def ids(encoder):
        out = []
        for _, flat, counts in encoder.encode(pa.array(some)):
            out += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        return out

    assert own.by_word and ids(own) == ids(own) == expected and own.lengths(pa.array(some)).tolist() == [len(x) for x in expected]
    monkeypatch.setattr(token_files, "CACHE_WORDS", 10)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 100)
    assert ids(own) == expected
    # Another normaliser: texts go to the library whole.
    parts = __import__("json").load(open(path))
    parts["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(__import__("json").dumps(parts))
    other = token_files.WordCachedEncoder(str(tmp_path / "other.json"))
    assert not other.by_word and ids(other) == [[*other.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in some]


def test_sequence_file_round_trip(tmp_path):
    docs = [np.arange(n, dtype="<u2") for n in (3, 0, 700, 1, 64)]
    with open(tmp_path / "x.arrow", "wb") as f:
        w = token_files.SequenceWriter(f, np.dtype("<u2"), 16, 4)
        first = w.extend(np.concatenate(docs), np.array([len(d) for d in docs])).tolist()
        w.close()
    r = token_files.SequenceFile(pa.memory_map(str(tmp_path / "x.arrow")))
    assert all(r.tokens(at, len(d)).tolist() == d.tolist() for at, d in zip(first, docs))
    ids, mask = r.sequence(768 // 16 - 1)
    assert len(ids) == 16 and r.unpack(mask).all() and r.real_tokens() == 768
    assert not any(x.flags.owndata for x in r.sequence(0))  # views


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=5), st.integers(1, 14), st.integers(1, 14), st.integers(0, 11), st.integers(0, 4), st.randoms(use_true_random=False))
def test_webp_round_trip(colours, h, w, cache, kind, rnd):
    a = np.array([rnd.choice(colours) for _ in range(h * w)], np.uint32).reshape(h, w)
    blocks = lambda top: np.array([rnd.randrange(top) for _ in range(-(-h >> 2) * -(-w >> 2))], np.uint32).reshape(-(-h >> 2), -1)
    steps = [(), (("predictor", 2, blocks(14)),), (("cross", 2, blocks(2**32)), ("green",)), (("palette", np.unique(a)),), (("green",), ("predictor", 2, blocks(14)), ("cross", 2, blocks(2**32)))][kind]
    f = webp.encode_image(a, steps, cache, back=bool(h % 2))
    assert (webp.decode_image(f) == a).all()


def test_texts_as_images():
    """Every form comes back byte for byte, by the decoder in step and by the plain one."""
    rnd = random.Random(9)
    few = ["abcd", "efgh", "ijkl", "mnop", "qrst"]
    line = "a line of text that comes back again and again, "
    some = ["", "x", "y" * 64, "é" * 70_000, *texts(4, 50), line * 300, "".join(rnd.choice(few) for _ in range(2000)), "".join(rnd.choice(["lorem ", "ipsum ", "dolor ", line]) for _ in range(3000)), "".join(chr(rnd.randint(1, 0x2FF)) for _ in range(5000))]
    raw = [t.encode() for t in some]
    offsets = np.cumsum([0, *map(len, raw)])
    media = webp.encode_texts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    headers, transforms = set(), 0
    for t, m in zip(raw, media):
        files = webp.split_files(m)
        got = np.concatenate(webp.decode_many(files)).tobytes()
        assert got == t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert b"".join(webp._rgba(webp.decode_image(f)).tobytes() for f in files[:4]) == got[: 4 * 64 * webp.MAX_ROWS]
        for f in files:
            h = webp._Header(webp._frame(f))
            transforms += not h.plain
            headers.add(h.plain and h.cache_bits)
        alone = webp.encode_texts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert alone == m  # whatever stands beside it in its batch
    assert headers == {False, 0, webp.CACHE_BITS} and transforms and len(media[-4]) < len(raw[-4]) / 20
    for bad in (b"", b"RIFF", media[2][:-70]):
        with pytest.raises(ValueError):
            webp.decode_image(bad)
    f = webp.split_files(media[-2])[0]
    broken = f[:300] + bytes(len(f) - 300)
    try:
        webp.decode_many([broken])
    except ValueError:
        pass  # damaged data is told or gives other pixels, never an endless loop


@pytest.mark.parametrize("seed", range(12))
def test_images_in_step(seed):
    """Files of the general encoder (codes of their own, caches and references of any size) by the decoder in step."""
    rnd = np.random.default_rng(seed)
    files, truth = [], []
    for _ in range(6):
        a = rnd.choice(rnd.integers(0, 2**32, 4).astype(np.uint32), (int(rnd.integers(1, 20)), int(rnd.integers(1, 30))))
        files.append(webp.encode_image(a, (), int(rnd.integers(0, 12)), bool(rnd.integers(0, 2))))
        truth.append(webp._rgba(a).tobytes())
    assert [x.tobytes() for x in webp.decode_many(files)] == truth


def test_image_of_another_encoder():
    """The alpha plane of a picture from Python's own test data, a lossless stream that this library didn't write."""
    email = pytest.importorskip("test.test_email")
    path = __import__("pathlib").Path(email.__file__).parent / "data" / "python.webp"
    if not path.exists():
        pytest.skip("Python's test data isn't installed")
    data, at = path.read_bytes(), 12
    while data[at : at + 4] != b"ALPH":
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    if data[at + 8] & 3 != 1:
        pytest.skip("not a lossless plane")
    r = webp.BitReader(data[at + 9 : at + 8 + size])
    alpha = webp.decode_stream(r, 16, 16) >> 8 & 255
    assert r.size - r.at < 32 and r.read(r.size - r.at) == 0  # the whole stream, to its last bits
    assert alpha.min() == 0 and alpha.max() == 255 and len(np.unique(alpha)) > 2


def shingle_set(text, width=5):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in __import__("re").findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_shingles():
    some = ["", " ", "A b", "a B", "a b c d e", "a b c d e f a b c d e", "x\n\ty  z", None, *texts(6, 60)]
    sets = next(shingles.shingle_sets(pa.array(some)))[1]
    for t, s in zip(some, sets):
        assert len(s) == len(shingle_set(t or ""))
    assert sets[2].tolist() == sets[3].tolist() != sets[4].tolist()
    assert [len(s) for s in next(shingles.shingle_sets(pa.array(some).slice(4, 2)))[1]] == [1, 6]


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    for n in (30, 500, 5000):
        x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.sort(x[: n + n // 2]), np.sort(x[n // 2 :])
        s = minhash.signatures([a, b])
        assert abs(minhash.estimate(s[0], s[1]) - 0.5) < 0.07 and minhash.estimate(s[0], s[0]) > 0.999


def test_packing_plan_is_best_fit():
    """Piece by piece, each goes to the fullest bin with room; a bin is opened only where none has room."""
    rnd = random.Random(2)
    for _ in range(60):
        h = {rnd.randint(1, 64): rnd.randint(1, 20) for _ in range(rnd.randint(1, 20))}
        p = packing.plan_packing(h, (16, 32, 64))
        items = [n for n in sorted(h, reverse=True) for _ in range(h[n])]
        ends, fill, size = [*p.first[1:], len(items)], {}, {}
        for run, end in enumerate(ends):
            for r in range(p.first[run], end):
                step = r - p.first[run]
                at, offset = p.bin[run] + step // p.per[run], p.offset[run] + step % p.per[run] * p.length[run]
                assert items[r] == p.length[run] and fill.get(at, 0) == offset
                fill[at] = offset + items[r]
        assert sorted(fill) == list(range(p.bins))
        for b, used in fill.items():
            k = np.searchsorted(p.bin_first, b, "right") - 1
            assert p.capacity[k] == min(s for s in (16, 32, 64) if s >= used)
    assert packing.plan_packing({}).bins == 0


def test_packing_equals_piece_by_piece():
    """The plan by runs has the bins of the plain algorithm: each piece into the fullest bin with room, or a new one."""
    rnd, sizes = random.Random(4), (16, 32, 64)
    for _ in range(120):
        h = {rnd.randint(1, 64): rnd.randint(1, 25) for _ in range(rnd.randint(1, 25))}
        lighter, room, size = sum(n * c for n, c in h.items()), [], []
        for n in sorted(h, reverse=True):
            lighter -= n * h[n]
            left = h[n]
            while left:
                fit = [b for b in range(len(room)) if room[b] >= n]
                if not fit:
                    opened = packing.cheapest(n, left, lighter, sizes)
                    for _ in range(max(1, left // (opened // n))):
                        room.append(opened)
                        size.append(opened)
                    continue
                at = min(fit, key=lambda b: (room[b], b))
                room[at] -= n
                left -= 1
        held = sorted((s - r, min(x for x in sizes if x >= s - r)) for s, r in zip(size, room) if r < s)
        p = packing.plan_packing(h, sizes)
        used = dict.fromkeys(range(p.bins), 0)
        ends = [*p.first[1:], sum(h.values())]
        for k, end in enumerate(ends):
            for r in range(end - p.first[k]):
                used[p.bin[k] + r // p.per[k]] += p.length[k]
        own = sorted((u, p.capacity[np.searchsorted(p.bin_first, b, "right") - 1]) for b, u in used.items())
        assert own == held


def test_opened_size_is_the_cheapest():
    """Among the sizes that hold the piece, none costs less a token for what can still fill the bins."""
    rnd = random.Random(6)
    for _ in range(300):
        n, count, lighter = rnd.randint(1, 64), rnd.randint(1, 30), rnd.choice([0, rnd.randint(0, 900)])
        costs = {}
        for s in (16, 32, 64):
            if s >= n:
                own = min(s // n, count)
                bins = -(-count // own)
                costs[s] = (s + packing.OVERHEAD) / (own * n + min(s - own * n, lighter / bins))
        assert costs[packing.cheapest(n, count, lighter, (16, 32, 64))] == min(costs.values())


def test_patience():
    assert line_dedup.patience(list("abcdefg"), list("abxdefg")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert line_dedup.patience(list("xaby"), list("pabq")) == [(1, 1), (2, 2)] and line_dedup.patience([], [1]) == []
    assert line_dedup.common_lines([1, 2, 3], [9, 1, 2, 8, 3], [5] * 5, 8) == [1, 2]
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        m = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2.0, 3.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == pytest.approx(1 / 3) and np.interp(9, x, y) == 1


def test_language_network_learns():
    rng = np.random.default_rng(0)
    words = {0: b"the and of to ", 1: b"der und die zu "}
    w = np.stack([np.frombuffer((words[k % 2] * 40)[k : k + 256], np.uint8) for k in range(60)])
    m = langid.fit(w, np.arange(60) % 2, ["en", "de"], steps=60)
    lang, score = langid.Predictor(m)(pa.array(["the and of to the", "die und der zu", "", None, "12 34", "und " * 900]))
    assert lang == ["en", "de", "und", "und", "und", "de"] and (score[[0, 1]] > 0.5).all() and not score[2:5].any()
    assert langid.Predictor(None)(pa.array(["x"]))[0] == ["und"]


@pytest.mark.parametrize("clusters", [1, 300])
def test_graph_recall(clusters):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(clusters, 16))
    x = centres[rng.integers(0, clusters, 3000)] + rng.normal(size=(3000, 16)) * (1 if clusters == 1 else 0.05)
    g = hnsw.Graph.build(x)
    found = hnsw.Graph.of(g.arrays()).search(x[:200], 11)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(t)) / 10 for f, t in zip(found, truth)]) >= 0.9
    assert (np.count_nonzero(found >= 0, axis=1) >= 11).all()
    assert hnsw.Graph.build(x[:1]).search(x[:2], 5).tolist() == [[0], [0]]
