"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can come last in that prefix's BPE encoding. It is found from the left:
a token t that ends the prefix is the one if it may follow the last token of the prefix before it, that is, if BPE of
the two tokens' bytes gives just these two again. Storing this last token for every prefix makes appends exact (old
entries never change) and lets an edit recompute only from the edit until the entries agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed

CACHE_PIECES = 600_000
CACHE_PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """Encoder and decoder of single pieces and whole texts by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """BPE by definition: merge the leftmost pair of lowest rank until none is in the vocabulary."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
        return ok

    def may_start(self, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merge(self.bytes[token]) == [token]
        return ok

    def extend(self, piece: bytes, last: list[int], stop=None) -> list[int]:
        """Complete `last` (entry i: last token of the prefix of i bytes; entry 0 is unused) to the whole piece.

        The automaton names the tokens that end at each byte, longest first. `stop(i)` may end the work early once
        entry i is known."""
        pairs, known = self.pairs, len(last) - 1
        base = max(0, known - self.longest)
        for end, (token, size) in self.automaton.iter(piece[base:].decode("latin-1")):
            i = base + end + 1
            if i <= known:
                continue
            if i > known + 1:
                break
            if size == i:
                ok = self.may_start(token)
            else:
                ok = pairs.get((last[i - size], token))
                if ok is None:
                    ok = self.may_follow(last[i - size], token)
            if ok:
                last.append(token)
                known = i
                if stop is not None and stop(i):
                    return last
        if known < len(piece):
            raise ValueError(f"no token ends the prefix {piece[: known + 1]!r}")
        return last

    def unwind(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.bytes[last[i]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        return [known] if known is not None else self.unwind(self.extend(piece, [-1]))

    def pack(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get, out = self.packed.get, []
        for piece in self.pattern.findall(text):
            ids = get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(self.packed) >= CACHE_PIECES:
                        self.packed.clear()
                    self.packed[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class EditableText:
    """A text with its encoding, kept exact under appends and edits at a cost near the change's size."""

    #: Characters beyond its end on which a piece can depend (a three-character contraction).
    LOOKAHEAD = 3

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.pieces: list[tuple[str, bytes, list[int]]] = []
        self.replace(0, 0, text)

    def _piece(self, piece: str, old: tuple[str, bytes, list[int]] | None) -> tuple[str, bytes, list[int]]:
        """The piece with its prefix table; `old`, the piece that stood here, lends what the two share."""
        raw = piece.encode()
        if old is None:
            return piece, raw, self.bpe.extend(raw, [-1])
        _, old_raw, old_last = old
        same = 0
        while same < min(len(raw), len(old_raw)) and raw[same] == old_raw[same]:
            same += 1
        tail, most = 0, min(len(raw), len(old_raw)) - same
        while tail < most and raw[-1 - tail] == old_raw[-1 - tail]:
            tail += 1
        last, shift, agreed = old_last[: same + 1], len(old_raw) - len(raw), 0

        def stop(i: int) -> bool:
            nonlocal agreed
            agreed = agreed + 1 if i > len(raw) - tail and last[i] == old_last[i + shift] else 0
            return agreed >= self.bpe.longest

        self.bpe.extend(raw, last, stop)
        return piece, raw, last + old_last[len(last) + shift :]

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: str) -> None:
        """Put `text` in place of the characters start to stop."""
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep][0]) + self.LOOKAHEAD <= start:
            at, keep = at + len(self.pieces[keep][0]), keep + 1
        shift = len(text) - (stop - start)
        ends, e = {}, at
        for k in range(keep, len(self.pieces)):
            if e >= stop:
                ends[e + shift] = k
            e += len(self.pieces[k][0])
        self.text = self.text[:start] + text + self.text[stop:]
        new, rest, old = [], len(self.pieces), keep
        for m in self.bpe.pattern.finditer(self.text, at):
            if m.start() in ends and m.start() >= start + len(text):
                rest = ends[m.start()]
                break
            new.append(self._piece(m.group(), self.pieces[old] if old < len(self.pieces) else None))
            old += 1
        self.pieces[keep:rest] = new

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, raw, last in self.pieces:
            known = self.bpe.ranks.get(raw)
            out += [known] if known is not None else self.bpe.unwind(last)
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> PrefixBPE:
    return PrefixBPE(load_ranks(path), pattern)


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null and empty texts have no tokens (digests of no bytes); repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column("text"):
                packed = own.pack(text.as_py() or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
