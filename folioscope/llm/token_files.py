"""Token IDs as Arrow IPC files of fixed-size-list batches, with random access and masks.

A file holds record batches of `FixedSizeList<uint16|uint32>[length]` ids and `FixedSizeList<uint8>[length / 8]` masks
(a bit for each token, least first, 1 for real tokens); every batch but the last has the same number of sequences, so
sequence r is row r mod B of batch r div B, and both its ids and its mask are views of a memory map. Files on an object store are not mapped: their
batches are read as they are asked for, and are views of what was read. The documents of a file, in ascending doc_id
order, fill its sequences without gaps; only the last sequence is padded (mask bits 0). A second small Arrow file beside it
holds each document's id, first token and token count. Files are named by task attempt and listed in a manifest that
only finished tasks reach, so lost or repeated tasks leave no visible trace.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed
from folioscope.llm.shingles import LOWER, SEPARATOR, slices, span_hashes, string_buffers
from folioscope.session import fanout, materialize, work_path

#: Bytes of Western letters: ASCII ones, and C3 with what may follow it but for the signs of times and division.
ASCII_LETTER, AFTER_C3, MARK = (np.zeros(256, bool) for _ in range(3))
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
AFTER_C3[0x80:0xC0] = True
AFTER_C3[[0x97, 0xB7]] = False
#: Closing ASCII marks other than the apostrophe (which can begin a contraction).
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True
MARK[39] = False
JOINED = 64
CACHE_WORDS = 700_000
#: Longer words go to the library each time they come.
CACHED_BYTES = 64
SLICE_BYTES = 2 << 20

# The parts of a tokenizer file under which texts may be encoded word by word. White space is dropped,
# and neither the normaliser nor the pattern nor the byte mapping looks across it; a piece of letters is one match of
# the pattern, and the last of its tokens, and no other, carries the end-of-word mark.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
WORD_END = "</w>"


class WordCachedEncoder:
    """The tokenizers library behind a cache of words (runs of bytes other than ASCII white space).

    Where the file's normaliser, pre-tokeniser and model are those stated above, a text's ids are those of its words
    one after the other, and those of a word of Western letters and closing marks are those of its letters (ASCII ones
    in lower case) and of its marks. Each distinct part goes to the library once (as long as it stays in the cache)
    and is known by a 64-bit hash of its at most 64 bytes. With any other tokenizer file every text goes to the library whole."""

    def __init__(self, path: str, end_id: int = 1, dtype=None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype or ("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) < 1 << 16 else "<u4"))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path) as f:
            parts = json.load(f)
        model = parts["model"]
        self.by_word = (parts["normalizer"], parts["pre_tokenizer"], model["type"], model.get("end_of_word_suffix"), model.get("unk_token"), model.get("continuing_subword_prefix")) == (NORMALIZER, PRE_TOKENIZER, "BPE", WORD_END, None, None)
        self.by_word &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in parts["added_tokens"])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.array([self.end_id], self.dtype)  # the end id stands first
        self.used = 1

    def _library(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [array(self.code, e.ids).tobytes() for e in encode(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, many to a text: each ends at a token with the word-end mark."""
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.frombuffer(b"".join(self._library(texts)), self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer file marks other word ends than its parts say")
        packed, cuts = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def _add(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put ids behind those held; their places and numbers."""
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, total), self.dtype)])
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(found), self.dtype)
        place = self.used + np.cumsum(size) - size
        self.used += total
        return place, size

    def _words(self, text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and numbers of the ids of each part of `text`, whose rows begin at `cut`, and the rows' first parts."""
        inside = ~SEPARATOR[text]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        row = cut[cut < len(text)]
        begins[row] = inside[row]
        stops[:-1] &= begins[1:] | ~inside[1:]
        start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        # Where each word's letters end, and whether only marks follow.
        letter = ASCII_LETTER[text]
        lead = text == 0xC3
        letter |= lead
        letter[1:] |= AFTER_C3[text[1:]] & lead[:-1]
        until = lambda kind, at: np.append(np.flatnonzero(~kind), len(text))[np.searchsorted(np.flatnonzero(~kind), at)]
        core = np.minimum(until(letter, start), stop)
        clean = (core > start) & (until(MARK[text], core) >= stop)
        two = np.flatnonzero(clean & (core < stop))
        lettered = np.insert(clean, two + 1, False)
        start, stop = np.insert(start, two + 1, core[two]), np.insert(stop, two, core[two])
        # Letters are known in lower case, all else as it stands.
        lower = LOWER[text]
        other = np.flatnonzero(~lettered)
        size = stop[other] - start[other]
        at = np.repeat(start[other] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lower[at] = text[at]
        raw = lower.tobytes()
        part = lambda which: [raw[a:b].decode() for a, b in zip(start[which].tolist(), stop[which].tolist())]
        short = np.flatnonzero(stop - start <= CACHED_BYTES)
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        hashes, first, which = np.unique(span_hashes(lower, start, stop)[short], return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        near = np.flatnonzero(at < len(self.keys))
        known[near] = self.keys[at[near]] == hashes[near]
        own, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        own[known], n[known] = self.place[at[known]], self.count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            of_letters = lettered[short[first[new]]]
            for some, learn in ((new[of_letters], self._letters), (new[~of_letters], self._library)):
                own[some], n[some] = self._add(learn(part(short[first[some]])))
            order = np.argsort(np.concatenate([self.keys, hashes[new]]), kind="stable")
            self.keys, self.place, self.count = (np.concatenate([a, b[new]])[order] for a, b in ((self.keys, hashes), (self.place, own), (self.count, n)))
        place[short], count[short] = own[which], n[which]
        long = np.flatnonzero(stop - start > CACHED_BYTES)
        if len(long):
            place[long], count[long] = self._add(self._library(part(long)))
        return place, count, np.searchsorted(start, cut)

    def _slices(self, column):
        """For slices of a column of texts: first row, and places, numbers and rows of the words' ids."""
        data, offsets = string_buffers(column)
        for lo, hi in slices(offsets, SLICE_BYTES):
            base, cut = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
            if self.by_word:
                yield lo, *self._words(data[base : int(offsets[hi])], cut)
                continue
            self._forget()
            raw = data[base : int(offsets[hi])].tobytes()
            yield lo, *self._add(self._library([raw[a:b].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])), np.arange(hi - lo + 1)

    def lengths(self, column) -> np.ndarray:
        """Ids of each text of a column, its end id among them; a null text is empty."""
        out = [np.zeros(0, np.int64)]
        for _, _, count, rows in self._slices(column):
            total = np.concatenate([[0], np.cumsum(count)])
            out.append(np.diff(total[rows]) + 1)
        return np.concatenate(out)

    def encode(self, column):
        """For slices of a column: first row, the ids of its texts one after the other, each with its end id, and the
        numbers of ids."""
        for lo, place, count, rows in self._slices(column):
            place, count = np.insert(place, rows[1:], 0), np.insert(count, rows[1:], 1)
            total = np.concatenate([[0], np.cumsum(count)])
            ids = self.ids[np.repeat(place - total[:-1], count) + np.arange(total[-1])]
            yield lo, ids, np.diff(total[rows + np.arange(len(rows))])


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int = 1) -> WordCachedEncoder:
    return WordCachedEncoder(path, end_id)


class SequenceWriter:
    """Writes a stream of tokens as equal-length sequences; `batch` sequences make a record batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        if length % 8:
            raise ValueError("sequences are a multiple of 8 tokens long")
        self.dtype, self.length, self.batch = dtype, length, batch
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.uint8(), False), length // 8))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = 0

    def extend(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add documents' ids, one after the other; returns each one's first position in the file."""
        first = self.tokens + np.cumsum(counts) - counts
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= self.batch * self.length:
            self._flush(False)
        return first

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, self.dtype), *self.waiting])
        full = self.batch * self.length
        end = len(ids) // full * full
        for at in range(0, end, full):
            self._write(ids[at : at + full], full)
        rest = ids[end:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
            rest = rest[:0]
        self.waiting, self.held = [rest.copy()], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.packbits(np.arange(len(ids)) < real, bitorder="little")
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class SequenceFile:
    """Random access to a written file; sequences and masks are views of its (memory-mapped) bytes."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self._last: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, k: int) -> pa.RecordBatch:
        if self._last is None or self._last[0] != k:
            self._last = k, self.reader.get_batch(k)
        return self._last[1]

    def _values(self, k: int, column: str) -> pa.Array:
        return self._batch(k).column(column).flatten()

    def sequence(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence r, both views; the mask is packed (`unpack` makes booleans of it)."""
        k, row = divmod(r, self.batch)
        ids, mask = (self._values(k, c).slice(row * n, n).to_numpy(zero_copy_only=True) for c, n in (("input_ids", self.length), ("mask", self.length // 8)))
        return ids, mask

    @staticmethod
    def unpack(mask: np.ndarray) -> np.ndarray:
        return np.unpackbits(mask, bitorder="little").astype(bool)

    def tokens(self, first: int, n: int) -> np.ndarray:
        """n tokens from position `first` of the file's stream."""
        full, parts = self.batch * self.length, []
        while n > 0:
            k, at = divmod(first, full)
            part = self._values(k, "input_ids").slice(at, n).to_numpy(zero_copy_only=True)
            parts.append(part)
            first, n = first + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def real_tokens(self) -> int:
        """Tokens under true masks."""
        return sum(int(np.bitwise_count(self._values(k, "mask").to_numpy(zero_copy_only=True)).sum()) for k in range(self.reader.num_record_batches))


INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "file_no int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, vocabulary: str, uri: str, end_id: int = 1, length: int = 2048, batch: int = 64) -> DataFrame:
    """Encode `docs` (doc_id, text) in ascending doc_id order under the folder `uri`; returns the files' manifest.

    Null text is empty and still gets its end id; null doc_ids come first; rows with one doc_id are ordered by a hash
    of the text, and a tie by input position lets a repeated doc_id fill many files. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("__hash", F.xxhash64("text")).withColumn("__tie", F.monotonically_increasing_id())
    order = ["doc_id", "__hash", "__tie"]
    rows = rows.repartitionByRange(fanout(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        own = encoder(vocabulary, end_id)
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(uri)
        name = f"tokens-{task.partitionId():07d}-{task.taskAttemptId()}"
        sink, kept = None, []
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}.arrow")
                writer = SequenceWriter(sink, own.dtype, length, batch)
                index_sink = store.open_output_stream(f"{base}/{name}.docs.arrow")
                index = pa.ipc.new_file(index_sink, INDEX)
                n_docs = 0
            for lo, ids, counts in own.encode(b.column("text")):
                index.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(counts)), pa.array(writer.extend(ids, counts)), pa.array(counts)], schema=INDEX))
            n_docs += b.num_rows
        if sink is not None:
            for x in (writer, sink, index, index_sink):
                x.close()
            kept.append((task.partitionId(), f"{base}/{name}", n_docs, writer.tokens))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["file_no", "path", "n_docs", "n_tokens"])

    return materialize(rows.mapInArrow(trimmed(write), MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files a manifest lists (one task a file)."""
    spark = manifest.sparkSession
    files, total = [], 0
    for no, path, _, n in sorted(tuple(r) for r in manifest.collect()):  # one row a file
        files.append((path, total))
        total += n
    listed = spark.createDataFrame(spark.sparkContext.parallelize(files, max(1, len(files))), "path string, start long")

    def read(batches):
        store, _ = fs.FileSystem.from_uri(uri)
        opened = (lambda p: pa.memory_map(p)) if isinstance(store, fs.LocalFileSystem) else store.open_input_file
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                tokens = SequenceFile(opened(f"{path}.arrow"))
                index = pa.ipc.open_file(opened(f"{path}.docs.arrow"))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    first, n = part.column("first").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(tokens.tokens(f, c).astype("<u4").tobytes()) for f, c in zip(first.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(first + start), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Write `docs` as token files into the shared folder and report each document from the files read back."""
    uri = work_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, uri, end_id, length), uri)
