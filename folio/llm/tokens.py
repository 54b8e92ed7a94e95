"""Token ids of whole texts, and packed id matrices for training."""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from array import array
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import released

# How the byte-level vocabulary splits text before merging, with its white space spelled out.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The same for texts within ASCII, where the standard library's patterns are quicker.
ASCII_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Bytes that byte-level vocabularies show as the character of that number; the others follow from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in SHOWN} | {b: 256 + k for k, b in enumerate(sorted({*range(256)}.difference(SHOWN)))}
#: So many characters of pre-tokens are remembered before the memory is cleared.
REMEMBERED = 1 << 24
#: Id after every document.
END = b"\0\0\0\0"


@cache
def split_by_library():
    """PRE_TOKEN for texts within the basic plane, by the standard library's quicker patterns; letters and numbers are those of ``regex``."""
    import regex

    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ranges = lambda kind: "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(rf"\p{{{kind}}}+", plane))
    return re.compile(PRE_TOKEN.replace(r"\p{L}+", f"[{ranges('L')}]+").replace(r"\p{N}+", f"[{ranges('N')}]+").replace(r"\p{L}\p{N}", ranges("L") + ranges("N"))).findall


def tokenizer_of(path: str) -> ByteTokenizer:
    """The process's own tokenizer for a file: a worker keeps what it has learned from one task to the next."""
    kept = sys.modules.setdefault("_folio_tokenizers", types.ModuleType("_folio_tokenizers"))
    if path not in vars(kept):
        setattr(kept, path, ByteTokenizer(path))
    return getattr(kept, path)


class ByteTokenizer:
    """Little-endian 32-bit ids of texts, as the tokenizer gives them without special tokens of its own.

    Where its file splits texts as PRE_TOKEN does, merges never cross pre-tokens, so each is encoded
    once and remembered.  Texts that hold the string of an added token, and all texts if the file
    has another way to split or normalise, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.split_any, self.split_plane, self.split_ascii = regex.compile(PRE_TOKEN).findall, split_by_library(), re.compile(ASCII_PRE_TOKEN, re.ASCII).findall
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        config = json.loads(self.tokenizer.to_str())
        split = config["pre_tokenizer"] or {}
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.whole = not byte_level or config["normalizer"] is not None or config["truncation"] is not None or config["padding"] is not None
        self.merge = None if self.whole or config["model"]["type"] != "BPE" else self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii(text)
        # Characters outside the basic plane, and none else, are two units.
        return (self.split_plane if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.split_any)(text)

    def __call__(self, text: str) -> bytes:
        if self.whole or self.holds_added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.split(text)
        if new := set(words).difference(self.known):
            if self.held > REMEMBERED:
                self.known, new, self.held = {}, set(words), 0
            self.held += sum(map(len, new))
            self.learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def learn(self, new: set[str]) -> None:
        """A BPE model merges the words' bytes itself, without the splitting and the offsets of whole texts; others are encoded one by one."""
        if self.merge:
            for w in new:
                self.known[w] = array("I", [t.id for t in self.merge(w.encode().decode("latin-1").translate(BYTES))]).tobytes()
            return
        new = list(new)
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, the first piece may be shorter."""
    first = n % most or most
    return [(0, min(n, first)), *((s, most) for s in range(first, n, most))]


def _pieces(batches, path: str, most: int):
    released()  # what an earlier stage left in this worker, before the memory of pre-tokens grows beside it
    encode = tokenizer_of(path)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        rows = []
        for i, text in zip(ids, texts, strict=True):
            data = encode(text.as_py() or "") + END
            rows += [(i, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(pieces_of(len(data) // 4, most))]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])
    released()


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each document's ids and a final 0, cut only where longer than ``most``.

    Null texts are empty (one piece with the 0 alone); rows with a null or repeated id are
    documents of their own; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(partial(_pieces, path=tokenizer, most=most), "id long, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


class CapacityTree:
    """A segment tree over remaining capacities: the smallest one that some bin has and that is at least n."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, n: int) -> int | None:
        at = n + self.leaves
        if self.count[at]:
            return n
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items (by number) of each bin: longest first, each into the fullest bin that still takes it."""
    tree, open_, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        left = tree.least(n)
        if left is None:
            left, b = capacity, len(bins)
            bins.append([])
        else:
            tree.add(left, -1)
            b = open_[left].pop()
        bins[b].append(i)
        if left > n:
            tree.add(left - n, 1)
            open_[left - n].append(b)
    return bins


def _matrices(batches, path: str, width: int, window: int, pad: int):
    """Packs windows of about ``window`` tokens, as they come; a window is one bounded piece of memory."""
    encode, part, made = tokenizer_of(path), TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    counting = np.arange(width, dtype="<u4")

    def column(rows: np.ndarray) -> pa.Array:
        """Rows of equal width as binary values, without a copy."""
        ends = np.arange(len(rows) + 1, dtype=np.int32) * 4 * width
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])

    def packed():
        nonlocal made
        bins = best_fit_decreasing([n for *_, n in held], width)
        for first in range(0, len(bins), 512):
            some = bins[first : first + 512]
            ids, places = np.full((len(some), width), pad, "<u4"), np.zeros((len(some), width), "<u4")
            docs, pieces, starts, ends = [], [], [], []
            for members, row, place in zip(some, ids, places, strict=True):
                at, cuts = 0, [0]
                for i in members:
                    data, n = held[i][3:]
                    row[at : at + n] = np.frombuffer(data, "<u4")
                    place[at : at + n] = counting[:n]
                    at += n
                    cuts.append(at)
                docs.append([held[i][0] for i in members])
                pieces.append([held[i][1] for i in members])
                starts.append([held[i][2] for i in members])
                ends.append(cuts)
            numbers = pa.array([(part << 33) + made + k for k in range(len(some))], pa.int64())
            made += len(some)
            lists = [pa.array(docs, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([numbers, column(ids), *lists, column(places)], ["sequence_id", "ids", "docs", "pieces", "starts", "cu_seqlens", "position_ids"])
        held.clear()

    total = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = encode(text.as_py() or "") + END
            for k, (s, n) in enumerate(pieces_of(len(data) // 4, width)):
                held.append((i, k, s, data[4 * s : 4 * (s + n)], n))
                total += n
                if total >= window:
                    yield from packed()
                    total = 0
    if held:
        yield from packed()


def packed_matrices(docs: DataFrame, tokenizer: str, width: int = 2048, window: int = 4 << 20, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the packed id matrix, each of exactly ``width`` ids.

    sequence_id long; ids binary (``width`` little-endian 32-bit ids, ``pad`` after the last
    segment); docs, pieces, starts arrays (what document, which of its pieces, how many of its ids
    before it, for each segment); cu_seqlens array<int> (0, then the end of each segment);
    position_ids binary (32-bit, back to 0 at each segment).  A document's ids end in 0; longer
    ones are cut losslessly.  Windows of ``window`` tokens are packed best-fit decreasing where
    they are read: nothing is shuffled, and memory is bounded by the window and the longest text.

    Null texts are empty; null and repeated ids, and columns of any name, do no harm.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "sequence_id long, ids binary, docs array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, position_ids binary"
    return source.mapInArrow(partial(_matrices, path=tokenizer, width=width, window=window, pad=pad), schema)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The matrix as files of rows, sorted by sequence within each file."""
    packed.sortWithinPartitions("sequence_id").write.parquet(path)
