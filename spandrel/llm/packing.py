"""Harmonic packing of token sequences (Lee & Lee 1985), one worker at a time.

A sequence holds 2048 tokens. Pieces belong to reciprocal-capacity classes:
class k holds pieces of at most 2048/k tokens, and its open bin is closed when
it has exactly k of them. Documents may be cut, so they are cut where a class
fits exactly: whole sequences (class 1), then at most one piece each of 1024,
512, 256, 128 and 64 tokens (classes 2 to 32), whose bins fill up without
padding; what is left, under 64 tokens, goes to class floor(2048 / length),
whose bins waste at most 1/(k+1). Each task numbers its own bins and never
talks to another, so there is no shuffle. The bins that are still open at the
end of a task are poured, piece after piece, into full sequences and then
sequences whose length is a power of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import small_batches, table

CAPACITY = 2048
#: Below this, what is left of a document is a fragment and is not cut again.
SMALLEST_CUT = 64
END_ID = 1
#: Words, and pieces of words, whose ids a task remembers at once.
CACHE = 500_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

# In texts of these characters alone, NFC changes nothing and lower-casing is one to one, so that
# the tokenizer's own splitting rule can be applied here. No piece has white space in it, and the
# rule looks at nothing around a piece: the ids of a text are those of its words, one by one.
_SAFE = re.sub(r"[^\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]", "", "".join(map(chr, range(256)))).encode("latin-1")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _safe(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _SAFE) and "<|" not in text  # "<|" may begin a special token
    except UnicodeEncodeError:
        return False


class WordEncoder:
    """The ids of texts by a BPE vocabulary with word ends; a word or a piece of one seen before is looked up."""

    def __init__(self, vocabulary: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(vocabulary)
        # The same model for pieces, which are normal and split already.
        self._pieces = Tokenizer.from_file(vocabulary)
        self._pieces.normalizer = None
        self._pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for token, number in self._tokenizer.get_vocab().items():
            self._ends[number] = token.endswith("</w>")
        self._known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 500):
            part = pieces[at : at + 500]
            ids = np.array(self._pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
            raw, began = ids.tobytes(), 0
            if len(ends) != len(part):  # a piece that reads as two: one at a time
                self._known.update((p, self._whole(p)) for p in part)
                continue
            for piece, end in zip(part, ends.tolist(), strict=True):
                self._known[piece] = raw[began:end]
                began = end

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit numbers."""
        split = [x.lower().split() if _safe(x) else None for x in texts]
        if len(self._known) > CACHE:
            self._known.clear()
        known = self._known
        new = set().union(*filter(None, split)).difference(known)
        mixed = {w: _PIECE.findall(w) for w in new if not w.isalpha()}  # letters alone are one piece
        self._learn(sorted(new.difference(mixed).union(*mixed.values()).difference(known)))
        known.update((w, b"".join([known[p] for p in x])) for w, x in mixed.items())
        return [self._whole(t) if x is None else b"".join(map(known.__getitem__, x)) for t, x in zip(texts, split, strict=True)]


def cuts(n: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of n tokens."""
    at = 0
    while n - at >= CAPACITY:
        yield at, CAPACITY, 1
        at += CAPACITY
    size = CAPACITY // 2
    while size >= SMALLEST_CUT:
        if n - at >= size:
            yield at, size, CAPACITY // size
            at += size
        size //= 2
    if n > at:
        yield at, n - at, CAPACITY // (n - at)


class Packer:
    """The bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, worker: int) -> None:
        self._open: dict[int, list[tuple]] = {}
        self._next = worker << 40

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, self._next, offset
            offset += len(ids) // 4
        self._next += 1

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        for start, length, kind in cuts(total):
            pieces = self._open.setdefault(kind, [])
            pieces.append((doc, start, ids[4 * start : 4 * (start + length)], total))
            if len(pieces) == kind:
                yield from self._sequence(self._open.pop(kind))

    def close(self) -> Iterator[tuple]:
        rest = [p for kind in sorted(self._open) for p in self._open[kind]]
        self._open.clear()
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room = min(CAPACITY, 1 << (left.bit_length() - 1))
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = rest.pop(0)
                n = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.insert(0, (doc, start + n, ids[4 * n :], total))
                room -= n
            yield from self._sequence(pieces)


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents (columns doc_id, text), with their ids, sequence and offset in it.

    A null text is empty; an empty text has the end id alone. Rows with a null or
    a repeated doc_id are packed like any other, each row by itself; an empty
    table gives no rows; other columns are not read.
    """
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordEncoder(vocabulary), Packer(TaskContext.get().partitionId())
        end = struct.pack("<I", END_ID)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                rows = [row for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True) for row in packer.add(doc, ids + end)]
                if rows:
                    yield batch(rows)
        if rows := list(packer.close()):
            yield batch(rows)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
