"""Concatenate and cut: documents one after another, cut into windows of a fixed length.

Every document becomes its token ids and an end mark.  Where it starts in the concatenation is a prefix sum in two passes:
the tokens before it within its task, and the totals of the tasks before that one (themselves summed in blocks of tasks, so
that no task handles them all).  Windows of `capacity` tokens are then fixed, and a document that crosses a bound has one
record on either side of it.  The tokens that are left after the last whole window are cut into windows whose lengths are
powers of two, longest first, which need no padding either.

Ids are written once, which fixes tasks and places; a lost executor repeats a task with the same rows and the same numbers.
No task holds more than a batch of documents, and only one total goes to the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from soundfield.llm.packing import COMMON, DIGIT, LETTER, SPACE, _byte_letters, _room
from soundfield.llm.shared import slices, stored

CAPACITY, END = 2048, 1
BLOCK = 1024

#: The words of the vocabulary, in lower case; letters and digits are those of the common characters.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
#: Blanks for `str.split` but not for the tokenizer.
UNLIKE = re.compile("[\x1c-\x1f]")


class ChunkIds:
    """Token ids of texts under a vocabulary that drops white space: what stands between blanks goes to the model once.

    Texts with a special token, or with one of four control characters that Python counts as blanks, go to the tokenizer
    whole.  The memory for chunks starts anew beyond `most` chunks or characters of 32 times that number.
    """

    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters, self.most = _byte_letters(), most
        self._forget()

    def _forget(self) -> None:
        self.chunks: dict[str, int] = {}
        self.held = 0
        self.flat, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _ids(self, chunk: str) -> list[int]:
        low = chunk.lower()
        if not COMMON.fullmatch(low):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return [t.id for w in WORD.findall(low) for t in self.tokenizer.model.tokenize(w.translate(self.letters))]

    def _learn(self, chunks: list[str]) -> None:
        found = [self._ids(c) for c in chunks]
        sizes = np.cumsum([len(x) for x in found])
        known = len(self.chunks)
        at = int(self.bounds[known])
        self.flat = _room(self.flat, at + int(sizes[-1]))
        self.bounds = _room(self.bounds, known + len(chunks) + 1)
        self.flat[at : at + int(sizes[-1])] = [i for x in found for i in x]
        self.bounds[known + 1 : known + len(chunks) + 1] = at + sizes
        self.chunks.update(zip(chunks, range(known, known + len(chunks)), strict=True))
        self.held += sum(map(len, chunks))

    def of(self, text: str) -> np.ndarray:
        if UNLIKE.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        chunks = text.split()
        if not chunks:
            return np.zeros(0, np.uint32)
        new = list(set(chunks).difference(self.chunks))
        if new:
            if len(self.chunks) + len(new) > self.most or self.held > 32 * self.most:
                self._forget()
                new = list(set(chunks))
            self._learn(new)
        which = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        first = self.bounds[which]
        size = self.bounds[which + 1] - first
        after = np.cumsum(size)
        return self.flat[np.arange(after[-1]) + np.repeat(first - after + size, size)]


_LOADED: dict[str, ChunkIds] = {}


def ids_of(path: str) -> ChunkIds:
    """One tokenizer for each worker process, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """One row for each row of `docs`: doc_id, its ids (little-endian, 32 bits each), their number, its task, the tokens before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_for, part, before = ids_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            found = [np.append(ids_for.of(t or ""), np.uint32(end)).astype("<u4") for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in found], np.int64)
            places = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            ids = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(sizes), pa.array(np.full(len(found), part, np.int32)), pa.array(places)],
                ["doc_id", "ids", "doc_tokens", "part", "place"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, ids binary, doc_tokens long, part int, place long")


def bases(rows: DataFrame) -> DataFrame:
    """(part, base): the tokens in all earlier tasks, summed within blocks of tasks and over the blocks."""
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")).withColumn("block", F.floor(F.col("part") / BLOCK))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", before(Window.orderBy("block")).alias("earlier"))
    inside = totals.select("block", "part", before(Window.partitionBy("block").orderBy("part")).alias("inside"))
    return inside.join(blocks, "block").select("part", (F.col("earlier") + F.col("inside")).alias("base"))


def tail_bounds(total: int, capacity: int = CAPACITY) -> list[int]:
    """Where the windows after the last whole one begin, and `total` at the end: their lengths are the binary digits of the rest."""
    bounds, rest = [total - total % capacity], total % capacity
    while rest:
        largest = 1 << rest.bit_length() - 1
        bounds.append(bounds[-1] + largest)
        rest -= largest
    return bounds


def cut(start: int, n: int, bounds: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """The records (first, length, sequence, offset) of a document of `n` tokens from place `start` of the concatenation on."""
    out, at, stop, whole = [], start, start + n, bounds[0] // capacity
    while at < stop:
        if at < bounds[0]:
            sequence, first = divmod(at, capacity)
            offset, until = first, (sequence + 1) * capacity
        else:
            k = bisect_right(bounds, at) - 1
            sequence, offset, until = whole + k, at - bounds[k], bounds[k + 1]
        until = min(until, stop)
        out.append((at - start, until - at, sequence, offset))
        at = until
    return out


def concatenated(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Every piece of every row of `docs` (doc_id, text) with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the end mark.  Repeated rows and rows without a doc_id are documents of their own;
    documents follow each other in the order of the input.  An empty table gives no rows.  Other columns are ignored.
    `keep_ids` adds the ids of the piece.  `end` is the id of the mark.
    """
    rows = stored(encoded(docs, tokenizer, end), "concatenation-ids")
    bounds = tail_bounds(rows.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0], capacity)
    # one row of 12 bytes for each task that wrote ids, fewer than the driver already keeps of a task
    placed = rows.join(F.broadcast(bases(rows)), "part").select("doc_id", "ids", "doc_tokens", (F.col("base") + F.col("place")).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: list[tuple] = []
            for doc, ids, n, place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for first, length, sequence, offset in cut(place, n, bounds, capacity):
                    own = memoryview(ids)[4 * first : 4 * (first + length)]
                    found.append((doc, first, length, zlib.crc32(own), n, sequence, offset, np.frombuffer(own, "<u4").astype(np.int64) if keep_ids else None))
            columns = list(zip(*found, strict=True)) if found else [[]] * 8
            types = [pa.int64()] * 7 + [pa.list_(pa.int64())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)  # noqa: B905

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return placed.mapInArrow(run, ", ".join(f"{n} long" for n in names[:7]) + ", ids array<long>" * keep_ids)
