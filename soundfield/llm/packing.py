"""Best-fit packing by large-item matching.

Every document becomes its token ids and an end mark; longer ones than the capacity are cut into pieces of full length,
their first piece takes what is left over.  How many pieces there are of each length (at most `capacity` numbers, whatever
the corpus) decides the layout:

1. Pieces above a third of the capacity go at most two to a bin.  From the longest down, each takes the longest partner that
   still fits.
2. Shorter pieces, from the longest down, fill the smallest gap that takes them, else a new bin.

Equal pieces are interchangeable, so both steps work on runs of equal bins instead of single ones, and the driver holds a
list of slots (length, first rank, last rank, first sequence, offset) whose size depends on the capacity only.  A piece finds
its slot by its rank among the pieces of its length: a running number within its task plus the sum over earlier tasks, so no
length, however frequent, meets in one task.

Pieces are written once, which fixes the ranks; a lost executor repeats a task with the same rows and the same numbers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from soundfield.llm.shared import slices, stored

CAPACITY, END = 1024, 2

LETTER, DIGIT, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
#: Texts of these characters only are split here; others go to the tokenizer whole.
COMMON = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")
WORD = re.compile(f" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for the characters of COMMON: for each of its bytes itself, or the next letter from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x20AD) if COMMON.fullmatch(chr(c))}


class Ids:
    """Token ids of texts.  Byte-level BPE never joins words, so each word goes to the model once and is remembered."""

    def __init__(self, path: str, most_words: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters, self.most_words = _byte_letters(), most_words
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _learn(self, words: list[str]) -> None:
        pieces_of, letters, flat, sizes = self.tokenizer.model.tokenize, self.letters, [], []
        for w in "\uffff".join(words).translate(letters).split("\uffff"):
            ids = [t.id for t in pieces_of(w)]
            flat += ids
            sizes.append(len(ids))
        known, at = len(self.words), int(self.bounds[len(self.words)])
        self.flat = _room(self.flat, at + len(flat))
        self.bounds = _room(self.bounds, known + len(words) + 1)
        self.flat[at : at + len(flat)] = flat
        self.bounds[known + 1 : known + len(words) + 1] = at + np.cumsum(sizes)
        self.words.update(zip(words, range(known, known + len(words)), strict=True))

    def of(self, text: str) -> np.ndarray:
        if not COMMON.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        words = WORD.findall(text)
        new = list(set(words).difference(self.words))
        if new:
            if len(self.words) + len(new) > self.most_words and self.words:
                self._forget()
                new = list(set(words))
            self._learn(new)
        if not words:
            return np.zeros(0, np.uint32)
        which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        first = self.bounds[which]
        size = self.bounds[which + 1] - first
        after = np.cumsum(size)
        return self.flat[np.arange(after[-1]) + np.repeat(first - after + size, size)]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """`array`, or a copy with twice the room or more if it is shorter than n."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(len(array), n), array.dtype)])


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One tokenizer for each worker process, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text), with its running number among its length in its task.

    Null and empty texts are one piece, the end mark.  `keep_ids` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_for, part, met = ids_of(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(ids_for.of(text or ""), np.uint32(end)).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    length = (len(ids) - at) % capacity or capacity
                    own = ids[at : at + length]
                    rows.append((doc, piece, at, length, zlib.crc32(own), part, met[length], own.astype(np.int64) if keep_ids else None))
                    met[length] += 1
                    at, piece = at + length, piece + 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)  # noqa: B905

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<long>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def layout(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, last rank + 1, sequence of the first rank, offset) for `counts` pieces of each length."""
    left, runs, third = Counter(counts), [], capacity // 3  # runs: number of equal bins, their lengths
    large = [n for n in range(capacity, third, -1) if left[n]]
    for a in large:
        for b in large:
            if b > a or a + b > capacity or not left[a] or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                runs.append((n, [a, b]))
                left[a] -= n
                left[b] -= n
        if left[a]:
            runs.append((left[a], [a]))
            left[a] = 0
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    for n, held in runs:
        gaps.setdefault(capacity - sum(held), []).append((n, held))
    for s in range(min(third, capacity), 0, -1):
        while left[s]:
            gap = next((g for g in range(s, capacity) if gaps.get(g)), capacity)
            n, held = gaps[gap].pop() if gap < capacity else (-(-left[s] // (capacity // s)), [])
            fit = gap // s
            full = min(n, left[s] // fit)
            for bins, each in ((full, fit), (1, left[s] - full * fit) if full < n and left[s] - full * fit < fit else (0, 0)):
                if bins and each:
                    gaps.setdefault(gap - each * s, []).append((bins, held + [s] * each))
                    left[s] -= bins * each
                    n -= bins
            if n and gap < capacity:
                gaps.setdefault(gap, []).append((n, held))
    slots, rank, sequence = [], Counter(), 0
    for group in gaps.values():
        for n, held in group:
            offset = 0
            for length in held:
                slots.append((length, rank[length], rank[length] + n, sequence, offset))
                rank[length] += n
                offset += length
            sequence += n
    return slots


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Every piece (see `pieces`) with its sequence_id and its offset there.

    Repeated rows are pieces of their own; ties between equal lengths are broken by place in the input.  An empty table
    gives no rows.  Columns but doc_id and text are ignored.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end, keep_ids), "packing-pieces")
    by_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by_task.withColumn("base", earlier).select("length", "part", "base")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    slots = docs.sparkSession.createDataFrame(layout(counts, capacity), "length long, lo long, hi long, first long, offset long")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return placed.select(*[ranked[c] for c in names], (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *["ids"] * keep_ids)
