"""Cross-tokenizer alignment over distinct texts.

Byte-level tokens (A) and sentence pieces (B) of the same text are laid side by side by their bytes.  Where tokens of both
end, a group ends; tokens whose bytes overlap are linked.  Corpus-wide counts say in how many documents a pair of ids is linked.

1. Rows are shuffled by their full text and counted, so each distinct text is encoded and aligned once, however many copies it
   has; its measures and its distinct linked pairs are written with its multiplicity.
2. Pair counts are sums of multiplicities: every task adds up its texts first, in a table of bounded size.
3. Pairs are looked up again text by text.  The `HEAVY` most frequent ones at most go to all tasks, a table of 17 bytes a pair;
   the links of all others take a shuffle join, in which no key is frequent, since the frequent ones are not in it.
4. Measures join the rows by the SHA-256 of the text.

Within a text, neither vocabulary joins a blank to what stands before it unless that is white space too, so both have an end
before such a blank.  Texts of more than `SEGMENT` characters are handled in segments that end there.  For a B vocabulary with
a piece that goes on past such a blank, and for texts without one, the whole text is one segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm.packing import Ids
from soundfield.llm.shared import slices, stored

HEAVY = 1 << 19
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 1 << 20
#: Characters of a segment at least, unless the text ends; and of segments that are aligned together, but for the last.
SEGMENT, TOGETHER = 1 << 16, 1 << 18
SAFE = re.compile(r"(?<=\S) ")
COMMA, BAR, SEMICOLON, NOTHING = range(4)


def align(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two divisions of the same bytes, given by their ids and where their parts end.

    Links as a << 32 | b in the order of a, the number of each a's links, which a are the last of a group, and how groups are
    written: numbers id * 4 + what follows the id, and the place in this list after each group.
    """
    a_starts = np.append(0, a_ends[:-1])
    first, last = np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_ends, a_ends)
    n = last - first + 1
    after = np.cumsum(n)
    links = np.repeat(a.astype(np.int64) << 32, n) | b[np.arange(after[-1]) + np.repeat(first - after + n, n)]
    a_closes, b_closes = b_ends[last] == a_ends, a_ends[np.searchsorted(a_ends, b_ends)] == b_ends
    a_group, b_group = np.cumsum(a_closes) - a_closes, np.cumsum(b_closes) - b_closes
    a_until, b_until = np.flatnonzero(a_closes) + 1, np.flatnonzero(b_closes) + 1
    written = np.zeros(len(a) + len(b), np.int64)
    written[np.arange(len(a)) + np.append(0, b_until)[a_group]] = 4 * a.astype(np.int64) + np.where(a_closes, BAR, COMMA)
    written[np.arange(len(b)) + a_until[b_group]] = 4 * b.astype(np.int64) + np.where(b_closes, SEMICOLON, COMMA)
    return links, n, a_closes, written, a_until + b_until


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Ids(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.special, self.a.tokenizer.encode_special_tokens = [], True
        letter = {v: bytes([k]) for k, v in _bytes_of_letters().items()}
        self.a_bytes = [b"".join(letter.get(c, c.encode()) for c in self.a.tokenizer.id_to_token(i) or "") for i in range(self.a.tokenizer.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.whole = any(re.search("[^▁]▁", p) for p in pieces) or self.blank == self.b.unk_id()
        self.written = np.array([f"{i}{c}" for i in range(max(len(self.a_bytes), len(pieces))) for c in (",", "|", ";", "")], object)

    def segments(self, text: str) -> Iterator[str]:
        """A blank and `text`, divided before blanks."""
        start, text = 0, " " + text
        while start < len(text):
            cut = None if self.whole or len(text) - start <= SEGMENT else SAFE.search(text, start + max(SEGMENT, 1))
            stop = cut.start() if cut else len(text)
            yield text[start:stop]
            start = stop

    def of(self, segments: list[str]) -> list[tuple[int, int, int, np.ndarray, str] | None]:
        """(tokens of A, of B, groups, links, the groups' text) of each segment; None where bytes differ."""
        out: list = [None] * len(segments)
        own_a, own_b, own = [], [], []
        for k, (segment, b) in enumerate(zip(segments, self.b.encode([s[1:] for s in segments], num_threads=1), strict=True)):
            a, b = self.a.of(segment), b or [self.blank]
            if b"".join([self.a_bytes[i] for i in a.tolist()]) == b"".join([self.b_bytes[i] for i in b]) == segment.encode():
                own_a.append(a)
                own_b.append(np.array(b, np.int64))
                own.append(k)
        if not own:
            return out
        a, b = np.concatenate(own_a), np.concatenate(own_b)
        links, n, closes, written, until = align(a, np.cumsum(self.a_sizes[a]), b, np.cumsum(self.b_sizes[b]))
        n_a, n_b = (np.array([len(x) for x in y]) for y in (own_a, own_b))
        a_to = np.cumsum(n_a)
        links_to, groups_to, written_to = np.cumsum(n)[a_to - 1], np.cumsum(closes)[a_to - 1], np.cumsum(n_a + n_b)
        written[written_to - 1] += NOTHING - SEMICOLON
        parts = self.written[written].tolist()
        links_from, groups_from, written_from = (np.append(0, x[:-1]).tolist() for x in (links_to, groups_to, written_to))
        for i, k in enumerate(own):
            out[k] = (int(n_a[i]), int(n_b[i]), int(groups_to[i]) - groups_from[i], links[links_from[i] : links_to[i]], "".join(parts[written_from[i] : written_to[i]]))
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A and B, groups, links, SHA-256 of the groups; distinct pairs with their numbers of links."""
        waiting, size, held = [], 0, _Held()
        for k, text in enumerate(texts):
            parts = list(self.segments(text)) if text else []
            if not parts:
                waiting.append((k, True, None))
            for i, part in enumerate(parts):
                waiting.append((k, i == len(parts) - 1, part))
                size += len(part)
                if size >= TOGETHER:
                    yield from self._told(waiting, held)
                    waiting, size = [], 0
        yield from self._told(waiting, held)

    def _told(self, waiting: list[tuple[int, bool, str | None]], held: _Held):
        found = iter(self.of([part for *_, part in waiting if part is not None]))
        for _, last, part in waiting:
            held.add(next(found) if part is not None else None)
            if last:
                yield held.told()


class _Held:
    """What is known of a text until its last segment has come."""

    def __init__(self):
        self._anew()

    def _anew(self) -> None:
        self.sums, self.n, self.sha, self.sound = np.zeros(4, np.int64), 0, hashlib.sha256(), True
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, found: tuple[int, int, int, np.ndarray, str] | None) -> None:
        self.sound = self.sound and found is not None
        if not self.sound:
            return
        n_a, n_b, n_groups, links, groups = found
        self.sums += (n_a, n_b, n_groups, len(links))
        self.sha.update((";" + groups if self.n else groups).encode())
        pairs, times = np.unique(links, return_counts=True)
        if self.n:
            pairs, which = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(which, np.concatenate([self.times, times])).astype(np.int64)
        self.pairs, self.times, self.n = pairs, times, self.n + 1

    def told(self) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        out = (*self.sums.tolist(), self.sha.hexdigest(), self.pairs, self.times) if self.sound else (0, 0, 0, 0, "", none, none)
        self._anew()
        return out


def _bytes_of_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printing ones stand for themselves, the rest count from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, kept from task to task."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


MEASURED = "text_no long, text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def measured(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each row of `texts` (text, copies): its measures, and its distinct linked pairs with their numbers of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows, texts = [], batch.column("text").to_pylist()
            for text, copies, (n_a, n_b, n_groups, n_links, sha, pairs, times) in zip(texts, batch.column("copies").to_pylist(), both.texts(texts), strict=True):
                key = hashlib.sha256(text.encode()).digest()
                rows.append((number, key, copies, n_a, n_b, n_groups, n_links, sha, pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes()))
                number += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            types = [pa.int64(), pa.binary()] + [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in MEASURED.split(", ")])

    return texts.select("text", "copies").mapInArrow(run, MEASURED)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers of all blobs of a column, and how many each blob has."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<i8"), np.array([len(x) // 8 for x in blobs], np.int64)


def pair_counts(rows: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(pair, n, best): the documents that hold a pair linked, and whether no pair with its A id is held by more."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, which, np.concatenate([w for _, w in parts]))
        return pairs, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in slices(batches):
            pairs, sizes = _joined(batch.column("pairs"))
            parts.append((pairs, np.repeat(batch.column("copies").to_numpy(zero_copy_only=False), sizes)))
            waiting += len(pairs)
            if waiting > max(len(parts[0][0]), counted // 4):
                parts, waiting = [merged(parts)], 0
                if len(parts[0][0]) > counted:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["pair", "n"])
                    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], ["pair", "n"])

    sums = rows.select("pairs", "copies").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # as many rows as B has ids, at most
    return sums.withColumn("best", F.col("n") == most)


def heavy_from(counts: DataFrame, most: int) -> int:
    """The least level (of `level`) from which on there are `most` pairs or fewer."""
    level, left = 512, most
    for r in counts.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 512 rows at most
        left -= r.n
        if left < 0:
            break
        level = r.level
    return level


def _level():
    return F.floor(F.log2("n") * 8)


def weighed(rows: DataFrame, counts: DataFrame, most: int = HEAVY) -> DataFrame:
    """(text_no, n_best, count_sum): for each row its links whose pair is the most frequent of its A id, and the sum of all links' counts."""
    level = heavy_from(counts, most)
    heavy = counts.where(_level() >= level).toArrow()  # `most` rows of 17 bytes at most
    order = np.argsort(heavy.column("pair").to_numpy(), kind="stable")
    known = tuple(heavy.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    lookup = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = lookup.value
        for batch in slices(batches):
            pairs, sizes = _joined(batch.column("pairs"))
            times, _ = _joined(batch.column("times"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(pair, pairs)
            found = np.zeros(len(pairs), bool)
            inside = at < len(pair)
            found[inside] = pair[at[inside]] == pairs[inside]
            n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, row[found], times[found] * best[at[found]])
            np.add.at(count_sum, row[found], times[found] * n[at[found]])
            numbers = batch.column("text_no").to_numpy()
            empty = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(numbers), empty, pa.array(n_best), pa.array(count_sum), empty], names)
            rest = ~found
            empty = pa.nulls(int(rest.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(numbers[row[rest]]), pa.array(pairs[rest]), empty, empty, pa.array(times[rest])], names)

    names = ["text_no", "pair", "n_best", "count_sum", "times"]
    looked = stored(rows.select("text_no", "pairs", "times").mapInArrow(run, ", ".join(f"{n} long" for n in names)), "alignment-looked")
    rare = counts.where(_level() < level)
    others = looked.where("pair is not null").select("text_no", "pair", "times").join(rare, "pair")
    others = others.select("text_no", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = looked.where("pair is null").select("text_no", "n_best", "count_sum").unionByName(others)
    return both.groupBy("text_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose joined bytes differ from a blank and the text, have no tokens: zeros and ''.  Repeated
    rows are documents of their own, and so are rows without a doc_id.  Ties for the most frequent pair all count as best.
    An empty table gives no rows.  Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = own.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    rows = stored(measured(texts, path_a, path_b), "alignment-texts")
    counts = stored(pair_counts(rows), "alignment-pairs")
    sums = weighed(rows, counts, heavy)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measures = rows.drop("pairs", "times", "copies").join(sums, "text_no").drop("text_no")
    keyed = own.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"))
    out = keyed.join(measures, "text_key", "left")
    return out.select("doc_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
