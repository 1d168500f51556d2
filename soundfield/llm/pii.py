"""Personal data by candidate gradient boosting.

1. Base spans: strict formats of email, ip, card and phone, leftmost and non-overlapping for each kind, always redacted.
2. Generators with high recall propose further, overlapping spans: of every run of digit groups with any usual separators, all
   windows of successive groups that have the digits of a phone or card or the four parts of an ip, so that numbers next to each
   other are told apart; and addresses written with @, (at), [dot] and the like.
3. Boosted trees judge each candidate by its format (digits, groups, separators, check digit, neighbours) and its context
   (words such as "call" or "card", digits and hexadecimal letters around it).
4. For each kind a calibrated threshold decides: the least probability, on contexts kept out of the fit, above which the
   share of true ones is at least PRECISION.  A kind without such a threshold adds nothing.

Nobody labels personal data here, so training labels are made: base spans of the corpus are true; variants of them in the
same context (no plus sign, other separators, "(at)" for @) are true; broken ones (a wrong check digit, groups cut short or
repeated, numbers out of range) are false, as are the corpus's own candidates that no base span covers, with less weight.
Base spans are also set next to another number: the span is true there, and windows over the border are false.
Training and thresholds take every base span and every other candidate of the corpus: Spark counts equal rows of bins and sums
gradients for each level of a tree.  All kinds weigh the same; so no kind is crowded out by another.

All patterns take time in proportion to the text, whatever it holds.  Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm import boosting
from soundfield.llm.shared import slices, stored

KINDS = ("email", "ip", "card", "phone")
PRECISION, AROUND, STEPS, NEIGHBOURS, TASK = 0.98, 40, 1000, 1000, 100_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
GROUPS = re.compile(r"[+(]{0,2}[0-9](?:(?:[ ().\-/]{1,2}|\[\.\])?[0-9])+")
AT = re.compile(r"@| ?[(\[{] ?at ?[)\]}] ?| at (?=[\w-]+ ?(?:[(\[{] ?dot ?[)\]}]| dot ))", re.I)
LOOSE_DOMAIN = re.compile(r"[\w-]{1,63}(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )[\w-]{1,63})+", re.I)
DIGIT_LEFT, DIGIT_RIGHT = re.compile(r"[0-9](?:[ ().\-/]{1,2}|\[\.\])?[+(]*\Z"), re.compile(r"(?:[ ().\-/]{1,2}|\[\.\])?[0-9]")
LOOSE_LOCAL = re.compile(r"[\w.%+-]{1,64}\Z")
HINTS = {
    "email": re.compile(r"mail|contact|write|address|reach", re.I), "ip": re.compile(r"\bip\b|host|server|login|client|addr", re.I),
    "card": re.compile(r"card|visa|credit|master|pay", re.I), "phone": re.compile(r"call|phone|tel|fax|mobile|cell|dial", re.I),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Strict spans, by kind in the order of KINDS, then by start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # a match has its @ after the run of local characters that begins it
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(Span("email", start, done := m.end()))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    if not ANY_DIGIT.search(text):
        return out
    for run in DOTTED.finditer(text):
        parts = [m.span() for m in NUMBER.finditer(text, run.start(), run.end())]
        for i in range(0, len(parts) - 3, 4):
            if all(small(text[a:b]) for a, b in parts[i : i + 4]):
                out.append(Span("ip", parts[i][0], parts[i + 3][1]))
    for m in CARD.finditer(text):
        digits = "".join(NUMBER.findall(m[0])) if len(m[0]) <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(len, NUMBER.findall(m[0]))) <= 15:
            out.append(Span("phone", *m.span()))
    return out


def windows(text: str, start: int, end: int) -> Iterator[Span]:
    """Of a run of digit groups, the windows of successive groups with 7 to 19 digits or four parts: from each group at most 19.

    None begins or ends beside a letter or an underscore, as digits inside a key or a hexadecimal string do.
    """

    def clear(a: int, b: int) -> bool:
        return not (a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))

    parts = [m.span() for m in NUMBER.finditer(text, start, end)]
    for i, (a, _) in enumerate(parts):
        first, n, own = a, 0, []
        while first > start and text[first - 1] in "+(":
            first -= 1
        for j in range(i, len(parts)):
            n += parts[j][1] - parts[j][0]
            if n > 19:
                break
            stop = parts[j][1]
            if j == i + 3 and first == a and all(y - x <= 3 for x, y in parts[i : j + 1]):
                own.append(Span("ip", a, stop))
            if 7 <= n <= 15:
                own.append(Span("phone", first, stop))
            if 13 <= n:
                own.append(Span("card", a, stop))
        yield from (s for s in reversed(own) if clear(s.start, s.end))  # longer ones first


def proposals(text: str) -> Iterator[Span]:
    """Loose spans of every kind, which may overlap."""
    for m in AT.finditer(text):
        left = LOOSE_LOCAL.search(text[max(0, m.start() - 64) : m.start()])
        right = LOOSE_DOMAIN.match(text, m.end())
        if left and right:
            yield Span("email", m.start() - len(left[0]), right.end())
    if ANY_DIGIT.search(text):
        for m in GROUPS.finditer(text):
            yield from windows(text, *m.span())


def candidates(text: str) -> list[Span]:
    return list(proposals(text))


def free_of(spans: list[Span], text: str) -> tuple[bytearray, Callable[[Span], bool]]:
    """Marks of the places that `spans` cover, and a test for spans that touch none."""
    marks = bytearray(len(text))
    for s in spans:
        marks[s.start : s.end] = b"\1" * (s.end - s.start)
    return marks, lambda c: marks.find(1, c.start, c.end) < 0


def features(kind: str, left: str, body: str, right: str) -> list[float]:
    """Numbers for the trees: `left` and `right` are up to AROUND characters on either side."""
    parts = NUMBER.findall(body)
    sizes = [len(p) for p in parts] or [0]
    digits, near = "".join(parts), left[-20:] + " " + right[:20]
    before, after = left[-1:], right[:1]
    return [
        KINDS.index(kind), len(body), len(digits), len(parts), max(sizes), min(sizes), sizes[0], sizes[-1],
        body.startswith("+"), "(" in body, "-" in body, " " in body, "." in body, "/" in body, "@" in body, "[" in body or "{" in body,
        luhn(digits) if 13 <= len(digits) <= 19 else -1, all(small(p) for p in parts), sum(small(p) for p in parts),
        before.isalnum(), after.isalnum(), before in "+#$€%.,-_=:/\"'" and before != "", after in "+#$€%-_=:/\"'" and after != "",
        bool(HINTS[kind].search(left)), bool(HINTS[kind].search(right)), any(HINTS[k].search(left[-20:]) for k in KINDS if k != kind),
        sum(c.isdigit() for c in near) / len(near), len(re.findall(r"[0-9a-f]{6,}", near)), body.count("."), sum(c.isalpha() for c in body) / len(body),
        len(set(re.findall(r"[^\w]+", body))), parts[0][:2] in ("19", "20") if parts else 0,
        bool(DIGIT_LEFT.search(left[-4:])), bool(DIGIT_RIGHT.match(right)),
    ]


def variants(kind: str, body: str, draw: random.Random) -> list[tuple[str, int]]:
    """Rewritten true spans (1) and broken ones (0) of a base span."""
    parts = NUMBER.findall(body)
    digits = "".join(parts)
    if kind == "email":
        name, _, place = body.rpartition("@")
        at, dot = draw.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", ".")])
        return [(name + at + place.replace(".", dot), 1), (f"{name} at {place.split('.')[0]}", 0), (f"{draw.randrange(9)}@{draw.randrange(9)}.{draw.randrange(9)}", 0)]
    if kind == "ip":
        wrong = parts[:3] + [str(draw.randrange(256, 999))]
        return [("[.]".join(parts), 1), (".".join(draw.sample(wrong, 4)), 0), ("/".join(parts), 0), (" ".join(parts), 0)]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + draw.randrange(1, 10)) % 10)
        four = lambda d: [d[i : i + 4] for i in range(0, len(d), 4)]
        mark = draw.choice([".", "/", " ", "-"])
        return [(mark.join(four(digits)), 1), (wrong, 0), (mark.join(four(wrong)), 0), (digits[:13], 0)]
    mark, tail = draw.choice(["-", ".", " "]), digits[-10:]
    soft = draw.choice([f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", mark.join([tail[:3], tail[3:6], tail[6:]]), "00" + digits])
    date = f"{draw.randrange(1900, 2030)}{mark}{draw.randrange(1, 13):02d}{mark}{draw.randrange(1, 29):02d}"
    return [(soft, 1), (tail[:7], 0), (date, 0), (tail, 0), (f"{tail[:5]}.{tail[5:]}", 0)]


class Model:
    """Trees and each kind's threshold on the probability."""

    def __init__(self, trees: boosting.Boosted | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all: base ones and the accepted candidates that overlap neither them nor a likelier one."""
        text = text or ""
        base = base_spans(text)
        if not self.trees or not self.thresholds:
            return base, base
        found, likely = list(base), []
        marks, free = free_of(base, text)
        for some in itertools.batched(filter(free, proposals(text)), 4096):
            x = np.array([features(c.kind, text[max(0, c.start - AROUND) : c.start], text[c.start : c.end], text[c.end : c.end + AROUND]) for c in some], float)
            p = 1 / (1 + np.exp(-self.trees.margins(x)))
            likely += [(-q, c) for q, c in zip(p.tolist(), some, strict=True) if q >= self.thresholds.get(c.kind, 2)]
        for _, c in sorted(likely, key=lambda o: o[0]):
            if free(c):
                marks[c.start : c.end] = b"\1" * (c.end - c.start)
                found.append(c)
        return base, sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "kind", "left", "body", "right", "true"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    for batch in slices(batches):
        for rows in itertools.batched(_rows(batch), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        base = base_spans(text := text or "")
        _, free = free_of(base, text)
        for s, true in itertools.chain(((s, True) for s in base), ((s, False) for s in filter(free, proposals(text)))):
            yield doc, s.kind, text[max(0, s.start - AROUND) : s.start], text[s.start : s.end][:200], text[s.end : s.end + AROUND], true


def beside(kind: str, left: str, body: str, right: str, other: str) -> list[tuple[str, str, str, int]]:
    """The span `body` with the number `other` before or after it (1), and windows over the border (0): left, body, right, label."""
    if kind == "email" or not (groups := [m.span() for m in NUMBER.finditer(other)]):
        return []
    own = [m.span() for m in NUMBER.finditer(body)]
    out = [(left + other + " ", body, right, 1), (left, body, " " + other + right, 1), (left, body + " " + other[: groups[0][1]], other[groups[0][1] :] + right, 0)]
    out.append((left + other[: groups[-1][0]], other[groups[-1][0] :] + " " + body, right, 0))
    if len(own) > 1:
        out.append((left + body[: own[1][0]], body[own[1][0] :] + " " + other[: groups[0][1]], other[groups[0][1] :] + right, 0))
    return [(a[-AROUND:], b, c[:AROUND], label) for a, b, c, label in out]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of every context and of what is made from it; every third context and its variants are kept out of the fit."""
    for batch in slices(batches, 1024):
        kinds, kept, labels, weights, x = [], [], [], [], []
        for r in batch.to_pylist():
            kind, left, body, right, draw = r["kind"], r["left"], r["body"], r["right"], random.Random(r["order"])
            made = [(left, body, right, 0, 0.5)]
            if r["true"]:
                made = [(left, body, right, 1, 1.0)] + [(left, v, right, label, 1.0) for v, label in variants(kind, body, draw)]
                made += [(*o, 1.0) for o in beside(kind, left, body, right, r["other"])] if r["other"] else []
            for before, v, after, label, weight in made:
                kinds.append(kind), kept.append(r["order"] % 3 == 0), labels.append(label), weights.append(weight)
                x.append([float(f) for f in features(kind, before, v, after)])
        columns = [pa.array(kinds, pa.string()), pa.array(kept, pa.bool_()), pa.array(labels, pa.int32()), pa.array(weights, pa.float64()), pa.array(x, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "kept", "y", "weight", "x"])


def train(docs: DataFrame) -> Model:
    """Fit on every base span and every other candidate of the corpus; without any, only base spans are found."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_contexts, "doc_id long, kind string, left string, body string, right string, true boolean")
    names = ("doc_id", "kind", "body", "left", "right")
    found = stored(found, "pii-contexts").withColumn("order", F.xxhash64(*names).bitwiseAND(2**63 - 1))
    number = F.col("true") & (F.col("kind") != "email")
    numbers, others = found.where(number), found.where(~number).withColumn("other", F.lit(None).cast("string"))
    near = Window.partitionBy(F.pmod("order", F.lit(numbers.count() // NEIGHBOURS + 1))).orderBy("order", *names)
    numbers = numbers.withColumn("other", F.coalesce(F.lag("body").over(near), F.lead("body").over(near)))
    every = numbers.unionByName(others).drop("doc_id").mapInArrow(_examples, "kind string, kept boolean, y int, weight double, x array<double>")
    every = stored(every, "pii-examples")
    counts = {(r.kind, r.y): r["count"] for r in every.where("not kept").groupBy("kind", "y").count().collect()}
    if len({y for _, y in counts}) < 2:
        return Model(None, {})
    cuts = boosting.quantiles(every.where("not kept"), "x", len(features("email", "", "x", "")))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(cuts))
            codes = pa.array([c.tobytes() for c in boosting.code(x, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "kept", "y", "weight")), codes], ["kind", "kept", "y", "weight", "code"])

    rows = every.mapInArrow(coded, "kind string, kept boolean, y int, weight double, code binary")
    rows = rows.groupBy("kind", "kept", "y", "code").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    tasks = sum(counts.values()) // TASK + 1  # a job for each level of a tree: no more tasks than its rows need
    rows = stored(rows.coalesce(tasks), "pii-coded")
    by_kind = {k: sum(n for (kind, _), n in counts.items() if kind == k) for k, _ in counts}
    scale = F.lit(1.0)  # all kinds weigh the same
    for kind, n in by_kind.items():
        scale = F.when(F.col("kind") == kind, sum(by_kind.values()) / len(by_kind) / n).otherwise(scale)
    trees = boosting.fit_table(rows.where("not kept").select("code", "y", (F.col("weight") * scale).alias("weight")).coalesce(tasks), cuts)
    return Model(boosting.decoded(trees, cuts), thresholds(rows.where("kept"), trees, len(cuts)))


def thresholds(rows: DataFrame, trees: boosting.Boosted, n_features: int) -> dict[str, float]:
    """Of each kind the least probability, in steps of 1 / STEPS, from which on PRECISION of all `rows` are true, at least 10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-trees.margins(boosting.matrix(batch, n_features))))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(np.floor(p * STEPS).astype(np.int64)), batch.column("y"), batch.column("n")], ["kind", "step", "y", "n"])

    steps = rows.select("kind", "y", "n", "code").mapInArrow(run, "kind string, step long, y int, n long").groupBy("kind", "step")
    found, out = steps.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("hits")).collect(), {}
    for kind in KINDS:
        hits = every = 0
        for r in sorted((r for r in found if r.kind == kind), key=lambda r: -r.step):
            hits, every = hits + r.hits, every + r.n
            if hits >= PRECISION * every and hits >= 10:
                out[kind] = max(r.step / STEPS, 0.5)
    return out


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def found(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans): one row per row of `docs`; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [model.spans(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s.kind == k for s in base) for base, _ in both], pa.int64()) for k in KINDS]
            texts = [pa.array([join_spans(b[i]) for b in both], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *texts], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(text: str | None, model: Model) -> str | None:
    """`text` with every span, or run of overlapping spans, replaced by the kind of its first, as in [EMAIL]."""
    if not text:
        return text
    out, at = [], 0
    for s in sorted(model.spans(text)[1], key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with all columns, the texts redacted; n_chars, if there, counts anew.  Nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = pa.array([redact(t, model) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            columns = list(batch.columns)
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out
