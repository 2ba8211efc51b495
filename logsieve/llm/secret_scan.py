"""Secret scans.

Base kinds are fixed patterns (ASSIGN, ACCESS, HEX).  Beside them, two character Markov models
judge what the base spans leave of every unbroken run of SHORTEST key characters or more: one
of random strings, one of ordinary identifiers.  A run is cut into its parts (letters and
digits between other key characters).  The parts' log-likelihood ratios, less a margin for each
character, decide which stretches of whole parts the random model explains better: the
maximal scoring segments, so neither a path before a key nor a name after it is averaged
with it.  Segments of SHORTEST characters or more are spans; no letter class is asked for.

Both models are trained on labelled samples from the corpus: values that the base patterns
found count as random strings, words, names joined from neighbouring words and numbers as ordinary identifiers.  The sample is
bounded by documented parameters (SAMPLE_DOCS documents of smallest hash, SAMPLE_RUNS
strings of each label); the values are cut into pieces so that both labels have like lengths.
The threshold MARGIN is in natural logarithms per character; a segment of less than FULL
characters needs as much in all as one of FULL, so the margin grows for short ones.  Seeded
random strings over the usual key alphabets smooth the first model, so that it also knows
letters that the corpus' own secrets lack; repeated letters and alphabets in order (fillers)
smooth the second.

Spans are in code points, end exclusive.  A method's span never overlaps a base span.

Defined results: null text counts as empty and has no spans; repeated rows are scanned each; an
empty table gives no rows (and an empty training sample leaves the smoothing alone);
other columns are not read, `redact` carries them along.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.ship import ship_by_value
from logsieve.llm.common import map_batches, table

#: Fixed patterns of the contract, with the least length of what they find.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "markov"]

#: What the models judge: runs of key characters of at least this length, in these parts.
SHORTEST, FULL = 12, 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
PART = re.compile(r"[A-Za-z0-9]+")
JOINING = "+/_=-"
#: Characters between parts that a span takes in at either end of its run, at most.
EDGE = 2
#: Characters of a sample string, at most.
PIECE = 64
#: Strings with a digit and a letter, for choosing samples; the scan asks for neither.
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")

SAMPLE_DOCS = 2_000
SAMPLE_RUNS = 20_000
SMOOTHING_STRINGS = 400
MARGIN = 0.4

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LETTERS + LETTERS.upper() + "0123456789+/_=-"
CODE = {c: i for i, c in enumerate(ALPHABET)}
REPLACEMENT = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    low = text.lower()
    found = []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(*m.span(2), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += hex_spans(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Runs of that length or more; a run is whole, as the class is greedy on both sides.
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])


def hex_spans(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]


class MarkovModel:
    """First-order character model with add-one smoothing: ln p(next | letter)."""

    def __init__(self, strings: list[str]):
        n = len(ALPHABET)
        counts = np.ones((n + 1, n))           # row n: the first letter
        for s in strings:
            codes = [CODE[c] for c in s if c in CODE]
            if codes:
                np.add.at(counts, ([n] + codes[:-1], codes), 1)
        self.table = np.log(counts / counts.sum(axis=1, keepdims=True)).tolist()


def random_strings(n: int, seed: int = 7) -> list[str]:
    draw = random.Random(seed)
    kinds = ["0123456789abcdef", LETTERS + LETTERS.upper() + "0123456789", LETTERS.upper() + "0123456789", ALPHABET]
    return ["".join(draw.choice(kinds[i % 4]) for _ in range(24)) for i in range(n)]


#: Runs of key characters without a letter.
NUMBER = re.compile(r"(?<![A-Za-z0-9+/_=-])[0-9][0-9+/_=-]++(?![A-Za-z])")


def fillers() -> list[str]:
    return [c * 24 for c in ALPHABET] + [LETTERS, LETTERS.upper(), "0123456789"] * 8


def identifiers(text: str) -> set[str]:
    """Ordinary identifiers: a text's words and numbers, and names joined from neighbouring
    words as programs and file names do."""
    words = re.findall(r"[A-Za-z]{2,}", text)
    out = set(words) | set(NUMBER.findall(text))
    for i in range(0, len(words) - 2, 3):
        a, b, c = (w.lower() for w in words[i:i + 3])
        out.add((f"{a}_{b}_{c}", f"{a}{b.title()}{c.title()}", f"{a}-{b}-{c}", f"{a.upper()}_{b.upper()}_{c.upper()}",
                 f"{a}/{b}/{c}", f"{a}_{b}{i}", f"{a}{b.title()}{i}", f"{a}-{b}-{1900 + i % 200}")[i // 3 % 8])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
          sample_runs: int = SAMPLE_RUNS) -> tuple[MarkovModel, MarkovModel]:
    """Models of random strings and of ordinary identifiers."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = slim.select("doc_id", F.xxhash64("doc_id", F.length("text")).alias("h"))
    last = keyed.orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = slim.filter(F.xxhash64("doc_id", F.length("text")) <= F.lit(0 if last is None else last)).limit(sample_docs)
    ship_by_value(__name__)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                # in pieces, so that a sample of bounded number is bounded in size too
                rows |= {(text[i:min(i + PIECE, b)], True) for a, b, _ in spans for i in range(a, b, PIECE)}
                rows |= {(w[i:i + PIECE], False) for w in identifiers(text or "") for i in range(0, len(w), PIECE)}
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()),
                                              pa.array([x for _, x in rows], pa.bool_())], ["s", "random"])

    labelled = map_batches(sample, label, "s string, random boolean").distinct()
    both = [[r.s for r in labelled.filter(F.col("random") == kind).orderBy(F.xxhash64("s"), "s").limit(sample_runs)
             .collect()] for kind in (True, False)]
    return MarkovModel(both[0] + random_strings(SMOOTHING_STRINGS)), MarkovModel(both[1] + fillers())


def segments(run: str, models, margin: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of the maximal scoring segments of whole parts, in order.  A
    segment takes in a part of negative score only where both sides outweigh it."""
    noise, names = (m.table for m in models)
    total, before, done = 0.0, len(ALPHABET), 0
    # start, end, total before and after, and the last segment that began at a lower total
    found: list[tuple[int, int, float, float, int]] = []

    def score(a: int, b: int) -> float:
        nonlocal before
        out = -margin * (b - a)
        for c in run[a:b]:
            k = CODE[c]
            out += noise[before][k] - names[before][k]
            before = k
        return out

    for m in PART.finditer(run):
        start, end = m.span()
        if done:
            total += min(0.0, score(done, start))
        low, total, done = total, total + score(start, end), end
        if total <= low:
            continue
        while True:
            i = len(found) - 1
            while i >= 0 and found[i][2] >= low:
                i = found[i][4]
            if i < 0 or found[i][3] >= total:
                break
            start, low = found[i][0], found[i][2]
            del found[i:]
        found.append((start, end, low, total, i))
    return [(a, b, y - x) for a, b, x, y, _ in found]


def left_over(start: int, end: int, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What spans, ordered by start, leave of a range."""
    for a, b, _ in taken:
        if b > start and a < end:
            if a > start:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def markov_spans(text: str, taken: list[tuple[int, int, str]], models, margin: float) -> list[tuple[int, int, str]]:
    out = []
    for m in RUN.finditer(text):
        for at, end in left_over(*m.span(), taken):
            run = text[at:end]
            if len(run) < SHORTEST:
                continue
            edges = len(run) - len(run.lstrip(JOINING)), len(run.rstrip(JOINING))
            for a, b, score in segments(run, models, margin):
                # a key may begin or end with such a character, or have padding
                first = max(0, a - EDGE) if a == edges[0] else a
                last = min(len(run), b + EDGE) if b == edges[1] else b
                if last - first >= SHORTEST and score >= margin * (FULL - min(FULL, b - a)):
                    out.append((at + first, at + last, "markov"))
    return out


def all_spans(text: str, models, margin: float) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + markov_spans(text, base, models, margin), key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, models=None, margin: float = MARGIN, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every document, base spans first by
    start, with `base` telling the fixed patterns' spans from the method's."""
    models = models or train(docs, id_col, text_col)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ship_by_value(__name__)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            spans = [all_spans(t or "", models, margin)[1] for t in batch.column(1).to_pylist()]
            rows = [[{"kind": k, "start": a, "stop": b} for a, b, k in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, one)], ["doc_id", "spans"])

    return map_batches(slim, run, f"doc_id {kind}, spans array<struct<kind:string,start:int,stop:int>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != "markov")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"),
                          F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, models=None, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text",
           length_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by REPLACEMENT; touching spans become one.
    `length_col`, if there is one, is set anew where the text changed."""
    models = models or train(docs, id_col, text_col)
    columns, ships = docs.columns, docs.schema
    at = columns.index(text_col)
    ship_by_value(__name__)

    def clean(text: str) -> str:
        out, done = [], 0
        for a, b, _ in all_spans(text, models, margin)[1]:
            if a >= done and (not out or a > done):
                out += [text[done:a], REPLACEMENT]
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t and clean(t) for t in texts]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, pa.string())
            i = columns.index(length_col) if length_col in columns else at
            if pa.types.is_integer(batch.schema.field(i).type):
                old = batch.column(i).to_pylist()
                arrays[i] = pa.array([o if t == u else len(u) for o, t, u in zip(old, texts, new, strict=True)],
                                     batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, ships)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
