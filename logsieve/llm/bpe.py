"""BPE encoding and decoding with a transducer of frequent words.

1. Count the words of all documents (counted per task, then summed).
2. Compile the LEXICON_WORDS most frequent into a minimal acyclic transducer over their UTF-8
   bytes: equal suffixes share states, and every arc outputs the number of words that sort
   before its branch, so that the outputs along a word add up to its number, which points
   at its ids.
3. Every executor fetches the transducer once and maps it into memory; tasks run all new
   words of a chunk through it in step, and merge exactly those that it does not hold.

Decoding joins the ids' vocabulary strings with single spaces, as the tokenizer does, which
has no decoder.

Defined results: null or empty text has no ids and decodes to the empty string; a text with
characters outside word_bpe.SAFE, or with a special token's text, is encoded by the tokenizer
whole; repeated rows are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import lookup, word_bpe
from logsieve.llm.common import chunks, cut, map_batches, table
from logsieve.llm.lookup import KeyTable, byte_matrix

#: Words in the transducer, and the longest of them in bytes: bounds of the shared file.
LEXICON_WORDS = 50_000
LEXICON_BYTES = 64


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents; `docs` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = word_bpe.Words()
        words: Counter[str] = Counter()

        def emit():
            fit = [(w, n) for w, n in words.items() if len(w) <= LEXICON_BYTES]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in fit], pa.string()),
                                               pa.array([n for _, n in fit], pa.int64())], ["word", "n"])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, word_bpe.CHUNK_CHARS):
                safe = [t.lower() for t in texts[a:b] if word_bpe.is_safe(t)]
                if not safe:
                    continue
                starts, ends = finder.find(safe)
                # a collision of hashes would only shift a count, never an id
                _, at, n = np.unique(finder.spans.hashes(starts, ends), return_index=True, return_counts=True)
                joined = finder.spans.joined
                for x, y, count in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                    words[joined[x:y]] += count
                if len(words) > word_bpe.MAX_WORDS:
                    yield emit()
        if words:
            yield emit()

    return map_batches(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Transducer:
    """A minimal acyclic transducer; arrays only, so that it can be shared and mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arcs = KeyTable({p: arrays[f"arc_{p}"] for p in KeyTable.PARTS})
        self.target, self.output, self.final = arrays["target"], arrays["output"], arrays["final"]
        self.ids, self.starts = arrays["ids"], arrays["starts"]

    def lookup(self, words: list[str]) -> list[bytes | None]:
        """Ids of the words that it holds, None for the others."""
        data = [w.encode() for w in words]
        out: list[bytes | None] = [None] * len(words)
        lens = np.fromiter(map(len, data), np.int64, len(data))
        for low, width in ((0, 8), (8, 16), (16, 32), (32, LEXICON_BYTES)):
            at = np.flatnonzero((lens > low) & (lens <= width))
            if len(at):
                number = self._numbers(byte_matrix([data[i] for i in at], width), lens[at])
                held = number >= 0
                first, last = self.starts[number[held]], self.starts[number[held] + 1]
                flat = np.ascontiguousarray(self.ids).view(np.uint8).data
                for i, a, b in zip(at[held].tolist(), first.tolist(), last.tolist(), strict=True):
                    out[i] = bytes(flat[4 * a:4 * b])
        return out

    def _numbers(self, letters: np.ndarray, lens: np.ndarray) -> np.ndarray:
        state, number = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        alive = np.arange(len(lens))
        for column in range(letters.shape[1]):
            alive = alive[lens[alive] > column]
            if not len(alive):
                break
            arc = self.arcs.find((state[alive] << 8) | letters[alive, column])
            state[alive[arc < 0]] = -1
            alive, arc = alive[arc >= 0], arc[arc >= 0]
            state[alive] = self.target[arc]
            number[alive] += self.output[arc]
        return np.where((state >= 0) & self.final[state], number, -1)


def compile_transducer(words: list[bytes], ids: list[bytes]) -> dict[str, np.ndarray]:
    """`words` sorted and distinct.  States are built along the sorted words; when a branch is
    finished, its states are replaced from the end by equal ones that are there already."""
    arcs: list[dict[int, int]] = [{}]        # state -> byte -> state
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]                                # states of the last word

    def settle(depth: int, last: bytes) -> None:
        for i in range(len(path) - 1, depth, -1):
            state = path[i]
            form = (final[state], tuple(arcs[state].items()))
            arcs[path[i - 1]][last[i - 1]] = known.setdefault(form, state)
        del path[depth + 1:]

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common, last)
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)

    kept = {0: 0}                             # reachable states, renumbered
    order = [0]
    for state in order:
        for t in arcs[state].values():
            if t not in kept:
                kept[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}                # words that end at or below a state
    stack = [0]
    while stack:
        state = stack[-1]
        waiting = [t for t in arcs[state].values() if t not in below]
        if waiting:
            stack += waiting
        else:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            stack.pop()
    keys, target, output = [], [], []
    for state in order:
        before = int(final[state])
        for byte, t in sorted(arcs[state].items()):
            keys.append(kept[state] << 8 | byte)
            target.append(kept[t])
            output.append(before)
            before += below[t]
    tables = KeyTable.build(np.array(keys, np.int64), np.arange(len(keys))).parts
    return {f"arc_{k}": v for k, v in tables.items()} | {
        "target": np.array(target, np.int64), "output": np.array(output, np.int64),
        "final": np.array([final[s] for s in order], bool),
        "ids": np.frombuffer(b"".join(ids), np.uint32),
        "starts": np.cumsum([0] + [len(x) // 4 for x in ids])}


def most_frequent(counts: DataFrame, size: int) -> list[str]:
    """At most `size` words of `counts` (word, n), by classes of frequency: an eighth of an
    octave is taken whole or not, so no task sends more than the words taken."""
    level = F.floor(F.log2("n") * 8)
    taken, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        taken += r["count"]
        if taken > size:
            break
        least = r["level"]
    return [] if least is None else [r.word for r in counts.filter(level >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer_path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, `size` at most, and share the file; returns its name."""
    counts = cut(word_counts(docs).filter("n > 1"))
    words = sorted(w.encode() for w in most_frequent(counts, size))
    ids = word_bpe.Merges(tokenizer_path).merge(words)
    return lookup.share_arrays(docs.sparkSession, compile_transducer(words, ids))


def token_strings(tokenizer_path: str) -> dict[int, str]:
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}


class Renderer:
    """Names of ids, each with a space behind it, for whole arrays of ids: rows of a byte matrix, of which the
    used bytes are taken in order.  Names longer than WIDTH bytes are rare and are put in one by one."""

    WIDTH = 24

    def __init__(self, names: dict[int, str]):
        data = [(names.get(i, "") + " ").encode() for i in range(max(names, default=0) + 1)]
        self.sizes = np.array([len(x) for x in data])
        self.long = {i: x for i, x in enumerate(data) if len(x) > self.WIDTH}
        self.rows = byte_matrix([x if len(x) <= self.WIDTH else b"" for x in data], self.WIDTH)
        self.used = np.arange(self.WIDTH) < self.sizes[:, None]

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
        """The names of ids[bounds[k]:bounds[k + 1]] joined by spaces, for each k."""
        step = 500_000
        size = self.sizes[ids]
        ends = np.append(0, np.cumsum(size))
        if self.long and np.isin(ids, list(self.long)).any():
            short = b"".join([self.long.get(i) or self.rows[i, :self.sizes[i]].tobytes() for i in ids.tolist()])
        else:
            parts = [self.rows[x][self.used[x]].tobytes() for k in range(0, len(ids), step) for x in (ids[k:k + step],)]
            short = b"".join(parts)
        view = memoryview(short)
        for a, b in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True):
            yield view[a:max(a, b - 1)]


def encode(docs: DataFrame, tokenizer_path: str, digests: bool = False, id_col: str = "doc_id",
           text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every document; with `digests`, doc_id,
    n_tokens, ids_sha256, decoded_sha256 instead."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    name = build_lexicon(slim, tokenizer_path, lexicon_words)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(lookup.mapped_arrays(name))
        ids_of = word_bpe.WordIds(tokenizer_path, transducer.lookup)
        strings = token_strings(tokenizer_path)
        decimal, decoded = Renderer({i: str(i) for i in strings}), Renderer(strings)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, word_bpe.CHUNK_CHARS):
                ids, bounds = ids_of.arrays(texts[a:b])
                if digests:
                    out = [pa.array(np.diff(bounds), pa.int64()), pa.array(map(sha, decimal.texts(ids, bounds)), pa.string()),
                           pa.array(map(sha, decoded.texts(ids, bounds)), pa.string())]
                    labels = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    out = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                           pa.array([bytes(x).decode() for x in decoded.texts(ids, bounds)], pa.string())]
                    labels = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], ["doc_id", *labels])

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_batches(slim, run, f"doc_id {kind}, {rest}")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
