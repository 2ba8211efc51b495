"""Token counts without tokens: a linear longest-match automaton.

Word pieces are taken greedily: the longest initial piece, then again and again the longest
continuation.  The automaton is a trie of both kinds of pieces.  Where a word leaves the trie,
the failure link of the state leads to the continuation-trie state of what remains after
popping the pieces that must end there, and the number of those pieces is stored with the
state.  Each letter is thus read once, and the count is the sum of the stored numbers; no piece
is ever built.  Many words run through the automaton in step.

Words are maximal runs of non-white-space characters, as UTF-8 bytes.  The production
vocabulary comes from a byte-level vocabulary file: strings that begin with the space mark
are initial pieces, strings without it continuations, and every single byte is both, so that
no word is unknown.  With another vocabulary, a word that has no such split counts as one
unknown piece.

Defined results: null, empty or blank text has 0 words and 0 tokens; words have no longest
length; repeated rows are counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.ship import ship_by_value
from logsieve.llm import lookup
from logsieve.llm.common import chunks, map_batches, table
from logsieve.llm.lookup import KeyTable, byte_matrix
from logsieve.llm.word_bpe import byte_characters

MAX_WORDS = 600_000
LONG_WORD = 100
MATRIX_BYTES = 256


def compile_automaton(initial: set[bytes], continuing: set[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the automaton.  State 0 is the initial root, state 1 the continuation root."""
    arcs: list[dict[int, int]] = [{}, {}]
    piece = [False, False]
    for root, pieces in ((0, initial), (1, continuing)):
        for p in sorted(pieces):
            state = root
            for byte in p:
                if byte not in arcs[state]:
                    arcs.append({})
                    piece.append(False)
                    arcs[state][byte] = len(arcs) - 1
                state = arcs[state][byte]
            if p:
                piece[state] = True
    n = len(arcs)
    link, popped = [-1] * n, [0] * n          # link -1: what was read cannot be split
    queue = [0, 1]
    for state in queue:
        for byte, below in arcs[state].items():
            queue.append(below)
            if piece[below]:
                link[below], popped[below] = 1, 1
                continue
            pops, at = popped[state], link[state]
            while at >= 0 and byte not in arcs[at]:
                pops += popped[at]
                at = link[at]
            link[below], popped[below] = (arcs[at][byte], pops) if at >= 0 else (-1, 0)
    closing = [-1] * n                        # pieces popped when the word ends here
    for state in range(2, n):
        pops, at = 0, state
        while at > 1:
            pops += popped[at]
            at = link[at]
        closing[state] = pops if at == 1 else -1
    closing[0] = closing[1] = 0
    keys = [s << 8 | b for s in range(n) for b in arcs[s]]
    target = [t for s in range(n) for t in arcs[s].values()]
    parts = KeyTable.build(np.array(keys, np.int64), np.array(target, np.int64)).parts
    return {f"arc_{k}": v for k, v in parts.items()} | {
        "link": np.array(link, np.int64), "popped": np.array(popped, np.int64), "closing": np.array(closing, np.int64)}


class Automaton:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arcs = KeyTable({p: arrays[f"arc_{p}"] for p in KeyTable.PARTS})
        self.link, self.popped, self.closing = arrays["link"], arrays["popped"], arrays["closing"]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each (non-empty) word."""
        out = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (8, 16, 32, MATRIX_BYTES):
            at = np.flatnonzero((lens > low) & (lens <= width))
            low = width
            for i in range(0, len(at), step := max(1, 4_000_000 // width)):
                part = at[i:i + step]
                out[part] = self._run(byte_matrix([words[j] for j in part], width), lens[part])
        for j in np.flatnonzero(lens > MATRIX_BYTES):
            out[j] = self._run(np.frombuffer(words[j], np.uint8)[None, :], lens[j:j + 1])[0]
        return out

    def _run(self, letters: np.ndarray, lens: np.ndarray) -> np.ndarray:
        state, pops = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        reading = np.arange(len(lens))
        for column in range(letters.shape[1]):
            reading = reading[(lens[reading] > column) & (state[reading] >= 0)]
            if not len(reading):
                break
            stuck = reading
            while len(stuck):
                to = self.arcs.find((state[stuck] << 8) | letters[stuck, column])
                state[stuck[to >= 0]] = to[to >= 0]
                stuck = stuck[to < 0]
                pops[stuck] += self.popped[state[stuck]]
                state[stuck] = self.link[state[stuck]]
                stuck = stuck[state[stuck] >= 0]
        rest = np.where(state >= 0, self.closing[state], -1)
        return np.where(rest >= 0, pops + rest, 1)


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuing pieces of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    chars = byte_characters()
    byte_of = {c: b for b, c in enumerate(chars)}
    space = chars[0x20]
    raw = lambda s: bytes(byte_of[c] for c in s)
    every = {bytes([b]) for b in range(256)}
    usable = [t for t in vocab if all(c in byte_of for c in t)]
    initial = {raw(t[1:]) for t in usable if t[0] == space and len(t) > 1 and space not in t[1:]}
    return initial | every, {raw(t) for t in usable if space not in t} | every


def count_tokens(docs: DataFrame, initial: set[bytes], continuing: set[bytes],
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    name = lookup.share_arrays(docs.sparkSession, compile_automaton(initial, continuing))
    ship_by_value(lookup.__name__, __name__)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lookup.mapped_arrays(name))
        known: dict[str, int] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                if len(known) > MAX_WORDS:
                    known = {}
                cut = [t.split() for t in texts[a:b]]
                new = list(set().union(*cut) - known.keys())
                known.update(zip(new, automaton.count([w.encode() for w in new]).tolist(), strict=True))
                out = [pa.array([len(ws) for ws in cut], pa.int64()),
                       pa.array([sum(map(known.__getitem__, ws)) for ws in cut], pa.int64())]
                for w in new:
                    if len(w) > LONG_WORD:
                        del known[w]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out],
                                                 ["doc_id", "n_words", "n_tokens"])

    return map_batches(slim, run, f"doc_id {kind}, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), *vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
