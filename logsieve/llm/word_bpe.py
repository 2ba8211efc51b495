"""Exact ids of a word-level BPE tokenizer, word by word.

The tokenizer normalises (NFC, white space, lower case), splits into words by a pattern and
merges each word's bytes by itself, so a text's ids are its words' ids in a row.  For texts
made of the characters in SAFE the splitting is done here (tested character by character
against the tokenizer); any other text, and any text that might hold a special token,
goes to the tokenizer whole.

New words are merged in NumPy, many words at a time: every step merges, in each word, the
leftmost pair of the lowest rank, which is what the tokenizer's merge loop does."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import cached_property

import numpy as np

from logsieve.llm.lookup import KeyTable, byte_matrix
from logsieve.llm.spans import Spans

#: Characters on which this splitting and the tokenizer's agree.
SAFE = "\t\n\r\x20-\x7e\xa0-\xac\xae-įı-ňŊ-ǃ‐-‧‰-⁞€"
UNSAFE = re.compile(f"[^{SAFE}]|<\\|")
SAFE_BYTES = bytes(c for c in range(256) if re.match(f"[{SAFE}]", chr(c)))
#: Numbers that are no decimal digits, among the safe characters.
OTHER_NUMBERS = "\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(rf"[^\W\d_{OTHER_NUMBERS}]+|'(?:[stmd]|re|ve|ll)|[\d{OTHER_NUMBERS}]|(?:[^\s\w]|_)+")

#: Words kept in a task's memory, and their ids; beyond that the store starts anew.
MAX_WORDS, MAX_IDS = 600_000, 10_000_000
#: Text encoded at once: merging many new words at a time costs less for each, but an executor's tasks hold the arrays
#: of their chunks (some 100 bytes a character) at the same time.
CHUNK_CHARS = 1_000_000
#: Cells of the matrices in which words are merged.
CELLS = 250_000
#: Words of more bytes are merged one by one, with a heap.
MATRIX_BYTES = 256

NO_RANK = np.int32(2**31 - 1)


def is_safe(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, SAFE_BYTES) and "<|" not in text
    except UnicodeEncodeError:
        return not UNSAFE.search(text)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself
    where it is visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Merges:
    """The merge table of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right = left, right
        self.table = KeyTable.build((left << 32) | right, np.arange(len(pairs)))

    @cached_property
    def rank(self) -> dict[tuple[int, int], int]:
        """Ranks by pair, for the words that are merged one by one."""
        return {p: i for i, p in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; negative ids (padding) have none."""
        found = self.table.find((left.astype(np.int64) << 32) | right.astype(np.int64)).astype(np.int32)
        return np.where(found < 0, NO_RANK, found)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each (non-empty) word, as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (4, 8, 12, 16, 24, 32, 64, 128, MATRIX_BYTES):
            at = np.flatnonzero((lens > low) & (lens <= width))
            low = width
            step = max(1, CELLS // width)
            for i in range(0, len(at), step):
                part = at[i:i + step]
                self._merge_matrix([words[j] for j in part], lens[part], width, part, out)
        for j in np.flatnonzero(lens > MATRIX_BYTES):
            out[j] = self._merge_long(words[j])
        return out

    def _merge_matrix(self, words, lens, width, place, out) -> None:
        n = len(words)
        data = byte_matrix(words, width)
        column = np.arange(width)
        ids = self.inner[data]
        ids[np.arange(n), lens - 1] = self.last[data[np.arange(n), lens - 1]]
        ids[column >= lens[:, None]] = -1
        ranks = np.full((n, width), NO_RANK, np.int32)
        if width > 1:
            ranks[:, :-1] = self.ranks_of(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        while n:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(n), at]
            done = best == NO_RANK
            if done.any():
                self._put(ids[done], place[rows[done]], out)
                keep = ~done
                ids, ranks, rows, at, best = ids[keep], ranks[keep], rows[keep], at[keep], best[keep]
                n = len(rows)
                if not n:
                    return
            r = np.arange(n)
            ids[r, at] = self.made[best]
            after = column[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            here = ids[r, at]
            following = np.where(at + 1 < width, ids[r, np.minimum(at + 1, width - 1)], -1)
            ranks[r, at] = self.ranks_of(here, following)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.ranks_of(ids[before, at[before] - 1], here[before])

    @staticmethod
    def _put(ids: np.ndarray, place: np.ndarray, out: list[bytes]) -> None:
        lens = (ids >= 0).sum(axis=1)
        flat = ids[ids >= 0].astype("<u4").tobytes()
        ends = np.cumsum(lens) * 4
        start = 0
        for j, end in zip(place.tolist(), ends.tolist(), strict=True):
            out[j] = flat[start:end]
            start = end

    def _merge_long(self, word: bytes) -> bytes:
        """One long word: a heap of pairs over a linked list."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.rank, self.made
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = following[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(made[k]), -1
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
            for x, y in ((before[i], i), (i, following[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in rank:
                    heapq.heappush(heap, (rank[p], x, *p))
        return array("I", [x for x in ids if x >= 0]).tobytes()


def kind_of(c: str) -> int:
    """0 white space, 1 letters, 2 numbers (a word each), 3 the rest: the classes of WORDS."""
    if c.isspace():
        return 0
    if WORDS.fullmatch(c) and not c.isalnum():
        return 3
    return 1 if re.fullmatch(rf"[^\W\d_{OTHER_NUMBERS}]", c) else 2 if c.isalnum() else 3


class Words:
    """The words of safe, lower-cased texts: the matches of WORDS, found for all texts at once."""

    def __init__(self):
        self.spans = Spans(kind_of, single=2)
        self.tails = [np.array([ord(c) for c in x], np.uint32) for x in ("s", "t", "m", "d", "re", "ve", "ll")]

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, kinds = self.spans.find(texts)
        points = self.spans.points
        # an apostrophe alone takes s, t, m, d, re, ve or ll from the letters behind it
        at = np.flatnonzero((kinds[:-1] == 3) & (ends[:-1] - starts[:-1] == 1) & (kinds[1:] == 1) & (starts[1:] == ends[:-1]))
        at = at[points[starts[at]] == ord("'")]
        if len(at):
            after, room = starts[at + 1], ends[at + 1] - starts[at + 1]
            taken = np.zeros(len(at), np.int64)
            for tail in self.tails:
                hit = (taken == 0) & (room >= len(tail))
                for k, c in enumerate(tail):
                    hit[hit] = points[after[hit] + k] == c
                taken[hit] = len(tail)
            ends[at] += taken
            starts[at + 1] += taken
            left = starts < ends
            starts, ends = starts[left], ends[left]
        return starts, ends


class WordIds:
    """Ids of texts.  The words of a chunk are looked up by 128-bit hashes, all at once; only a word that is new becomes a
    string and is merged."""

    def __init__(self, path: str, lookup=None):
        self.path = path
        self.merges = Merges(path)
        #: words -> ids or None, asked before merging
        self.lookup = lookup
        self.words = Words()
        self.forget()

    @cached_property
    def tokenizer(self):
        """The library's, loaded by the first text that goes to it whole."""
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)           # first hashes of the words, sorted
        self.place = np.zeros(0, np.int64)            # each one's place in the arrays below
        self.check = np.zeros(0, np.uint64)           # second hash
        self.first = np.zeros(0, np.int64)            # where its ids are in `flat`
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words: from the lexicon, else merged."""
        out = list(self.lookup(words)) if self.lookup is not None else [None] * len(words)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.merges.merge([words[i].encode() for i in rest]), strict=True):
            out[i] = x
        return out

    def arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the last one ends)."""
        if len(self.known) > MAX_WORDS or len(self.flat) > MAX_IDS:
            self.forget()
        safe = np.array([is_safe(t) for t in texts], bool)
        ids, bounds = self._safe([t.lower() for t, s in zip(texts, safe.tolist(), strict=True) if s]) if safe.any() else (self.flat[:0], np.zeros(1, np.int64))
        if safe.all():
            return ids, bounds
        parts, k = [], 0
        for t, s in zip(texts, safe.tolist(), strict=True):
            parts.append(ids[bounds[k]:bounds[k + 1]] if s else self.whole(t))
            k += s
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def _safe(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self.words.find(texts)
        spans = self.words.spans
        first, second = spans.hashes(starts, ends), spans.hashes(starts, ends, 1)
        kinds, at, back = np.unique(first, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, kinds)
        number = np.full(len(kinds), -1, np.int64)
        seen = np.flatnonzero(slot < len(self.known))
        seen = seen[self.known[slot[seen]] == kinds[seen]]
        number[seen] = self.place[slot[seen]]
        new = np.flatnonzero(number < 0)
        if len(new):
            joined = spans.joined
            found = self.learn([joined[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            size = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
            number[new] = np.arange(len(self.first), len(self.first) + len(new))
            self.known, self.place = np.insert(self.known, slot[new], kinds[new]), np.insert(self.place, slot[new], number[new])
            self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
            self.size, self.check = np.append(self.size, size), np.append(self.check, second[at[new]])
            self.flat = np.append(self.flat, np.frombuffer(b"".join(found), np.int32))
        word = number[back]
        if (self.check[word] != second).any():
            raise RuntimeError("two words with one hash")        # 2**-64 for a pair; the second hash tells
        size = self.size[word]
        ends_of = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[word] - (ends_of - size), size) + np.arange(ends_of[-1] if len(size) else 0)]
        return ids, np.append(0, ends_of)[spans.text_bounds(starts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        ids, bounds = self.arrays(texts)
        data = ids.astype("<u4").tobytes()
        return [data[4 * a:4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
