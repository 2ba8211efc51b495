"""Words of many texts at once as arrays: their places and hashes, without an object per word.

The texts become one array of code points.  A table says which belong to a word; runs of those are the words.
A word's hash is a polynomial over its letters modulo 2**64, taken from running sums of letter * base**place by
one subtraction and one product with the inverse power, for all words in step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Odd, so that the powers have inverses modulo 2**64.  Two of them make 128 bits where texts are told apart by hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TABLE = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """`kind` gives a character's class: 0 for none, 1 for a letter of a word, and so on.  A word is a run of one class; with
    `single`, characters of that class are words by themselves."""

    def __init__(self, kind: Callable[[str], int], single: int | None = None):
        self.kind, self.single = kind, single
        self.kinds = np.array([kind(chr(c)) for c in range(TABLE)], np.int8)
        self.value = mixed(np.arange(TABLE, dtype=np.uint64) + np.uint64(1))
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def _powers(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) <= k or len(self.powers[k][0]) < n:
            size = max(n, 1 << 16)
            both = []
            for base in (BASES[k], pow(BASES[k], -1, 2**64)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                both.append(np.cumprod(p))
            self.powers[k:k + 1] = [tuple(both)]
        return self.powers[k]

    def find(self, texts: list[str]):
        """(starts, ends, kinds) of the words in the joined texts; `joined`, `points` and `ends_of` (the end of each text, with its
        separator) stay until the next call."""
        self.joined = "\n".join(texts)
        self.points = points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        low = np.minimum(points, TABLE - 1)
        kinds, self.values = self.kinds[low], self.value[low]
        high = np.flatnonzero(points >= TABLE - 1)
        if len(high):
            found, where = np.unique(points[high], return_inverse=True)
            kinds[high] = np.array([self.kind(chr(c)) for c in found], np.int8)[where]
            self.values[high] = mixed(points[high].astype(np.uint64) + np.uint64(1))
        self.ends_of = np.cumsum([len(t) + 1 for t in texts])
        kinds[self.ends_of[:-1] - 1] = 0
        edge = kinds[1:] != kinds[:-1]
        if self.single is not None:
            edge |= kinds[1:] == self.single
        starts = np.append(0, np.flatnonzero(edge) + 1) if len(kinds) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(kinds))
        of = kinds[starts]
        word = of > 0
        return starts[word], ends[word], of[word]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
        """A 64-bit hash of each of these stretches, by the k-th base."""
        power, inverse = self._powers(len(self.points) + 1, k)
        sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(self.values * power[:len(self.points)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def text_bounds(self, starts: np.ndarray) -> np.ndarray:
        """Of each text its first word's number, and the number of words at the end."""
        return np.append(0, np.searchsorted(starts, self.ends_of, "left"))
