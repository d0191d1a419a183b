"""Pre-tokens of whole slices of texts, found with array operations on code points.

Both public byte-pair tokenizers split a text before merging: into letters, digits, other signs and
white space, with common English contractions kept together. Runs of one character class are found
for all texts of a slice at once; a few index corrections then give the exact splits.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from tidemark.llm.arrays import Texts, mix, prefix, span_hash

SPACE, LETTER, DIGIT, OTHER = range(4)


@cache
def classes() -> np.ndarray:
    """Character class of every code point."""
    kind = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


@cache
def lower() -> np.ndarray:
    """Lower case of every code point that has a single one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1:
                out[c] = ord(low)
    return out


class Points:
    """Code points of a slice of texts, text ``i`` at ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, points: np.ndarray, bounds: np.ndarray) -> None:
        self.points, self.bounds = points, bounds

    @classmethod
    def of(cls, texts: Texts) -> Points:
        points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(texts.data):
            return cls(points, texts.bounds)
        before = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
        return cls(points, before[texts.bounds])

    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        kind = classes()[self.points]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[self.bounds[:-1][self.bounds[:-1] < len(kind)]] = True
        return kind, new

    def _contractions(self, new: np.ndarray, begin: np.ndarray, kind: np.ndarray) -> None:
        """Join an apostrophe that begins a token and stands alone with s, t, m, d, re, ve or ll."""
        p, n = self.points, len(self.points)
        at = np.flatnonzero((p == 0x27) & begin)
        at = at[at + 1 < n]
        at = at[new[at + 1] & (kind[at + 1] == LETTER) & ~self._first()[at + 1]]
        one = np.isin(p[at + 1], [ord(c) for c in "stmd"])
        pair = at[~one & (at + 2 < n)]
        pair = pair[~new[pair + 2]]
        ends = np.zeros(len(pair), bool)
        for x, y in ("re", "ve", "ll"):
            ends |= (p[pair + 1] == ord(x)) & (p[pair + 2] == ord(y))
        for heads, size in ((at[one], 2), (pair[ends], 3)):
            begin[heads + 1] = False
            rest = heads + size
            rest = rest[rest < n]
            begin[rest] |= (kind[rest] == LETTER) & ~new[rest]

    def _first(self) -> np.ndarray:
        first = np.zeros(len(self.points) + 1, bool)
        first[self.bounds[:-1]] = True
        return first

    def spaced_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the splits that keep white space: one space goes with what follows."""
        kind, new = self._runs()
        begin = new.copy()
        to = np.flatnonzero(new & (kind != SPACE))
        to = to[(to > 0) & ~self._first()[to]]
        to = to[kind[to - 1] == SPACE]
        begin[to - 1] = True
        begin[to[self.points[to - 1] == 0x20]] = False
        self._contractions(new, begin, kind)
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(kind))

    def bare_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the splits that drop white space; each digit stands alone."""
        kind, new = self._runs()
        begin = new | (kind == DIGIT)
        self._contractions(new, begin, kind)
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(kind))
        keep = kind[starts] != SPACE
        return starts[keep], ends[keep]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for every span."""
        one = mix(self.points.astype(np.uint64) + np.uint64(0x1234567))
        two = mix(one ^ np.uint64(0x2545F4914F6CDD1D))
        return (
            span_hash(prefix(one, 0), starts, ends, 0),
            (span_hash(prefix(two, 1), starts, ends, 1) >> np.uint64(32)).astype(np.uint32),
        )

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        text = self.points.tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def with_specials(texts: Texts, specials: tuple[bytes, ...]) -> np.ndarray:
    """Texts that hold one of the special strings; they are left to the library."""
    data = texts.data.tobytes()
    found = set()
    for special in specials:
        at = data.find(special)
        while at >= 0:
            i = int(np.searchsorted(texts.bounds, at, side="right")) - 1
            if at + len(special) <= texts.bounds[i + 1]:
                found.add(i)
            at = data.find(special, at + 1)
    return np.array(sorted(found), np.int64)
