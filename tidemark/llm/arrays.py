"""Vectorised text primitives used inside tasks: packed texts, word spans, rolling hashes, minimisers.

Texts are handled as one byte buffer with offsets, in slices of bounded size, so that no step keeps
Python objects per word. Hashes are polynomial over seeded random letters and mixed afterwards;
wherever equality decides a result, two independent 64-bit hashes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}
_letters: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of an odd base modulo 2**64, or of its inverse."""
    table = _powers.get((seed, inverse))
    if table is None or len(table) < n:
        base = _BASES[seed]
        if inverse:
            base = pow(base, -1, 1 << 64)
        table = np.ones(1 << max(n, 1 << 14).bit_length(), np.uint64)
        table[1:] = base
        table = np.multiply.accumulate(table)
        _powers[(seed, inverse)] = table
    return table[:n]


def letters(seed: int) -> np.ndarray:
    """A random 64-bit value per byte value."""
    if seed not in _letters:
        _letters[seed] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[seed]))
    return _letters[seed]


def prefix(values: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums of ``values[j] * base**j``, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(seed, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each span; equal spans hash alike wherever they stand."""
    shift = _power(seed, len(sums), inverse=True)
    return mix((sums[ends] - sums[starts]) * shift[starts])


def gram_hash(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` values."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    sums = prefix(values, seed)
    n = len(values) - width + 1
    return mix((sums[width:] - sums[:n]) * _power(seed, n, inverse=True))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class Texts:
    """Some texts as one byte buffer: text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray) -> None:
        self.first, self.data, self.bounds = first, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs without ASCII white space, and the first word of each text
        (one entry more than there are texts)."""
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[self.data], out=inside[1:-1])
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cuts = self.bounds[1:-1]
        joined = cuts[inside[cuts] & inside[cuts + 1]] if n else cuts[:0]
        begins[joined] = True
        ends[joined] = True
        starts = np.flatnonzero(begins[:n])
        stops = np.flatnonzero(ends)
        return starts, stops, np.searchsorted(starts, self.bounds)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut an Arrow string column into byte slices of about ``limit``; a longer text is one slice.
    A null text counts as an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32) if len(texts) else np.zeros(1)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def window_owner(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of ``counts`` items laid end to end: the start item of every window of ``width``
    items that stays inside one text, and the text it is in."""
    have = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), have)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    skipped = np.concatenate(([0], np.cumsum(have)[:-1])) if len(counts) else counts
    return np.arange(len(owner)) - np.repeat(skipped - first, have), owner


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` items are inside a window of ``width`` at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gap: int = 0, fill: int = 32) -> np.ndarray:
    """The bytes of the given spans end to end, each followed by ``gap`` bytes of ``fill``.

    Index arrays are eight times the bytes, so they are formed for a slice of spans at a time; a span
    longer than a slice is copied as it is."""
    sizes = lengths + gap
    ends = np.cumsum(sizes)
    if not len(sizes) or not ends[-1]:
        return np.zeros(0, np.uint8)
    out = np.full(ends[-1], fill, np.uint8)
    lo = 0
    while lo < len(sizes):
        begin = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + (SLICE_BYTES >> 1), side="right")))
        if hi == lo + 1:
            out[begin : begin + lengths[lo]] = data[starts[lo] : starts[lo] + lengths[lo]]
        elif len(data):
            index = np.arange(begin, ends[hi - 1]) + np.repeat(starts[lo:hi] - (ends[lo:hi] - sizes[lo:hi]), sizes[lo:hi])
            out[begin : ends[hi - 1]] = data[np.minimum(index, len(data) - 1)]
        lo = hi
    for k in range(gap):
        out[ends - 1 - k] = fill
    return out


def joined_words(texts: Texts, keep: np.ndarray | None = None) -> list[bytes]:
    """Per text its (kept) words joined by one space."""
    starts, ends, first = texts.words()
    if keep is not None:
        first = np.concatenate(([0], np.cumsum(keep)))[first]
        starts, ends = starts[keep], ends[keep]
    out = gather(texts.data, starts, ends - starts, gap=1).tobytes()
    to = np.concatenate(([0], np.cumsum(ends - starts + 1)))[first].tolist()
    return [out[a : max(a, b - 1)] for a, b in zip(to, to[1:])]
