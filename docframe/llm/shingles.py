"""Word and shingle hashes of whole texts, computed in numpy on Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; a longer text is hashed alone.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(6364136223846793005)
_STEP_INVERSE = np.uint64(pow(6364136223846793005, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _bytes_table(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * _ODD)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK)
        up, down = np.full(size, _STEP), np.full(size, _STEP_INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * BLOCK:
            return up, down
        _powers["up"], _powers["down"] = up, down
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: the bytes of some texts end to end, bounds: where each begins, and the end. Returns the 64-bit hash of each
    word, where each text's words begin (one more than texts), and the byte at which each word begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[bounds[bounds < n]] = True
    after[bounds[bounds > 0] - 1] = True
    first, last = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
    up, down = _powers_to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes_table(lower)[data] * up[:n], out=total[1:])
    hashes = mix((total[last + 1] - total[first]) * down[first] + (last - first + 1).astype(np.uint64) * _ODD)
    return hashes, np.searchsorted(first, bounds), first


def run_sums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each run of bytes."""
    up, down = _powers_to(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes_table(False)[data] * up[: len(data)], out=total[1:])
    return mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64) * _ODD)


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow string array into blocks of whole texts: the index of the first, the bytes, the bounds."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def text_words(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The different words of each text, by `bits` bits of their hashes: the text's index, rising, the word, how often
    it is there."""
    for at, data, bounds in blocks(texts):
        hashes, starts, _ = word_hashes(data, bounds)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(starts))
        found, times = np.unique(owner << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        yield at + (found >> bits), found & ((1 << bits) - 1), times


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; runs across texts are there too."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += mix(hashes[j : j + n] + np.uint64((j + 1) * int(_ODD) % (1 << 64)))
    return mix(out)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, at a cost that doesn't grow with n."""
    size = len(hashes)
    if size < n:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(size)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes * up[:size], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: size - n + 1])


def word_ends(data: np.ndarray) -> np.ndarray:
    """The byte after each word of one text."""
    space = _SPACE[data]
    return np.flatnonzero(~space & np.append(space[1:], True)) + 1 if len(data) else np.zeros(0, np.int64)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct hashes of the k-word shingles) of each text: with fewer words, its whole sequence as one;
    without words, empty. Hashes have 63 bits."""
    for at, data, bounds in blocks(texts):
        hashes, starts, _ = word_hashes(data, bounds)
        runs = window_hashes(hashes, k) >> np.uint64(1)
        for i in range(len(bounds) - 1):
            a, b = starts[i], starts[i + 1]
            if b - a >= k:
                yield at + i, np.unique(runs[a : b - k + 1])
            elif b > a:
                own = hashes[a:b]
                whole = sum(int(x) * (j + 3) for j, x in enumerate(mix(own + np.uint64(b - a)))) % (1 << 63)
                yield at + i, np.array([whole], np.uint64)
            else:
                yield at + i, np.zeros(0, np.uint64)
