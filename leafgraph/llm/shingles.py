"""Word-shingle sets and MinHash signatures of whole texts, vectorised over a batch's UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed seed of all hash tables: signatures of different runs can be compared.
_RNG = np.random.default_rng(20_240_601)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at once: longer batches are taken in pieces of whole texts.
PIECE = 1 << 20


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the runs of bytes that aren't ``blank``, by default ``[^\\x20\\x09-\\x0D]+``;
    A-Z count as a-z."""
    start, end = word_spans(raw, blank)
    return span_hashes(raw, start, end), start, end


def word_spans(raw: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the runs of bytes that aren't ``blank``."""
    solid = ~blank[raw]
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, equal for equal bytes wherever they are; A-Z count as a-z."""
    power = np.full(len(raw) + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:-1], out=sums[1:])
    back = np.full(len(raw) + 1, _BACK, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed_bits((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles; a text with fewer words is one
    shingle, null and wordless texts have none."""
    odd = mixed_bits(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for padded, bounds in pieces(texts):
        hashes, start, _ = word_hashes(padded)
        at = np.searchsorted(start, bounds)
        joined = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            joined += hashes[k : k + len(joined)] * odd[k]
        joined = mixed_bits(joined)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                yield np.unique(joined[a : b - size + 1])
            elif b > a:
                yield mixed_bits((hashes[a:b] * odd[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield hashes[:0]


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of whole texts, a blank after each, some PIECE bytes at a time, and where each text begins (and the end)."""
    raw, offsets = flat(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        last = min(last, len(texts))
        low, high = int(offsets[first]), int(offsets[last])
        bounds = np.concatenate(([0], np.cumsum(np.diff(offsets[first : last + 1]) + 1)))
        padded = np.full(high - low + last - first, 0x20, np.uint8)
        keep = np.ones(len(padded), bool)
        keep[bounds[1:] - 1] = False
        padded[keep] = raw[low:high]
        yield padded, bounds
        first = last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null has none."""
    texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


class MinHash:
    """``size`` minima of a set of 64-bit hashes under as many multiply-add permutations of 32 bits."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.times = rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 2**32, size, dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        out = np.full(len(self.times), 2**32 - 1, np.uint32)
        for i in range(0, len(low), 4096):
            part = self.times[:, None] * low[None, i : i + 4096]
            part += self.plus[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out
