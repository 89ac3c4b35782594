"""Words of whole batches of texts as arrays: positions, owners and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
LONG = 48  # code points of a word beyond which its bytes are hashed by the library


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of a multiply-xorshift hash)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    codes: np.ndarray  # code points of all texts, one line feed after each
    text_start: np.ndarray  # where each text starts in codes
    start: np.ndarray  # of each word
    end: np.ndarray
    owner: np.ndarray  # index of the word's text
    first: np.ndarray  # index of each text's first word, and the number of words at the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.codes, self.start, self.end)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of code points; equal spans have equal hashes.

    Three code points make one number and each number is scrambled into the hash, so no arithmetic relation between
    spans carries over to their hashes.  Long spans are hashed by XXH64.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x51ED27))
    wide = np.zeros(len(codes) + 2, np.uint64)
    wide[: len(codes)] = codes
    wide = wide[:-2] | (wide[1:-1] << np.uint64(21)) | (wide[2:] << np.uint64(42))
    active, done = np.flatnonzero(size <= LONG), 0
    while True:
        left = size[active] - done
        active, left = active[left > 0], left[left > 0]
        if not len(active):
            break
        value = wide[start[active] + done] & _MASKS[np.minimum(left, 3)]
        out[active] = mix(out[active] * np.uint64(_BASE) + value)
        done += 3
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(codes[start[i] : end[i]].astype("<u4").tobytes(), 42)
    return out


_MASKS = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], np.uint64)


def split(texts: list[str | None], lower: bool = False) -> Words:
    """Words of each text; null is empty.  ``lower`` lowers A to Z only."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    text_start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
    if lower:
        codes = codes + np.uint32(32) * ((codes >= 65) & (codes <= 90))
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[1:] = (codes != 32) & ((codes < 9) | (codes > 13))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.append(np.searchsorted(start, text_start), len(start))
    return Words(codes, text_start, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours; runs may cross texts, which callers mask."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[i : len(hashes) - n + 1 + i])
    return out


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word) for each text."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
