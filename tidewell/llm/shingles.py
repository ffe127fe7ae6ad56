"""Words and word shingles of many texts at once, as 64-bit hashes, by numpy.

Words are runs of bytes other than space and 09 to 0D, with A-Z lower-cased. Equal shingles have equal hashes; different
ones collide with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

from tidewell.llm.common import mix64

_LOWER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], np.uint64)  # and 1, so none is 0
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int, most: int = 1 << 20) -> np.ndarray:
    """The first n powers, to be read only; those kept for later calls are bounded."""
    if len(_KNOWN.get(base, ())) >= n:
        return _KNOWN[base][:n]
    size = n if n > most else 1 << max(n - 1, 1).bit_length()
    out, done, factor = np.ones(size, np.uint64), 1, base
    with np.errstate(over="ignore"):
        while done < size:  # the powers so far, times the next one
            np.multiply(out[: min(done, size - done)], np.uint64(factor), out=out[done : 2 * done])
            done, factor = 2 * done, factor * factor & 0xFFFFFFFFFFFFFFFF
    out.flags.writeable = False
    if n <= most:
        _KNOWN[base] = out
    return out[:n]


def words(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For UTF-8 texts: each word's hash, text number, and first and end byte in its text."""
    starts = np.cumsum([0, *(len(d) + 1 for d in data)])
    raw = np.frombuffer(b" ".join([*data, b""]) if data else b"", np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    first, end = edges[::2], edges[1::2]
    # a word's polynomial is a difference of prefix sums, brought to power 0 by the inverse base
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_LOWER[raw] * _powers(_BASE, len(raw)))])
        hashes = mix64((sums[end] - sums[first]) * _powers(_INVERSE, len(raw) + 1)[first], 3)
    text = np.searchsorted(starts, first, side="right") - 1
    return hashes, text, first - starts[text], end - starts[text]


def shingles(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within a text, and the number of each one's first word."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix64(out, 5) + hashes[k : k + len(out)]
    at = np.nonzero(text[: len(out)] == text[n - 1 :])[0]
    return mix64(out[at], 4), at


def shingle_sets(data: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: (hash, text). A text of 1 to n-1 words has one shingle,
    its whole sequence; one without words has none."""
    hashes, text, _, _ = words(data)
    found, at = shingles(hashes, text, n)
    owner = text[at]
    counts = np.bincount(text, minlength=len(data)) if len(text) else np.zeros(len(data), np.int64)
    short = np.nonzero((counts > 0) & (counts < n))[0]
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        with np.errstate(over="ignore"):
            for t in short:
                one = np.zeros(1, np.uint64)
                for h in hashes[begin[t] : begin[t + 1]]:
                    one = mix64(one, 5) + h
                extra.append(mix64(one + np.uint64(counts[t]), 6)[0])
        found, owner = np.concatenate([found, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        keep = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
        found, owner = found[keep], owner[keep]
    return found, owner
