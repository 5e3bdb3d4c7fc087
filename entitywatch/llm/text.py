"""Whole-text helpers for Arrow batches: words, 64-bit word and window hashes, and documents in chunks.

A word is a run of bytes other than space and 0x09-0x0D. Hashes depend on bytes alone: the same on every
machine, for every chunking. Two different inputs share a 64-bit hash with a chance of about 2**-58.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class _Powers:
    """Powers of the step and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 4096)
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
                for x in (_STEP, _STEP_INVERSE)
            )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hashes` hashes any span of the bytes."""
    up, _ = _POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = _POWERS.to(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(data)
    return span_hashes(prefix_sums(data), starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of `size` values; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mix(total)


def chunked(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in chunks of about CHUNK_BYTES; null is empty, a long text is a chunk of its own."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > CHUNK_BYTES:
            yield first, held
            first, held, size = k, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def chunk_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts after each other, and the bounds of each text in them (one more than texts)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_spans(data)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles, A-Z in lower case.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, bounds = chunk_words([t.lower() for t in texts])
    windows = window_hashes(words, size)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            own = np.sort(windows[a : b - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield mix(window_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)
