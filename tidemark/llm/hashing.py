"""Words of many texts at once: where they are and a 64-bit hash of each.

A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums
over the whole buffer and mixed.  Equal words have equal hashes wherever they
stand; different ones meet with a chance of about 2^-58 a pair.
"""

from __future__ import annotations

import functools

import numpy as np

SEGMENT = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15  # 5 modulo 8
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


@functools.lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
    return out


def _powers(base: int, n: int) -> np.ndarray:
    size = SEGMENT
    while size < n:
        size *= 2
    return powers(base, size)[:n]


class Running:
    """Running sums over a buffer, from which any stretch's hash is read."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.empty(len(data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(BYTES[data] * _powers(BASE, len(data)), out=self.sums[1:])
        self.back = _powers(INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``inside`` holds."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(inside) and inside[-1]:
        edge = np.concatenate([edge, [len(inside)]])
    return edge[0::2], edge[1::2]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ``SPACE`` bytes, and how many each text has.

    Texts are joined with spaces and looked at about a megabyte at a time, cut
    between words, so that memory does not follow the longest text.
    """
    out, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def look():
        nonlocal held, size
        if held:
            data = np.frombuffer(b" ".join(t for _, t in held), np.uint8)
            if lower:
                data = LOWER[data]
            starts, ends = runs(~SPACE[data])
            out.append(Running(data).of(starts, ends))
            bounds = np.cumsum([len(t) + 1 for _, t in held])
            cut = np.searchsorted(starts, bounds)
            for (i, _), n in zip(held, np.diff(cut, prepend=0).tolist(), strict=True):
                counts[i] += n
        held, size = [], 0

    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > SEGMENT:
            look()
            end = at + SEGMENT
            while end < len(text) and not SPACE[text[end]]:  # a word stays whole
                end += 1
            held, size = [(i, text[at:end])], SEGMENT
            at = end
        if size + len(text) - at > SEGMENT:
            look()
        held.append((i, text[at:] if at else text))
        size += len(text) - at + 1
    look()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


@functools.lru_cache(16)
def _weights(n: int, salt: int) -> tuple[int, ...]:
    return tuple(pow(BASE ^ (salt << 8) | 1, j + 1, 1 << 64) for j in range(n))


def window_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of every ``n`` consecutive words; empty if there are fewer."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j, w in enumerate(_weights(n, salt)):
            out += words[j : j + size] * U(w)
    return mix(out)
