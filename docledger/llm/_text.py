"""Byte-level word access shared by the operators that run in Arrow batches.

Words are maximal runs outside the six ASCII white-space bytes. No multi-byte UTF-8
sequence contains such a byte, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: ASCII letters (lower-cased) and digits stay, other ASCII becomes a space, the rest stays.
ALNUM_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_MULT = np.uint64(0x9E3779B97F4A7C15)


def small(batches, rows: int = 1000, size: int = 8 << 20):
    """The same rows in batches of at most ``rows``, fewer where they are over ``size`` bytes: a worker's memory is a few of them."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * size / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def utf8(texts: list) -> list:
    """The same byte strings; bytes that are not UTF-8 become replacement characters."""
    try:
        b" ".join(t for t in texts if t is not None).decode()
        return texts
    except UnicodeDecodeError:
        return [t if t is None else t.decode(errors="replace").encode() for t in texts]


def groups_of(texts: list, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``limit`` bytes together (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte buffer."""
    edge = np.diff(np.concatenate(([True], IS_SPACE[buf], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """c^0..c^(n-1) and their inverses modulo 2^64 for an odd c."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        c = int(_MULT)
        inv = pow(c, -1, 1 << 64)
        for base in (c, inv):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(p, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def word_hashes(buf: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hash64) of the words of a buffer; equal words have equal hashes.

    Works in slices that end at white space, so memory follows ``step`` and the
    longest word, not the text.
    """
    parts, at, n = [], 0, len(buf)
    while at < n:
        to = min(n, at + step)
        while to < n and not IS_SPACE[buf[to]]:
            nxt = np.flatnonzero(IS_SPACE[buf[to : to + step]])
            to = to + int(nxt[0]) if len(nxt) else min(n, to + step)
        b = buf[at:to]
        s, e = word_bounds(b)
        up, down = _powers(len(b) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=run[1:])
            h = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        parts.append((s + at, e + at, h))
        at = to
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes, by doubling; length n - k + 1."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    out, have, power, size = None, 0, h, 1
    c = int(_MULT)
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out, have = power, size
                else:
                    m = n - have - size + 1
                    out, have = out[:m] + power[have : have + m] * np.uint64(pow(c, have, 1 << 64)), have + size
            if have == k:
                return mix(out[: n - k + 1].copy())
            m = n - 2 * size + 1
            power, size = power[:m] + power[size : size + m] * np.uint64(pow(c, size, 1 << 64)), 2 * size
