"""Liang hyphenation from a pattern list given as data, and longest-match segmentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LEFT, MIN_RIGHT, MAX_WORD = 2, 3, 64


def load_patterns(lines: list[str]) -> dict[str, list[int]]:
    """``a1b2c`` -> letters and the weights between them."""
    out = {}
    for p in lines:
        p = p.strip()
        if not p or p.startswith("%"):
            continue
        letters, weights = "", [0]
        for c in p:
            if c.isdigit():
                weights[-1] = int(c)
            else:
                letters += c
                weights.append(0)
        out[letters] = weights
    return out


def break_points(word: str, patterns: dict[str, list[int]]) -> list[int]:
    """Positions before which an ASCII word may be hyphenated."""
    if not word.isascii() or not word.isalpha() or not MIN_LEFT + MIN_RIGHT <= len(word) <= MAX_WORD:
        return []
    text, marks = f".{word.lower()}.", [0] * (len(word) + 3)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            for k, w in enumerate(patterns.get(text[i:j], ())):
                marks[i + k] = max(marks[i + k], w)
    return [i for i in range(MIN_LEFT, len(word) - MIN_RIGHT + 1) if marks[i + 1] % 2]


def hyphenate(c: Column, patterns: dict[str, list[int]]) -> Column:
    """Words of a string column with soft hyphens at their break points."""

    @F.pandas_udf("string")
    def run(s):
        known: dict[str, str] = {}

        def mark(w):
            if w not in known:
                at = [0, *break_points(w, patterns), len(w)]
                known[w] = "­".join(w[a:b] for a, b in zip(at, at[1:], strict=False))
            return known[w]

        return s.map(lambda t: None if t is None else " ".join(mark(w) for w in t.split(" ")))

    return run(c)


def segment(text: str, words: set[str]) -> list[str]:
    """Longest match first; a character no word starts with stands alone."""
    longest, out, i = max(map(len, words), default=1), [], 0
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 0, -1) if text[i : i + n] in words), 1)
        out.append(text[i : i + n])
        i += n
    return out
