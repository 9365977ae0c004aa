"""Structure from positioned text fragments: rows, cells, tables, columns, headings, paragraphs.

Clustering depends on the order of fragments within a page, so each page is one row with a list of
its fragments, many rows an Arrow batch; a page is bounded, and pages spread over all tasks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = re.compile(r"[\s0-9.,+%$€£()-]+")
MAX_CUTS, MAX_DEPTH = 128, 16


@dataclass
class Fragment:
    x: float
    y: float
    size: float
    text: str

    @property
    def end(self) -> float:
        return self.x + len(self.text) * self.size * 0.5


@dataclass
class Line:
    y: float
    size: float
    cells: list[Fragment] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(c.text for c in self.cells)


def rows(fragments: list[Fragment]) -> list[list[Fragment]]:
    """Baselines: a fragment further than 0.35 sizes below a row's first starts a new row."""
    out: list[list[Fragment]] = []
    for f in sorted(fragments, key=lambda f: (-f.y, f.x)):
        if out and abs(out[-1][0].y - f.y) <= 0.35 * max(out[-1][0].size, f.size):
            out[-1].append(f)
        else:
            out.append([f])
    return out


def cells(row: list[Fragment]) -> Line:
    """Fragments with a gap of at most 1.5 sizes are one cell."""
    out: list[Fragment] = []
    for f in sorted(row, key=lambda f: f.x):
        if out and f.x - out[-1].end <= 1.5 * f.size:
            last = out[-1]
            out[-1] = Fragment(last.x, last.y, max(last.size, f.size), " ".join(f"{last.text} {f.text}".split()))
        else:
            out.append(Fragment(f.x, f.y, f.size, " ".join(f.text.split())))
    return Line(row[0].y, max(f.size for f in row), out)


def numeric(text: str) -> bool:
    return bool(re.search("[0-9]", text) and NUMERIC.fullmatch(text))


def table_at(lines: list[Line], i: int) -> int:
    """How many lines from i on form a table: at least 3, aligned, short cells; two columns need numbers."""
    head = lines[i]
    n = len(head.cells)
    if n < 2:
        return 0
    j = i
    while j < len(lines):
        line = lines[j]
        fits = len(line.cells) == n and all(len(c.text) <= 24 for c in line.cells) and all(abs(a.x - b.x) <= 0.5 * head.size for a, b in zip(line.cells, head.cells, strict=True))
        if not fits or (j > i and lines[j - 1].y - line.y > 2.5 * head.size):
            break
        j += 1
    if j - i < 3:
        return 0
    if n == 2 and max(sum(numeric(x.cells[k].text) for x in lines[i:j]) for k in range(2)) < 2:
        return 0
    return j - i


def apart(values: list[float]) -> list[float]:
    """Sorted values, those within 1 of the one kept before left out."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] >= 1.0:
            out.append(v)
    return out


def column_cut(fragments: list[Fragment]) -> float | None:
    """The x that separates two columns best, leftmost among equals.

    Cuts are tried in the middle of gaps of over two sizes between neighbours of a row and of over 24 between any
    edges; of many, every k-th over the whole width. A row supports the side it has text on; rows that a fragment crosses the
    cut in support neither, and may be no more than the support, which is 3 rows or more on either side.
    """
    lines = [sorted(r, key=lambda f: f.x) for r in rows(fragments)]
    tried = [(a.end + b.x) / 2 for r in lines for a, b in zip(r, r[1:], strict=False) if b.x - a.end > 2.0 * max(a.size, b.size)]
    edges = apart([v for f in fragments for v in (f.x, f.end)])
    tried = apart(tried + [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False) if b - a > 24.0])
    best, score = None, 0
    for cut in tried[:: max(1, -(-len(tried) // MAX_CUTS))]:
        crossed = [any(f.x < cut < f.end for f in r) for r in lines]
        left = sum(not c and any(f.end <= cut for f in r) for r, c in zip(lines, crossed, strict=True))
        right = sum(not c and any(f.x >= cut for f in r) for r, c in zip(lines, crossed, strict=True))
        support = min(left, right)
        if support >= 3 and sum(crossed) <= support and support > score:
            best, score = cut, support
    return best


def bands(fragments: list[Fragment], depth: int = 0) -> list[list[Fragment]]:
    """Columns left to right, each split again."""
    cut = column_cut(fragments) if depth < MAX_DEPTH and len(fragments) >= 6 else None
    if cut is None or table_like(fragments):
        return [fragments]
    wide = [f for f in fragments if f.x < cut < f.end]
    if not wide:
        return [*bands([f for f in fragments if f.end <= cut], depth + 1), *bands([f for f in fragments if f.x >= cut], depth + 1)]
    # rows that cross the cut stand between the stretches of columns above and below them
    out, stretch, crossing = [], [], []
    for r in rows(fragments):
        own = any(f in wide for f in r)
        if own and stretch:
            out += bands(stretch, depth + 1)
            stretch = []
        elif not own and crossing:
            out.append(crossing)
            crossing = []
        (crossing if own else stretch).extend(r)
    return out + ([crossing] if crossing else []) + (bands(stretch, depth + 1) if stretch else [])


def table_like(fragments: list[Fragment]) -> bool:
    lines = [cells(r) for r in rows(fragments)]
    return any(table_at(lines, i) for i in range(len(lines)))


def upper_median(sizes: list[float]) -> float:
    return sorted(sizes)[len(sizes) // 2] if sizes else 0.0


def heading(line: Line, median: float) -> int | None:
    ratio = line.size / median if median else 0.0
    if ratio < 1.25 or len(line.text) > 120:
        return None
    return 1 if ratio >= 2.0 else 2 if ratio >= 1.6 else 3


def page_blocks(fragments: list[Fragment]) -> list[tuple[str, int | None, str]]:
    """``(kind, level, text)`` of a page in reading order; table rows with cells by tabs."""
    out: list[tuple[str, int | None, str]] = []
    median = upper_median([f.size for f in fragments])
    for band in bands(fragments):
        lines, i, para = [cells(r) for r in rows(band)], 0, []

        def flush(para):
            if para:
                out.append(("p", None, " ".join(x.text for x in para)))
            para.clear()

        while i < len(lines):
            n, line = table_at(lines, i), lines[i]
            if n:
                flush(para)
                out += [("row", None, "\t".join(c.text for c in x.cells)) for x in lines[i : i + n]]
                i += n
                continue
            level = heading(line, median)
            if level:
                flush(para)
                out.append(("h", level, line.text))
            else:
                if para and (para[-1].y - line.y > 1.8 * line.size or line.cells[0].x - para[-1].cells[0].x > 1.5 * line.size):
                    flush(para)
                para.append(line)
            i += 1
        flush(para)
    return out


def recover(fragments: DataFrame) -> DataFrame:
    """``(doc_id, page_no, x, y, size, text)`` -> ``(doc_id, page_no, ord, kind, level, text)``."""

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string())
    names = ["doc_id", "page_no", "ord", "kind", "level", "text"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = [(d, p, i, *x) for d, p, f in zip(*(c.to_pylist() for c in part.columns), strict=True) for i, x in enumerate(page_blocks(in_order(f)))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    fragment = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "size")], "text")
    pages = fragments.where("text is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no")).agg(F.collect_list(fragment).alias("fragments"))
    return pages.mapInArrow(run, "doc_id bigint, page_no int, ord bigint, kind string, level int, text string")


def in_order(fragments: list[dict]) -> list[Fragment]:
    """Fragments with text from the top down, then from the left; those without a place come last."""
    out = [Fragment(*(math.nan if f[c] is None else f[c] for c in ("x", "y", "size")), f["text"]) for f in fragments if f["text"].strip()]
    return sorted(out, key=lambda f: (math.isnan(f.y), 0.0 if math.isnan(f.y) else -f.y, math.isnan(f.x), 0.0 if math.isnan(f.x) else f.x, f.text, f.size))
