"""Benchmark decontamination: every training passage queries a BM25 index of test items.

The index is inverted (term -> items with impacts) and queried by block-max WAND. An
impact is the item's BM25 weight of a term over the item's own total, so a score is the
weighted share of the item that the passage holds, and one threshold suits short and long
items. Passages are two adjacent chunks of a document, chunks being no shorter than the longest
item: each occurrence of an item lies whole in a passage. What is retrieved is
verified on words: enough of the question's and of the answer's shingles must occur in the passage.

An item's question and answer are columns of their own, or else its last sentence is
the answer. Items are indexed in shards of a stated size; a stated number of shards is broadcast
at a time and each document queries all of them in one scan, so no item is left out.

Defined cases: null or empty texts match nothing; items without words are never
matched; a part shorter than a shingle counts as one shingle; an empty question or answer is
fully covered; repeated rows give one result row for each (doc_id, item); a null doc_id
stays null; ties in score are all kept. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._columns import map_rows
from docledger.llm._text import ALNUM_LOWER, groups_of, small, word_hashes
from docledger.plans.storage import discard, materialize

K1, B = 1.2, 0.75
#: Share of an item's own BM25 total from which it is retrieved; shingle size and overlap to confirm.
RETRIEVE, SHINGLE, OVERLAP = 0.65, 5, 0.8
CHUNK, BLOCK, SUPER = 64, 4, 64
#: Items in one broadcast index.
MAX_ITEMS = 20_000
#: Indexes that one scan of the documents queries.
PER_SCAN = 4
NEVER = 1 << 60


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(ALNUM_LOWER).split()


def split_item(text: str | None) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer where there are two or more."""
    parts = re.split(r"(?<=[.!?])\s+", (text or "").strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else ((text or ""), "")


def shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Index:
    """Impacts by term, with maxima for each term, block of items and super-block."""

    def __init__(self, items: list[tuple[int, str, str]], n_items: int | None = None, mean_length: float | None = None, df: dict | None = None, shingle: int = SHINGLE):
        items = [x for x in items if words_of(x[1]) or words_of(x[2])]
        texts = [words_of(q) + words_of(a) for _, q, a in items]
        self.ids = [x[0] for x in items]
        self.parts = [(shingles(words_of(q), shingle), shingles(words_of(a), shingle)) for _, q, a in items]
        self.shingle, self.chunk = shingle, max([CHUNK, *map(len, texts)])
        n, mean = n_items or len(items), mean_length or sum(map(len, texts)) / max(1, len(texts))
        if df is None:
            df = {}
            for t in texts:
                for w in set(t):
                    df[w] = df.get(w, 0) + 1
        self.terms: dict[bytes, int] = {}
        self.items: list[list[int]] = []
        self.impacts: list[list[float]] = []
        for i, t in enumerate(texts):
            tf: dict[bytes, int] = {}
            for w in t:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(t) / mean)
            raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                k = self.terms.setdefault(w, len(self.terms))
                if k == len(self.items):
                    self.items.append([])
                    self.impacts.append([])
                self.items[k].append(i)
                self.impacts[k].append(x / own)
        self.most = np.array([max(x) for x in self.impacts] or [0.0])
        self.wide = -(-max(1, len(items)) // SUPER)
        self.supers = np.zeros((SUPER, max(1, len(self.terms))))
        self.blocks: list[dict[int, float]] = [{} for _ in self.terms]
        for k, (at, imp) in enumerate(zip(self.items, self.impacts, strict=True)):
            for i, x in zip(at, imp, strict=True):
                self.supers[i // self.wide, k] = max(self.supers[i // self.wide, k], x)
                self.blocks[k][i // BLOCK] = max(self.blocks[k].get(i // BLOCK, 0.0), x)
        self._tables()

    def _tables(self) -> None:
        """Term lookup by word hash: a few direct tables, so that arrays are looked up at once."""
        blob = b" ".join(self.terms)
        self.hash = word_hashes(np.frombuffer(blob, dtype=np.uint8))[2] if blob else np.zeros(1, dtype=np.uint64)
        left, self.tables = np.arange(len(self.terms)), []
        while len(left):
            shift = np.uint64(64 - max(12, (4 * len(left)).bit_length()) - len(self.tables))
            table = np.full(1 << (64 - int(shift)), -1, dtype=np.int64)
            slot = (self.hash[left] >> shift).astype(np.int64)
            table[slot] = left
            self.tables.append((shift, table))
            left = left[table[slot] != left]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The term of each word hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        for shift, table in self.tables:
            k = table[(h >> shift).astype(np.int64)]
            out = np.where((k >= 0) & (self.hash[k] == h), k, out)
        return out

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (item, score) of at least ``least``, by block-max WAND over distinct terms."""
        eps = 1e-9
        cursors = [[self.items[k][0], 0, k] for k in terms]
        found = []
        while True:
            cursors.sort()
            total, p = 0.0, -1
            for j, (item, _, k) in enumerate(cursors):
                if item == NEVER:
                    break
                total += self.most[k]
                if total >= least - eps:
                    p = j
                    break
            if p < 0:
                return found
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            block = pivot // BLOCK
            bound = sum(self.blocks[c[2]].get(block, 0.0) for c in cursors[: p + 1])
            if bound < least - eps:
                to = min((block + 1) * BLOCK, cursors[p + 1][0] if p + 1 < len(cursors) else NEVER)
            elif cursors[0][0] == pivot:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: p + 1])
                if score >= least - eps:
                    found.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for c in cursors[: p + 1]:
                if c[0] < to:
                    at = self.items[c[2]]
                    c[1] = bisect_left(at, to, c[1])
                    c[0] = at[c[1]] if c[1] < len(at) else NEVER

    def passages(self, texts: list, least: float):
        """(text, first chunk, terms) of the passages whose bounds reach ``least``."""
        blob = b"\n".join((t or b"").translate(ALNUM_LOWER) for t in texts)
        first = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])[:-1]
        starts, _, h = word_hashes(np.frombuffer(blob, dtype=np.uint8))
        if not len(h) or not self.terms:
            return
        word0 = np.append(np.searchsorted(starts, first), len(starts))
        own = np.repeat(np.arange(len(texts)), np.diff(word0))
        chunks = -(-np.diff(word0) // self.chunk)
        chunk0 = np.concatenate(([0], np.cumsum(chunks)))
        at = chunk0[own] + (np.arange(len(h)) - word0[own]) // self.chunk
        k = self.lookup(h)
        m = k >= 0
        pair = np.unique(at[m] * len(self.terms) + k[m])
        c, k = pair // len(self.terms), pair % len(self.terms)
        total = int(chunk0[-1])
        text_of = np.repeat(np.arange(len(texts)), chunks)
        paired = np.append(text_of[1:] == text_of[:-1], False)

        def reach(weight: np.ndarray) -> np.ndarray:
            s = np.bincount(c, weights=weight[k], minlength=total)
            return s + np.where(paired, np.append(s[1:], 0.0), 0.0)

        likely = reach(self.most) >= least - 1e-9
        if likely.any():
            best = np.zeros(total)
            for row in self.supers:
                best = np.maximum(best, reach(row))
            likely &= best >= least - 1e-9
        lone = np.repeat(chunks == 1, chunks)
        likely &= paired | lone
        bounds = np.searchsorted(c, np.arange(total + 1), "left")
        for j in np.flatnonzero(likely).tolist():
            end = bounds[j + 2] if paired[j] else bounds[j + 1]
            yield int(text_of[j]), int(j - chunk0[text_of[j]]), np.unique(k[bounds[j] : end]).tolist()

    def matches(self, texts: list, least: float, overlap: float) -> list[dict]:
        """For each text: item index -> (score, question overlap, answer overlap) of confirmed items."""
        out: list[dict] = [{} for _ in texts]
        of, words = -1, []
        for i, j, terms in self.passages(texts, least):
            got = self.retrieve(terms, least)
            if not got:
                continue
            if of != i:
                of, words = i, words_of(texts[i])
            have = shingles(words[j * self.chunk : (j + 2) * self.chunk], self.shingle)
            span = words[j * self.chunk : (j + 2) * self.chunk]
            for item, score in got:
                q, a = (self._covered(part, have, span) for part in self.parts[item])
                if q >= overlap and a >= overlap and (item not in out[i] or out[i][item] < (score, q, a)):
                    out[i][item] = (score, q, a)
        return out

    def _covered(self, part: set[bytes], have: set[bytes], span: list[bytes]) -> float:
        if not part:
            return 1.0
        hits = len(part & have)
        if not hits and len(part) == 1 and (only := next(iter(part)).split()) and len(only) < self.shingle:
            hits = any(span[i : i + len(only)] == only for i in range(len(span) - len(only) + 1))
        return hits / len(part)


def item_rows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None) -> DataFrame:
    """``(item, q, a)``; split on the driver later where there is one text."""
    q = F.col(question_col) if question_col else F.col(text_col)
    a = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    return items.select(F.col(id_col).cast("bigint").alias("item"), q.alias("q"), a.alias("a"))


def indexes(items: DataFrame, max_items: int = MAX_ITEMS, shingle: int = SHINGLE):
    """One index for each shard of at most about ``max_items`` items, with the statistics of all items."""
    n = items.count()
    shards = max(1, -(-n // max_items))
    parts = lambda rows: [(r.item, r.q, r.a) if r.a is not None else (r.item, *split_item(r.q)) for r in rows]
    if shards == 1:
        yield Index(parts(items.collect()), shingle=shingle)
        return

    def stats(batches):
        for b in small(batches):
            rows = parts(type("R", (), dict(zip(b.schema.names, x, strict=True))) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
            bags = [words_of(q) + words_of(a) for _, q, a in rows]
            flat = [(w, len(t) if i == 0 else 0, int(i == 0)) for t in bags for i, w in enumerate(dict.fromkeys(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.binary()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], names=["w", "len", "one"])

    words = items.select("item", "q", "a").mapInArrow(stats, "w binary, len bigint, one bigint")
    total = words.agg(F.sum("len"), F.sum("one")).first()
    counted = materialize(words.groupBy("w").agg(F.count("*").alias("df")), "benchmark-words")
    for s in range(shards):
        rows = parts(items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == s).collect())
        own = sorted({w for _, q, a in rows for w in words_of(q) + words_of(a)})
        wanted = items.sparkSession.createDataFrame([(bytearray(w),) for w in own], "w binary")
        df = {bytes(r.w): r.df for r in counted.join(wanted, "w", "left_semi").collect()}
        yield Index(rows, total[1], total[0] / total[1], df, shingle)
    discard(counted)


def _scans(items: DataFrame, max_items: int, shingle: int):
    """The indexes, broadcast, in groups for one scan each."""
    group, sc = [], items.sparkSession.sparkContext
    for index in indexes(items, max_items, shingle):
        group.append(sc.broadcast(index))
        if len(group) == PER_SCAN:
            yield group
            group = []
    if group:
        yield group


def contaminated(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP, shingle: int = SHINGLE, max_items: int = MAX_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of every confirmed match."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for group in _scans(items, max_items, shingle):

        def run(batches, group=group):
            known, kind = [x.value for x in group], [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            for b in small(batches):
                ids, texts, found = b.column(0).to_pylist(), b.column(1).to_pylist(), []
                for lo, hi in groups_of(texts):
                    for index in known:
                        for i, hits in enumerate(index.matches(texts[lo:hi], retrieve, overlap)):
                            found += [(ids[lo + i], index.ids[k], *x) for k, x in hits.items()]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kind, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        got = rows.mapInArrow(run, "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double")
        out = got if out is None else out.union(got)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def clean(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP, shingle: int = SHINGLE, max_items: int = MAX_ITEMS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item, all columns kept, without a shuffle."""
    at = docs.columns.index(text_col)
    for group in _scans(items, max_items, shingle):

        def run(batches, group=group):
            known = [x.value for x in group]
            for b in small(batches):
                texts, keep = b.column(at).cast(pa.binary()).to_pylist(), []
                for lo, hi in groups_of(texts):
                    found = [index.matches(texts[lo:hi], retrieve, overlap) for index in known]
                    keep += [not any(hits) for hits in zip(*found, strict=True)]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = map_rows(docs, run)
    return docs
