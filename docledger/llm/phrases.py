"""Substring deduplication with repeated-phrase automata.

A window is ``width`` consecutive words of one document. Every word covered by a window
whose word sequence also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed; windows are judged on the input.

0. A row whose whole text occurs at a smaller doc_id needs no search: all its windows
   recur. Such copies are set aside by SHA-256, so a text in a third of all rows is searched once.
1. Seeds. The smallest hash among the short grams inside a window is a function of the
   window's words, so equal windows share their seed. Seeds at one place in the corpus only
   cannot belong to a recurring window. Counts are summed per batch before the shuffle.
2. Candidate windows (recurring seed) are counted by hash the same way; what recurs is
   kept as a bitmap of a size that follows the count up to a stated bound. Bitmaps and hashes only
   let too much through, never too little.
3. Passages: runs of recurring windows with one seed, with every place they start at.
   Passages of the same words (by a 128-bit hash) collapse in a partial aggregate to their first place, so
   a passage in a third of all documents is one row; only first places ship their text.
4. Distinct passages are dealt to shards by seed. Each shard compiles an Aho-Corasick automaton
   of its windows (one symbol per word) and streams its passages through it, which
   gives the true first place of every window and confirms repeats on words. What holds for a passage
   holds wherever its words stand, so other places need no second pass through the automaton.
   A seed with more distinct text than a shard should hold is split: its windows are passages of their own
   and are dealt by their words.
5. The removed ranges go back to the documents by doc_id.

Defined cases: a null text has no words; repeated rows and rows sharing a doc_id are
one document and are treated alike; a null doc_id comes after all others. Documents
shorter than a window keep everything; a text may have up to 2^28 words, more than a row can hold. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._bitmap import MAX_BITS_LOG2, bitmap, member
from docledger.llm._text import gram_hashes, groups_of, mix, small, word_hashes
from docledger.plans.storage import discard, materialize, release

LAST = (1 << 63) - 1
#: Mask of the bits that hold a seed's place in its group of texts.
PLACE = (1 << 28) - 1
#: Groups of copies that may be broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
#: Words of distinct passages that one automaton should hold.
SHARD_WORDS = 50_000
#: A seed with more times that many words is split.
CROWDED = 4


class Windows:
    """Word windows of a few texts: hashes, seeds and the places of the seeds."""

    def __init__(self, texts: list, width: int, gram: int):
        self.blob = b"\n".join(t or b"" for t in texts)
        first = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])[:-1]
        self.starts, self.ends, self.h = word_hashes(np.frombuffer(self.blob, dtype=np.uint8))
        self.word0 = np.searchsorted(self.starts, first)
        self.own = np.repeat(np.arange(len(texts)), np.diff(np.append(self.word0, len(self.starts))))
        n = max(0, len(self.h) - width + 1)
        self.valid = self.own[:n] == self.own[width - 1 :] if n else np.zeros(0, dtype=bool)
        g, span = gram_hashes(self.h, gram), width - gram + 1
        if len(g) > PLACE:
            raise ValueError(f"a text of more than {PLACE} words")
        # hash above, place below: the minimum is the leftmost of the smallest hashes
        low, size = (g & ~np.uint64(PLACE)) | np.arange(len(g), dtype=np.uint64), 1
        while size < span and n:
            step = min(size, span - size)
            low, size = np.minimum(low[: len(low) - step], low[step:]), size + step
        self.place = (low[:n] & np.uint64(PLACE)).astype(np.int64)
        self.seed = g[self.place]

    def runs(self, chosen: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First window and length of each run of chosen windows with one seed place in one text; windows in ``single`` stay alone."""
        i = np.flatnonzero(chosen)
        if not len(i):
            return i, i
        new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(self.place[i]) != 0) | (np.diff(self.own[i]) != 0)))
        if single is not None:
            new |= single[i]  # a seed is split or not, so what follows such a window has another seed
        at = np.flatnonzero(new)
        return i[at], np.diff(np.append(at, len(i)))


def _counts(docs: DataFrame, pick, width: int, gram: int) -> DataFrame:
    """Recurring keys: ``pick(Windows)`` gives the hashes to count; summed per batch, then by key."""

    def run(batches):
        for b in small(batches):
            texts, found = b.column(0).to_pylist(), []
            for lo, hi in groups_of(texts):
                found.append(pick(Windows(texts[lo:hi], width, gram)))
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    rows = docs.select("text").mapInArrow(run, "key bigint, n bigint")
    return rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def recurring(docs: DataFrame, width: int, gram: int, max_log2: int) -> tuple[np.ndarray, int]:
    """Bitmap of the window hashes that recur in the corpus."""
    sc = docs.sparkSession.sparkContext

    def seeds(w: Windows) -> np.ndarray:
        at, _ = w.runs(w.valid)
        return w.seed[at]

    keys = materialize(_counts(docs, seeds, width, gram), "phrase-seeds")
    seen = sc.broadcast(bitmap(keys, max_log2))
    discard(keys)

    def candidates(w: Windows) -> np.ndarray:
        m = w.valid & member(*seen.value, w.seed)
        return gram_hashes(w.h, width)[m]

    release(docs.sparkSession)
    keys = materialize(_counts(docs, candidates, width, gram), "phrase-windows")
    out = bitmap(keys, max_log2)
    discard(keys)
    seen.unpersist()
    release(docs.sparkSession)
    return out


def _places(docs: DataFrame, known, width: int, gram: int, split=None, within=None, chosen=None) -> DataFrame:
    """``(seed, seg, seg2, doc, start, n)`` of every place of every recurring passage; n counts windows.

    ``seg, seg2`` is the 128-bit hash of the words. Seeds in the bitmap ``split`` have passages of one window; with
    ``within``, a bitmap of documents, only these seeds and documents count. With ``chosen``, a bitmap over ``place_key``, only those places, with
    their text and ``deal``, by which they are dealt to shards.
    """
    import xxhash

    def run(batches):
        for b in small(batches):
            if within:
                b = b.filter(pa.array(member(*within.value, place_key(b.column(0).to_numpy()))))
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, hi in groups_of(texts):
                w = Windows(texts[lo:hi], width, gram)
                wanted, single = w.valid & member(*known.value, gram_hashes(w.h, width)), None
                if split:
                    single = member(*split.value, w.seed)
                    wanted &= single | (within is None)
                at, n = w.runs(wanted, single)
                own, start, seed = w.own[at], at - w.word0[w.own[at]], w.seed[at].view(np.int64)
                norm, size = b" ".join(w.blob.split()), w.ends - w.starts
                stop = np.cumsum(size + 1) - 1  # where the words end in norm
                body = [norm[x:y] for x, y in zip((stop - size)[at].tolist(), stop[at + n + width - 2].tolist(), strict=True)]
                seg = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in body]), dtype="<i8").reshape(-1, 2)
                cols = [seed, seg[:, 0], seg[:, 1], ids[lo + own], start, n]
                if chosen is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=NAMES)
                else:
                    m = np.flatnonzero(member(*chosen.value, place_key(*cols[1:5])))
                    deal = np.where(single[at], cols[1], seed) if split else seed
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[m]) for c in cols), pa.array(deal[m]), pa.array([body[i] for i in m], pa.binary())], names=[*NAMES, "deal", "text"])

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in NAMES) + (", deal bigint, text binary" if chosen else ""))


NAMES = ["seed", "seg", "seg2", "doc", "start", "n"]


def place_key(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = mix(out * np.uint64(3) + c.astype(np.int64).view(np.uint64))
    return out


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """``key``: ``place_key`` of the columns."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place_key(*(c.to_numpy() for c in b.columns)).view(np.int64))], names=["key"])

    return rows.select(*columns).mapInArrow(run, "key bigint")


def _firsts(at: DataFrame) -> DataFrame:
    """Stored: each distinct passage with its first place."""
    first = at.groupBy("seg", "seg2").agg(F.min(F.struct("doc", "start")).alias("rep"), F.max("n").alias("n"), F.min("seed").alias("seed"))
    return materialize(first.select("seed", "seg", "seg2", "rep.doc", "rep.start", "n"), "phrase-firsts")


def _split(docs: DataFrame, known, at: DataFrame, first: DataFrame, width: int, gram: int, max_log2: int, most: int):
    """(places, their stored first places, broadcast bitmap of the split seeds or None).

    A seed of over ``most`` words of distinct passages is split: its places are found again, one for each
    window, in the documents that have it. The bitmap may let further seeds through, whose windows then stand beside
    their passages; that changes no result.
    """
    sc, few = docs.sparkSession.sparkContext, lambda df: F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df
    crowded = first.groupBy("seed").agg(F.sum(F.col("n") + width - 1).alias("words")).where(F.col("words") > most)
    crowded = materialize(crowded.select("seed"), "phrase-crowded")
    if crowded.isEmpty():
        discard(crowded)
        return at, first, None
    split = sc.broadcast(bitmap(crowded.select(F.col("seed").alias("key")), max_log2))
    touched = at.join(few(crowded), "seed", "left_semi").select("doc").distinct()
    within = sc.broadcast(bitmap(_keys(touched, "doc"), max_log2))
    windows = materialize(_places(docs, known, width, gram, split, within), "phrase-windows")
    at = at.join(few(crowded), "seed", "left_anti").unionByName(windows)
    discard(first)
    return at, _firsts(at), split


#: Characters there are for symbols: the code points but for zero and the surrogates.
SYMBOLS = 0x110000 - 0x800 - 1


class Symbols(dict):
    """A symbol for each word, given out as words come: one character, or ``parts`` of them where words are more."""

    def __init__(self, words: int, limit: int = SYMBOLS):
        super().__init__()
        self.limit, self.parts = limit, 1
        while limit**self.parts <= words:
            self.parts += 1

    def __missing__(self, word: bytes) -> str:
        n, out = len(self), []
        for _ in range(self.parts):
            n, c = divmod(n, self.limit)
            out.append(chr(c + 1 if c + 1 < 0xD800 else c + 0x801))
        self[word] = "".join(out)
        return self[word]


def repeated_windows(texts: list[bytes], width: int) -> list[tuple[int, list[int]]]:
    """(text, starts) of the windows whose hash two places in these texts share; only they need a key."""
    w = Windows(texts, width, min(width, 8))
    h = gram_hashes(w.h, width)[w.valid]
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(w.valid)[n[inverse] > 1]
    own = w.own[at]
    cut = np.flatnonzero(np.diff(own)) + 1
    starts = np.split(at - w.word0[own], cut)
    return [(int(k), x.tolist()) for k, x in zip(own[np.concatenate(([0], cut))] if len(own) else own, starts, strict=False)]


def confirm_shard(width: int, limit: int = SYMBOLS):
    """For one shard: the window ranges of each passage's first place that recur earlier still.

    Passages are added from the last place to the first, so each window ends up with the
    first place it has; streaming the passages then finds every window that is elsewhere first.
    """

    def run(key, table):
        import ahocorasick

        table = table.sort_by([("doc", "ascending"), ("start", "ascending")])
        names = np.stack([table["seg"].to_numpy(), table["seg2"].to_numpy()])
        order = np.lexsort(names)  # stable: a bitmap may let later places of a passage through
        again = order[1:][(names[:, order[1:]] == names[:, order[:-1]]).all(axis=0)]
        keep = np.ones(len(order), dtype=bool)
        keep[again] = False
        table = table.filter(pa.array(keep))
        raw = table["text"].to_pylist()
        symbol = Symbols(sum(t.count(b" ") + 1 for t in raw), limit)
        texts = ["".join([symbol[w] for w in t.split(b" ")]) for t in raw]
        auto = ahocorasick.Automaton()
        add, parts = auto.add_word, symbol.parts
        size, own = width * parts, width - 1
        for k, at in reversed(repeated_windows(raw, width)):
            s, base = texts[k], k * width
            for i in at:
                add(s[i * parts : i * parts + size], base + i)
        auto.make_automaton()
        row, at = [], []
        for k, s in enumerate(texts):
            base = k * width - own
            for end, place in auto.iter(s) if len(auto) else ():
                if parts > 1:
                    if (end + 1) % parts:
                        continue  # not at a word's end
                    end = (end + 1) // parts - 1
                if place != base + end:
                    row.append(k)
                    at.append(end - own)
        row, at = np.array(row, dtype=np.int64), np.array(at, dtype=np.int64)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(at) != 1)))) if len(row) else row
        last = np.append(new[1:], len(row)) - 1 if len(row) else row
        start = table["start"].to_numpy()[row[new]]
        cut = pa.StructArray.from_arrays([pa.array(start + at[new]), pa.array(start + at[last] + width)], names=["a", "z"])
        offsets = np.searchsorted(row[new], np.arange(len(texts) + 1), "left").astype(np.int32)
        cuts = pa.ListArray.from_arrays(pa.array(offsets), cut)
        return pa.table({"seg": table["seg"], "seg2": table["seg2"], "rep_doc": table["doc"], "rep_start": table["start"], "cuts": cuts})

    return run


def removed_ranges(docs: DataFrame, width: int = 20, gram: int = 8, max_log2: int = MAX_BITS_LOG2, shard_words: int = SHARD_WORDS, symbols: int = SYMBOLS) -> DataFrame:
    """``(doc, ranges array<struct<a, z>>)``: word ranges to remove, sorted, for documents that have any."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(recurring(docs, width, gram, max_log2))
    stored = materialize(_places(docs, known, width, gram), "phrase-places")
    at, first, split = _split(docs, known, stored, _firsts(stored), width, gram, max_log2, CROWDED * shard_words)
    release(docs.sparkSession)
    words = first.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    chosen = sc.broadcast(bitmap(_keys(first, "seg", "seg2", "doc", "start"), max_log2))
    parted = _places(docs, known, width, gram, split, chosen=chosen).drop("seed", "n").withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
    cut = parted.drop("deal").groupBy("shard").applyInArrow(confirm_shard(width, symbols), "seg bigint, seg2 bigint, rep_doc bigint, rep_start bigint, cuts array<struct<a:bigint,z:bigint>>")
    cut = materialize(cut, "phrase-cuts")
    discard(first)
    release(docs.sparkSession)
    at_rep = (F.col("doc") == F.col("rep_doc")) & (F.col("start") == F.col("rep_start"))
    whole_range = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + width - 1).alias("z")))
    marks = at.join(cut, ["seg", "seg2"]).select("doc", F.explode(F.when(at_rep, F.col("cuts")).otherwise(whole_range)).alias("r"))
    marks = materialize(marks.groupBy("doc").agg(F.sort_array(F.collect_set("r")).alias("ranges")), "phrase-ranges")
    discard(stored)
    discard(cut)
    release(docs.sparkSession)
    return marks


def kept_words(text: bytes, width: int, copy: bool, ranges) -> tuple[int, list[bytes]]:
    """(number of words, the words that stay)."""
    words = text.split()
    if copy:
        return len(words), words if len(words) < width else []
    if not ranges:
        return len(words), words
    keep = np.ones(len(words), dtype=bool)
    for r in ranges:
        keep[r["a"] : r["z"]] = False
    return len(words), list(compress(words, keep.tolist()))


def _marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``copy``: the same text stands at a smaller doc; the other rows)."""
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    groups = keyed.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select(F.col("digest").alias("group"), "first"), "phrase-copies")
    few = groups.count() <= BROADCAST_GROUPS
    joined = keyed.join(F.broadcast(groups) if few else groups, F.col("digest") == F.col("group"), "left")
    marked = joined.select("doc", "text", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy"))
    single = marked.where("not copy").select("doc", "text")
    return marked, single if few else materialize(single, "phrase-single")


def _finished(docs: DataFrame, with_text: bool, options: dict) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(options.pop("id_col", "doc_id")).cast("bigint"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(options.pop("text_col", "text")).cast("binary"), F.lit(b"")).alias("text"))
    width = options.get("width", 20)
    marked, single = _marked(rows)
    joined = marked.join(removed_ranges(single, **options), "doc", "left")
    last, kind = ("kept_text", "binary") if with_text else ("kept_sha256", "string")
    struct = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))

    def run(batches):
        for b in small(batches):
            total, removed, kept, cuts = [], [], [], []
            for text, copy, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n, words = kept_words(text, width, copy, ranges)
                total.append(n)
                removed.append(n - len(words))
                out = b" ".join(words)
                kept.append(out if with_text else hashlib.sha256(out).hexdigest())
                cuts.append(([{"a": 0, "z": n}] if n > len(words) else []) if copy else ranges or [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary() if with_text else pa.string()), pa.array(cuts, struct)], names=["doc", "n_words", "n_removed", last, "ranges"])

    out = joined.select("doc", "text", "copy", "ranges").mapInArrow(run, f"doc bigint, n_words bigint, n_removed bigint, {last} {kind}, ranges array<struct<a:bigint,z:bigint>>")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", last, "ranges")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text, ranges)`` for every row; ranges of words removed."""
    out = _finished(docs, True, options)
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``."""
    return _finished(docs, False, options).drop("ranges")
