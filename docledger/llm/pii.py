"""Personal data: fixed patterns, and information-theoretic sanitisation of what reveals them.

Patterns give the protected entities: e-mail addresses, IP addresses, payment cards and
phone numbers. Document counts over the whole corpus then estimate how strongly a term reveals
an entity: PMI(term; entity) over the entity's information content, which is 1 when the
term never occurs without the entity. Terms above one threshold are generalised to their class (a number,
a code, a name, a word), above a higher one removed, wherever they occur.

Only terms can matter that occur often enough with some entity, which bounds
them by counts alone; the bound is exact and prunes the co-occurrence join, as do entities of too few
documents, before any pair of a term and an entity is made. Counts are
summed per batch before the shuffle. Revealing terms are broadcast in chunks of stated size.

Defined cases: a null text is an empty one; bytes that are not UTF-8 count as replacement characters; repeated rows count and are marked alike; a
null doc_id stays null; an empty corpus has no terms; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._bitmap import MAX_BITS_LOG2, bitmap, member
from docledger.llm._text import ALNUM_LOWER, groups_of, mix, small, utf8, word_hashes
from docledger.plans.storage import discard, materialize, release

KINDS = ("email", "ip", "card", "phone")
#: Shares of an entity's information from which a term is generalised, or removed.
GENERALISE, REMOVE = 0.9, 0.97
#: Documents a term and an entity must share at least.
SUPPORT = 3
#: Revealing terms in one broadcast (8 bytes each and a flag).
CHUNK_TERMS = 2_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
DIGITS = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Any of these bytes must be there for any pattern to match.
HINT = re.compile(rb"@|[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, cur, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cur and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            cur = m.end()
        at = text.find("@", max(at + 1, cur))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out, cur = [], 0
    if text.count(".") < 3:
        return out
    for d in DIGITS.finditer(text):
        if d.end() <= cur:
            continue
        m = QUAD.match(text, max(cur, d.start()))
        if m:
            cur = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(m.span())
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(raw: bytes | None) -> tuple[str, list[tuple[int, int, int]]]:
    """(text, [(start, kind number, end)]) sorted by start, then kind."""
    if not raw or not HINT.search(raw):
        return "", []
    text = raw.decode()
    out = [(s, k, e) for k, kind in enumerate(KINDS) if kind != "phone" or "+" in text for s, e in FINDERS[kind](text)]
    return text, sorted(out)


def _words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte, last byte + 1, hash) of every term of each text."""
    blob = b"\n".join((t or b"").translate(ALNUM_LOWER) for t in texts)
    first = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])[:-1]
    s, e, h = word_hashes(np.frombuffer(blob, dtype=np.uint8))
    own = np.repeat(np.arange(len(texts)), np.diff(np.append(np.searchsorted(s, first), len(s))))
    return own, s - first[own], e - first[own], h


def _terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each distinct term of each text."""
    own, _, _, h = _words(texts)
    with np.errstate(over="ignore"):
        _, at = np.unique(mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return own[at], h[at]


def _entity_rows(docs: DataFrame) -> DataFrame:
    """``(entities array<bigint>, terms array<bigint>)`` of the documents with personal data."""
    import xxhash

    def run(batches):
        for b in small(batches):
            ent, held = [], []
            for raw in utf8(b.column(0).to_pylist()):
                text, spans = base_spans(raw)
                if spans:
                    ent.append(sorted({xxhash.xxh64_intdigest(f"{KINDS[k]}:{text[s:e].lower()}") >> 1 for s, k, e in spans}))
                    held.append(raw)
            terms = []
            for lo, hi in groups_of(held):
                own, h = _terms(held[lo:hi])
                order = np.argsort(own, kind="stable")
                terms += np.split(h[order].view(np.int64), np.cumsum(np.bincount(own, minlength=hi - lo))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ent, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))], names=["entities", "terms"])

    return docs.select("text").mapInArrow(run, "entities array<bigint>, terms array<bigint>")


def _term_counts(docs: DataFrame, known) -> DataFrame:
    """``(term, n)`` document counts over all documents for the terms in a bitmap."""

    def run(batches):
        for b in small(batches):
            texts, found = utf8(b.column(0).to_pylist()), []
            for lo, hi in groups_of(texts):
                _, h = _terms(texts[lo:hi])
                found.append(h[member(*known.value, h)])
            if found:
                t, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _pruned(rows: DataFrame, often, maybe) -> DataFrame:
    """``_entity_rows`` without the entities and terms outside two bitmaps, and without rows that lose all of either."""
    shared = rows.sparkSession.sparkContext.broadcast((often, maybe))

    def run(batches):
        for b in small(batches):
            cols = []
            for col, bits in zip(b.columns, shared.value, strict=True):
                flat, at = col.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(col.offsets.to_numpy()))))
                keep = member(*bits, flat.view(np.uint64))
                n = np.concatenate(([0], np.cumsum(keep)))[at].astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(n), pa.array(flat[keep])))
            out = pa.RecordBatch.from_arrays(cols, names=b.schema.names)
            yield out.filter(pa.array(np.all([np.diff(c.offsets.to_numpy()) > 0 for c in cols], axis=0)))

    return rows.mapInArrow(run, rows.schema)


def revealing_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, max_log2: int = MAX_BITS_LOG2) -> DataFrame:
    """``(term, disclosure, removed)``: terms by hash whose disclosure reaches ``generalise``."""
    total = docs.count()
    rows = materialize(_entity_rows(docs), "pii-entities")
    with_any = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("near")).where(F.col("near") >= support)
    with_any = materialize(with_any, "pii-terms")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(with_any.select(F.col("term").alias("key")), max_log2))
    # p(entity | term) must be at least (p(entity)) ** (1 - generalise), and an entity has `support` documents
    least = (support / max(total, 1)) ** (1 - generalise)
    seen = with_any.join(_term_counts(docs, known), "term").where((F.col("near") >= F.col("n") * least))
    seen = materialize(seen.select("term", "n"), "pii-candidates")
    known.unpersist()
    entity = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("m")).where(F.col("m") >= support)
    entity = materialize(entity, "pii-often")
    often, maybe = (bitmap(x, max_log2) for x in (entity.select(F.col("entity").alias("key")), seen.select(F.col("term").alias("key"))))
    pairs = _pruned(rows, often, maybe).select("entities", F.explode("terms").alias("term")).join(seen, "term")
    both = pairs.select("term", "n", F.explode("entities").alias("entity")).groupBy("term", "n", "entity").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    both = both.join(entity, "entity")
    information = F.log(F.lit(float(max(total, 1))) / F.col("m"))
    pmi = F.log(F.lit(float(total)) * F.col("both") / (F.col("n") * F.col("m")))
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    out = both.select("term", share.alias("d")).groupBy("term").agg(F.max("d").alias("disclosure")).where(F.col("disclosure") >= generalise)
    out = materialize(out.select("term", "disclosure", (F.col("disclosure") >= remove).alias("removed")), "pii-revealing")
    for x in (rows, with_any, seen, entity):
        discard(x)
    return out


def _chunks(terms: DataFrame, n: int):
    """The revealing terms as ``n`` sorted arrays."""
    for k in range(n):
        got = terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).select("term", "removed").toArrow()
        h = got["term"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        yield h[order], got["removed"].to_numpy()[order]


SPAN = "struct<start:bigint,kind:string,end:bigint>"
ORDER = {k: i for i, k in enumerate((*KINDS, "generalise", "remove"))}


def spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, chunk_terms: int = CHUNK_TERMS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``(doc_id, text binary, spans array<struct<start, kind, end>>)`` for every row; code points, end exclusive.

    Kinds are the four patterns, ``generalise`` and ``remove``. Term spans never overlap base spans.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    terms = revealing_terms(rows, generalise, remove, support)
    release(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    out = rows.withColumn("spans", F.lit(None).cast(f"array<{SPAN}>"))
    chunks = max(1, -(-terms.count() // chunk_terms))
    for i, chunk in enumerate(_chunks(terms, chunks)):
        shared, text_out = docs.sparkSession.sparkContext.broadcast(chunk), with_text or i + 1 < chunks

        def run(batches, shared=shared, text_out=text_out):
            known, removed = shared.value
            for b in small(batches):
                texts, old, found = utf8(b.column(1).to_pylist()), b.column(2).to_pylist(), []
                for lo, hi in groups_of(texts):
                    hits = term_places(texts[lo:hi], known, removed)
                    for j in range(lo, hi):
                        if old[j] is None:
                            base = [(s, KINDS[k], e) for s, k, e in base_spans(texts[j])[1]]
                        else:
                            base = [(x["start"], x["kind"], x["end"]) for x in old[j]]
                        if j - lo in hits:
                            base = sorted(base + outside(hits[j - lo], base), key=lambda x: (x[0], ORDER[x[1]]))
                        found.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                cols = {"doc_id": b.column(0), **({"text": pa.array(texts, pa.binary())} if text_out else {}), "spans": pa.array(found, kind)}
                yield pa.RecordBatch.from_pydict(cols)

        if i:
            out = materialize(out, "pii-chunk")
        out = out.mapInArrow(run, f"doc_id bigint, {'text binary, ' if text_out else ''}spans array<{SPAN}>")
    return out


def term_places(texts: list, known: np.ndarray, removed: np.ndarray) -> dict[int, list[tuple[int, str, int]]]:
    """By text number: the places of the revealing terms, in code points."""
    if not len(known):
        return {}
    own, s, e, h = _words(texts)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    out: dict[int, list] = {}
    cut = np.flatnonzero(np.diff(own[hit])) + 1
    for part in np.split(hit, cut) if len(hit) else ():
        i = int(own[part[0]])
        chars = np.cumsum((np.frombuffer(texts[i], dtype=np.uint8) & 0xC0) != 0x80)  # a character ends no earlier than it starts
        kinds = ["remove" if x else "generalise" for x in removed[at[part]].tolist()]
        out[i] = list(zip((chars[s[part]] - 1).tolist(), kinds, chars[e[part] - 1].tolist(), strict=True))
    return out


def outside(places: list[tuple[int, str, int]], taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The places that overlap none of those taken."""
    if not taken:
        return places
    busy = sorted((s, e) for s, _, e in taken)
    starts, ends = [s for s, _ in busy], np.maximum.accumulate([e for _, e in busy])
    return [x for x in places if not (k := bisect_left(starts, x[2])) or ends[k - 1] <= x[0]]


def coarser(term: str) -> str:
    """The class that stands for a generalised term."""
    if any(c.isdigit() for c in term):
        return "[NUMBER]" if term.isdigit() else "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, clean_text, spans)``: patterns become ``[KIND]``, terms their class or nothing."""

    def run(batches):
        for b in small(batches):
            out = []
            for raw, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, parts, at = raw.decode(), [], 0
                for x in found:
                    if x["start"] < at:
                        at = max(at, x["end"])
                        continue
                    parts += [text[at : x["start"]], "" if x["kind"] == "remove" else coarser(text[x["start"] : x["end"]]) if x["kind"] == "generalise" else f"[{x['kind'].upper()}]"]
                    at = x["end"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], names=["doc_id", "clean_text", "spans"])

    return spans(docs, **options).mapInArrow(run, f"doc_id bigint, clean_text string, spans array<{SPAN}>")


def digest(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``."""
    out = spans(docs, with_text=False, **options)
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
