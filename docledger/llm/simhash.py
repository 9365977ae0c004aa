"""SimHash near-duplicate groups by anchor-point covering.

The 64 bits are cut into segments; two fingerprints within ``threshold`` bits agree to
within ``threshold // segments`` bits on at least one of them. Each segment has a covering
code as its set of anchors: the [15,11] Hamming code on 15 bits (covering radius 1)
times all words on the remaining bits. A fingerprint's home anchor is the code word
nearest its segment; it is replicated to every anchor within covering radius plus
segment threshold, so it meets each neighbour at that neighbour's home anchor.
Comparing home rows with all rows of an anchor therefore loses no link.

Only distinct fingerprints are replicated, so a group of exact copies is one row.
Crowded anchors are dealt out as a grid of blocks (home block x replica block), each of
bounded size; every block reports a spanning forest of its links, never all pairs.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; fewer words than the shingle size give one shingle; repeated
rows and rows sharing a doc_id are one document; a null doc_id never becomes a group's
id (the component of a group of null ids only is null). An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._bitmap import bitmap, member
from docledger.llm._columns import free, own
from docledger.llm._text import mix, small
from docledger.operators.graph import connected_components
from docledger.plans.storage import discard, materialize, release

BITS = 64
SLICE = 1 << 15
#: Rows of one kind that meet in a block, and hot anchors that may be broadcast.
BLOCK, HOT_LIMIT = 4096, 100_000
#: Rows and bytes of shingle sets that one block of a crowd should hold.
CROWD_BLOCK, CELL_BYTES = 1024, 32 << 20
#: Rows with one fingerprint from which it counts as hot in a join.
MANY = 256
#: [15,11] Hamming code: the parity-check column of bit j is j + 1.
CODE_BITS = 15


def shingle_hashes(text: bytes | None, shingle: int, seed: int):
    """The 64-bit hashes of a text's shingles in order, in slices of bounded size."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return
    norm, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        starts, ends = [0], [len(norm)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stop = np.cumsum(sizes + 1) - 1
        starts, ends = (stop - sizes)[:n].tolist(), stop[shingle - 1 :].tolist()
    del words
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        yield np.array([digest(norm[a:b], seed) for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE], strict=True)], dtype="<u8")


def shingle_set(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    parts = [np.unique(h) for h in shingle_hashes(text, shingle, seed)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *parts]))


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two shingle sets share ``least`` of their union; two empty ones do."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def fingerprint_bytes(text: bytes | None, shingle: int, seed: int, count: int = 1) -> list[int]:
    """``count`` fingerprints of one text, in slices of bounded size; all but the first from mixed hashes."""
    return _fingerprints(shingle_hashes(text, shingle, seed), count)


def _fingerprints(slices, count: int) -> list[int]:
    n, ones = 0, np.zeros((count, BITS), dtype=np.int64)
    for h in slices:
        n += len(h)
        for k in range(count):
            with np.errstate(over="ignore"):
                own = mix(h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) if k else h
            ones[k] += np.unpackbits(own.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.uint32)
    return [sum(1 << j for j in np.flatnonzero(2 * row > n).tolist()) for row in ones]


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, count: int = 1, id_col: str = "doc_id", text_col: str = "text", with_set: bool = False) -> DataFrame:
    """``(doc_id, fp, fp1, ...)``: each fingerprint's 64 bits as a signed long; ``with_set`` adds ``same``, a hash of the shingle set."""
    names = ["fp", *(f"fp{k}" for k in range(1, count)), *["same"] * with_set]

    def values(text):
        if not with_set:
            return fingerprint_bytes(text, shingle, seed, count)
        import xxhash

        slices = list(shingle_hashes(text, shingle, seed))
        held = np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *slices]))
        return [*_fingerprints(slices, count), xxhash.xxh64_intdigest(held.tobytes(), seed)]

    def run(batches):
        for b in small(batches):
            rows = [values(t.as_py()) for t in b.column(1)]
            bits = np.array(rows, dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(bits[:, k]) for k in range(len(names)))], names=["doc_id", *names])

    ids = F.col(id_col).cast("bigint").alias("doc_id")
    return docs.select(ids, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in names))


def segments_of(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; widths differ by one bit at most."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _syndrome(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for j in range(CODE_BITS):
        out ^= np.where((x >> np.uint64(j)) & np.uint64(1), j + 1, 0)
    return out


def error_patterns(width: int, reach: int) -> list[np.ndarray]:
    """By syndrome: the error patterns of weight up to ``reach`` that lead to an anchor."""
    from itertools import combinations

    by: list[list[int]] = [[] for _ in range(16)]
    for weight in range(min(reach, width) + 1):
        for bits in combinations(range(width), weight):
            s = 0
            for j in bits:
                s ^= j + 1 if j < CODE_BITS else 0
            by[s].append(sum(1 << j for j in bits))
    return [np.array(x, dtype=np.uint64) for x in by]


def anchors(distinct: DataFrame, of: str, carried: list[str], reach: int, segments: int) -> DataFrame:
    """Replicas ``(anchor, <carried>, home)`` of every row for the fingerprint in column ``of``.

    ``reach`` is the segment threshold; ``carried`` columns are longs and hold ``of``.
    """
    cuts = segments_of(segments)
    if min(w for _, w in cuts) < CODE_BITS:
        raise ValueError(f"at most {BITS // CODE_BITS} segments")
    near = {w: error_patterns(w, 1 + reach) for w in {w for _, w in cuts}}
    place = carried.index(of)

    def run(batches):
        for b in batches:
            cols = [c.to_numpy().astype(np.int64) for c in b.columns]
            for at in range(0, b.num_rows, 1024):
                part_of = [c[at : at + 1024] for c in cols]
                fp = part_of[place].view(np.uint64)
                for k, (shift, width) in enumerate(cuts):
                    part = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    s = _syndrome(part)
                    fixed = np.where(s > 0, part ^ (np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64)), part)
                    for syn in np.unique(s):
                        at_s, errors = np.flatnonzero(s == syn), near[width][syn]
                        to = (part[at_s][:, None] ^ errors[None, :]).ravel()
                        home = to == np.repeat(fixed[at_s], len(errors))
                        key = to.astype(np.int64) | np.int64(k << 40)
                        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.repeat(c[at_s], len(errors))) for c in part_of), pa.array(home)], names=["anchor", *carried, "home"])

    return distinct.select(*carried).mapInArrow(run, f"anchor bigint, {', '.join(f'{c} bigint' for c in carried)}, home boolean")


def dealt(rows: DataFrame, carried: list[str], block: int = BLOCK) -> DataFrame:
    """Adds ``cell``: one per anchor, or for a crowded anchor a grid of bounded cells."""
    hot = rows.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count("*").alias("r")).where(f"h > 0 and r > {block}")
    n = F.ceil(F.col("r") / block).cast("int")
    hot = materialize(hot.select("anchor", F.ceil(F.col("h") / block).cast("int").alias("nh"), n.alias("nr")), "hot")
    few = hot.count() <= HOT_LIMIT
    split = rows.join(F.broadcast(hot) if few else hot, "anchor", "left").withColumn("x", F.xxhash64(carried[0]))
    nh, nr = F.coalesce("nh", F.lit(1)), F.coalesce("nr", F.lit(1))
    as_replica = split.select("anchor", *carried, F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), nh - 1)).alias("i"), F.pmod(F.col("x"), nr).cast("int").alias("j"))
    as_home = split.where("home").select("anchor", *carried, "home", F.pmod(F.col("x"), nh).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), nr - 1)).alias("j"))
    return as_replica.union(as_home).select(F.xxhash64("anchor", "i", "j").alias("cell"), *carried, "home")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; root is compressed before and after."""
    while len(a):
        ra, rb = root[a], root[b]
        m = ra != rb
        a, b, ra, rb = a[m], b[m], ra[m], rb[m]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def nearest(n: int, a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Indexes of the edges a[i]-b[i] of a spanning forest over ``n`` nodes with the smallest gaps."""
    order = np.argsort(gap, kind="stable")
    a, b, root, at, kept = a[order], b[order], np.arange(n), np.arange(len(order)), [np.zeros(0, dtype=np.int64)]
    while len(at):
        ra, rb = root[a[at]], root[b[at]]
        m = ra != rb
        at, ra, rb = at[m], ra[m], rb[m]
        best = np.full(n, len(order))
        np.minimum.at(best, ra, at)
        np.minimum.at(best, rb, at)
        kept.append(np.unique(best[best < len(order)]))
        _unite(root, a[kept[-1]], b[kept[-1]])
    return order[np.concatenate(kept)]


def links(cells: DataFrame, names: list[str], node: str, carried: list[str], threshold: int, pick: str = "star") -> DataFrame:
    """Edges ``(u, v)`` between the ``node`` values whose fingerprints ``names`` differ in few bits.

    ``star``: each linked row of a cell with its group's first one. ``tree``: a spanning forest of the links
    themselves, the nearest first.
    """
    bits_at, node_at = [carried.index(c) for c in names], carried.index(node)

    def within(cell, cols, home):
        """Edges of whole cells: arrays sorted by cell."""
        ids, place = np.unique(cols[node_at], return_inverse=True)
        tree = [np.zeros(0, dtype=np.int64)] * 3
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(first, len(cell)))
        own = np.repeat(np.arange(len(first)), size)
        at_home, node = np.flatnonzero(home), cols[node_at]
        root, todo = np.arange(len(cell)), size[own[at_home]]
        stops = np.cumsum(todo)
        i = 0
        while i < len(at_home):
            j = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + (1 << 20), "right")))
            h, n = at_home[i:j], todo[i:j]
            left = np.repeat(h, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own[h]], n)
            gap = sum(np.bitwise_count(cols[k][left].view(np.uint64) ^ cols[k][right].view(np.uint64)).astype(np.int16) for k in bits_at)
            near = (gap <= threshold) & (node[left] != node[right])
            if pick == "tree":
                if near.any():
                    tree = [np.concatenate(x) for x in zip(tree, (place[left[near]], place[right[near]], gap[near]), strict=True)]
                    at = nearest(len(ids), *tree)
                    tree = [x[at] for x in tree]
            else:
                _unite(root, left[near], right[near])
            i = j
        if pick == "tree":
            yield ids[np.maximum(tree[0], tree[1])], ids[np.minimum(tree[0], tree[1])]
        elif pick == "star":
            m = np.flatnonzero(root != np.arange(len(root)))
            yield node[m], node[root[m]]

    def edges(parts):
        if parts:
            cell, *cols, home = (np.concatenate(x) for x in zip(*parts, strict=True))
            for a, b in within(cell, cols, home):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    def run(batches):
        kept: list = []
        for b in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))
            if cut or (kept and kept[-1][0][-1] != part[0][0]):
                yield from edges([*kept, [x[:cut] for x in part]] if cut else kept)
                kept = []
            kept.append([x[cut:] for x in part])
        yield from edges(kept)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u bigint, v bigint")


def linked(groups: DataFrame, of: str, names: list[str], node: str, threshold: int, reach: int, segments: int, block: int, pick: str = "star") -> DataFrame:
    """Stored edges ``(u, v)``, picked as in ``links``, between groups that meet at an anchor of column ``of``."""
    carried = list(dict.fromkeys([*names, node]))
    rows = materialize(anchors(groups, of, carried, reach, segments), "simhash-anchors")
    edges = links(dealt(rows, carried, block), names, node, carried, threshold, pick)
    edges = materialize(edges if pick == "star" else edges.distinct(), "simhash-links")
    discard(rows)
    release(groups.sparkSession)
    return edges


def grouped(prints: DataFrame, names: list[str]) -> DataFrame:
    """``(<names>, low, n)``: each distinct fingerprint, its smallest doc_id and its rows."""
    return materialize(prints.groupBy(*names).agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-groups")


def attach(prints: DataFrame, to: DataFrame, names: list[str], many: int = MANY) -> DataFrame:
    """``prints`` joined on ``names`` with ``to(<names>, n, ...)``, unique by them; those of many rows are broadcast."""
    hot = materialize(to.where(F.col("n") > many), "simhash-hot")
    if hot.count() > HOT_LIMIT:
        return prints.join(to, names)
    rest = prints.join(F.broadcast(hot.select(*names)), names, "left_anti").join(to.where(F.col("n") <= many), names)
    return prints.join(F.broadcast(hot), names).unionByName(rest)


def components(prints: DataFrame, threshold: int = 4, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fp)`` -> ``(doc_id, fp, component_id)``: every link within ``threshold`` bits counts.

    More bits in a segment mean fewer chance meetings but more replicas; ``segments`` follows the
    number of fingerprints and never changes the result.
    """
    groups = grouped(prints, ["fp"])
    if segments is None:
        segments = 3 if groups.count() < 1 << 26 else 2
    edges = linked(groups, "fp", ["fp"], "fp", threshold, threshold // segments, segments, block)
    comp = materialize(connected_components(edges), "simhash-components")
    low = groups.join(comp, groups.fp == comp.node, "inner").groupBy("root").agg(F.min("low").alias("least"))
    least = comp.join(low, "root").select(F.col("node").alias("fp"), "least")
    to = materialize(groups.join(least, "fp", "left").select("fp", "n", F.coalesce("least", "low").alias("component_id")), "simhash-classes")
    return attach(prints, to, ["fp"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, seed: int = 42, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    prints = materialize(fingerprints(docs, shingle, seed), "simhash-prints")
    out = components(prints, threshold, segments, block)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, pairs: DataFrame, shingle: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored ``(node, held binary)``: the distinct shingles, as 64-bit hashes, of the documents in ``pairs(u, v)``."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("u", "v")).alias("id")).select(F.xxhash64("id").alias("key")).distinct()))

    def sets(batches):
        for b in small(batches):
            b = b.filter(pa.array(member(*wanted.value, b.column(2).to_numpy().view(np.uint64))))
            held = [shingle_set(t.as_py(), shingle, seed).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["node", "held"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id"))
    out = materialize(rows.mapInArrow(sets, "node bigint, held binary").distinct(), "simhash-sets")
    wanted.unpersist()
    return out


def confirmed(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Stored: the ``pairs(u, v)`` whose texts share ``least`` of their distinct shingles."""

    def check(batches):
        for b in small(batches, 256):
            ok = [alike(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), least) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    first, second = held.select(F.col("node").alias("u"), F.col("held").alias("a")), held.select(F.col("node").alias("v"), F.col("held").alias("b"))
    both = pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b")
    return materialize(both.mapInArrow(check, "u bigint, v bigint").distinct(), "simhash-confirmed")


def join_alike(own: np.ndarray, side: np.ndarray, cross: bool, fps: np.ndarray, sets: list[np.ndarray], threshold: int, least: float) -> list[tuple[int, int]]:
    """Row pairs (a, b) that join the groups in ``own``: near by bits, alike by sets, as few as join what can be joined.

    With ``cross`` only rows of different sides are compared. Where a row has many near ones, the
    sizes of all its intersections are counted at once, through the rows that hold each shingle.
    """
    label, n, found = own.copy(), len(own), []
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate([np.zeros(0, dtype="<u8"), *sets])
    order = np.argsort(flat, kind="stable")
    holder, flat = np.repeat(np.arange(n), sizes)[order], flat[order]
    for a in range(n):
        if cross and side[a] != side[0]:
            continue
        gap = np.bitwise_count(fps ^ fps[:, a : a + 1]).sum(axis=0, dtype=np.int64)
        near = (gap <= threshold) & (label != label[a])
        near &= side != side[a] if cross else np.arange(n) > a
        at = np.flatnonzero(near)
        if len(at) > 8:
            lo, hi = np.searchsorted(flat, sets[a], "left"), np.searchsorted(flat, sets[a], "right")
            n_of = hi - lo
            rows = holder[np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of) + np.repeat(lo, n_of)]
            both = np.bincount(rows, minlength=n)[at]
            at = at[both >= least * (sizes[a] + sizes[at] - both)]
        for b in at[np.argsort(gap[at], kind="stable")].tolist():
            if label[a] != label[b] and alike(sets[a], sets[b], least):
                found.append((a, b))
                label[label == label[b]] = label[a]
    return found


def crowd_links(known: DataFrame, names: list[str], edges: DataFrame, comp: DataFrame, held: DataFrame, threshold: int, least: float, block: int) -> DataFrame:
    """Stored links ``(u, v)`` that join groups of ``comp(node, root)`` further, among rows that ``edges`` lead to.

    A crowd is what edges hold together, be they links or not; it is looked at only if it holds several groups.
    Crowds of more rows or bytes than a cell should hold are dealt out as a grid of cells (block x block), as
    crowded anchors are. Each cell has its rows' shingle sets and gives the links that join its groups, so
    what comes out is fewer than the rows that go in, whatever a crowd's size.
    """
    group = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"{c}_own"))
    named = edges.join(group("u"), "u", "left").join(group("v"), "v", "left").select("u", "v", F.coalesce("u_own", "u").alias("a"), F.coalesce("v_own", "v").alias("b"))
    named = materialize(named, "simhash-named")
    crowd = materialize(connected_components(named.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), "simhash-crowds")
    met = named.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("own")), F.struct(F.col("v").alias("node"), F.col("b").alias("own")))).alias("m")).select("m.*").distinct()
    met = met.join(crowd.select(F.col("node").alias("own"), F.col("root").alias("crowd")), "own")
    rows = met.join(known.select(F.col("low").alias("node"), *names), "node").join(held, "node")
    rows = materialize(rows.select("crowd", "own", "node", *names, "held"), "simhash-again")
    sizes = rows.groupBy("crowd").agg(F.count("*").alias("rows"), F.sum(F.octet_length("held")).alias("bytes"))
    hot = sizes.select("crowd", F.greatest(F.ceil(F.col("rows") / min(block, CROWD_BLOCK)), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int").alias("blocks")).where("blocks > 1")
    hot = materialize(hot, "simhash-hot")
    split = rows.join(F.broadcast(hot) if hot.count() <= HOT_LIMIT else hot, "crowd", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = split.select(F.xxhash64("crowd", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "side", (F.col("side") != F.col("other")).alias("cross"), "own", "node", *names, "held")

    def run(key, table):
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["held"]]
        fps = np.stack([table[c].to_numpy() for c in names]).view(np.uint64)
        node = table["node"].to_numpy()
        found = join_alike(table["own"].to_numpy(), table["side"].to_numpy(), table["cross"][0].as_py(), fps, sets, threshold, least)
        u, v = (node[[p[k] for p in found]] if found else node[:0] for k in range(2))
        return pa.table({"u": u, "v": v})

    out = materialize(cells.groupBy("cell").applyInArrow(run, "u bigint, v bigint"), "simhash-more")
    for x in (named, crowd, rows, hot):
        discard(x)
    return out


def near_duplicates_wide(docs: DataFrame, parts: int, threshold: int, shingle: int, seed: int = 42, segments: int = 3, block: int = BLOCK, least: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``: groups linked by a shingle similarity of ``least``, found by fingerprints of ``parts`` times 64 bits.

    The share of differing bits measures the angle between two shingle multisets; more bits
    measure it better. Every part is covered by anchors with segment threshold 1, and two
    documents that meet at any anchor are compared over all bits. Pairs within
    ``2 * segments * parts - 1`` bits always meet; farther ones meet with a probability that falls with the distance.

    Bits only propose: a pair is a link once its shingle sets are compared. First the nearest links of
    each cell that span it are confirmed. What they leave apart is compared again crowd by crowd
    (``crowd_links``). So each pair that meets within ``threshold`` bits is confirmed, refused or within one group.
    The work grows with the square of a crowd, spread over cells of bounded size; the rows that come out do not.

    Rows whose doc_ids are all null for one fingerprint are in no group. Recall against all pairs and wrong
    links are measured in ``tests/llm/test_simhash.py``.
    """
    prints = materialize(fingerprints(docs, shingle, seed, parts, with_set=True), "simhash-prints")
    names = ["fp", *(f"fp{k}" for k in range(1, parts))]
    groups = grouped(prints, [*names, "same"])
    known, edges = groups.where("low is not null"), None
    for of in names:
        new = linked(known, of, names, "low", threshold, 1, segments, block, "tree")
        edges = new if edges is None else edges.union(new)
    edges = materialize(edges.distinct(), "simhash-edges")
    held = shingle_sets(docs, edges, shingle, seed)
    sure = confirmed(edges, held, least)
    comp = materialize(connected_components(sure), "simhash-components")
    more = crowd_links(known, names, edges, comp, held, threshold, least, block)
    discard(held)
    if not more.isEmpty():
        comp = materialize(connected_components(comp.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "simhash-components")
    to = groups.join(comp, F.col("low") == F.col("node"), "left").select(*names, "same", "n", F.coalesce("root", "low").alias("component_id"))
    return attach(prints, materialize(to, "simhash-classes"), [*names, "same"]).select("doc_id", "component_id")


#: The pipeline's choice: links of similarity 0.8 over five-word shingles, proposed where at most 54 of 256 bits differ
#: (39 on average at 0.8, with a deviation of 6), so that nearly every such pair is proposed; shingle sets then decide.
STAGE = {"parts": 4, "threshold": 54, "shingle": 5}


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, all columns kept.

    A row with a null doc_id is named by no group and always stays.
    """
    key = free("gone", docs.columns)
    named = docs.select(own(id_col).alias("doc_id"), own(text_col).alias("text")).where("doc_id is not null")
    found = near_duplicates_wide(named, **STAGE | options)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, own(id_col).cast("bigint") == own(key), "left_anti")


def expected_pairs(n: int, threshold: int = 4, segments: int = 3) -> float:
    """Chance meetings of n unrelated fingerprints, for sizing."""
    width = min(w for _, w in segments_of(segments))
    reach = sum(math.comb(width, k) for k in range(2 + threshold // segments)) / 16
    return segments * n * n * reach / 2 ** (width - 4)
