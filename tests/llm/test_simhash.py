import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from docledger.llm import simhash


def fp_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, threshold):
    """(fingerprint, doc_id) -> smallest doc_id reachable, by comparing all pairs."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (f, _) in enumerate(pairs):
        for j in range(i):
            if (f ^ pairs[j][0]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (_, d) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(pairs))]


def test_against_all_pairs(docs, corpus):
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in simhash.near_duplicates(docs).collect())
    pairs = [(fp_of(r[1]), r[0]) for r in corpus]
    want = sorted((d is None, d or 0, f"{f:016x}", c) for (f, d), c in zip(pairs, classes(pairs, 4), strict=True))
    assert got == want


@pytest.mark.parametrize(("segments", "block"), [(3, 4096), (2, 4096), (3, 5)])
def test_planted_distances_and_crowded_anchors(spark, segments, block):
    rnd = np.random.default_rng(1)
    base = [int(x) for x in rnd.integers(0, 1 << 63, 30)]
    rows, k = [], 0
    for f in base:
        for far in range(7):
            bits = rnd.choice(64, far, replace=False)
            for b in bits.tolist():
                f ^= 1 << b
            rows.append((k, f - (1 << 64) if f >> 63 else f))
            k += 1
    rows += [(k + i, (1 << (i % 64)) | 1 if i % 64 < 63 else 0) for i in range(64)]  # a dense ball
    df = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    got = {r[0]: r[2] for r in simhash.components(df, 4, segments, block).collect()}
    assert [got[i] for i, _ in rows] == classes([(f & (2**64 - 1), i) for i, f in rows], 4)


def test_every_close_pair_meets_at_an_anchor():
    width, reach = 21, 1
    near = simhash.error_patterns(width, 1 + reach)
    rnd = np.random.default_rng(2)
    for x in rnd.integers(0, 1 << width, 200).tolist():
        s = int(simhash._syndrome(np.array([x], dtype=np.uint64))[0])
        home = x ^ (1 << (s - 1)) if s else x
        for b in [None, *range(width)]:
            y = x if b is None else x ^ (1 << b)
            sy = int(simhash._syndrome(np.array([y], dtype=np.uint64))[0])
            assert home in {y ^ int(e) for e in near[sy]}


def test_stage_keeps_one_of_each_group(docs, corpus, odd, none):
    kept = [r[0] for r in simhash.keep_representatives(docs).collect()]
    assert 0 in kept and not {40, 41, 42} & set(kept)  # copies of 0
    assert 1 in kept and 43 not in kept and 44 not in kept  # near copies of 1
    assert set(range(2, 40)) - set(kept) == set()
    assert kept.count(5) == 2  # repeated rows of one document stay together
    assert simhash.keep_representatives(odd).columns == odd.columns
    assert simhash.keep_representatives(odd).count() == 6
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_representatives(none).count() == 0


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("block", [4096, 3])
def test_stage_confirms_links_by_shingles(spark, block):
    rnd = random.Random(5)
    texts = []
    for k in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(90)]
        for changed in (0, 1, 1, 1, 2, 2, 3, 3):
            words = list(base)
            for at in rnd.sample(range(5, 85), changed):
                words[at] = f"x{k}y{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    rnd.shuffle(texts)
    sets = [shingles(t) for t in texts]
    bits = [simhash.fingerprint_bytes(t.encode(), 5, 42, 4) for t in texts]
    gap = lambda i, j: sum((a ^ b).bit_count() for a, b in zip(bits[i], bits[j], strict=True))
    close = [(i, j) for i in range(len(texts)) for j in range(i) if gap(i, j) <= simhash.STAGE["threshold"]]
    like = {(i, j) for i in range(len(texts)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert len([p for p in close if p not in like]) > 20 and len([p for p in close if p in like]) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    comp = {r[0]: r[1] for r in simhash.near_duplicates_wide(df, **simhash.STAGE, block=block).collect()}

    def roots(pairs):
        root = list(range(len(texts)))
        for _ in texts:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    sure = roots([(i, j) for i, j in close if (i, j) in like and gap(i, j) < 24])
    most = roots([p for p in close if p in like])
    assert all(comp[i] == comp[r] for i, r in enumerate(sure))  # these always meet
    assert all(most[i] == most[c] for i, c in comp.items())  # nothing else is a link
    assert sum(comp[i] == i for i in comp) <= sum(r == i for i, r in enumerate(most)) + 3


def test_one_fingerprint_with_other_shingles_is_no_copy(spark):
    often = "a b c d e " * 40
    rows = [(0, often + "some tail of words"), (1, often + " ".join(f"other{i}" for i in range(60))), (2, often + "some tail of words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r[0] for r in simhash.keep_representatives(df).collect()) == [0, 1]


def test_long_text_is_read_in_slices():
    text = " ".join(f"w{i % 977}" for i in range(simhash.SLICE + 500)).encode()
    whole = simhash.fingerprint_bytes(text, 4, 42)[0]
    old, simhash.SLICE = simhash.SLICE, 1000
    try:
        assert simhash.fingerprint_bytes(text, 4, 42)[0] == whole
    finally:
        simhash.SLICE = old


def similar_pairs(texts):
    """All pairs of texts at a similarity of 0.8 or more, through an inverted index of every shingle."""
    sets, held, pairs = [shingles(t) for t in texts], {}, []
    for i, own in enumerate(sets):
        common = Counter(j for s in own for j in held.get(s, ()))
        pairs += [(i, j) for j, n in common.items() if 10 * n >= 8 * (len(own) + len(sets[j]) - n)]
        for s in own:
            held.setdefault(s, []).append(i)
    return pairs


def test_stage_recall_against_all_pairs(spark):
    """Real texts with copies spread over the similarities from 0.8 up: few links are lost, none is wrong."""
    rnd, texts = random.Random(11), []
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        words = (r.text or "").lower().split()
        texts.append(" ".join(words))
        if len(words) >= 60:
            for _ in range(2):
                copy = list(words)
                for at in rnd.sample(range(len(copy)), max(1, int(len(copy) * rnd.uniform(0.002, 0.024)))):
                    copy[at] = f"x{rnd.randrange(10**9)}"
                texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    pairs = similar_pairs(texts)
    low = [p for p in pairs if len(shingles(texts[p[0]]) & shingles(texts[p[1]])) < 0.9 * len(shingles(texts[p[0]]) | shingles(texts[p[1]]))]
    assert len(pairs) > 800 and len(low) > 400
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    comp = {r[0]: r[1] for r in simhash.near_duplicates_wide(df, **simhash.STAGE).collect()}
    assert all(find(i) == find(c) for i, c in comp.items())  # no wrong link
    lost = sum(comp[i] != comp[j] for i, j in pairs)
    assert lost <= 0.01 * len(pairs), f"{lost} of {len(pairs)}"


def test_rows_without_an_id_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (None, text + " x"), (None, "another text altogether"), (None, text), (4, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r[0], r[1]) for r in simhash.keep_representatives(df).collect()]
    assert sorted(kept, key=str) == sorted([x for x in rows if x[0] != 4], key=str)
