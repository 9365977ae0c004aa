import math
import random
import re
from collections import Counter

import pytest

from docledger.llm import decontaminate as dc

from llm_data import prose


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(11)
    return [(i, prose(rnd, rnd.randint(12, 40)) + ". " + prose(rnd, 4) + ".") for i in range(60)] + [(60, ""), (61, None), (62, "one")]


def full_scores(index, terms):
    """BM25 shares of every item, by adding up all postings."""
    out = {}
    for k in terms:
        for i, x in zip(index.items[k], index.impacts[k], strict=True):
            out[i] = out.get(i, 0.0) + x
    return out


@pytest.mark.parametrize("least", [0.1, 0.3, 0.65, 0.9])
def test_wand_finds_all_above_the_threshold(items, least):
    index = dc.Index([(i, *dc.split_item(t)) for i, t in items])
    rnd = random.Random(3)
    for _ in range(60):
        words = dc.words_of(prose(rnd, 60) + " " + rnd.choice(items[:60])[1])
        terms = sorted({index.terms[w] for w in words if w in index.terms})
        want = {i: s for i, s in full_scores(index, terms).items() if s >= least}
        got = dict(index.retrieve(terms, least))
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_bounds_lose_no_passage(items):
    index = dc.Index([(i, *dc.split_item(t)) for i, t in items])
    rnd = random.Random(4)
    texts = [(prose(rnd, rnd.randint(0, 400)) + " " + (rnd.choice(items[:60])[1] if rnd.random() < 0.7 else "")).encode() for _ in range(40)] + [b"", None]
    seen = {}
    for i, j, terms in index.passages(texts, 0.65):
        seen[i, j] = terms
    for i, t in enumerate(texts):
        words = dc.words_of(t)
        n = -(-len(words) // index.chunk)
        for j in range(max(n - 1, 1 if n else 0)):
            span = words[j * index.chunk : (j + 2) * index.chunk]
            terms = sorted({index.terms[w] for w in span if w in index.terms})
            if max(full_scores(index, terms).values(), default=0) >= 0.65:
                assert seen[i, j] == terms


def test_planted_items_are_found_and_clean_documents_left(spark, items, none, odd, docs):
    rnd = random.Random(5)
    rows, want = [], set()
    for i in range(80):
        text = prose(rnd, rnd.randint(20, 300))
        if i % 4 == 0:
            k = rnd.randrange(60)
            cut = rnd.randrange(len(text))
            text = f"{text[:cut]}\n{items[k][1].upper().replace(' ', ', ')} {text[cut:]}"
            want.add((i, k))
        rows.append((i, text))
    df = spark.createDataFrame([*rows, (100, None), (101, ""), rows[0], (None, items[0][1])], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows_of = dc.item_rows(bench)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, rows_of).collect()}
    assert got == want | {(None, 0)}
    assert dc.contaminated(df, rows_of).count() == len(got)
    kept = [r.doc_id for r in dc.clean(df, rows_of).collect()]
    assert set(kept) == {i for i in range(80) if i % 4} | {100, 101}
    sharded = {(r.doc_id, r.item_id) for r in dc.contaminated(df, rows_of, max_items=17).collect()}
    assert sharded == got
    assert dc.contaminated(none, rows_of).count() == 0
    assert dc.contaminated(df, rows_of.where("false")).count() == 0
    assert dc.clean(odd, rows_of).columns == odd.columns


def test_question_and_answer_columns(spark):
    q = spark.createDataFrame([(1, "what is the tall blue tower made of today", "plain grey stone and glass panes")], "item_id bigint, question string, answer string")
    items = dc.item_rows(q, text_col="question", question_col="question", answer_col="answer")
    only = "what is the tall blue tower made of today asked someone"
    df = spark.createDataFrame([(1, only), (2, only + " plain grey stone and glass panes")], "doc_id bigint, text string")
    assert [r.doc_id for r in dc.contaminated(df, items, retrieve=0.4).collect()] == [2]


def plain(docs, items, retrieve=0.65, overlap=0.8, k=5):
    """The operator's definition without an index: (doc, item) -> (score, question, answer) by every passage against every item."""
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parts = {}
    for i, t in items:
        sentences = re.split(r"(?<=[.!?])\s+", (t or "").strip())
        q, a = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (t or "", "")
        if word(q) or word(a):
            parts[i] = (word(q), word(a))
    n, mean = len(parts), sum(len(q + a) for q, a in parts.values()) / max(1, len(parts))
    df = Counter(w for q, a in parts.values() for w in set(q + a))
    weight = {}
    for i, (q, a) in parts.items():
        tf = Counter(q + a)
        weight[i] = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(q + a) / mean)) for w, c in tf.items()}
    chunk = max([64, *(len(q + a) for q, a in parts.values())])
    out = {}
    for d, t in docs:
        words = word(t)
        chunks = -(-len(words) // chunk)
        for j in range(max(chunks - 1, min(chunks, 1))):
            span = words[j * chunk : (j + 2) * chunk]
            have, held = set(span), {tuple(span[i : i + k]) for i in range(max(1, len(span) - k + 1))}

            def covered(part, span=span, held=held):
                own = grams(part)
                if not own:
                    return 1.0
                if len(part) < k:
                    return float(any(span[i : i + len(part)] == part for i in range(len(span))))
                return len(own & held) / len(own)

            for i, own in weight.items():
                score = sum(x for w, x in own.items() if w in have) / sum(own.values())
                if score >= retrieve - 1e-9:
                    got = (score, *map(covered, parts[i]))
                    if got[1] >= overlap and got[2] >= overlap:
                        out[d, i] = tuple(max(a, b) for a, b in zip(out.get((d, i), (0, 0, 0)), got, strict=True))
    return out


@pytest.mark.parametrize("retrieve", [0.65, 0.3])
def test_whole_tables_against_a_plain_version(spark, retrieve):
    path = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 400"), spark.read.parquet(f"{path}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], retrieve)
    got = {(r.doc_id, r.item_id): r[2:] for r in dc.contaminated(docs, dc.item_rows(bench), retrieve=retrieve).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x]) for x in want)
    sharded = {(r.doc_id, r.item_id): r[2:] for r in dc.contaminated(docs, dc.item_rows(bench), retrieve=retrieve, max_items=6).collect()}
    assert sharded.keys() == want.keys()  # several indexes in one scan
