import math
import random
import re
import time

from docledger.llm import licenses as lic

from llm_data import prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_digest_base_against_the_definition(spark, docs, corpus, none, odd):
    more = [(900, "CC-BY by cc by; All rights\nreserved. cc  BY 4.0"), (901, "the GNU general public licenses general public license"), (902, "ccby all rights reservedé")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = []
    for d, t in [(r[0], r[1]) for r in corpus] + more:
        w, at, labels = words(t), [], set()
        for phrase, label in lic.PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        want.append(str((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))))
    got = lic.digest(df).collect()
    assert sorted(str(tuple(r[:6])) for r in got) == sorted(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert lic.digest(none).count() == 0
    assert lic.digest(odd).count() == 6


def plain(matcher_templates, threshold, text):
    """Every (template, block) by comparing all of them."""
    w, out = words(text), set()
    for k, (_, t) in enumerate(matcher_templates):
        need, size = set(words(t)), len(words(t))
        step = 1 << (size - 1).bit_length()
        for s in range(0, max(1, len(w)), step):
            block = w[s : s + 2 * step]
            share = len(need & set(block)) / len(need)
            if share >= threshold - 1e-12 and (s == 0 or s < len(w)):
                run = math.ceil(size / threshold)
                ordered = any(common(words(t), block[i : i + run]) >= threshold * size - 1e-9 for i in range(len(block)))
                out.add((k, s, round(share, 12), ordered))
    return out


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def test_join_finds_every_block(spark):
    rnd = random.Random(9)
    templates = lic.TEMPLATES + [("own", prose(rnd, 40)), ("own2", prose(rnd, 9))]
    rows = []
    for i in range(80):
        parts = [prose(rnd, rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            t = rnd.choice(templates)[1].split()
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = "other"
            parts += [" ".join(t), prose(rnd, rnd.randint(0, 50))]
        rows.append((i, "\n".join(parts)))
    df = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id bigint, text string")
    for threshold in (0.6, 0.9):
        got = {r.doc_id: {(b.template, b.start, round(b.containment, 12), b.ordered) for b in r.blocks} for r in lic.scans(df, templates, threshold).collect()}
        for i, t in rows:
            assert got[i] == plain(templates, threshold, t)
        assert got[500] == got[501] == set()


def test_notices_get_their_labels(spark):
    rows = [(i, f"some words before\n{t}\nand after") for i, (_, t) in enumerate(lic.TEMPLATES)]
    got = {r.doc_id: r.labels.split(",") for r in lic.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(lic.TEMPLATES))


def test_words_without_order_are_no_notice(spark):
    rows = [(0, "rights of all the people are reserved"), (1, "no license: all rights reserved"), (2, "Released to us under the strict MIT style License")]
    got = {r.doc_id: r for r in lic.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].labels == "" and got[0].score == 0
    assert got[1].labels == "reserved" and got[1].score == 1
    assert got[2].labels == ""


def test_many_places_take_linear_time():
    text = b"all rights reserved " * 100_000
    began = time.perf_counter()
    places = lic.base_places(text.split())
    assert [s for s, _ in places] == list(range(0, 300_000, 3))
    assert time.perf_counter() - began < 5
