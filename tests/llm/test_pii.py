import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docledger.llm import pii

from llm_data import prose

SAMPLES = [
    "a@b.c", "x.y+z@d-e.co.uk.", "@a.b", "a@b", "a@b.c_d@e.f", "q@@r.s", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "01.002.3.04", "1.2.3.", "4539 1488 0343 6467",
    "4539-1488-0343-6467", "4539148803436467", "123456789012", "+1 (017) 555-7713", "+49 89 1234567.", "+1 2", "++12345678901", "+12345678901234567", "漢字@x.y", "ü +1 555 123 4567 1.1.1.1",
]


KINDS = ["email", "ip", "card", "phone"]
PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and checked(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
]


def checked(digits):
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return (sum(int(c) for c in digits[-1::-2]) + sum(twice[int(c)] for c in digits[-2::-2])) % 10 == 0


def plain(text):
    """The base by the contract's patterns: counts by kind, and the digest."""
    found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok(m.group()))
    told = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
    return (*(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(told.encode()).hexdigest())


@settings(max_examples=300)
@given(st.lists(st.one_of(st.sampled_from(SAMPLES), st.text(alphabet="0123456789 .-+@ab_%()é", max_size=12)), max_size=8), st.sampled_from([" ", "", "\n"]))
def test_base_against_plain_patterns(parts, sep):
    text = sep.join(parts)
    spans = pii.base_spans(text.encode())[1]
    told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert plain(text) == (*(sum(k == x for _, k, _ in spans) for x in range(4)), hashlib.sha256(told.encode()).hexdigest())


def test_long_runs_are_read_in_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+" * 300_000, "1 " * 150_000, "a@" * 150_000):
        pii.base_spans((text + "@ 1").encode())


def planted(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, 40)) for i in range(120)]
    for i in range(0, 20, 2):
        rows[i] = (i, f"{rows[i][1]} Zephyrine mail jo@corp.example today halfway")
    for i in range(60, 62):
        rows[i] = (i, rows[i][1] + " Zephyrine halfway")
    for i in range(70, 90):
        rows[i] = (i, rows[i][1] + " halfway")
    rows += [(200, None), (201, ""), rows[0], (None, "nobody 1.2.3.4")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_revealing_terms_against_counts(spark):
    rows, df = planted(spark)
    texts = [set(w.lower() for w in (t or "").replace("@", " ").replace(".", " ").split()) for _, t in rows]
    n, with_it = len(rows), [i for i, (_, t) in enumerate(rows) if t and "jo@corp" in t]
    want = {}
    for w in set().union(*texts):
        have = [i for i, t in enumerate(texts) if w in t]
        both = len(set(have) & set(with_it))
        if both >= 3:
            d = math.log(n * both / (len(have) * len(with_it))) / math.log(n / len(with_it))
            if d >= 0.9:
                want[w] = d
    got = pii.revealing_terms(df.selectExpr("doc_id", "cast(coalesce(text, '') as binary) as text"), 0.9, 0.97, 3)
    assert sorted(round(r.disclosure, 9) for r in got.collect()) == sorted(round(x, 9) for x in want.values())
    assert "zephyrine" in want and "halfway" not in want


def test_short_terms_reveal_too(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 40) + " it") for i in range(100)]
    for i in range(8):
        rows[i] = (i, f"Kim Q in 17: {rows[i][1]} call kim@corp.example")
    rows[8] = (8, "Kim Q in 17 " + rows[8][1])
    out = {r.doc_id: r for r in pii.sanitised(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i in range(9):
        words = out[i].clean_text.replace(":", " ").split()
        assert not {"Kim", "Q", "17"} & set(words) and "it" in words
    assert out[50].clean_text == rows[50][1]


def test_spans_text_and_chunks(spark):
    rows, df = planted(spark)
    out = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert "Zephyrine" not in out[60].clean_text and "halfway" in out[60].clean_text
    assert "[EMAIL]" in out[0].clean_text and "corp.example" not in out[0].clean_text
    texts = dict(rows)
    for d, r in out.items():
        last = 0
        for s in r.spans:
            assert s.start < s.end <= len(texts[d] or "")
            if s.kind in ("remove", "generalise"):
                assert all(s.end <= b.start or b.end <= s.start for b in r.spans if b is not s)
            assert s.start >= last
            last = s.start
    whole = sorted(map(str, pii.digest(df).collect()))
    assert sorted(map(str, pii.digest(df, chunk_terms=1).collect())) == whole


def test_digest_and_defined_cases(spark, docs, none, odd):
    rows, df = planted(spark)
    got = sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in pii.digest(df).collect())
    assert got == sorted(str((d, *plain(t))) for d, t in rows)
    assert pii.digest(docs).count() == docs.count()
    assert pii.digest(none).count() == 0
    assert pii.digest(odd).count() == 6


def test_generalised_terms_get_their_class(spark):
    assert [pii.coarser(x) for x in ("17", "b2", "Kim", "kim", "Ünal")] == ["[NUMBER]", "[CODE]", "[NAME]", "[WORD]", "[NAME]"]
    rows, df = planted(spark)
    out = {r.doc_id: r for r in pii.sanitised(df, generalise=0.9, remove=2.0).collect()}
    assert "[NAME]" in out[60].clean_text and "Zephyrine" not in out[60].clean_text


def test_bytes_that_are_not_utf8(spark):
    raw = [(0, b"\xff\xfe mail me@x.example \xc3"), (1, b"plain 1.2.3.4"), (2, b"\xc3")]
    df = spark.createDataFrame(raw, "doc_id bigint, b binary").selectExpr("doc_id", "cast(b as string) as text")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert got[0].n_email == 1 and got[1].n_ip == 1
    for i, b in raw:
        assert got[i].base_sha256 == plain(b.decode(errors="replace"))[4]


def test_many_entities_in_one_text(spark):
    """Entities of too few documents make no pairs with terms."""
    many = " ".join(f"u{i}@x{i}.example" for i in range(3000))
    rows = [(0, many)] + [(i, f"Zephyrine writes jo@corp.example {prose(random.Random(i), 30)}") for i in range(1, 6)] + [(i, prose(random.Random(i), 30)) for i in range(6, 60)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].n_email == 3000 and "remove" in got[1].spans
