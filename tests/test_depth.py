"""Inputs past the sizes at which rules once gave up."""

import decimal

from pyspark.sql import functions as F

from docledger.operators import forms, merkle, validate
from docledger.sources import geometry


def test_long_chains_are_no_cycles(spark):
    rows = [(1, f"f{i}", f"f{i + 1}") for i in range(3000)]  # a chain
    rows += [(2, f"f{i}", f"f{(i + 1) % 700}") for i in range(700)]  # a ring
    rows += [(3, "a", "a"), (4, "a", "b"), (4, "c", "b"), (None, "a", "a"), (5, "a", "b"), (5, "b", "x"), (5, "c", "d"), (5, "d", "c")]
    got = validate.field_cycles(spark.createDataFrame(rows, "doc_id bigint, field_id string, ref string"))
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 5]


def test_two_columns_with_many_gaps():
    """200 narrow words on the left, the gutter on the right."""
    frags = [geometry.Fragment(10 + 30.0 * i, 700 - 14 * k, 2, "w") for k in range(5) for i in range(200)]
    frags += [geometry.Fragment(6300, 700 - 14 * k, 2, "right") for k in range(5)]
    cut = geometry.column_cut(frags)
    assert cut is not None
    wide = [geometry.Fragment(0, 800, 10, "x" * 120)]
    two = [geometry.Fragment(x, 700 - 14 * k, 10, "some words here") for k in range(6) for x in (0, 300)]
    assert 75 < geometry.column_cut([*wide, *two]) < 300  # a title may cross
    assert geometry.column_cut([geometry.Fragment(0, 800 - 14 * k, 10, "x" * 120) for k in range(7)] + two) is None  # more cross than support
    texts = [t for _, _, t in geometry.page_blocks([*wide, *two])]
    assert texts[0] == "x" * 120 and len(texts) == 3


def test_numbers_show_all_digits_and_no_exponent(spark):
    xs = [1e-13, 1.2345678901234568e-05, 0.1, 0.002, 8.41e21, 1e300, 5e-324, 1.5, -2.25, 123456.789, 1e15, 123456789012345680.0, -3.3333333333e-7, 1234567.1, 2.0**53, 0.30000000000000004, 1e22, -7.0]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(forms.number_text(F.col("x")).alias("t")).collect()]
    for x, t in zip(xs, got, strict=True):
        want = format(decimal.Decimal(repr(x)), "f")
        assert t == (want.rstrip("0").rstrip(".") if "." in want else want)


def test_consistency_of_trees_over_several_steps(spark):
    import hashlib

    n = 2100
    entries = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]

    def root(e):
        if len(e) == 1:
            return hashlib.sha256(b"\0" + e[0]).digest()
        k = 1 << (len(e) - 1).bit_length() - 1
        return hashlib.sha256(b"\1" + root(e[:k]) + root(e[k:])).digest()

    levels = merkle.levels(spark.createDataFrame(list(enumerate(entries)), "idx bigint, entry binary"))
    assert merkle.head(levels).first()["root"] == root(entries).hex()
    sizes = [1, 2, 3, 6, 1000, 1023, 1024, 1025, 2048, 2099]
    path = {m: [None] * len(merkle.consistency_proof(m, n)) for m in sizes}
    for r in merkle.consistency_proofs(levels, sizes, n).collect():
        path[r.m][r.step] = r.hash
    rows = [(m, n, root(entries[:m]).hex(), root(entries).hex(), p, True) for m, p in path.items()]
    rows += [(m, n, "00" * 32, end, p, False) for m, _, _, end, p, _ in rows[: len(sizes)]]
    rows += [(m, n, begin, end, ["11" * 32, *p[1:]], False) for m, _, begin, end, p, _ in rows[: len(sizes)]]
    rows += [(n, n, root(entries).hex(), root(entries).hex(), [], True), (n + 1, n, "", "", [], False)]
    proofs = spark.createDataFrame(rows, "m bigint, n bigint, root_m string, root_n string, path array<string>, want boolean")
    assert all(r.ok == r.want for r in merkle.verify_consistency(proofs).collect())
