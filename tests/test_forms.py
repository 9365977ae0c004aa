import math

import pytest
from pyspark.sql import functions as F

from docledger.operators import forms
from docledger.operators.forms import ExprError, Field, compile_expr, of_column


def value(spark, expr, **fields):
    """(kind, payload, error) of an expression over one form."""
    kinds = {float: ("num", "double"), str: ("str", "string"), bool: ("bool", "boolean"), type(None): ("num", "double")}
    schema = ", ".join(f"{k} {kinds[type(v)][1]}" for k, v in fields.items()) or "x int"
    df = spark.createDataFrame([tuple(fields.values()) or (1,)], schema)
    env = {k: of_column(F.col(k), kinds[type(v)][0]) for k, v in fields.items()}
    cell = compile_expr(expr, env)
    r = df.select(cell.struct().alias("c"), forms.to_text(cell).alias("text")).first()
    c = r.c
    return c.kind, {"num": c.num, "str": c.str, "bool": c.bool, "empty": None}[c.kind], c.err, r.text


A = {"$": "a"}


@pytest.mark.parametrize(
    ("expr", "fields", "want"),
    [
        (["/", 1, 0], {}, math.inf),
        (["/", -1, 0], {}, -math.inf),
        (["/", 1, -0.0], {}, -math.inf),
        (["+", A, 2], {"a": None}, 2.0),
        (["-", 10, 3, 2], {}, 5.0),
        (["min", float("nan"), 3], {}, 3.0),
        (["max", 3, float("nan")], {}, 3.0),
        (["round", 2.5], {}, 2.0),
        (["round", 3.5], {}, 4.0),
        (["round", -2.5], {}, -2.0),
        (["=", float("nan"), float("nan")], {}, False),
        (["!=", float("nan"), float("nan")], {}, True),
        (["=", A, {"$": "b"}], {}, True),
        (["=", A, 0], {"a": None}, False),
        (["<", float("nan"), 1], {}, False),
        (["<", "B", "a"], {}, True),
        (["and", True, False], {}, False),
        (["or", False, True], {}, True),
        (["or", True, A], {"a": 1.0}, True),
        (["and", False, A], {"a": 1.0}, False),
        (["if", [">", A, 1], "big", 0], {"a": 2.0}, "big"),
        (["match", A, ["4", 1], ["5", 2], 0], {"a": 5.0}, 2.0),
        (["match", A, ["", 1], 0], {"a": None}, 1.0),
        (["regex-valid", A, "[0-9]+"], {"a": "12\n"}, False),
        (["regex-valid", A, "a|ab"], {"a": "ab"}, True),
    ],
)
def test_values(spark, expr, fields, want):
    kind, got, err, _ = value(spark, expr, **fields)
    assert err is None
    assert got == want or (isinstance(want, float) and math.isnan(want) and math.isnan(got))


def test_nan_and_negative_zero(spark):
    assert math.isnan(value(spark, ["/", 0, 0])[1])
    assert math.copysign(1, value(spark, ["round", -0.4])[1]) == 1


@pytest.mark.parametrize("expr", [["+", A, 1], ["not", A], ["<", A, 1], ["if", A, 1, 2], ["and", A], ["or", False, A]])
def test_kind_errors(spark, expr):
    assert value(spark, expr, a="x")[2]


@pytest.mark.parametrize(("x", "text"), [(4.0, "4"), (-0.5, "-0.5"), (1e14, "100000000000000"), (0.1, "0.1"), (float("inf"), "inf")])
def test_number_text(spark, x, text):
    assert value(spark, A, a=x)[3] == text


@pytest.mark.parametrize("bad", [["+", 1], ["round", 1, 2], ["regex-valid", A, "(a)\\1"], ["regex-valid", A, "(?=a)"], ["nope", 1], [], {"x": 1}, ["match", A], ["regex-valid", A, "a" * 1001]])
def test_malformed(bad):
    with pytest.raises(ExprError):
        compile_expr(bad, {})


def test_limits():
    deep = 1
    for _ in range(70):
        deep = ["round", deep]
    with pytest.raises(ExprError, match="deep"):
        compile_expr(deep, {})
    with pytest.raises(ExprError, match="large"):
        compile_expr(["+", *[["+", *range(100)] for _ in range(101)]], {})


def test_dependency_order_and_cycles():
    r = lambda x: {"$": x}
    order = forms.dependency_order({"c": ["+", r("b"), 1], "b": ["+", r("a"), r("in")], "a": 1})
    assert order.index("a") < order.index("b") < order.index("c")
    with pytest.raises(ExprError, match="cycle"):
        forms.dependency_order({"a": r("b"), "b": r("a"), "c": 1})


def test_violations_fill_and_flatten(spark):
    fs = [Field("qty", "number", required=True, constraint=[">=", {"$": "qty"}, 1]), Field("note", "text", constraint=["regex-valid", {"$": "note"}, "x+"]), Field("total", "number", computed=["*", {"$": "qty"}, 9.5])]
    df = spark.createDataFrame([(1, 4.0, None), (2, None, "xx"), (3, 0.0, "y"), (4, 2.0, "x")], "k int, q double, n string")
    got = {(r.k, r.field, r.message) for r in forms.violations(df, fs, {"qty": "q", "note": "n"}, "k").collect()}
    assert got == {(2, "qty", "required field is empty"), (3, "qty", "constraint violated"), (3, "note", "constraint violated")}
    flat = sorted((r.k, r.ord, r.text) for r in forms.flatten(df, fs, {"qty": "q", "note": "n"}, "k").collect())
    assert flat == [(1, 0, "4"), (1, 1, ""), (1, 2, "38"), (4, 0, "2"), (4, 1, "x"), (4, 2, "19")]
    layer = "doc_id int, field_id string, kind string, num double, str string, bool boolean"
    old = spark.createDataFrame([(1, "qty", "num", 1.0, None, None), (1, "note", "str", None, "x", None)], layer)
    new = spark.createDataFrame([(1, "qty", "num", 7.0, None, None), (1, "note", "empty", None, None, None), (1, "who", "str", None, "z", None), (2, "qty", "str", None, "7", None)], layer)
    got = {(r.doc_id, r.field_id): (r.num, r.problem) for r in forms.fill(old, new, fs).collect()}
    assert got == {(1, "qty"): (7.0, None), (1, "who"): (None, "unknown field"), (2, "qty"): (None, "wrong kind")}
