"""The form expression language, compiled to Spark columns.

An expression is JSON: a number, string or boolean literal; ``{"$": field}``; or an
operation ``[op, ...]``. ``compile_expr`` turns it once into a ``Cell`` of columns, which Catalyst
then optimises and generates code for over all rows: each row is one filled form.

A cell is one of four kinds (num, str, bool, empty) or an error. Empty is a value, not
SQL null: it counts as 0 in arithmetic and equals itself. Division follows IEEE 754.
Branches that are not reached raise nothing, which ``when`` guarantees and SQL AND does not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, MAX_PATTERN = 64, 10_000, 1_000
NEEDS_NUMBER, NEEDS_BOOLEAN = "expected a number", "expected a boolean"
NEEDS_PAIR = "ordered comparison requires two numbers or two strings"


class ExprError(ValueError):
    """The expression is not well-formed."""


@dataclass
class Cell:
    """Columns of a value: its kind, payloads, and an error message or null."""

    kind: Column
    num: Column
    text: Column
    flag: Column
    err: Column

    def pick(self, cond: Column, other: Cell) -> Cell:
        return Cell(*(F.when(cond, a).otherwise(b) for a, b in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[Column, ...]:
        return self.kind, self.num, self.text, self.flag, self.err

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip(("kind", "num", "str", "bool", "err"), self.parts(), strict=True)))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def number(c: Column, err: Column | None = None) -> Cell:
    return Cell(F.lit("num"), c.cast("double"), _null("string"), _null("boolean"), err if err is not None else _null("string"))


def string(c: Column) -> Cell:
    return Cell(F.lit("str"), _null("double"), c.cast("string"), _null("boolean"), _null("string"))


def boolean(c: Column, err: Column | None = None) -> Cell:
    return Cell(F.lit("bool"), _null("double"), _null("string"), c.cast("boolean"), err if err is not None else _null("string"))


def empty() -> Cell:
    return Cell(F.lit("empty"), _null("double"), _null("string"), _null("boolean"), _null("string"))


def of_column(c: Column, kind: str) -> Cell:
    """A nullable column of a field; null is Empty."""
    return {"num": number, "str": string, "bool": boolean}[kind](c).pick(c.isNotNull(), empty())


def cell_of(c: Column) -> Cell:
    return Cell(c["kind"], c["num"], c["str"], c["bool"], c["err"])


def _as_num(c: Cell) -> tuple[Column, Column]:
    bad = F.when(c.kind.isin("num", "empty"), _null("string")).otherwise(NEEDS_NUMBER)
    return F.coalesce(c.num, F.lit(0.0)), F.coalesce(c.err, bad)


def _as_bool(c: Cell) -> tuple[Column, Column]:
    return F.coalesce(c.flag, F.lit(False)), F.coalesce(c.err, F.when(c.kind == "bool", _null("string")).otherwise(NEEDS_BOOLEAN))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives a signed infinity or NaN."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def round_even(x: Column) -> Column:
    """Half to even, never negative zero."""
    return F.rint(x) + F.lit(0.0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value's expression standing once in the plan, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def number_text(x: Column) -> Column:
    """Whole numbers below 1e15 without a point, others with all their shortest digits and never an exponent.

    A JVM may print more digits than needed, so forms of 1, 15 and 16 digits that read back as the number come first.
    """

    def shortest(v):
        return F.coalesce(*[F.when(F.format_string(f"%.{n}e", v).try_cast("double") == v, F.format_string(f"%.{n}e", v)) for n in (0, 14, 15)], v.cast("string"))

    def parts(shown):
        front, power = F.regexp_extract(shown, "^-?([0-9.]+)", 1), F.regexp_extract(shown, "[eE]([-+]?[0-9]+)$", 1)
        return F.struct(front.alias("front"), F.coalesce(F.when(power != "", power).cast("int"), F.lit(0)).alias("power"))

    def digits(p):
        raw = F.replace(p["front"], F.lit("."), F.lit(""))
        point = F.length(F.substring_index(p["front"], ".", 1)) + p["power"]
        bare = F.regexp_replace(raw, "^0+", "")  # leading zeros move the point
        return F.struct(F.regexp_replace(bare, "0+$", "").alias("d"), (point - F.length(raw) + F.length(bare)).alias("at"))

    def spelled(s):
        d, at, n = s["d"], s["at"], F.length(s["d"])
        mixed = F.concat(F.substring(d, F.lit(1), at), F.lit("."), F.substring(d, at + 1, n))
        return F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), d)).when(at >= n, F.concat(d, F.repeat(F.lit("0"), at - n))).otherwise(mixed)

    def text(v):
        odd = F.when(F.isnan(v), "NaN").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
        whole = (F.abs(v) < 1e15) & (v == F.floor(v))
        plain = F.concat(F.when(v < 0, "-").otherwise(""), _let(_let(_let(shortest(v), parts), digits), spelled))
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), odd).when(whole, F.when(whole, v).cast("bigint").cast("string")).otherwise(plain)

    return _let(x, text)


def to_text(c: Cell) -> Column:
    return F.when(c.kind == "str", c.text).when(c.kind == "num", number_text(c.num)).when(c.kind == "bool", c.flag.cast("string")).otherwise("")


def check_pattern(p: str) -> None:
    """Only the linear-time subset: no backreferences, no look-around, no possessive groups."""
    if len(p.encode()) > MAX_PATTERN:
        raise ExprError("pattern too long")
    if re.search(r"\\[1-9]|\\k<|\(\?[=!>]|\(\?<[=!]", p):
        raise ExprError("unsupported pattern")
    try:
        re.compile(p)
    except re.error as e:
        raise ExprError(f"bad pattern: {e}") from e


def _ref(v) -> str:
    if not isinstance(v, dict) or set(v) != {"$"} or not isinstance(v["$"], str):
        raise ExprError("expected a field reference")
    return v["$"]


def field_refs(e) -> list[str]:
    """Fields an expression reads, in order, with repeats."""
    if isinstance(e, dict):
        return [_ref(e)]
    if not isinstance(e, list):
        return []
    if e[:1] == ["match"]:
        return [_ref(e[1]), *(r for arm in e[2:-1] for r in field_refs(arm[1])), *field_refs(e[-1])]
    if e[:1] == ["regex-valid"]:
        return [_ref(e[1])]
    return [r for x in e[1:] for r in field_refs(x)]


def compile_expr(e, env: dict[str, Cell], depth: int = 0, budget: list[int] | None = None) -> Cell:
    """The cell of an expression over an environment of field cells."""
    budget = [0] if budget is None else budget
    budget[0] += 1
    if depth > MAX_DEPTH:
        raise ExprError("expression too deep")
    if budget[0] > MAX_NODES:
        raise ExprError("expression too large")
    sub = lambda x: compile_expr(x, env, depth + 1, budget)
    if isinstance(e, bool):
        return boolean(F.lit(e))
    if isinstance(e, int | float):
        return number(F.lit(float(e)))
    if isinstance(e, str):
        return string(F.lit(e))
    if isinstance(e, dict):
        return env.get(_ref(e), empty())
    if not isinstance(e, list) or not e or not isinstance(e[0], str):
        raise ExprError("an expression is a literal, a field reference or an operation")
    op, args = e[0], e[1:]
    if op in ARITHMETIC:
        _count(op, args, least=2)
        (acc, err), *rest = [_as_num(sub(a)) for a in args]
        for x, bad in rest:
            acc, err = ARITHMETIC[op](acc, x), F.coalesce(err, bad)
        return number(F.when(err.isNull(), acc), err)
    if op == "round":
        _count(op, args, 1)
        x, err = _as_num(sub(args[0]))
        return number(F.when(err.isNull(), round_even(x)), err)
    if op in ("=", "!="):
        _count(op, args, 2)
        a, b = sub(args[0]), sub(args[1])
        same = (a.kind == b.kind) & F.when(a.kind == "num", (a.num == b.num) & ~F.isnan(a.num)).when(a.kind == "str", a.text == b.text).when(a.kind == "bool", a.flag == b.flag).otherwise(True)
        same = F.coalesce(same, F.lit(False))
        return boolean(same if op == "=" else ~same, F.coalesce(a.err, b.err))
    if op in ORDERED:
        _count(op, args, 2)
        a, b = sub(args[0]), sub(args[1])
        nums, texts = (a.kind == "num") & (b.kind == "num"), (a.kind == "str") & (b.kind == "str")
        got = F.when(nums, ORDERED[op](a.num, b.num) & ~F.isnan(a.num) & ~F.isnan(b.num)).when(texts, ORDERED[op](a.text, b.text))
        return boolean(got, F.coalesce(a.err, b.err, F.when(nums | texts, _null("string")).otherwise(NEEDS_PAIR)))
    if op in ("and", "or"):
        _count(op, args, least=1)
        # from the last argument back: each decides, or leaves it to those after it
        flag, err = F.lit(op == "and"), _null("string")
        for x, bad in reversed([_as_bool(sub(a)) for a in args]):
            stop = ~x if op == "and" else x
            flag, err = F.when(stop, op == "or").otherwise(flag), F.coalesce(bad, F.when(~stop, err))
        return boolean(F.when(err.isNull(), flag), err)
    if op == "not":
        _count(op, args, 1)
        x, err = _as_bool(sub(args[0]))
        return boolean(F.when(err.isNull(), ~x), err)
    if op == "if":
        _count(op, args, 3)
        cond, bad = _as_bool(sub(args[0]))
        out = sub(args[1]).pick(cond, sub(args[2]))
        out.err = F.coalesce(bad, out.err)
        return out
    if op == "match":
        _count(op, args, least=2)
        text, out = to_text(env.get(_ref(args[0]), empty())), sub(args[-1])
        for arm in reversed(args[1:-1]):
            if not isinstance(arm, list) or len(arm) != 2 or not isinstance(arm[0], str):
                raise ExprError("a match arm is [pattern, expression]")
            out = sub(arm[1]).pick(text == arm[0], out)
        return out
    if op == "regex-valid":
        _count(op, args, 2)
        if not isinstance(args[1], str):
            raise ExprError("a pattern is a string")
        check_pattern(args[1])
        return boolean(to_text(env.get(_ref(args[0]), empty())).rlike(f"\\A(?:{args[1]})\\z"))
    raise ExprError(f"unknown operation {op!r}")


def _count(op: str, args: list, exact: int | None = None, least: int = 0) -> None:
    if (exact is not None and len(args) != exact) or len(args) < least:
        raise ExprError(f"{op} takes {exact if exact is not None else f'at least {least}'} arguments")


ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    "min": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b)),
    "max": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)),
}
ORDERED = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def dependency_order(computed: dict) -> list[str]:
    """Computed fields so that each comes after those it reads; a cycle names the fields in it."""
    left = {k: {r for r in field_refs(e) if r in computed} for k, e in computed.items()}
    out: list[str] = []
    while left:
        ready = [k for k, d in left.items() if not d]
        if not ready:
            raise ExprError(f"computed-field dependency cycle involving {sorted(left)}")
        out += ready
        left = {k: d - set(ready) for k, d in left.items() if k not in ready}
    return out


@dataclass
class Field:
    """A form field: kind is number, checkbox, or any text kind."""

    id: str
    kind: str = "text"
    label: str | None = None
    required: bool = False
    constraint: object = None
    computed: object = None


CELL_KINDS = {"number": "num", "checkbox": "bool"}


def with_cells(rows: DataFrame, fields: list[Field], columns: dict[str, str], prefix: str = "f_") -> DataFrame:
    """Adds a cell struct for every field, computed fields level by level in dependency order."""
    known = {f.id: f for f in fields}
    out = rows.select("*", *(of_column(F.col(columns[f.id]), CELL_KINDS.get(f.kind, "str")).struct().alias(prefix + f.id) for f in fields if f.id in columns and f.computed is None))
    for k in dependency_order({f.id: f.computed for f in fields if f.computed is not None}):
        env = {f: cell_of(F.col(prefix + f)) for f in known if prefix + f in out.columns}
        out = out.withColumn(prefix + k, compile_expr(known[k].computed, env).struct())
    return out


def violations(rows: DataFrame, fields: list[Field], columns: dict[str, str], key: str, prefix: str = "f_") -> DataFrame:
    """``(key, field, message)``: required fields that are empty, and constraints that do not hold."""
    cells = with_cells(rows, fields, columns, prefix)
    env = {f.id: cell_of(F.col(prefix + f.id)) for f in fields if prefix + f.id in cells.columns}
    found = []
    for f in fields:
        value, message = env.get(f.id, empty()), _null("string")
        if f.constraint is not None:
            c = compile_expr(f.constraint, env)
            verdict = F.when(c.err.isNotNull(), F.concat(F.lit("constraint evaluation failed: "), c.err))
            verdict = verdict.when(c.kind != "bool", "constraint did not evaluate to a boolean").when(~c.flag, "constraint violated")
            message = F.when(value.kind != "empty", verdict)
        if f.required and f.computed is None:
            message = F.when(value.kind == "empty", "required field is empty").otherwise(message)
        found.append(F.struct(F.lit(f.id).alias("field"), message.alias("message")))
    return cells.select(key, F.explode(F.array(*found)).alias("v")).where("v.message is not null").select(key, "v.field", "v.message")


def fill(old: DataFrame, new: DataFrame, fields: list[Field]) -> DataFrame:
    """Overlay of filled layers ``(doc_id, field_id, kind, num, str, bool)``; an Empty entry deletes.

    ``problem`` tells unknown fields and wrong kinds; such rows leave the old value.
    """
    kinds = F.create_map(*[x for f in fields for x in (F.lit(f.id), F.lit(CELL_KINDS.get(f.kind, "str")))])
    o = old.select("doc_id", "field_id", *(F.col(c).alias(f"o_{c}") for c in ("kind", "num", "str", "bool")))
    both = o.join(new.withColumn("given", F.lit(True)), ["doc_id", "field_id"], "full_outer")
    want = F.element_at(kinds, F.col("field_id"))
    problem = F.when(F.col("given") & want.isNull(), "unknown field").when(F.col("given") & (F.col("kind") != "empty") & (F.col("kind") != want), "wrong kind")
    both = both.withColumn("problem", problem)
    take = F.coalesce(F.col("given"), F.lit(False)) & F.col("problem").isNull()
    out = both.select("doc_id", "field_id", *(F.when(take, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in ("kind", "num", "str", "bool")), "problem")
    return out.where("problem is not null or coalesce(kind, 'empty') <> 'empty'")


def flatten(rows: DataFrame, fields: list[Field], columns: dict[str, str], key: str, prefix: str = "f_") -> DataFrame:
    """``(key, ord, text)``: each field as a paragraph of its text; forms with any violation are left out."""
    bad = violations(rows, fields, columns, key, prefix).select(key).distinct()
    cells = with_cells(rows, fields, columns, prefix).join(bad, key, "left_anti")
    texts = [F.struct(F.lit(i).cast("bigint").alias("ord"), to_text(cell_of(F.col(prefix + f.id))).alias("text")) for i, f in enumerate(fields)]
    return cells.select(key, F.explode(F.array(*texts)).alias("x")).select(key, "x.ord", "x.text")


def parse_typed(c: Column, kind: str) -> Cell:
    """A typed value from command text: numbers, true/false, or the text itself."""
    if kind == "number":
        x = F.expr("try_cast(null as double)") if c is None else c.try_cast("double")
        return number(x, F.when(x.isNull(), "expected a number"))
    if kind == "checkbox":
        x = F.when(F.lower(c).isin("true", "yes", "1"), True).when(F.lower(c).isin("false", "no", "0"), False)
        return boolean(x, F.when(x.isNull(), "expected a boolean"))
    return string(c)
