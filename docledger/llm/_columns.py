"""Column names that an operator adds or uses inside, beside whatever names its input has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores appended until no column has it; case does not matter, as in Spark."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def own(name: str, inside: str = "") -> Column:
    """The column (or the field of struct ``inside``) with exactly this name."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{inside}.{quoted}" if inside else quoted)


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``docs.mapInArrow(run, docs.schema)`` for any column names; ``run`` goes by position."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
