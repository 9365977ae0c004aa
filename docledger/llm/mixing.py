"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Each source has a mean repetition rate: its target share of the total over its present
share. A document's uniform number comes from a hash of the seed and its doc_id; the
Poisson distribution function of its source's rate is inverted at it, the document is
exploded by that count, and the copies are put in the order of a second hash.

Defined cases: a null source is a source of its own; sources without a target weight get
weight 0 when a weight table is given; repeated rows and rows sharing a doc_id get the
same count; a null doc_id hashes as an empty string; a null or empty text has size 0 (a
source of total size 0 has rate 1); an empty table gives an empty result. Columns of the
input pass through unchanged, whatever their names; an added column whose name the input
has already gets underscores appended until it is free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm._columns import free, own
from docledger.plans.storage import materialize

#: A source's rate is exact; its distribution is tabulated to where 2^-52 of it is left.
HASH_DIGITS = 13
#: Characters of the mix that one output partition should hold.
PART_CHARS = 16_000_000
#: Sources whose tabulated distributions (about 1 kB for a small rate) may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from MD5 of the seed and the parts."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, total: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, size, rate)``. Without ``weights`` (source, weight) the target weight is size ** power.

    Sizes are characters; ``total`` is the wanted size of the mix, by default that of the input.
    """
    size = F.coalesce(F.length(own(text_col)).cast("bigint"), F.lit(0))
    by = docs.select(own(source_col).alias("source"), size.alias("n")).groupBy("source").agg(F.sum("n").alias("size"))
    if weights is None:
        by = by.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        by = by.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    by = materialize(by, "mix-sources")  # one row per source, read again instead of the documents
    all_weight, all_size = by.agg(F.sum("weight"), F.sum("size").cast("double")).first()
    want = F.lit(float(total if total is not None else all_size or 0.0))
    rate = F.when((F.col("size") > 0) & F.lit((all_weight or 0.0) > 0), F.col("weight") / F.lit(all_weight or 1.0) * want / F.col("size")).otherwise(1.0)
    return by.select("source", "size", rate.alias("rate"))


#: Above this rate the distribution is tabulated from 12 deviations and 25 below it, where exp(-70) of it is left.
FROM_ZERO = 256.0


def lowest(rate: Column) -> Column:
    """The count at which the table of a rate's distribution begins."""
    return F.when(rate > FROM_ZERO, F.floor(rate - 12 * F.sqrt(rate) - 25)).otherwise(0).cast("bigint")


def distribution(rate: Column) -> Column:
    """Poisson distribution function at lowest(rate), lowest(rate) + 1, ... as an array, long enough for 52-bit numbers.

    exp(-rate) is 0 above about 700, so a large rate's first probability comes from its logarithm,
    with Stirling's series for the factorial; the count is then 39 at least.
    """
    low = lowest(rate).cast("double")
    top = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("bigint")
    series = 1 / (12 * low) - 1 / (360 * F.pow(low, 3)) + 1 / (1260 * F.pow(low, 5))
    begun = F.exp(low - rate + low * F.log1p((rate - low) / low) - 0.5 * F.log(2 * math.pi * low) - series)
    first = F.when(low > 0, begun).otherwise(F.exp(-rate))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s, k):
        p = s["p"] * rate / k.cast("double")
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(s["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(lowest(rate) + 1, top), start, step, lambda s: s["all"])


def mixed(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, total: float | None = None, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy", key_col: str = "mix_key", part_chars: int = PART_CHARS) -> DataFrame:
    """The input's rows once for each copy, plus ``copy`` (from 0) and ``mix_key``, in the order of mix_key.

    The keys are uniform, so a row's partition follows from its key alone: no pass samples the
    rows for range bounds, and the number of partitions follows the size of the mix.
    """
    rate = rates(docs, weights, power, total, source_col, text_col)
    table = rate.select("source", lowest(F.col("rate")).alias("low"), distribution(F.col("rate")).alias("cdf"))
    row = F.struct(*[own(c) for c in docs.columns])
    inner = docs.select(row.alias("row"), own(id_col).cast("bigint").alias("id"), own(source_col).alias("own"))
    joined = inner.join(F.broadcast(table), F.col("own").eqNullSafe(F.col("source"))) if rate.count() <= BROADCAST_SOURCES else inner.join(table, F.col("own").eqNullSafe(F.col("source")))
    u = uniform(seed, F.col("id"))
    drawn = joined.withColumn("u", u).select("row", "id", (F.size(F.filter("cdf", lambda c: c <= F.col("u"))) + F.col("low")).cast("int").alias("k"))
    copies = drawn.where("k > 0").select("row", "id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("copy"))
    keyed = copies.select("row", F.col("copy").cast("bigint").alias("copy"), uniform(f"{seed}/order", F.col("id"), F.col("copy")).alias("key"), "id")
    size = rate.agg(F.sum(F.col("rate") * F.col("size"))).first()[0] or 0.0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / part_chars))
    placed = keyed.repartitionById(n, F.floor(F.col("key") * n).cast("int")).sortWithinPartitions("key", "id", "copy")
    added = free(copy_col, docs.columns)
    return placed.select(*[own(c, "row").alias(c) for c in docs.columns], F.col("copy").alias(added), F.col("key").alias(free(key_col, [*docs.columns, added])))


ORACLE = """
WITH s AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size FROM documents GROUP BY source),
     w AS (SELECT source, size, sqrt(CAST(size AS DOUBLE)) AS weight FROM s),
     a AS (SELECT sum(weight) AS all_weight, CAST(sum(size) AS DOUBLE) AS all_size FROM w),
     r AS (SELECT source, CASE WHEN size > 0 THEN weight / all_weight * all_size / size ELSE 1.0 END AS rate FROM w, a),
     d AS (
        SELECT d.*, r.rate,
               CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
        FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
     c AS (
        SELECT doc_id, text, lang, source, n_chars, len(list_filter(
                 list_transform(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 25) AS BIGINT) + 1),
                   lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate + j * ln(rate) - lgamma(CAST(j + 1 AS DOUBLE)))))),
                 lambda x: x <= u)) AS k
        FROM d),
     e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, k)) AS copy FROM c)
SELECT doc_id, text, lang, source, n_chars, copy,
       CAST(CAST('0x' || substr(md5('mix-1/order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS mix_key
FROM e
"""
