"""Content-addressed store operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks_to_objects(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row ``(doc_id, ord, object_id, bytes, n_bytes)`` per line block.

    The id is the SHA-256 of the block's bytes. A null text has no blocks; an empty
    text has one empty block.
    """
    parts = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("ord", "block"))
    data = F.col("block").cast("binary")
    return parts.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.sha2(data, 256).alias("object_id"), data.alias("bytes"), F.octet_length("block").cast("bigint").alias("n_bytes"))


def dedup_report(objects: DataFrame) -> DataFrame:
    """Total against unique objects and bytes, and the share of bytes saved.

    Two-level aggregation: per id first (partial counts before the shuffle), then one
    row. An empty store reports zeros.
    """
    per_id = objects.groupBy("object_id").agg(F.count("*").alias("copies"), F.min("n_bytes").alias("n"))
    total = F.coalesce(F.sum(F.col("copies") * F.col("n")), F.lit(0))
    unique = F.coalesce(F.sum("n"), F.lit(0))
    out = per_id.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_objects"), F.count("*").alias("unique_objects"), total.alias("total_bytes"), unique.alias("unique_bytes"))
    saved = F.rint(1000.0 * (F.col("total_bytes") - F.col("unique_bytes")) / F.col("total_bytes")) / 10
    return out.withColumn("pct_saved", F.when(F.col("total_bytes") == 0, 0.0).otherwise(saved))


def distinct_objects(objects: DataFrame) -> DataFrame:
    """The store: one row per id."""
    return objects.groupBy("object_id").agg(F.min("n_bytes").alias("n_bytes"))


def verified_insert(claims: DataFrame) -> DataFrame:
    """``(claimed_id, bytes)`` -> the rows with ``reason``: null where the bytes hash to the claimed id."""
    got = F.sha2("bytes", 256)
    reason = F.when(F.col("bytes").isNull(), "no bytes").when(~F.col("claimed_id").rlike("^[0-9a-f]{64}$"), "bad id").when(got != F.col("claimed_id"), "id mismatch")
    return claims.withColumn("reason", reason)


def store_stats(objects: DataFrame) -> DataFrame:
    """Number of objects, references and bytes of a store."""
    per_id = objects.groupBy("object_id").agg(F.count("*").alias("refs"), F.min("n_bytes").alias("n"))
    return per_id.agg(F.count("*").alias("objects"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"))


def retain(objects: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects whose id is in ``keep``, ids purged)."""
    return objects.join(keep.select("object_id"), "object_id", "left_semi"), objects.join(keep.select("object_id"), "object_id", "left_anti").select("object_id").distinct()


def closure(edges: DataFrame, roots: DataFrame, max_depth: int = 256) -> DataFrame:
    """``(root, id)`` of everything reachable over ``edges(src, dst)``, roots themselves included.

    Semi-naive: each round joins only the newly found pairs and drops known ones, so a
    shared node is expanded once per root and a cycle ends.
    """
    from docledger.plans.storage import materialize

    new = materialize(roots.select(F.col("root"), F.col("root").alias("id")).distinct(), "closure")
    found, parts = new, [new]
    for _ in range(max_depth):
        step = new.join(edges, new.id == edges.src).select("root", F.col("dst").alias("id")).distinct()
        new = materialize(step.join(found, ["root", "id"], "left_anti"), "closure")
        if new.isEmpty():
            return found
        parts.append(new)
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
    raise ValueError(f"deeper than {max_depth}")


def orphans_and_missing(store: DataFrame, reachable: DataFrame) -> DataFrame:
    """``(id, verdict)``: in the store but unreachable, or reachable but not in the store."""
    s, r = store.select("id").distinct(), reachable.select("id").distinct()
    orphan = s.join(r, "id", "left_anti").select("id", F.lit("orphan").alias("verdict"))
    return orphan.union(r.join(s, "id", "left_anti").select("id", F.lit("missing").alias("verdict")))


def listing(objects: DataFrame, roots: DataFrame, reachable: DataFrame) -> DataFrame:
    """``(id, n_bytes, mark)``: ROOT, ORPHAN or an empty mark."""
    r = roots.select(F.col("id").alias("root_id")).distinct()
    c = reachable.select(F.col("id").alias("seen_id")).distinct()
    mark = F.when(F.col("root_id").isNotNull(), "ROOT").when(F.col("seen_id").isNull(), "ORPHAN").otherwise("")
    return objects.join(r, F.col("id") == F.col("root_id"), "left").join(c, F.col("id") == F.col("seen_id"), "left").select("id", "n_bytes", mark.alias("mark"))


def info(objects: DataFrame) -> DataFrame:
    """Per document: blocks, distinct blocks, bytes, and whether a block repeats."""
    per = objects.groupBy("doc_id", "object_id").agg(F.count("*").alias("c"), F.min("n_bytes").alias("n"))
    out = per.groupBy("doc_id").agg(F.sum("c").alias("blocks"), F.count("*").alias("unique_blocks"), F.sum(F.col("c") * F.col("n")).alias("bytes"))
    return out.withColumn("repeats", F.col("blocks") > F.col("unique_blocks"))


def object_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared, added and removed objects of two stores, with bytes; one full outer join on the id."""
    a = distinct_objects(left).select("object_id", F.col("n_bytes").alias("a"))
    b = distinct_objects(right).select("object_id", F.col("n_bytes").alias("b"))
    j = a.join(b, "object_id", "full_outer")
    both, only_a, only_b = F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b").isNull(), F.col("a").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.agg(
        F.count_if(both).alias("shared"), F.count_if(only_b).alias("added"), F.count_if(only_a).alias("removed"),
        zero(F.sum(F.when(only_b, F.col("b")))).alias("added_bytes"), zero(F.sum(F.when(only_a, F.col("a")))).alias("removed_bytes"),
    )


def set_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of intersection, difference and union of two id sets."""
    a, b = left.select("object_id").distinct(), right.select("object_id").distinct()
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(a.intersect(b), "n_intersection").join(one(a.subtract(b), "n_difference")).join(one(a.union(b).distinct(), "n_union"))


def corpus_index(objects: DataFrame, containers: DataFrame) -> DataFrame:
    """``(kind, id)`` of every object and container, each once; unreadable (null) ids are left out."""
    o = objects.select(F.lit("object").alias("kind"), F.col("object_id").alias("id"))
    return o.union(containers.select(F.lit("container").alias("kind"), "id")).where("id is not null").distinct()


def route(requests: DataFrame, index: DataFrame) -> DataFrame:
    """``(path, status, id)``: object and document paths of known ids are found, others are not."""
    m = F.regexp_extract("path", "^/store/([od])/([0-9a-fA-F]{64})$", 1)
    rid = F.lower(F.regexp_extract("path", "^/store/([od])/([0-9a-fA-F]{64})$", 2))
    asked = requests.select("path", F.when(m == "o", "object").when(m == "d", "container").alias("k"), rid.alias("asked"))
    hit = asked.join(index, (F.col("k") == F.col("kind")) & (F.col("asked") == F.col("id")), "left")
    return hit.select("path", F.when(F.col("id").isNull(), 404).otherwise(200).alias("status"), "id")
