"""Redaction, sealing and selective disclosure, signature binding, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.operators.tree import listagg


def block_hash(kind: Column, text: Column) -> Column:
    """The hash of a block: kind and text, null text as empty."""
    return F.sha2(F.concat_ws("\x1f", kind, F.coalesce(text, F.lit(""))), 256)


def is_prefix(prefix: Column, path: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(prefix)) == prefix


def redact(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes with each target ``(doc_id, path, reason)`` replaced by a proof, its descendants gone.

    The proof is the hash of the removed subtree. The join is on the document, so a
    document with many targets is compared with its own nodes only.
    """
    own = nodes.withColumn("h", block_hash(F.col("kind"), F.col("text")))
    t = targets.select(F.col("doc_id").alias("t_doc"), F.col("path").alias("t_path"), "reason").distinct()
    inside = own.join(t, (F.col("doc_id") == F.col("t_doc")) & is_prefix(F.col("t_path"), F.col("path")))
    proofs = inside.groupBy("doc_id", F.col("t_path").alias("path"), "reason").agg(F.min("ord").alias("ord"), F.sha2(listagg(F.col("h"), "ord", ""), 256).alias("proof"))
    removed = inside.select("doc_id", "path").distinct()
    kept = nodes.join(removed, ["doc_id", "path"], "left_anti").select("doc_id", "path", "ord", "kind", "text", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("proof"))
    gone = proofs.select("doc_id", "path", "ord", F.lit("redacted").alias("kind"), F.lit(None).cast("string").alias("text"), "reason", "proof")
    return kept.unionByName(gone)


def verify_proof(removed: DataFrame, proofs: DataFrame) -> DataFrame:
    """``(doc_id, path, ok)``: whether removed content hashes to its proof."""
    return removed.join(proofs.select("doc_id", "path", "proof"), ["doc_id", "path"]).select("doc_id", "path", (F.col("h") == F.col("proof")).alias("ok"))


def leaks(nodes: DataFrame, secret: Column) -> DataFrame:
    """Number of nodes whose text holds the secret; 0 after a redaction of every place."""
    return nodes.agg(F.count_if(F.contains("text", secret)).alias("leaks"))


def seal(nodes: DataFrame, salts: DataFrame | None = None) -> DataFrame:
    """``(doc_id, i, leaf)``: each top block as an object of its own; the salt goes in front of its content.

    ``salts(doc_id, i, salt)`` comes in as data, so a recomputed task gets the same salt.
    """
    top = nodes.where("depth = 1").select("doc_id", F.element_at("path", 1).alias("i"), block_hash(F.col("kind"), F.col("text")).alias("h"))
    if salts is None:
        return top.select("doc_id", "i", F.col("h").alias("leaf"))
    j = top.join(salts, ["doc_id", "i"], "left")
    return j.select("doc_id", "i", F.when(F.col("salt").isNull(), F.col("h")).otherwise(F.sha2(F.concat_ws("\x1f", "salt", "h"), 256)).alias("leaf"))


def roots(sealed: DataFrame) -> DataFrame:
    """``(doc_id, root, blocks)``: the hash over all leaves in order."""
    return sealed.groupBy("doc_id").agg(F.sha2(listagg(F.col("leaf"), "i", ""), 256).alias("root"), F.count("*").alias("blocks"))


def disclose(sealed: DataFrame, nodes: DataFrame, wanted: DataFrame, salts: DataFrame | None = None) -> DataFrame:
    """A bundle for each ``wanted(doc_id, i)``: content, salt, all leaves; ``problem`` where there is no such block."""
    all_leaves = sealed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
    top = nodes.where("depth = 1").select("doc_id", F.element_at("path", 1).alias("i"), "kind", "text")
    out = wanted.join(all_leaves, "doc_id", "left").join(top, ["doc_id", "i"], "left")
    out = out.join(salts, ["doc_id", "i"], "left") if salts is not None else out.withColumn("salt", F.lit(None).cast("string"))
    return out.withColumn("problem", F.when(F.col("leaves").isNull(), "no such document").when(F.col("kind").isNull(), "block out of range"))


def verify_disclosure(bundles: DataFrame, expected: DataFrame) -> DataFrame:
    """``(doc_id, i, root_ok, leaf_ok, valid, hidden, salted)`` against ``expected(doc_id, root)``."""
    h = block_hash(F.col("kind"), F.col("text"))
    leaf = F.when(F.col("salt").isNull(), h).otherwise(F.sha2(F.concat_ws("\x1f", "salt", h), 256))
    root_ok = F.sha2(F.array_join("leaves", ""), 256) == F.col("root")
    leaf_ok = F.coalesce(F.get("leaves", F.col("i")) == leaf, F.lit(False))
    j = bundles.where("problem is null").join(expected.select("doc_id", "root"), "doc_id")
    return j.select("doc_id", "i", root_ok.alias("root_ok"), leaf_ok.alias("leaf_ok"), (root_ok & leaf_ok).alias("valid"), (F.size("leaves") - 1).alias("hidden"), F.col("salt").isNotNull().alias("salted"))


SCOPES = {"document": 0, "subtree": 1, "field-layer": 2}


def signed_message(domain: str, scope: Column, target: Column) -> Column:
    """Domain, one byte of scope, target: the bytes that are signed."""
    byte = F.when(scope == "document", "00").when(scope == "subtree", "01").when(scope == "field-layer", "02")
    return F.concat(F.lit(domain).cast("binary"), F.unhex(byte), target)


def bind_signatures(signatures: DataFrame, documents: DataFrame, store: DataFrame) -> DataFrame:
    """``verdict`` from ``crypto_ok`` and the target: a document's own id, or for other scopes any object of it."""
    d = documents.select("doc_id", F.col("id").alias("own_id"))
    s = store.select(F.col("doc_id").alias("s_doc"), F.col("object_id").alias("s_id")).distinct()
    j = signatures.join(d, "doc_id", "left").join(s, (F.col("doc_id") == F.col("s_doc")) & (F.col("target") == F.col("s_id")), "left")
    bound = F.when(F.col("scope") == "document", F.col("target") == F.col("own_id")).otherwise(F.col("s_id").isNotNull())
    verdict = F.when(~F.col("crypto_ok"), "Invalid").when(F.coalesce(bound, F.lit(False)), "Valid").otherwise("ValidForOtherTarget")
    return j.select("doc_id", "scope", "target", verdict.alias("verdict"))


def append_assertion(chains: DataFrame, kind: str, claims: dict[str, Column]) -> DataFrame:
    """A new assertion at the end of each chain; it anchors the id the document had before."""
    pairs = [x for k, v in sorted(claims.items()) for x in (F.lit(k), v)]
    new = F.struct(F.lit(kind).alias("kind"), F.create_map(*pairs).alias("claims"), F.col("id").alias("manifest_hash"))
    return chains.withColumn("chain", F.array_append("chain", new))


def show_chain(chains: DataFrame) -> DataFrame:
    """``(doc_id, pos, kind, manifest_hash, claim, value)``: one row per claim."""
    steps = chains.select("doc_id", F.posexplode("chain").alias("pos", "a"))
    return steps.select("doc_id", "pos", "a.kind", "a.manifest_hash", F.explode("a.claims").alias("claim", "value"))
