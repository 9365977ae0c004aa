"""Sharding by a permutation-filled lookup table, with built-in functions only.

Every shard has its own order of preference over the slots of a table of prime size
(offset + j * skip, both from the shard's name). Shards take turns claiming their most
preferred free slot until the table is full, so slot counts differ by one at most, and
adding or removing a shard moves few slots. The table has ``slots`` entries whatever
the data, so broadcasting it is bounded; a row's slot comes from the hash of its
doc_id, and one array access gives the shard.

Defined cases: a null doc_id hashes as an empty string; repeated rows go to one shard; other
columns pass through unchanged, whatever their names, and an added column whose name the input has
already gets underscores appended until it is free; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm._columns import free, own

SLOTS, SHARDS = 2039, 16
MAX_SLOTS = 1 << 20


def name_hash(name: str, what: str) -> int:
    return int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:13], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if slots > MAX_SLOTS or len(shards) > slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}, and no less than the shards")
    skip = [name_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    want = [name_hash(s, "offset") % slots for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            if not free:
                break
            while owner[want[i]] >= 0:
                want[i] = (want[i] + skip[i]) % slots
            owner[want[i]] = i
            free -= 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return F.pmod(F.conv(hexed, 16, 10).cast("bigint"), F.lit(slots))


def sharded(docs: DataFrame, shards: int | list[str] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """The rows of ``docs`` plus their slot and shard (both long). No shuffle."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    of = free("of", docs.columns)
    slot = free(slot_col, [*docs.columns, of])
    shard = free(shard_col, [*docs.columns, of, slot])
    table = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, lookup_table(names, slots)))), ",")).alias(slot, shard))
    table = table.select(own(slot).cast("bigint").alias(slot), own(shard).cast("bigint").alias(shard))
    keyed = docs.select(*[own(c) for c in docs.columns], slot_of(own(id_col).cast("bigint"), slots).alias(of))
    joined = keyed.join(F.broadcast(table), own(of) == own(slot))
    return joined.select(*[own(c) for c in docs.columns], own(slot), own(shard))


ORACLE = f"""
WITH RECURSIVE
p AS (
  SELECT i, CAST('0x' || substr(md5('skip:shard-' || lpad(CAST(i AS VARCHAR), 5, '0')), 1, 13) AS BIGINT) % {SLOTS - 1} + 1 AS skip,
         CAST('0x' || substr(md5('offset:shard-' || lpad(CAST(i AS VARCHAR), 5, '0')), 1, 13) AS BIGINT) % {SLOTS} AS first
  FROM range(0, {SHARDS}) t(i)),
turns AS (
  SELECT 0 AS n, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT n + 1, list_append(taken, list_filter(
           list_transform(range(0, {SLOTS}), lambda j: (p.first + j * p.skip) % {SLOTS}),
           lambda s: NOT list_contains(taken, s))[1])
  FROM turns JOIN p ON p.i = n % {SHARDS} WHERE n < {SLOTS}),
t AS (SELECT unnest(taken) AS slot, generate_subscripts(taken, 1) - 1 AS n FROM turns WHERE n = {SLOTS})
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.slot, CAST(t.n % {SHARDS} AS BIGINT) AS shard
FROM documents d JOIN t ON t.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) % {SLOTS}
"""
