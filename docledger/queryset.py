"""Registered queries of the document operators over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.catalog import register
from docledger.functions import scalar
from docledger.operators import forms, merkle, store, tree
from docledger.plans.storage import table

BLOCKS = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS block FROM documents"
OBJECTS = f"SELECT doc_id, source, lang, sha256(block) AS id, strlen(block) AS n FROM ({BLOCKS})"
LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS text FROM documents"


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def objects_of(spark, sf_dir, where=None):
    d = docs_of(spark, sf_dir)
    return store.blocks_to_objects(d.where(where) if where else d)


# -- store -----------------------------------------------------------------------------------


@register("hsh1_object_ids", f"SELECT doc_id, id AS object_id, CAST(n AS BIGINT) AS n_bytes FROM ({OBJECTS})")
def hsh1(spark, sf_dir):
    return objects_of(spark, sf_dir).select("doc_id", "object_id", "n_bytes")


@register("hsh2_hex_round_trip", f"SELECT DISTINCT id AS hex, CAST(32 AS INT) AS n FROM ({OBJECTS})")
def hsh2(spark, sf_dir):
    ids = objects_of(spark, sf_dir).select("object_id").distinct()
    return ids.select(scalar.id_hex(scalar.parse_id("object_id")).alias("hex"), F.octet_length(scalar.parse_id("object_id")).alias("n"))


@register("hsh3_chunk_checksum", f"SELECT DISTINCT id AS object_id, substr(id, 1, 16) AS checksum FROM ({OBJECTS})")
def hsh3(spark, sf_dir):
    return objects_of(spark, sf_dir).select("object_id", scalar.id_hex(F.substring(F.unhex("object_id"), 1, 8)).alias("checksum")).distinct()


@register(
    "hsh4_document_ids",
    f"""SELECT doc_id, sha256(string_agg(sha256(block), '' ORDER BY i)) AS id FROM
    (SELECT doc_id, i, text AS block FROM ({LINES})) GROUP BY doc_id""",
)
def hsh4(spark, sf_dir):
    got = objects_of(spark, sf_dir).groupBy("doc_id").agg(tree.listagg(F.col("object_id"), "ord", "").alias("m"))
    return got.select("doc_id", F.sha2(F.col("m").cast("binary"), 256).alias("id"))


@register(
    "hsh5_layout_hash",
    f"""SELECT doc_id, sha256(unhex(CASE WHEN count(*) < 24 THEN lpad(to_hex(CAST(128 + count(*) AS BIGINT)), 2, '0') WHEN count(*) < 256 THEN '98' || lpad(to_hex(count(*)), 2, '0') ELSE '99' || lpad(to_hex(count(*)), 4, '0') END
      || string_agg('5820' || sha256(text), '' ORDER BY i))) AS layout_hash FROM ({LINES}) GROUP BY doc_id""",
)
def hsh5(spark, sf_dir):
    got = objects_of(spark, sf_dir).groupBy("doc_id").agg(tree.listagg(F.concat(F.lit("5820"), F.col("object_id")), "ord", "").alias("m"), F.count("*").alias("n"))
    return got.select("doc_id", F.sha2(F.unhex(F.concat(scalar.head_bytes(4, "n"), F.col("m"))), 256).alias("layout_hash"))


@register("sto1_insert_by_content", f"SELECT id AS object_id, CAST(min(n) AS BIGINT) AS n_bytes FROM ({OBJECTS}) GROUP BY id")
def sto1(spark, sf_dir):
    return store.distinct_objects(objects_of(spark, sf_dir))


@register(
    "sto2_verified_insert",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'id mismatch' END AS reason FROM documents""",
)
def sto2(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    own = F.when(F.col("doc_id") % 2 == 0, F.sha2(F.col("text").cast("binary"), 256)).otherwise(F.sha2(F.lit("other"), 256))
    return store.verified_insert(d.select("doc_id", own.alias("claimed_id"), F.col("text").cast("binary").alias("bytes"))).select("doc_id", "reason")


@register(
    "sto3_store_stats",
    f"SELECT count(*) AS objects, CAST(sum(c) AS BIGINT) AS refs, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT id, count(*) AS c, min(n) AS n FROM ({OBJECTS}) GROUP BY id)",
)
def sto3(spark, sf_dir):
    return store.store_stats(objects_of(spark, sf_dir))


KEPT = f"SELECT DISTINCT id FROM ({OBJECTS}) WHERE lang = 'en'"


@register("sto4_retain_only", f"SELECT DISTINCT id AS object_id, CASE WHEN id IN ({KEPT}) THEN 'kept' ELSE 'purged' END AS verdict FROM ({OBJECTS})")
def sto4(spark, sf_dir):
    kept, purged = store.retain(objects_of(spark, sf_dir), objects_of(spark, sf_dir, "lang = 'en'"))
    return kept.select("object_id").distinct().withColumn("verdict", F.lit("kept")).union(purged.withColumn("verdict", F.lit("purged")))


EDGES = """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"""


def edges_of(spark, sf_dir):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    e = n.select(k("r", "n_regionkey").alias("src"), k("n", "n_nationkey").alias("dst"))
    return e.union(c.select(k("n", "c_nationkey"), k("c", "c_custkey"))).union(o.select(k("c", "o_custkey"), k("o", "o_orderkey")))


@register(
    "sto5_closure",
    f"""WITH RECURSIVE e AS ({EDGES}), c AS (SELECT DISTINCT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id FROM region
    UNION SELECT c.root, e.dst FROM c JOIN e ON e.src = c.id) SELECT root, id FROM c""",
)
def sto5(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return store.closure(edges_of(spark, sf_dir), roots)


@register(
    "sto6_orphans_missing",
    """SELECT 'c' || c_custkey AS id, 'orphan' AS verdict FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT DISTINCT 'c' || o_custkey, 'missing' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def sto6(spark, sf_dir):
    k = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("id")
    return store.orphans_and_missing(table(spark, sf_dir, "customer").select(k("c_custkey")), table(spark, sf_dir, "orders").select(k("o_custkey")))


@register(
    "sto7_dedup_report",
    f"""WITH o AS (SELECT id, n FROM ({OBJECTS})), u AS (SELECT id, min(n) AS n FROM o GROUP BY id),
    t AS (SELECT count(*) AS objects, sum(n) AS bytes FROM o), d AS (SELECT count(*) AS uobjects, sum(n) AS ubytes FROM u)
    SELECT objects AS total_objects, uobjects AS unique_objects, CAST(bytes AS BIGINT) AS total_bytes, CAST(ubytes AS BIGINT) AS unique_bytes,
    CAST(CASE WHEN bytes = 0 THEN 0 ELSE round(1000.0 * (bytes - ubytes) / bytes) / 10 END AS DOUBLE) AS pct_saved FROM t, d""",
)
def sto7(spark, sf_dir):
    return store.dedup_report(objects_of(spark, sf_dir))


@register(
    "sto8_listing",
    f"""WITH u AS (SELECT id, CAST(min(n) AS BIGINT) AS n_bytes FROM ({OBJECTS}) GROUP BY id), f AS (SELECT DISTINCT sha256(text) AS id FROM ({LINES}) WHERE i = 0)
    SELECT u.id, n_bytes, CASE WHEN f.id IS NOT NULL THEN 'ROOT' WHEN u.id NOT IN ({KEPT}) THEN 'ORPHAN' ELSE '' END AS mark FROM u LEFT JOIN f ON f.id = u.id""",
)
def sto8(spark, sf_dir):
    o = objects_of(spark, sf_dir)
    first = o.where("ord = 0").select(F.col("object_id").alias("id"))
    seen = objects_of(spark, sf_dir, "lang = 'en'").select(F.col("object_id").alias("id"))
    return store.listing(store.distinct_objects(o).withColumnRenamed("object_id", "id"), first, seen)


@register(
    "sto9_document_info",
    f"SELECT doc_id, count(*) AS blocks, count(DISTINCT id) AS unique_blocks, CAST(sum(n) AS BIGINT) AS bytes, count(*) > count(DISTINCT id) AS repeats FROM ({OBJECTS}) GROUP BY doc_id",
)
def sto9(spark, sf_dir):
    return store.info(objects_of(spark, sf_dir))


A = f"SELECT id, min(n) AS n FROM ({OBJECTS}) WHERE source = 'src0' GROUP BY id"
B = f"SELECT id, min(n) AS n FROM ({OBJECTS}) WHERE source <> 'src0' GROUP BY id"


@register(
    "dif1_object_diff",
    f"""WITH a AS ({A}), b AS ({B}), j AS (SELECT a.n AS a, b.n AS b FROM a FULL JOIN b ON a.id = b.id)
    SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NOT NULL AND a IS NULL) AS added, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS removed,
    CAST(coalesce(sum(b) FILTER (a IS NULL), 0) AS BIGINT) AS added_bytes, CAST(coalesce(sum(a) FILTER (b IS NULL), 0) AS BIGINT) AS removed_bytes FROM j""",
)
def dif1(spark, sf_dir):
    return store.object_diff(objects_of(spark, sf_dir, "source = 'src0'"), objects_of(spark, sf_dir, "source <> 'src0'"))


@register("dif2_shared_objects", f"SELECT id AS object_id FROM ({A}) INTERSECT SELECT id FROM ({B})")
def dif2(spark, sf_dir):
    return objects_of(spark, sf_dir, "source = 'src0'").select("object_id").intersect(objects_of(spark, sf_dir, "source <> 'src0'").select("object_id"))


@register(
    "set1_set_sizes",
    f"""SELECT (SELECT count(*) FROM (SELECT id FROM ({A}) INTERSECT SELECT id FROM ({B}))) AS n_intersection,
    (SELECT count(*) FROM (SELECT id FROM ({A}) EXCEPT SELECT id FROM ({B}))) AS n_difference, (SELECT count(*) FROM (SELECT id FROM ({A}) UNION SELECT id FROM ({B}))) AS n_union""",
)
def set1(spark, sf_dir):
    return store.set_sizes(objects_of(spark, sf_dir, "source = 'src0'"), objects_of(spark, sf_dir, "source <> 'src0'"))


PAIRS = "SELECT * FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS predecessor FROM documents) WHERE predecessor IS NOT NULL"


@register("dif5_amendments", PAIRS)
def dif5(spark, sf_dir):
    return tree.amendments(docs_of(spark, sf_dir), "source")


@register(
    "dif3_structural_diff",
    f"""WITH l AS (SELECT doc_id, i, text FROM ({LINES})), c AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), p AS ({PAIRS}),
    q AS (SELECT p.*, x.n AS nb, y.n AS na FROM p JOIN c x ON x.doc_id = p.doc_id JOIN c y ON y.doc_id = p.predecessor),
    d AS (SELECT q.doc_id, predecessor, '(root)' AS path, -1 AS i FROM q WHERE na <> nb
      UNION ALL SELECT q.doc_id, predecessor, CAST(b.i AS VARCHAR), b.i FROM q JOIN l b ON b.doc_id = q.doc_id JOIN l a ON a.doc_id = q.predecessor AND a.i = b.i WHERE na = nb AND a.text <> b.text)
    SELECT doc_id, predecessor, path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, predecessor ORDER BY i) AS r FROM d) WHERE r <= 200""",
)
def dif3(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    return tree.structural_diff(n, n, tree.amendments(docs_of(spark, sf_dir), "source"))


@register(
    "dif4_redline",
    f"""WITH l AS (SELECT doc_id, i, text FROM ({LINES})), p AS ({PAIRS}),
    a AS (SELECT p.doc_id, predecessor, i, text AS old FROM p JOIN l ON l.doc_id = p.predecessor), b AS (SELECT p.doc_id, predecessor, i, text AS new FROM p JOIN l ON l.doc_id = p.doc_id),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.predecessor, b.predecessor) AS predecessor, coalesce(a.i, b.i) AS ord,
      CASE WHEN old IS NULL THEN 'insert' WHEN new IS NULL THEN 'delete' WHEN old <> new THEN 'change' END AS change
      FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.predecessor = b.predecessor AND a.i = b.i)
    SELECT doc_id, predecessor, ord, change FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, predecessor ORDER BY ord) AS r FROM j WHERE change IS NOT NULL) WHERE r <= 500""",
)
def dif4(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    return tree.redline(n, n, tree.amendments(docs_of(spark, sf_dir), "source")).drop("path")


@register(
    "snk13_corpus_index",
    f"SELECT DISTINCT 'object' AS kind, id FROM ({OBJECTS}) UNION SELECT 'container', sha256(text) FROM documents",
)
def snk13(spark, sf_dir):
    boxes = docs_of(spark, sf_dir).select(F.sha2(F.col("text").cast("binary"), 256).alias("id"))
    return store.corpus_index(objects_of(spark, sf_dir), boxes)


@register(
    "snk14_route",
    """WITH d AS (SELECT sha256(text) AS id FROM documents), r AS (SELECT '/store/d/' || upper(id) AS path, id AS want FROM d UNION ALL SELECT '/store/o/' || substr(id, 2), NULL FROM d UNION ALL SELECT '/store/x/' || id, NULL FROM d)
    SELECT path, CAST(CASE WHEN want IS NULL THEN 404 ELSE 200 END AS INT) AS status, want AS id FROM r""",
)
def snk14(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(F.sha2(F.col("text").cast("binary"), 256).alias("id"))
    boxes = d.select(F.lit("container").alias("kind"), "id").distinct()
    asked = d.select(F.concat(F.lit("/store/d/"), F.upper("id")).alias("path")).union(d.select(F.concat(F.lit("/store/o/"), F.substring("id", 2, 64)))).union(d.select(F.concat(F.lit("/store/x/"), "id")))
    return store.route(asked, boxes)


@register(
    "snk1_container_offsets",
    f"""SELECT id AS object_id, doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS intra_offset
    FROM (SELECT DISTINCT doc_id, id, n FROM ({OBJECTS}))""",
)
def snk1(spark, sf_dir):
    from pyspark.sql import Window

    o = objects_of(spark, sf_dir).select("doc_id", "object_id", "n_bytes").distinct()
    w = Window.partitionBy("doc_id").orderBy("object_id").rowsBetween(Window.unboundedPreceding, -1)
    return o.select("object_id", "doc_id", F.coalesce(F.sum("n_bytes").over(w), F.lit(0)).alias("intra_offset"))


# -- traversal and search ---------------------------------------------------------------------


@register(
    "trv1_extract",
    f"""WITH b AS (SELECT doc_id, i, CASE WHEN contains(text, ' | ') THEN array_to_string(list_transform(string_split(text, ' | '), lambda c: trim(c, ' ')), chr(9)) ELSE text END AS t FROM ({LINES}))
    SELECT doc_id, regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY i), '[ \\t\\n\\r\\f\\v]+$', '') || chr(10) AS text FROM b GROUP BY doc_id""",
)
def trv1(spark, sf_dir):
    return tree.extract(tree.nodes_of_lines(docs_of(spark, sf_dir)))


@register("trv2_fields_in_order", "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rank, text FROM conversations")
def trv2(spark, sf_dir):
    n = tree.nodes_of_conversations(table(spark, sf_dir, "conversations")).where("kind = 'p'")
    return tree.fields_in_order(n.withColumn("kind", F.lit("field")))


@register(
    "trv3_preview",
    f"SELECT doc_id, i AS ord, CASE WHEN i = 0 THEN '[h1] ' || text WHEN contains(text, ' | ') THEN text ELSE text END AS preview FROM ({LINES})",
)
def trv3(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    kind = F.when(F.col("ord") == 0, "h").otherwise(F.col("kind"))
    return n.select("doc_id", "ord", tree.preview(kind, F.lit(1), F.col("text")).alias("preview"))


@register(
    "trv4_resolve",
    """SELECT c.conv_id AS doc_id, CAST(turn AS VARCHAR) || '.0' AS path, 'p' AS kind, text FROM conversations c
    UNION ALL SELECT conv_id, max(turn) + 1 || '.0', NULL, NULL FROM conversations GROUP BY conv_id""",
)
def trv4(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    path = lambda c: F.array(c.cast("int"), F.lit(0)).alias("path")
    want = t.select(F.col("conv_id").alias("doc_id"), path(F.col("turn"))).union(t.groupBy(F.col("conv_id").alias("doc_id")).agg(path(F.max("turn") + 1)))
    got = tree.resolve(tree.nodes_of_conversations(t), want)
    return got.select("doc_id", F.array_join("path", ".").alias("path"), "kind", "text")


@register("trv5_last_alt", "SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def trv5(spark, sf_dir):
    return tree.last_by(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "text", "turn")


@register(
    "trv6_page_text",
    """WITH s AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS BIGINT) AS op_no, o_orderstatus AS t, o_totalprice AS y, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders)
    SELECT doc_id, CAST(1 AS INT) AS page_no, string_agg(CASE WHEN l IS NULL THEN '' WHEN y > l THEN chr(10) ELSE ' ' END || t, '' ORDER BY op_no) AS text FROM s GROUP BY doc_id""",
)
def trv6(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return tree.page_text(o.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("o_orderkey").alias("op_no"), F.col("o_totalprice").alias("y"), F.col("o_orderstatus").alias("text")))


@register("trv7_search_counts", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits FROM documents WHERE contains(lower(text), 'the')")
def trv7(spark, sf_dir):
    return tree.matches(docs_of(spark, sf_dir), "the").select("doc_id", "hits")


@register("trv8_matching_pages", f"SELECT DISTINCT doc_id, i AS page_no FROM ({LINES}) WHERE contains(lower(text), 'tion')")
def trv8(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    return n.where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id", F.col("ord").alias("page_no")).distinct()


@register(
    "trv9_next_match",
    f"""WITH m AS (SELECT doc_id, i AS page FROM ({LINES}) WHERE contains(lower(text), 'tion')), c AS (SELECT doc_id, 3 AS cur FROM documents)
    SELECT c.doc_id, CAST(c.cur AS BIGINT) AS cur, coalesce(min(page) FILTER (page > cur), min(page)) AS page FROM c LEFT JOIN m ON m.doc_id = c.doc_id GROUP BY c.doc_id, cur""",
)
def trv9(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir)).where(F.contains(F.lower("text"), F.lit("tion")))
    return tree.next_match(n.select("doc_id", F.col("ord").alias("page")), docs_of(spark, sf_dir).select("doc_id", F.lit(3).cast("bigint").alias("cur")))


@register(
    "trv10_text_layer",
    """SELECT conv_id AS doc_id, CAST(1 AS INT) AS page_no, '[' || string_agg('{"op":' || turn || ',"text":"' || role || '"}', ',' ORDER BY turn, role) || ']' AS json FROM conversations WHERE trim(role) <> '' GROUP BY conv_id""",
)
def trv10(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return tree.text_layer(t.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").alias("op_no"), F.col("role").alias("text")))


@register(
    "trv11_banner",
    """SELECT d.doc_id, CASE WHEN count(*) FILTER (quality = 0) > 0 THEN 'INVALID' WHEN count(*) FILTER (toxic = 1) > 0 THEN 'BAD SIGNATURE' WHEN count(quality) > 0 THEN 'VERIFIED' ELSE 'UNSIGNED' END AS state
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def trv11(spark, sf_dir):
    j = docs_of(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    v = j.groupBy("doc_id").agg(F.count_if(F.col("quality") == 0).alias("errors"), F.lit(0).alias("warnings"), F.count("quality").alias("signatures"), F.count_if(F.col("toxic") == 1).alias("bad_signatures"))
    return tree.banner(v)


@register("src27_text_recovery", f"""WITH l AS (SELECT doc_id, i, text, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ({LINES}))
    SELECT doc_id, g, string_agg(trim(text), ' ' ORDER BY i) AS text, min(i) AS first_line FROM l WHERE trim(text) <> '' GROUP BY doc_id, g""")
def src27(spark, sf_dir):
    return tree.paragraphs(docs_of(spark, sf_dir)).withColumn("g", F.col("g").cast("bigint"))


@register(
    "src26_headings",
    """WITH m AS (SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_orderkey)
    SELECT l.l_orderkey, l.l_linenumber, CAST(CASE WHEN l_quantity / median < 1.25 OR length(l_returnflag) > 120 THEN NULL WHEN l_quantity / median >= 2 THEN 1 WHEN l_quantity / median >= 1.6 THEN 2 ELSE 3 END AS INT) AS level FROM lineitem l JOIN m USING (l_orderkey)""",
)
def src26(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    j = li.join(tree.upper_median(li, ["l_orderkey"], "l_quantity"), "l_orderkey")
    return j.select("l_orderkey", "l_linenumber", tree.heading_level(F.col("l_quantity"), F.col("median"), F.col("l_returnflag")).alias("level"))


@register(
    "snk8_struct_tags",
    f"SELECT doc_id, i AS ord, CASE WHEN i = 0 THEN 'H1' ELSE 'P' END AS tag FROM ({LINES})",
)
def snk8(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    return n.select("doc_id", "ord", tree.struct_tag(F.when(F.col("ord") == 0, "h").otherwise("p"), F.lit(1)).alias("tag"))
