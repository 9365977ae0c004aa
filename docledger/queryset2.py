"""Further registered queries: forms, validation, redaction, logs, layout, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.catalog import register
from docledger.functions import ed25519, scalar
from docledger.operators import disclosure, forms, layout, merkle, tree, validate
from docledger.operators.forms import Field
from docledger.plans.storage import table
from docledger.queryset import LINES, docs_of, objects_of

# -- forms: each line item is a filled form -----------------------------------------------------

KEYS = ["l_orderkey", "l_linenumber"]
COLUMNS = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "line": "l_linenumber"}
KINDS = {"qty": "num", "price": "num", "disc": "num", "tax": "num", "flag": "str", "line": "num"}
REF = {k: {"$": k} for k in COLUMNS}


def evaluated(spark, sf_dir, expr, part):
    """One expression over all line items: its value and error."""
    li = table(spark, sf_dir, "lineitem")
    env = {k: forms.of_column(F.col(c), KINDS[k]) for k, c in COLUMNS.items()}
    cell = forms.compile_expr(expr, env)
    value = {"num": cell.num, "bool": cell.flag, "str": cell.text, "text": forms.to_text(cell), "kind": cell.kind}[part]
    return li.select("l_orderkey", "l_linenumber", value.alias("value"), cell.err.alias("err"))


def expr_query(name, expr, part, sql, err="NULL"):
    @register(name, f"SELECT l_orderkey, l_linenumber, {sql} AS value, CAST({err} AS VARCHAR) AS err FROM lineitem")
    def q(spark, sf_dir):
        return evaluated(spark, sf_dir, expr, part)

    return q


expr_query("frm1_literal", 4, "num", "CAST(4 AS DOUBLE)")
expr_query("frm2_reference", {"$": "nowhere"}, "kind", "'empty'")
expr_query("frm3_arithmetic", ["-", ["*", REF["price"], ["-", 1, REF["disc"]]], REF["tax"]], "num", "l_extendedprice * (1 - l_discount) - l_tax")
expr_query("frm3_type_error", ["+", REF["flag"], 1], "num", "CAST(NULL AS DOUBLE)", "'expected a number'")
expr_query("frm3_division", ["/", REF["price"], REF["disc"]], "text", "CASE WHEN l_discount = 0 THEN 'inf' WHEN l_extendedprice / l_discount = floor(l_extendedprice / l_discount) THEN CAST(CAST(l_extendedprice / l_discount AS BIGINT) AS VARCHAR) ELSE CAST(l_extendedprice / l_discount AS VARCHAR) END")
expr_query("frm4_min_max", ["max", ["min", REF["qty"], 30], 5, REF["line"]], "num", "greatest(least(l_quantity, 30), 5, CAST(l_linenumber AS DOUBLE))")
expr_query("frm5_round", ["round", ["/", REF["qty"], 2]], "num", "round_even(l_quantity / 2, 0)")
expr_query("frm6_equal", ["=", REF["flag"], "A"], "bool", "l_returnflag = 'A'")
expr_query("frm6_not_equal_kinds", ["!=", REF["flag"], REF["qty"]], "bool", "true")
expr_query("frm7_less", ["<=", REF["disc"], 0.05], "bool", "l_discount <= 0.05")
expr_query("frm7_mixed", ["<", REF["flag"], 1], "bool", "CAST(NULL AS BOOLEAN)", "'ordered comparison requires two numbers or two strings'")
expr_query("frm8_and_or", ["or", ["and", [">", REF["qty"], 25], ["<", REF["disc"], 0.04]], ["=", REF["flag"], "R"]], "bool", "(l_quantity > 25 AND l_discount < 0.04) OR l_returnflag = 'R'")
expr_query("frm8_short_circuit", ["or", [">", REF["qty"], 25], REF["flag"]], "bool", "CASE WHEN l_quantity > 25 THEN true END", "CASE WHEN l_quantity > 25 THEN NULL ELSE 'expected a boolean' END")
expr_query("frm9_if_not", ["if", ["not", ["=", REF["flag"], "N"]], REF["qty"], REF["line"]], "num", "CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE CAST(l_linenumber AS DOUBLE) END")
expr_query("frm10_match", ["match", REF["flag"], ["A", 1], ["R", 2], 0], "num", "CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS DOUBLE)")
TINY = "CAST(l_extendedprice / 3e9 AS VARCHAR)"
expr_query("frm11_small_numbers", ["/", REF["price"], 3e9], "text", f"CASE WHEN contains({TINY}, 'e-') THEN '0.' || repeat('0', CAST(string_split({TINY}, 'e-')[2] AS INT) - 1) || replace(string_split({TINY}, 'e-')[1], '.', '') ELSE {TINY} END")
expr_query("frm11_text", REF["qty"], "text", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)")
expr_query("frm12_regex_valid", ["regex-valid", REF["qty"], "[1-3][0-9]"], "bool", "regexp_full_match(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '[1-3][0-9]')")

FORM = [
    Field("qty", "number", required=True, constraint=[">=", REF["qty"], 5]),
    Field("price", "number", constraint=["and", [">", REF["price"], 1000], ["<", REF["price"], 90000]]),
    Field("flag", "text", constraint=["regex-valid", REF["flag"], "[AN]"]),
    Field("net", "number", computed=["round", ["*", REF["price"], ["-", 1, {"$": "rate"}]]]),
    Field("rate", "number", computed=["/", REF["qty"], 100], constraint=["<", {"$": "rate"}, 0.45]),
]
FORM_COLUMNS = {"qty": "l_quantity", "price": "l_extendedprice", "flag": "l_returnflag"}


@register("frm13_field_refs", "SELECT * FROM (VALUES ('net', 'price'), ('net', 'rate'), ('rate', 'qty')) t(field, ref)")
def frm13(spark, sf_dir):
    return spark.createDataFrame([(f.id, r) for f in FORM if f.computed for r in forms.field_refs(f.computed)], "field string, ref string")


@register("frm14_computed", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * (1 - l_quantity / 100), 0) AS net FROM lineitem")
def frm14(spark, sf_dir):
    return forms.with_cells(table(spark, sf_dir, "lineitem"), FORM, FORM_COLUMNS).select(*KEYS, F.col("f_net.num").alias("net"))


@register(
    "frm15_constraints",
    """SELECT l_orderkey, 'qty' AS field, 'constraint violated' AS message FROM lineitem WHERE NOT l_quantity >= 5
    UNION ALL SELECT l_orderkey, 'price', 'constraint violated' FROM lineitem WHERE NOT (l_extendedprice > 1000 AND l_extendedprice < 90000)
    UNION ALL SELECT l_orderkey, 'flag', 'constraint violated' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT l_orderkey, 'rate', 'constraint violated' FROM lineitem WHERE NOT l_quantity / 100 < 0.45""",
)
def frm15(spark, sf_dir):
    return forms.violations(table(spark, sf_dir, "lineitem"), FORM, FORM_COLUMNS, "l_orderkey")


@register(
    "frm16_fill",
    """SELECT o_orderkey AS doc_id, 'status' AS field_id, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS str, CAST(NULL AS VARCHAR) AS problem
    FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'other', NULL, 'unknown field' FROM orders WHERE o_orderstatus = 'P'""",
)
def frm16(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = lambda f, k, s: [F.col("o_orderkey").alias("doc_id"), F.lit(f).alias("field_id"), F.lit(k).alias("kind"), F.lit(None).cast("double").alias("num"), s.cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool")]
    old = o.select(*row("status", "str", F.col("o_orderstatus")))
    new = o.where("o_orderstatus = 'O'").select(*row("status", "str", F.lit("open")))
    new = new.union(o.where("o_orderstatus = 'F'").select(*row("status", "empty", F.lit(None)))).union(o.where("o_orderstatus = 'P'").select(*row("other", "str", F.lit("x"))))
    return forms.fill(old, new, [Field("status", "text")]).select("doc_id", "field_id", "str", "problem")


@register(
    "frm17_flatten",
    """WITH ok AS (SELECT * FROM orders WHERE o_totalprice >= 1000) SELECT o_orderkey, 0 AS ord, o_orderstatus AS text FROM ok
    UNION ALL SELECT o_orderkey, 1, CAST(CAST(round_even(o_totalprice, 0) AS BIGINT) AS VARCHAR) FROM ok""",
)
def frm17(spark, sf_dir):
    fs = [Field("status", "text"), Field("total", "number", computed=["round", {"$": "price"}]), Field("price", "number", constraint=[">=", {"$": "price"}, 1000])]
    out = forms.flatten(table(spark, sf_dir, "orders"), fs, {"status": "o_orderstatus", "price": "o_totalprice"}, "o_orderkey")
    return out.where("ord < 2")


@register(
    "frm18_typed_parse",
    "SELECT event_id, TRY_CAST(split_part(split_part(props, ': ', 2), '}', 1) AS DOUBLE) AS num, CASE WHEN TRY_CAST(split_part(split_part(props, ': ', 2), '}', 1) AS DOUBLE) IS NULL THEN 'expected a number' END AS err FROM events",
)
def frm18(spark, sf_dir):
    raw = F.split_part(F.split_part("props", F.lit(": "), F.lit(2)), F.lit("}"), F.lit(1))
    c = forms.parse_typed(raw, "number")
    return table(spark, sf_dir, "events").select("event_id", c.num.alias("num"), c.err.alias("err"))


# -- validation -----------------------------------------------------------------------------------

FIND = "'{s}' AS severity, '{c}' AS code"


def sev(s, c):
    return FIND.format(s=s, c=c)


@register("val1_version", f"SELECT doc_id, {sev('error', 'E_VERSION')}, '(root)' AS path, 'unsupported major version' AS message FROM documents WHERE source = 'src1'")
def val1(spark, sf_dir):
    return validate.version(docs_of(spark, sf_dir).select("doc_id", F.when(F.col("source") == "src1", 2).otherwise(1).alias("major")), 1)


PARTS = ("root", "metadata", "resources", "provenance", "field_layer")


@register(
    "val2_undecodable",
    f"""SELECT page_id AS doc_id, 'error' AS severity, 'E_' || upper(part) AS code, '(root)' AS path, 'no article' AS message
    FROM (SELECT *, [{", ".join(f"'{p}'" for p in PARTS)}][page_id % 5 + 1] AS part FROM pages) WHERE page_id % 3 = 0""",
)
def val2(spark, sf_dir):
    part = F.get(F.array(*map(F.lit, PARTS)), (F.col("page_id") % 5).cast("int"))
    p = table(spark, sf_dir, "pages")
    return validate.undecodable(p.select(F.col("page_id").alias("doc_id"), part.alias("part"), F.when(F.col("page_id") % 3 == 0, "no article").alias("problem")))


@register(
    "val3_root_and_language",
    f"""SELECT conv_id AS doc_id, {sev('error', 'E_NESTED_DOC')}, CAST(turn AS VARCHAR) AS path, 'a doc inside a doc' AS message FROM conversations WHERE role = 'system'
    UNION ALL SELECT doc_id, {sev('error', 'E_LANG')}, '(root)', 'no language' FROM documents WHERE lang NOT IN ('en', 'de')
    UNION ALL SELECT doc_id, {sev('error', 'E_ROOT_KIND')}, '(root)', 'the root is not a doc' FROM documents WHERE source = 'src2'""",
)
def val3(spark, sf_dir):
    n = tree.nodes_of_conversations(table(spark, sf_dir, "conversations")).where("kind = 'sec'")
    n = n.withColumn("kind", F.when(F.col("role") == "system", "doc").otherwise(F.col("kind")))
    roots = docs_of(spark, sf_dir).select("doc_id", F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.when(F.col("source") == "src2", "sec").otherwise("doc").alias("kind"))
    d = docs_of(spark, sf_dir).select("doc_id", F.when(F.col("lang").isin("en", "de"), F.col("lang")).alias("lang"))
    return validate.report(validate.root_kind(n.select("doc_id", "path", "depth", "kind").unionByName(roots)), validate.language(d))


@register(
    "val4_pages",
    f"""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, l_partkey AS page_id FROM lineitem), p AS (SELECT * FROM part WHERE p_size > 5),
    h AS (SELECT doc_id, sha256(string_agg(CAST(page_id AS VARCHAR), '' ORDER BY page_no, page_id)) AS h FROM c GROUP BY doc_id)
    SELECT doc_id, {sev('error', 'E_PAGE_MISSING')}, 'page ' || page_no AS path, 'page object missing' AS message FROM c WHERE page_id NOT IN (SELECT p_partkey FROM p)
    UNION ALL SELECT doc_id, {sev('error', 'E_PAGE_DECODE')}, 'page ' || page_no, 'bad page' FROM c JOIN p ON p_partkey = page_id WHERE p_size > 45
    UNION ALL SELECT doc_id, {sev('error', 'E_GEOMETRY')}, 'page ' || page_no, 'page without an area' FROM c JOIN p ON p_partkey = page_id WHERE p_size % 10 = 0
    UNION ALL SELECT doc_id, {sev('error', 'E_LAYOUT_HASH')}, '(root)', 'layout hash differs' FROM h WHERE doc_id % 4 = 0""",
)
def val4(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_partkey").alias("page_id"))
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("page_id"), size.alias("width"), (size % 10).alias("height"), F.when(size > 45, "bad page").alias("problem"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page_id"))), lambda x: x["page_id"]), "")
    claimed = c.groupBy("doc_id").agg(F.when(F.col("doc_id") % 4 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(whole, 256)).alias("layout_hash"))
    return validate.report(validate.pages(c, p), validate.layout_hash(c, claimed))


@register("val5_unknown_fields", f"SELECT doc_id, {sev('error', 'E_FIELD_LAYER_ID')}, '(root)' AS path, 'unknown field ' || source AS message FROM documents WHERE source IN ('src3', 'src4')")
def val5(spark, sf_dir):
    v = docs_of(spark, sf_dir).select("doc_id", F.col("source").alias("field_id"))
    return validate.unknown_fields(v, v.where("field_id not in ('src3', 'src4')"))


@register("val6_field_cycles", f"SELECT o_orderkey AS doc_id, {sev('error', 'E_FIELD_CYCLE')}, '(root)' AS path, 'computed fields depend on each other' AS message FROM orders WHERE o_orderstatus = 'F'")
def val6(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = F.when(F.col("o_orderstatus") == "F", "a").otherwise("input")
    rows = F.array(*(F.struct(F.lit(a).alias("field_id"), b.alias("ref")) for a, b in (("a", F.lit("b")), ("b", F.lit("c")), ("c", last))))
    return validate.field_cycles(o.select(F.col("o_orderkey").alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.field_id", "x.ref"))


@register("val7_constraints", f"SELECT l_orderkey AS doc_id, {sev('warning', 'W_CONSTRAINT')}, '(root)' AS path, 'qty: constraint violated' AS message FROM lineitem WHERE l_quantity < 5")
def val7(spark, sf_dir):
    v = forms.violations(table(spark, sf_dir, "lineitem"), [FORM[0]], FORM_COLUMNS, "l_orderkey")
    return validate.constraints(v.withColumnRenamed("l_orderkey", "doc_id"))


@register(
    "val8_profiles",
    f"""WITH o AS (SELECT o_orderkey AS doc_id, o_orderstatus AS s, o_totalprice AS p FROM orders)
    SELECT doc_id, {sev('error', 'E_ARCHIVE_CACHE')}, '(root)' AS path, 'an archive needs a render cache' AS message FROM o WHERE s = 'F' AND p < 1000
    UNION ALL SELECT doc_id, {sev('error', 'E_ARCHIVE_PROV')}, '(root)', 'an archive needs provenance' FROM o WHERE s = 'F' AND doc_id % 7 = 0
    UNION ALL SELECT doc_id, {sev('error', 'E_ARCHIVE_FIELDS')}, '(root)', 'an archive has no open fields' FROM o WHERE s = 'F' AND p > 400000
    UNION ALL SELECT doc_id, {sev('error', 'E_STREAM_INDEX')}, '(root)', 'a stream needs a page index' FROM o WHERE s = 'O' AND p < 1000""",
)
def val8(spark, sf_dir):
    p = F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "archive").when(F.col("o_orderstatus") == "O", "stream").alias("profile"), (p >= 1000).alias("has_cache"), (F.col("o_orderkey") % 7 != 0).alias("has_provenance"), (p > 400000).alias("has_fields"), (p >= 1000).alias("has_index"))
    return validate.profiles(o)


@register(
    "val9_objects",
    f"""WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS id FROM lineitem), s AS (SELECT DISTINCT o_orderkey AS doc_id, o_custkey AS id FROM orders UNION SELECT doc_id, id FROM r WHERE id % 4 <> 0)
    SELECT doc_id, {sev('error', 'E_MISSING_OBJECT')}, '(root)' AS path, CAST(id AS VARCHAR) AS message FROM r WHERE (doc_id, id) NOT IN (SELECT (doc_id, id) FROM s)
    UNION ALL SELECT DISTINCT doc_id, {sev('warning', 'W_ORPHANS')}, '(root)', 'unreachable objects' FROM s WHERE (doc_id, id) NOT IN (SELECT (doc_id, id) FROM r)""",
)
def val9(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("id")).distinct()
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("id")).union(refs.where("id % 4 <> 0")).distinct()
    missing = refs.join(stored, ["doc_id", "id"], "left_anti").withColumn("verdict", F.lit("missing"))
    orphans = stored.join(refs, ["doc_id", "id"], "left_anti").withColumn("verdict", F.lit("orphan"))
    return validate.objects(missing.unionByName(orphans))


@register(
    "val10_figures",
    f"""WITH f AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN NULL WHEN length(text) >= 40 THEN text END AS alt FROM conversations)
    SELECT conv_id AS doc_id, {sev('error', 'E_ALT_TEXT')}, turn || '.0' AS path, 'figure without alternative text' AS message FROM f WHERE alt IS NULL AND turn % 2 = 0
    UNION ALL SELECT conv_id, {sev('error', 'E_FIG_RES')}, turn || '.0', 'figure resource missing' FROM f WHERE turn >= 3""",
)
def val10(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    n = t.select(
        F.col("conv_id").alias("doc_id"), F.array(F.col("turn").cast("int"), F.lit(0)).alias("path"), F.lit("fig").alias("kind"),
        F.when((F.col("role") != "user") & (F.char_length("text") >= 40), F.col("text")).alias("alt"), (F.col("turn") % 2 == 1).alias("decorative"), F.col("turn").alias("res_id"),
    )
    return validate.figures(n, t.where("turn < 3").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("res_id")).distinct())


CELLS = f"SELECT doc_id, i, len(string_split(text, ' | ')) AS n, min(i) OVER (PARTITION BY doc_id) AS f FROM ({LINES}) WHERE contains(text, ' | ')"


@register(
    "val11_table_shape",
    f"""WITH c AS ({CELLS}), h AS (SELECT doc_id, n AS w FROM c WHERE i = f)
    SELECT c.doc_id, {sev('error', 'E_TABLE_SHAPE')}, '0' AS path, 'row ' || c.i AS message FROM c JOIN h ON h.doc_id = c.doc_id WHERE n <> w
    UNION ALL SELECT doc_id, {sev('error', 'E_TABLE_EMPTY')}, '0', 'table without body rows' FROM c GROUP BY doc_id HAVING count(*) = 1""",
)
def val11(spark, sf_dir):
    rows = tree.nodes_of_lines(docs_of(spark, sf_dir)).where("kind = 'row'").select("doc_id", F.array(F.lit(0)).alias("path"), F.col("ord").alias("row_no"), F.size(F.split("text", " \\| ")).alias("spans"))
    head = rows.groupBy("doc_id").agg(F.min_by("spans", "row_no").alias("columns"), F.min("row_no").alias("first"))
    rows = rows.join(head.select("doc_id", "first"), "doc_id").withColumn("part", F.when(F.col("row_no") == F.col("first"), "head").otherwise("body")).drop("first")
    return validate.tables(head.select("doc_id", F.array(F.lit(0)).alias("path"), F.lit("table").alias("kind"), "columns"), rows)


@register(
    "val12_emptiness",
    f"""SELECT doc_id, {sev('error', 'E_MATH_EMPTY')}, CAST(i AS VARCHAR) AS path, 'empty formula' AS message FROM ({LINES}) WHERE trim(text) = '' AND i % 2 = 0
    UNION ALL SELECT conv_id, {sev('error', 'E_MATH_EMPTY')}, turn || '.1', 'empty formula' FROM conversations WHERE turn % 4 = 1
    UNION ALL SELECT conv_id, {sev('warning', 'W_LIST_EMPTY')}, turn || '.0', 'empty list' FROM conversations WHERE role = 'user' AND turn % 4 = 0""",
)
def val12(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir)).where("ord % 2 = 0").select("doc_id", "path", F.lit("math").alias("kind"), "text", F.lit(1).alias("items"))
    t, turn = table(spark, sf_dir, "conversations"), F.col("turn").cast("int")
    lists = t.select(F.col("conv_id").alias("doc_id"), F.array(turn, F.lit(0)).alias("path"), F.lit("list").alias("kind"), "text", F.when((F.col("role") == "user") & (turn % 4 == 0), 0).otherwise(2).alias("items"))
    maths = t.select(F.col("conv_id").alias("doc_id"), F.array(turn, F.lit(1)).alias("path"), F.lit("math").alias("kind"), F.when(turn % 4 == 1, " ").otherwise(F.lit("x")).alias("text"), F.lit(None).cast("int").alias("items"))
    return validate.emptiness(n.unionByName(lists).unionByName(maths))


@register(
    "val13_field_ids",
    f"""SELECT conv_id AS doc_id, {sev('error', 'E_FIELD_DUP')}, '(root)' AS path, role AS message FROM conversations GROUP BY conv_id, role HAVING count(*) > 1
    UNION ALL SELECT DISTINCT conv_id, {sev('error', 'E_FIELD_REF')}, '(root)', 'turn' || (turn % 3) FROM conversations WHERE turn % 3 > 0""",
)
def val13(spark, sf_dir):
    refs = F.array(F.col("role"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit("turn"), (F.col("turn") % 3).cast("string"))).otherwise(F.col("role")))
    return validate.field_ids(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("field_id"), refs.alias("refs")))


@register(
    "val14_inlines",
    f"""SELECT conv_id AS doc_id, {sev('error', 'E_STYLE_REF')}, CAST(turn AS VARCHAR) AS path, 'unknown style' AS message FROM conversations WHERE turn >= 3
    UNION ALL SELECT conv_id, {sev('error', 'E_LINK_EMPTY')}, CAST(turn AS VARCHAR), 'empty link' FROM conversations WHERE role = 'user' AND turn % 4 = 2""",
)
def val14(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "link").otherwise("span")
    href = F.when(F.col("turn") % 4 == 2, " ").otherwise("x")
    spans = t.select(F.col("conv_id").alias("doc_id"), F.array(F.col("turn")).alias("path"), kind.alias("kind"), F.col("turn").alias("style_id"), href.alias("href"))
    return validate.inlines(spans, t.select(F.col("conv_id").alias("doc_id"), F.lit(3).alias("n_styles")).distinct())


@register("val15_roll_up", "SELECT d.doc_id, coalesce(max(1 - quality), 0) = 0 AS valid, count(*) FILTER (quality = 0) AS errors, count(*) FILTER (quality = 1 AND toxic = 1) AS warnings FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id")
def val15(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    f = validate.report(validate.finding(lab.where("quality = 0"), "error", "E", "low quality"), validate.finding(lab.where("quality = 1 and toxic = 1"), "warning", "W", "toxic"))
    return validate.roll_up(docs_of(spark, sf_dir), f)


# -- redaction, disclosure, provenance -------------------------------------------------------------

BLOCK = "sha256(kind || chr(31) || coalesce(text, ''))"
NODES = """SELECT conv_id AS doc_id, CAST(turn AS VARCHAR) AS path, 2 * turn AS ord, 'sec' AS kind, CAST(NULL AS VARCHAR) AS text, role, turn FROM conversations
    UNION ALL SELECT conv_id, turn || '.0', 2 * turn + 1, 'p', text, role, turn FROM conversations"""


def conversation(spark, sf_dir):
    return tree.nodes_of_conversations(table(spark, sf_dir, "conversations"))


def redacted(spark, sf_dir):
    n = conversation(spark, sf_dir)
    return disclosure.redact(n, n.where("kind = 'sec' and role = 'user'").select("doc_id", "path", F.lit("private").alias("reason")))


@register(
    "red1_redact",
    f"""WITH n AS ({NODES}) SELECT doc_id, path, ord, kind, text, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS proof FROM n WHERE role <> 'user'
    UNION ALL SELECT doc_id, CAST(turn AS VARCHAR), min(ord), 'redacted', NULL, 'private', sha256(string_agg({BLOCK}, '' ORDER BY ord)) FROM n WHERE role = 'user' GROUP BY doc_id, turn""",
)
def red1(spark, sf_dir):
    return redacted(spark, sf_dir).withColumn("path", scalar.path_text("path"))


@register("red3_verify_proof", f"WITH n AS ({NODES}) SELECT doc_id, CAST(turn AS VARCHAR) AS path, doc_id % 3 <> 0 AS ok FROM n WHERE role = 'user' AND kind = 'sec'")
def red3(spark, sf_dir):
    n = conversation(spark, sf_dir)
    n = n.withColumn("text", F.when((F.col("doc_id") % 3 == 0) & (F.col("kind") == "p"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))  # changed since
    n = n.withColumn("h", disclosure.block_hash(F.col("kind"), F.col("text")))
    whole = n.groupBy("doc_id", F.slice("path", 1, 1).alias("path")).agg(F.sha2(tree.listagg(F.col("h"), "ord", ""), 256).alias("h"))
    return disclosure.verify_proof(whole, redacted(spark, sf_dir).where("proof is not null")).withColumn("path", scalar.path_text("path"))


@register("red4_leaks", "SELECT count(*) FILTER (role <> 'user' AND contains(text, 'ation')) AS leaks FROM conversations")
def red4(spark, sf_dir):
    return disclosure.leaks(redacted(spark, sf_dir), F.lit("ation"))


@register("dsc1_seal", f"SELECT doc_id, CAST(i AS INT) AS i, sha256('salt' || i || chr(31) || sha256((CASE WHEN contains(text, ' | ') THEN 'row' ELSE 'p' END) || chr(31) || text)) AS leaf FROM ({LINES})")
def dsc1(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    return disclosure.seal(n, salts_of(n))


def salts_of(nodes):
    i = F.element_at("path", 1)
    return nodes.select("doc_id", i.alias("i"), F.concat(F.lit("salt"), i.cast("string")).alias("salt"))


@register("dsc2_disclose", f"SELECT doc_id, CAST(i AS INT) AS i, text, CAST(NULL AS VARCHAR) AS problem FROM ({LINES}) WHERE i = 0 UNION ALL SELECT doc_id, 100000, NULL, 'block out of range' FROM documents")
def dsc2(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    want = docs_of(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit(0), F.lit(100000))).alias("i"))
    return disclosure.disclose(disclosure.seal(n), n, want).select("doc_id", "i", "text", "problem")


@register(
    "dsc3_verify_disclosure",
    f"""WITH d AS (SELECT doc_id, CAST(count(*) - 1 AS INT) AS hidden, doc_id % 5 AS k FROM ({LINES}) GROUP BY doc_id)
    SELECT doc_id, CAST(0 AS INT) AS i, k <> 1 AS root_ok, k NOT IN (1, 2, 3) AS leaf_ok, k NOT IN (1, 2, 3) AS valid, hidden, k <> 4 AS salted FROM d WHERE k <> 4
    UNION ALL SELECT doc_id, 0, true, false, false, hidden, false FROM d WHERE k = 4""",
)
def dsc3(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    sealed = disclosure.seal(n, salts_of(n))
    good = disclosure.disclose(sealed, n, docs_of(spark, sf_dir).select("doc_id", F.lit(0).alias("i")), salts_of(n))
    k = F.col("doc_id") % 5
    # 1: another leaf in its place, 2: changed text, 3: another salt, 4: no salt
    bundles = good.withColumn("leaves", F.when(k == 1, F.transform("leaves", lambda x, j: F.when(j == 0, F.sha2(F.lit("x"), 256)).otherwise(x))).otherwise(F.col("leaves")))
    bundles = bundles.withColumn("text", F.when(k == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    bundles = bundles.withColumn("salt", F.when(k == 3, "other").when(k != 4, F.col("salt")))
    return disclosure.verify_disclosure(bundles, disclosure.roots(sealed))


@register("sig1_signed_message", "SELECT doc_id, sha256(encode('docledger/v1') || unhex('00') || unhex(sha256(text))) AS digest FROM documents")
def sig1(spark, sf_dir):
    m = disclosure.signed_message("docledger/v1", F.lit("document"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return docs_of(spark, sf_dir).select("doc_id", F.sha2(m, 256).alias("digest"))


@register("sig3_bind", f"SELECT doc_id, 'subtree' AS scope, CASE WHEN lang = 'de' THEN 'ValidForOtherTarget' WHEN lang = 'fr' THEN 'Invalid' ELSE 'Valid' END AS verdict FROM documents")
def sig3(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    first = F.sha2(F.get(F.split("text", "\n"), F.lit(0)).cast("binary"), 256)
    target = F.when(F.col("lang") == "de", "none").otherwise(first)
    sigs = d.select("doc_id", F.lit("subtree").alias("scope"), target.alias("target"), (F.col("lang") != "fr").alias("crypto_ok"))
    return disclosure.bind_signatures(sigs, d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("id")), objects_of(spark, sf_dir)).select("doc_id", "scope", "verdict")


def chains(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    none = F.array().cast("array<struct<kind:string,claims:map<string,string>,manifest_hash:string>>")
    c = d.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("id"), none.alias("chain"))
    c = disclosure.append_assertion(c, "created", {"by": F.col("source")})
    return disclosure.append_assertion(c, "reviewed", {"by": F.lit("desk"), "of": F.col("source")})


@register("prv1_append", "SELECT doc_id, 2 AS steps, sha256(text) AS anchor FROM documents")
def prv1(spark, sf_dir):
    return chains(spark, sf_dir).select("doc_id", F.size("chain").alias("steps"), F.col("chain")[1]["manifest_hash"].alias("anchor"))


@register(
    "prv2_show",
    "SELECT doc_id, 0 AS pos, 'created' AS kind, 'by' AS claim, source AS value FROM documents UNION ALL SELECT doc_id, 1, 'reviewed', 'by', 'desk' FROM documents UNION ALL SELECT doc_id, 1, 'reviewed', 'of', source FROM documents",
)
def prv2(spark, sf_dir):
    return disclosure.show_chain(chains(spark, sf_dir)).drop("manifest_hash")


# -- transparency log -------------------------------------------------------------------------------


def log_of(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("e"))
    return merkle.append(d.select("doc_id", F.unhex("e").alias("entry")), ["doc_id"])


LOG = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, sha256(text) AS entry FROM documents"
LEVELS = f"""l(level, idx, hash) AS (SELECT 0, idx, sha256(unhex('00') || unhex(entry)) FROM ({LOG})
    UNION ALL SELECT level + 1, idx // 2, CASE WHEN hi IS NULL THEN lo ELSE sha256(unhex('01') || unhex(lo) || unhex(hi)) END FROM (
      SELECT level, idx, hash AS lo, lead(hash) OVER (PARTITION BY level ORDER BY idx) AS hi, count(*) OVER (PARTITION BY level) AS n FROM l) WHERE idx % 2 = 0 AND n > 1)"""


@register("log1_append", LOG)
def log1(spark, sf_dir):
    return log_of(spark, sf_dir).select("idx", scalar.id_hex("entry").alias("entry"))


@register("log2_tree_head", f"WITH RECURSIVE {LEVELS} SELECT (SELECT count(*) FROM documents) AS size, (SELECT arg_max(hash, level) FROM l) AS root")
def log2(spark, sf_dir):
    return merkle.head(merkle.levels(log_of(spark, sf_dir)))


@register("log3_node_hashes", f"WITH RECURSIVE {LEVELS} SELECT level, idx, hash FROM l")
def log3(spark, sf_dir):
    return merkle.levels(log_of(spark, sf_dir))


@register(
    "log4_inclusion_paths",
    f"""WITH RECURSIVE {LEVELS} SELECT e.idx, s.level AS step, s.hash AS sibling, s.idx < (e.idx >> s.level) AS on_left
    FROM ({LOG}) e JOIN l s ON s.idx = xor(e.idx >> s.level, 1) AND s.level < (SELECT max(level) FROM l)""",
)
def log4(spark, sf_dir):
    log = log_of(spark, sf_dir)
    return merkle.inclusion_paths(merkle.levels(log), log)


@register("log5_verify_inclusion", f"SELECT idx, idx % 4 = 0 AS ok FROM ({LOG})")
def log5(spark, sf_dir):
    log = log_of(spark, sf_dir)
    lv = merkle.levels(log)
    k, other = F.col("idx") % 4, F.sha2(F.lit("x"), 256)
    # 1: another entry, 2: a sibling on the way replaced, 3: the root of another tree
    claimed = log.withColumn("entry", F.when(k == 1, F.unhex(other)).otherwise(F.col("entry"))).withColumn("root", F.when(k == 3, other).otherwise(F.lit(merkle.head(lv).first()["root"])))
    paths = merkle.inclusion_paths(lv, log).withColumn("sibling", F.when((k == 2) & (F.col("step") == 0), other).otherwise(F.col("sibling")))
    return merkle.verify_inclusion(paths, claimed, F.col("root"))


PREFIXES = (1, 2, 3, 7, 64, 100, 150)
PREFIX_ROOTS = f"""s AS (SELECT unnest([{", ".join(map(str, PREFIXES))}]) AS n), pl(n, level, idx, hash) AS (SELECT n, 0, idx, sha256(unhex('00') || unhex(entry)) FROM s JOIN ({LOG}) ON idx < n
    UNION ALL SELECT n, level + 1, idx // 2, CASE WHEN hi IS NULL THEN lo ELSE sha256(unhex('01') || unhex(lo) || unhex(hi)) END FROM (
      SELECT n, level, idx, hash AS lo, lead(hash) OVER (PARTITION BY n, level ORDER BY idx) AS hi, count(*) OVER (PARTITION BY n, level) AS c FROM pl) WHERE idx % 2 = 0 AND c > 1)"""


@register("log6_prefix_roots", f"WITH RECURSIVE {PREFIX_ROOTS} SELECT CAST(n AS INT) AS n, arg_max(hash, level) AS root FROM pl GROUP BY n")
def log6(spark, sf_dir):
    log = log_of(spark, sf_dir)
    return spark.createDataFrame([(n, merkle.root_of_prefix(log, n)) for n in PREFIXES], "n int, root string")


@register(
    "log6_consistency_proofs",
    f"""WITH RECURSIVE {LEVELS}, s AS (SELECT unnest([{", ".join(map(str, PREFIXES))}]) AS m, (SELECT count(*) FROM documents) AS n),
    w(m, lo, hi, whole, depth, a, z) AS (SELECT m, CAST(0 AS BIGINT), n, true, 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM s
      UNION ALL SELECT m, CASE WHEN m - lo <= k THEN lo ELSE lo + k END, CASE WHEN m - lo <= k THEN lo + k ELSE hi END, whole AND m - lo <= k, depth + 1,
        CASE WHEN m - lo <= k THEN lo + k ELSE lo END, CASE WHEN m - lo <= k THEN hi ELSE lo + k END
      FROM (SELECT *, CAST(pow(2, length(bin(hi - lo - 1)) - 1) AS BIGINT) AS k FROM w WHERE hi > m OR lo > m OR (hi - lo > 1 AND m < hi))),
    r AS (SELECT m, depth, a, z FROM w WHERE depth > 0 UNION ALL SELECT m, max(depth) + 1, arg_max(lo, depth), arg_max(hi, depth) FROM w GROUP BY m HAVING NOT arg_max(whole, depth)),
    o AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY depth DESC) - 1 AS step, a, CASE WHEN z - a = 1 THEN 0 ELSE length(bin(z - a - 1)) END AS level FROM r)
    SELECT m, CAST(step AS INT) AS step, hash FROM o JOIN l ON l.level = o.level AND l.idx = o.a >> o.level""",
)
def log6_proofs(spark, sf_dir):
    log = log_of(spark, sf_dir)
    lv = merkle.levels(log)
    return merkle.consistency_proofs(lv, list(PREFIXES), lv.where("level = 0").count())


@register(
    "log6_verify_consistency",
    f"SELECT CAST(m AS BIGINT) AS m, what, what = 'as it is' AS ok FROM (SELECT unnest([{', '.join(map(str, PREFIXES))}]) AS m), (SELECT unnest(['as it is', 'entry changed', 'step changed', 'step missing', 'step added']) AS what)",
)
def log6_verify(spark, sf_dir):
    log = log_of(spark, sf_dir)
    lv = merkle.levels(log)
    top = merkle.head(lv).first()
    path = merkle.consistency_proofs(lv, list(PREFIXES), top["size"]).groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "hash"))), lambda x: x["hash"]).alias("path"))
    roots = spark.createDataFrame([(m, merkle.root_of_prefix(log, m)) for m in PREFIXES], "m bigint, root_m string")
    proofs = roots.join(path, "m").select("m", F.lit(top["size"]).alias("n"), "root_m", F.lit(top["root"]).alias("root_n"), "path")
    other, end = F.sha2(F.lit("x"), 256), F.size("path")
    case = lambda what, r, p: F.struct(F.lit(what).alias("what"), r.alias("r"), p.alias("p"))
    root, path = F.col("root_m"), F.col("path")
    cases = F.array(
        case("as it is", root, path), case("entry changed", other, path), case("step changed", root, F.concat(F.slice(path, F.lit(1), end - 1), F.array(other))),
        case("step missing", root, F.slice(path, F.lit(1), end - 1)), case("step added", root, F.concat(path, F.array(other))),
    )
    rows = proofs.select("m", "n", "root_n", F.explode(cases).alias("c")).select("m", "n", F.col("c.r").alias("root_m"), "root_n", F.col("c.p").alias("path"), "c.what")
    return merkle.verify_consistency(rows).select("m", "what", "ok")


@register("log7_tree_head_bytes", f"SELECT idx, substr(lpad(lower(to_hex(idx + 1)), 16, '0') || entry, 1, 80) AS head, CAST(136 AS INT) AS n_bytes, idx % 3 = 0 AS ok FROM ({LOG})")
def log7(spark, sf_dir):
    """Signed heads of 136 bytes; of three, one is as signed, one has another size, one another key."""
    seed, k = bytes([42]) * 32, F.col("idx") % 3
    said = F.concat(F.unhex(F.lpad(F.hex(F.col("idx") + 1), 16, "0")), F.col("entry"))
    t = log_of(spark, sf_dir).withColumn("said", said).withColumn("sig", ed25519.signed(F.col("said"), seed))
    key = F.lit(ed25519.public_key(seed))
    t = t.withColumn("head", merkle.tree_head_bytes(F.col("idx") + 1, F.hex("entry"), key, F.col("sig")))
    heard = F.when(k == 1, F.concat(F.unhex(F.lpad(F.hex(F.col("idx") + 2), 16, "0")), F.col("entry"))).otherwise(F.substring("head", 1, 40))
    by = F.when(k == 2, F.lit(ed25519.public_key(bytes([7]) * 32))).otherwise(F.substring("head", 41, 32))
    return t.select("idx", F.substring(F.lower(F.hex("head")), 1, 80).alias("head"), F.octet_length("head").alias("n_bytes"), ed25519.verified(by, heard, F.substring("head", 73, 64)).alias("ok"))


@register("log8_parse_records", f"SELECT idx, entry FROM ({LOG})")
def log8(spark, sf_dir):
    log = log_of(spark, sf_dir)
    # one small file of records for each stretch of 256 entries, read back and put in place
    part = log.groupBy((F.col("idx") / 256).cast("bigint").alias("part")).agg(tree.listagg(F.hex("entry"), "idx", "").alias("x"))
    data = part.select("part", F.concat(F.lit(b"LOG1"), F.unhex("x")).alias("content"))
    rows = merkle.parse_records(data.unionByName(data.withColumn("content", F.concat(F.lit(b"LOG0"), "content"))), b"LOG1", ("part",))
    return rows.select((F.col("part") * 256 + F.col("idx")).alias("idx"), F.lower(F.hex("entry")).alias("entry"))


@register("log9_find", f"SELECT min(idx) AS idx FROM ({LOG}) WHERE entry = (SELECT sha256(text) FROM documents ORDER BY doc_id DESC LIMIT 1)")
def log9(spark, sf_dir):
    last = docs_of(spark, sf_dir).agg(F.max_by(F.sha2(F.col("text").cast("binary"), 256), "doc_id").alias("e")).first()["e"]
    return merkle.find(log_of(spark, sf_dir), F.unhex(F.lit(last)))


# -- layout ----------------------------------------------------------------------------------------


@register("lay2_muldiv", "SELECT l_orderkey, l_linenumber, CAST(floor((CAST(l_partkey AS HUGEINT) * 25400 + 36) // 72) AS BIGINT) AS v FROM lineitem")
def lay2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEYS, scalar.muldiv("l_partkey", F.lit(25400), F.lit(72)).alias("v"))


@register("lay3_layout_text", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM documents")
def lay3(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", scalar.layout_text("text").alias("text"))


@register(
    "lay4_greedy_lines",
    """WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM conversations),
    f AS (SELECT conv_id, turn, ws, 1 AS k, CAST(0 AS BIGINT) AS used, 0 AS line FROM w
      UNION ALL SELECT conv_id, turn, ws, k + 1, CASE WHEN used = 0 THEN length(ws[k]) WHEN used + 1 + length(ws[k]) <= 60 THEN used + 1 + length(ws[k]) ELSE length(ws[k]) END,
        CASE WHEN used = 0 THEN 1 WHEN used + 1 + length(ws[k]) <= 60 THEN line ELSE line + 1 END FROM f WHERE k <= len(ws))
    SELECT conv_id, turn, CAST(max(line) AS INT) AS lines FROM f GROUP BY conv_id, turn""",
)
def lay4(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(layout.break_lines(F.col("text"), 60)).alias("lines"))


@register("lay5_width", "SELECT doc_id, CAST(length(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g')) * 500 AS INT) AS width FROM documents")
def lay5(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", layout.advance_width(F.col("text"), 500).alias("width"))


@register("lay10_scripts", "SELECT doc_id, CASE WHEN regexp_matches(text, '[À-ɏ]') THEN 'latin-extended' ELSE '' END AS scripts FROM documents")
def lay10(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(scalar.scripts_of("text"), ",").alias("scripts"))


@register(
    "lay12_column_widths",
    """WITH s AS (SELECT l_orderkey AS table_id, l_linenumber AS col, CAST(l_quantity AS BIGINT) * 1000 AS w, sum(CAST(l_quantity AS BIGINT) * 1000) OVER (PARTITION BY l_orderkey) AS a, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)),
    o AS (SELECT *, CAST((170000 * w + a // 2) // a AS BIGINT) AS own FROM s)
    SELECT table_id, col, CAST(CASE WHEN col = m THEN 170000 - coalesce(sum(own) OVER (PARTITION BY table_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE own END AS BIGINT) AS width FROM o""",
)
def lay12(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("weight"))
    return layout.column_widths(li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("col"), "weight"), 170000)


@register(
    "lay14_pagination",
    """WITH RECURSIVE b AS (SELECT conv_id, list(CAST(length(text) * 100 AS BIGINT) ORDER BY turn) AS h FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, h, 1 AS k, 1 AS no, CAST(0 AS BIGINT) AS y, 0 AS done FROM b
      UNION ALL SELECT conv_id, h, k + 1, CASE WHEN y > 0 AND y + 3000 + h[k] > 257000 THEN no + 1 ELSE no END, CASE WHEN y = 0 THEN h[k] WHEN y + 3000 + h[k] > 257000 THEN h[k] ELSE y + 3000 + h[k] END, k FROM p WHERE k <= len(h))
    SELECT conv_id, CAST(done - 1 AS INT) AS pos, CAST(no AS INT) AS page FROM p WHERE done > 0""",
)
def lay14(spark, sf_dir):
    h = (F.char_length("text") * 100).cast("bigint")
    b = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", h.alias("h")))).alias("b"))
    blocks = F.transform("b", lambda x: F.struct(x["h"].alias("h"), F.lit(3000).cast("bigint").alias("gap"), F.lit(False).alias("force")))
    return b.select("conv_id", F.posexplode(layout.paginate(blocks, 257000)).alias("pos", "page"))


@register(
    "lay18_image_size",
    """WITH s AS (SELECT p_partkey, p_partkey % 5 > 0 AS png, CAST(p_size AS BIGINT) * 100 AS px, CAST(p_size AS BIGINT) * 50 AS py FROM part),
    m AS (SELECT p_partkey, CASE WHEN png THEN (px * 25400 + 48) // 96 ELSE 40000 END AS w, CASE WHEN png THEN (py * 25400 + 48) // 96 ELSE 30000 END AS h FROM s)
    SELECT p_partkey, CAST(least(w, 170000) AS BIGINT) AS w, CAST(CASE WHEN w > 170000 THEN (h * 170000 + w // 2) // w ELSE h END AS BIGINT) AS h FROM m""",
)
def lay18(spark, sf_dir):
    """Sizes from the headers of PNG data; every fifth part has data of another kind."""
    n = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    magic = F.unhex(F.when(F.col("p_partkey") % 5 > 0, "89504E470D0A1A0A").otherwise("FFD8FFE000104A46"))
    data = F.concat(magic, F.unhex(F.lit("0000000D49484452")), n(F.col("p_size").cast("bigint") * 100), n(F.col("p_size").cast("bigint") * 50))
    t = table(spark, sf_dir, "part").select("p_partkey", layout.png_dimensions(data).alias("d"))
    return t.select("p_partkey", layout.image_size(F.col("d.w"), F.col("d.h"), 170000).alias("s")).select("p_partkey", "s.w", "s.h")


@register("lay21_page_index", "SELECT doc_id, page_no, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT doc_id, i // 5 AS page_no, sha256(text) AS id FROM (" + LINES + ")) GROUP BY doc_id, page_no")
def lay21(spark, sf_dir):
    u = objects_of(spark, sf_dir).select("doc_id", F.floor(F.col("ord") / 5).alias("page_no"), "object_id")
    return layout.page_index(u).select("doc_id", "page_no", F.array_join("ids", ",").alias("ids"))


@register("lay22_recompute", "SELECT doc_id, CASE WHEN lang = 'es' THEN 'NoCache' WHEN lang = 'de' THEN 'UnknownEngine' WHEN lang = 'fr' THEN 'Mismatch' ELSE 'Match' END AS verdict FROM documents")
def lay22(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    ids = F.transform(F.split("text", "\n"), lambda x: F.sha2(x.cast("binary"), 256))
    stored = d.where("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", "9.9").otherwise("1.4").alias("engine"), F.when(F.col("lang") == "fr", F.array(F.lit("x"))).otherwise(ids).alias("pages"))
    return layout.recompute_verdict(stored, d.select("doc_id", ids.alias("again")), ["1.4"])


@register("lay23_capabilities", "SELECT v.engine, c.capability, c.minor <= v.m AS supported FROM (VALUES ('1.0', 0), ('1.4', 4), ('1.11', 11), ('2.0', -1)) v(engine, m), (VALUES (1, 'justify'), (2, 'hyphenation'), (3, 'columns'), (4, 'bidi'), (5, 'cjk'), (6, 'shaping'), (7, 'dictionary'), (8, 'vertical'), (9, 'math'), (10, 'widow-control'), (11, 'tibetan')) c(minor, capability)")
def lay23(spark, sf_dir):
    return layout.capabilities(spark.createDataFrame([("1.0",), ("1.4",), ("1.11",), ("2.0",)], "engine string"))


# -- scalar functions --------------------------------------------------------------------------------


def text_query(name, col, fn, sql, of="documents", key="doc_id"):
    @register(name, f"SELECT {key}, {sql} AS v FROM {of}")
    def q(spark, sf_dir):
        return table(spark, sf_dir, of).select(key, fn(F.col(col)).alias("v"))

    return q


text_query("fn1_named_entities", "html", scalar.decode_named, "replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')", "pages", "page_id")
text_query("fn2_collapse_keep", "text", scalar.collapse_keep, "regexp_replace(text, '\\s+', ' ', 'g')")
text_query("fn3_collapse_trim", "text", scalar.collapse_trim, "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
text_query("fn4_html_escape", "html", scalar.html_escape, "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "pages", "page_id")
text_query("fn5_xml_escape", "html", scalar.xml_escape, "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')", "pages", "page_id")
text_query("fn8_numeric_cell", "text", scalar.numeric_cell, "regexp_matches(text, '[0-9]') AND regexp_matches(text, '^[0-9\\s.,+%$€£()-]+$')")
text_query("fn9_est_width", "text", lambda c: scalar.est_width(c, F.lit(11)), "length(text) * 11 * 0.5")
text_query("snk6_typst_escape", "text", scalar.typst_escape, "regexp_replace(text, '([\\\\#*_`<>@$\\[\\]~])', '\\\\\\1', 'g')")
text_query("src11_guess_mime", "url", scalar.guess_mime, "CASE lower(list_last(string_split(url, '.'))) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'svg' THEN 'image/svg+xml' WHEN 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END", "pages", "page_id")


@register("fn6_inline_text", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def fn6(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tree.listagg(F.col("text"), "turn", "").alias("text"))


@register("fn7_path_text", "SELECT conv_id AS doc_id, CAST(turn AS VARCHAR) AS v FROM conversations UNION ALL SELECT conv_id, turn || '.0' FROM conversations UNION ALL SELECT DISTINCT conv_id, '(root)' FROM conversations")
def fn7(spark, sf_dir):
    n = conversation(spark, sf_dir).select("doc_id", "path")
    roots = n.select("doc_id", F.array().cast("array<int>").alias("path")).distinct()
    return n.union(roots).select("doc_id", scalar.path_text("path").alias("v"))


@register("fn11_split_point", "SELECT o_orderkey, CAST(pow(2, length(bin(o_orderkey + 1)) - 1) AS BIGINT) AS v FROM orders WHERE o_orderkey >= 0")
def fn11(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("n", F.col("o_orderkey") + 2).select("o_orderkey", scalar.split_point(F.col("n")).alias("v"))


@register("fn14_json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn14(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@register(
    "enc2_integer_head",
    """SELECT l_orderkey, l_linenumber, lower(CASE WHEN n < 24 THEN lpad(to_hex(n), 2, '0') WHEN n < 256 THEN '18' || lpad(to_hex(n), 2, '0') WHEN n < 65536 THEN '19' || lpad(to_hex(n), 4, '0') WHEN n < 4294967296 THEN '1a' || lpad(to_hex(n), 8, '0') ELSE '1b' || lpad(to_hex(n), 16, '0') END) AS head
    FROM (SELECT *, l_orderkey * l_partkey * l_linenumber AS n FROM lineitem)""",
)
def enc2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_orderkey") * F.col("l_partkey") * F.col("l_linenumber"))
    return li.select(*KEYS, scalar.head_bytes(0, "n").alias("head"))
