"""Queries of importers, exporters, codecs and page geometry; partly beyond SQL."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from docledger.catalog import register
from docledger.functions import codecs, ed25519, hyphenation, scalar, wire
from docledger.operators import layout, tree
from docledger.plans import storage
from docledger.plans.storage import table
from docledger.queryset import LINES, docs_of, objects_of
from docledger.sinks import container, files, interchange
from docledger.sources import authoring, corpus, geometry, html
from docledger.sources.content import inline_text


def page_nodes(spark, sf_dir):
    return corpus.ingest(table(spark, sf_dir, "pages"), "html", "html", "page_id")


def mapped(df, key, text, fn, out="string"):
    """``(key, v)``: a Python function of a text column, by Arrow batch."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fn(t or "") for t in b.column(1).to_pylist()], {"string": pa.string(), "bigint": pa.int64()}[out])], names=[key, "v"])

    return df.select(key, text).mapInArrow(run, f"{key} bigint, v {out}")


def marked_pages(spark, sf_dir):
    """Pages with ``page_id % 3`` as one digit in front."""
    return table(spark, sf_dir, "pages").select("page_id", F.concat((F.col("page_id") % 3).cast("string"), "html").alias("html"))


@register(
    "src13_html_headings",
    "SELECT page_id AS doc_id, len(regexp_extract_all(html, '<h1>[^<]')) AS n FROM pages WHERE contains(html, '<h1>')",
)
def src13(spark, sf_dir):
    return page_nodes(spark, sf_dir).where("kind = 'h' and level = 1").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("src13_html_nodes")
def src13_nodes(spark, sf_dir):
    return page_nodes(spark, sf_dir).withColumn("path", scalar.path_text("path"))


@register(
    "src14_html_lists",
    "SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages WHERE contains(html, '<li>')",
)
def src14(spark, sf_dir):
    return page_nodes(spark, sf_dir).where("kind = 'p' and depth >= 3 and text is not null").join(page_nodes(spark, sf_dir).where("kind = 'list'").select("doc_id", F.col("path").alias("lp")), "doc_id").where(F.slice("path", F.lit(1), F.size("lp")) == F.col("lp")).groupBy("doc_id").agg(F.count("*").alias("n"))


def plain_sql(x):
    """SQL for markup's text: the entities of the table decoded, white space collapsed."""
    for name, c in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{c}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


HEADING, FOOTER, ITEM = "regexp_extract(html, '<h1>([^<]*)', 1)", "regexp_extract(html, '<footer>([^<]*)', 1)", """unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]+)</a></li>', 1))"""


@register(
    "src15_html_text",
    f"""SELECT page_id AS doc_id, 'heading' AS part, {plain_sql(HEADING)} AS text FROM pages WHERE {HEADING} <> ''
    UNION ALL SELECT page_id, 'footer', {plain_sql(FOOTER)} FROM pages WHERE contains(html, '<footer>')
    UNION ALL SELECT page_id, 'item', {plain_sql('item')} FROM (SELECT page_id, {ITEM} AS item FROM pages)""",
)
def src15(spark, sf_dir):
    """Text of headings, footers and list items as the importer finds it."""
    n = page_nodes(spark, sf_dir)
    part = F.when((F.col("kind") == "h") & (F.col("level") == 1), "heading").when((F.col("kind") == "p") & (F.col("depth") == 1) & F.col("text").startswith("©"), "footer").when((F.col("kind") == "p") & (F.col("depth") == 3), "item")
    in_list = n.where("kind = 'list'").select("doc_id", F.col("path").alias("up"))
    n = n.withColumn("part", part).where("part is not null").withColumn("up", F.slice("path", 1, F.greatest(F.size("path") - 2, F.lit(0))))
    items = n.where("part = 'item'").join(in_list, ["doc_id", "up"], "left_semi")
    return n.where("part <> 'item'").unionByName(items.select(*n.columns)).select("doc_id", "part", "text")


@register(
    "src14_html_tables",
    """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k, l_linenumber, l_partkey FROM lineitem)
    SELECT DISTINCT doc_id, '0.' || c AS path, 'head' AS part, CASE c WHEN 0 THEN 'line no' ELSE 'part' END AS text FROM r, (SELECT unnest([0, 1]) AS c)
    UNION ALL SELECT doc_id, '0.' || (2 * k + c), 'body', CASE c WHEN 0 THEN CAST(l_linenumber AS VARCHAR) ELSE 'part ' || l_partkey || ' & more' END FROM r, (SELECT unnest([0, 1]) AS c)
    UNION ALL SELECT doc_id, '0.' || (2 * max(k) + 2), 'foot', CAST(count(*) AS VARCHAR) FROM r GROUP BY doc_id""",
)
def src14_tables(spark, sf_dir):
    """Order lines as an HTML table each: a head, bare rows, a foot that comes first in the source."""
    cells = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("<td>part  <b>"), F.col("l_partkey").cast("string"), F.lit("</b> &amp; more</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", cells.alias("c")))), lambda x: x["c"]), "\n")
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(rows.alias("rows"), F.count("*").alias("n"))
    page = F.concat(F.lit("<table><thead><tr><th>line<br>no</th><th>part</th></thead><tfoot><tr><td>"), F.col("n").cast("string"), F.lit("</td></tr></tfoot>"), "rows", F.lit("</table>"))
    got = corpus.ingest(by.select("doc_id", page.alias("text")), "html").where("kind = 'cell'")
    return got.select("doc_id", scalar.path_text("path").alias("path"), F.col("role").alias("part"), "text")


@register(
    "src16_tag_classes",
    """SELECT tag, CASE WHEN tag IN ('h1','h2','h3','h4','h5','h6','p','ul','ol','pre','blockquote','section','article','aside','table','figure','img') THEN 'block'
    WHEN tag IN ('html','body','main','div','header','footer','nav','hgroup','fieldset') THEN 'transparent'
    WHEN tag IN ('head','script','style','template','noscript','title','meta','link','svg') THEN 'skipped' ELSE 'inline' END AS class, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag""",
)
def src16(spark, sf_dir):
    tag = F.col("tag")
    cls = F.when(tag.isin(*sorted(html.BLOCK)), "block").when(tag.isin(*sorted(html.TRANSPARENT)), "transparent").when(tag.isin(*sorted(html.SKIPPED)), "skipped").otherwise("inline")
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).withColumn("class", cls)


@register("src12_markdown_nodes")
def src12(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n\n- "))).alias("text"))
    return corpus.ingest(d, "markdown").withColumn("path", scalar.path_text("path"))


@register("src10_json_nodes", f"SELECT doc_id, count(*) AS n FROM ({LINES}) GROUP BY doc_id")
def src10(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.split("text", "\n").alias("content"))).alias("text"))
    return corpus.ingest(d, "json").where("depth = 1").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("src17_pandoc_round_trip", "SELECT page_id, page_id % 3 <> 0 AS same FROM pages")
def src17(spark, sf_dir):
    """To Pandoc and back; every third page loses its last block on the way."""

    def same(t):
        blocks = html.parse(t[1:])
        sent = json.loads(interchange.to_pandoc(blocks))
        if t[0] == "0":
            sent["blocks"].pop()
        back = authoring.parse_pandoc(json.dumps(sent))
        flat = lambda bs: [x for b in bs for x in ([inline_text(b["inlines"])] if "inlines" in b else flat(b.get("children", [])) + [y for i in b.get("items", []) for y in flat(i)])]
        return int([" ".join(x.split()) for x in flat(blocks)] == [" ".join(x.split()) for x in flat(back)])

    return mapped(marked_pages(spark, sf_dir), "page_id", "html", same, "bigint").select("page_id", (F.col("v") == 1).alias("same"))


@register("snk5_pandoc")
def snk5(spark, sf_dir):
    return mapped(table(spark, sf_dir, "pages"), "page_id", "html", lambda t: interchange.to_pandoc(html.parse(t)))


@register("snk6_typst")
def snk6(spark, sf_dir):
    return mapped(table(spark, sf_dir, "pages"), "page_id", "html", lambda t: interchange.to_typst(html.parse(t)))


@register("snk4_json_dump", f"SELECT doc_id, i AS ord, '{{\"kind\":\"p\",\"text\":' || to_json(text) || '}}' AS json FROM ({LINES})")
def snk4(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    return n.select("doc_id", "ord", F.to_json(F.struct(F.lit("p").alias("kind"), "text")).alias("json"))


@register(
    "snk12_redline_report",
    f"""WITH l AS (SELECT doc_id, i, text FROM ({LINES})), p AS (SELECT * FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS predecessor FROM documents) WHERE predecessor IS NOT NULL),
    a AS (SELECT p.doc_id, predecessor, i, text AS old FROM p JOIN l ON l.doc_id = p.predecessor), b AS (SELECT p.doc_id, predecessor, i, text AS new FROM p JOIN l ON l.doc_id = p.doc_id)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, least(count(*), 500) AS changes FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.i = b.i WHERE old IS NULL OR new IS NULL OR old <> new GROUP BY 1""",
)
def snk12(spark, sf_dir):
    n = tree.nodes_of_lines(docs_of(spark, sf_dir))
    changes = tree.redline(n, n, tree.amendments(docs_of(spark, sf_dir), "source"))
    texts = n.select("doc_id", "ord", F.col("text").alias("new"))
    olds = n.select(F.col("doc_id").alias("predecessor"), "ord", F.col("text").alias("old"))
    full = changes.join(texts, ["doc_id", "ord"], "left").join(olds, ["predecessor", "ord"], "left")
    return interchange.redline_html(full).select("doc_id", "changes")


@register("src1_container_round_trip", f"SELECT doc_id, count(DISTINCT text) AS objects FROM ({LINES}) GROUP BY doc_id")
def src1(spark, sf_dir):
    packed = container.pack(objects_of(spark, sf_dir).select("doc_id", "bytes"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x[2]) for x in container.read_many(b.column(1).to_pylist())], pa.int64())], names=["doc_id", "objects"])

    return packed.mapInArrow(run, "doc_id bigint, objects bigint")


@register("src7_point_lookup", f"SELECT DISTINCT sha256(text) AS object_id FROM ({LINES}) WHERE sha256(text) = (SELECT min(sha256(text)) FROM ({LINES}))")
def src7(spark, sf_dir):
    o = objects_of(spark, sf_dir).select("object_id").distinct()
    low = o.agg(F.min("object_id")).first()[0]
    return o.where(F.col("object_id") == low)


@register("src8_page_closure", f"SELECT DISTINCT doc_id, sha256(text) AS object_id FROM ({LINES}) WHERE i // 5 = 1")
def src8(spark, sf_dir):
    u = objects_of(spark, sf_dir)
    page = u.where(F.floor(F.col("ord") / 5) == 1).select("doc_id", "object_id").distinct()
    return u.select("doc_id", "object_id").distinct().join(page, ["doc_id", "object_id"], "left_semi")


HEAD = "lower(CASE WHEN {n} < 24 THEN lpad(to_hex({b} + {n}), 2, '0') WHEN {n} < 256 THEN to_hex({b} + 24) || lpad(to_hex({n}), 2, '0') WHEN {n} < 65536 THEN to_hex({b} + 25) || lpad(to_hex({n}), 4, '0') ELSE to_hex({b} + 26) || lpad(to_hex({n}), 8, '0') END)"


@register(
    "enc1_canonical_round_trip",
    f"""WITH d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST(strlen(text) AS BIGINT) AS m FROM documents)
    SELECT doc_id, sha256(unhex('a2616e' || CASE WHEN n < 24 THEN lpad(to_hex(n), 2, '0') ELSE {HEAD.format(n='n', b=0)} END || '6174' || {HEAD.format(n='m', b=96)} || hex(encode(text)))) AS digest, doc_id % 3 <> 0 AS canonical FROM d""",
)
def enc1(spark, sf_dir):
    """Bytes of a map (keys given in the other order); every third document's have one more at the end."""

    @F.pandas_udf("binary")
    def encoded(s):
        return s.map(lambda t: codecs.encode({"t": t, "n": len(t)}))

    d = docs_of(spark, sf_dir).select("doc_id", encoded("text").alias("b"))
    sent = F.when(F.col("doc_id") % 3 == 0, F.concat("b", F.lit(b"\0"))).otherwise(F.col("b"))
    return d.select("doc_id", F.sha2("b", 256).alias("digest"), codecs.checked(sent)["error"].isNull().alias("canonical"))


@register("hsh1_blake3_ids")
def hsh1_blake3(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.lower(F.hex(codecs.blake3(F.col("text").cast("binary")))).alias("id"))


@register("src22_page_geometry")
def src22(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    frags = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_quantity") * 10).alias("x"), (700.0 - F.col("l_linenumber") * 14).alias("y"),
        F.when(F.col("l_linenumber") == 1, 20.0).otherwise(10.0).alias("size"), F.concat_ws(" ", "l_returnflag", F.col("l_partkey").cast("string")).alias("text"),
    )
    return geometry.recover(frags)


@register("lay7_hyphenation")
def lay7(spark, sf_dir):
    patterns = hyphenation.load_patterns(["1ti", "e1r", "n1d", "1th", "i1n", "s1t"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hyphenation.hyphenate(F.col("text"), patterns).alias("text"))


@register("lay6_code_lines", f"SELECT doc_id, i AS ord, replace(text, chr(13), '') AS line FROM ({LINES})")
def lay6(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.posexplode(layout.code_lines(F.col("text"))).alias("ord", "line"))
    return d.withColumn("ord", F.col("ord").cast("bigint"))


@register("lay8_segments", "SELECT conv_id, turn, list_aggregate(list_transform(string_split(role, 's'), lambda x: length(x)), 'count') > 0 AS some FROM conversations")
def lay8(spark, sf_dir):
    words = {"user", "assist", "ant", "sys", "tem"}
    t = table(spark, sf_dir, "conversations")

    @F.pandas_udf("boolean")
    def some(s):
        return s.map(lambda x: "".join(hyphenation.segment(x, words)) == x)

    return t.select("conv_id", "turn", some("role").alias("some"))


CJK = "translate(lower(text), 'abcdefghij', '漢字仮名。「」、組版')"
BOTH = "'[\u3040-\u30FF\u3400-\u9FFF\u3000-\u303F]'"


@register(
    "lay9_cjk_breaks",
    f"""WITH c AS (SELECT conv_id, turn, string_split({CJK}, '') AS c FROM conversations)
    SELECT conv_id, turn, CAST(len(list_filter(range(2, len(c) + 1), lambda i: regexp_matches(c[i - 1], {BOTH}) AND regexp_matches(c[i], {BOTH}) AND NOT contains('。」、', c[i]) AND c[i - 1] <> '「')) AS INT) AS breaks FROM c""",
)
def lay9(spark, sf_dir):
    text = F.translate(F.lower("text"), "abcdefghij", "漢字仮名。「」、組版")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(layout.cjk_breaks(text)).alias("breaks"))


@register(
    "lay15_widow_control",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN r >= n THEN n WHEN least(r, n - 2) < 2 OR n < 4 THEN 0 ELSE least(r, n - 2) END AS INT) AS stay FROM (SELECT *, CAST(l_quantity AS INT) AS n, l_linenumber * 5 AS r FROM lineitem)""",
)
def lay15(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", layout.split_paragraph(F.col("l_quantity").cast("int"), F.col("l_linenumber") * 5).alias("stay"))


@register("lay20_math_subset", "SELECT page_id, len(list_filter(list_distinct(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)), lambda x: x NOT IN ('math'))) AS n FROM pages")
def lay20(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(layout.unsupported_math(F.col("html"))).alias("n"))


@register("enc5_document_round_trip", "SELECT page_id, page_id % 3 <> 0 AS same FROM pages")
def enc5(spark, sf_dir):
    """To wire form and back; every third page's bytes get one more at the end."""

    def same(t):
        raw = wire.encode_document(html.parse(t[1:]), "und")
        try:
            return int(wire.encode_document(wire.decode_document(raw + b"\0" * (t[0] == "0"))[2], "und") == raw)
        except codecs.CodecError:
            return 0

    return mapped(marked_pages(spark, sf_dir), "page_id", "html", same, "bigint").select("page_id", (F.col("v") == 1).alias("same"))


@register("lay13_justify", "SELECT conv_id, turn, CAST(CASE WHEN n <= 60 AND w > 1 THEN 60 ELSE n END AS INT) AS length FROM (SELECT *, length(t) AS n, len(string_split(t, ' ')) AS w FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM conversations))")
def lay13(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(layout.justify(F.col("text"), 60)).alias("length"))


@register("sig2_sign_and_verify", "SELECT conv_id, turn, turn % 2 = 0 AS ok FROM conversations")
def sig2(spark, sf_dir):
    seed = bytes([42]) * 32
    m = F.col("text").cast("binary")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", m.alias("m"), ed25519.signed(m, seed).alias("s"))
    said = F.when(F.col("turn") % 2 == 0, F.col("m")).otherwise(F.concat(F.col("m"), F.lit(b"!")))
    return t.select("conv_id", "turn", ed25519.verified(F.lit(ed25519.public_key(seed)), said, F.col("s")).alias("ok"))


# -- trees of several levels ------------------------------------------------------------------------

SENTENCES = "SELECT conv_id, CAST(turn AS INT) AS turn, generate_subscripts(string_split(text, '. '), 1) - 1 AS k, unnest(string_split(text, '. ')) AS text FROM conversations"
NEIGHBOURS = "SELECT DISTINCT a.conv_id AS doc_id, b.conv_id AS predecessor FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id - 1"


def dialogues(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    ids = t.select(F.col("conv_id").alias("doc_id")).distinct()
    before = ids.select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_id").alias("predecessor"))
    return tree.nodes_of_dialogues(t), ids.join(before, "doc_id")


@register(
    "dif3_nested_diff",
    f"""WITH s AS ({SENTENCES}), c AS (SELECT conv_id, turn, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id), p AS ({NEIGHBOURS}),
    q AS (SELECT p.* FROM p JOIN t x ON x.conv_id = doc_id JOIN t y ON y.conv_id = predecessor WHERE x.n = y.n),
    u AS (SELECT q.*, x.turn, x.n AS nb, y.n AS na FROM q JOIN c x ON x.conv_id = doc_id JOIN c y ON y.conv_id = predecessor AND y.turn = x.turn)
    SELECT doc_id, predecessor, '(root)' AS path FROM p WHERE (doc_id, predecessor) NOT IN (SELECT (doc_id, predecessor) FROM q)
    UNION ALL SELECT doc_id, predecessor, CAST(turn AS VARCHAR) FROM u WHERE na <> nb
    UNION ALL SELECT u.doc_id, u.predecessor, u.turn || '.' || b.k FROM u JOIN s b ON b.conv_id = u.doc_id AND b.turn = u.turn JOIN s a ON a.conv_id = u.predecessor AND a.turn = u.turn AND a.k = b.k WHERE na = nb AND a.text <> b.text""",
)
def dif3_nested(spark, sf_dir):
    n, pairs = dialogues(spark, sf_dir)
    return tree.structural_diff(n, n, pairs)


@register(
    "dif4_nested_redline",
    f"""WITH s AS ({SENTENCES}), c AS (SELECT DISTINCT conv_id, turn FROM s), p AS ({NEIGHBOURS}),
    b AS (SELECT p.*, turn FROM p JOIN c ON c.conv_id = doc_id), a AS (SELECT p.*, turn FROM p JOIN c ON c.conv_id = predecessor),
    bs AS (SELECT b.*, k, text FROM b JOIN s ON s.conv_id = doc_id AND s.turn = b.turn), sa AS (SELECT a.*, k, text FROM a JOIN s ON s.conv_id = predecessor AND s.turn = a.turn),
    common AS (SELECT b.* FROM b JOIN a USING (doc_id, predecessor, turn))
    SELECT doc_id, predecessor, CAST(turn AS VARCHAR) AS path, 'insert' AS change FROM b WHERE (doc_id, predecessor, turn) NOT IN (SELECT (doc_id, predecessor, turn) FROM a)
    UNION ALL SELECT doc_id, predecessor, CAST(turn AS VARCHAR), 'delete' FROM a WHERE (doc_id, predecessor, turn) NOT IN (SELECT (doc_id, predecessor, turn) FROM b)
    UNION ALL SELECT doc_id, predecessor, turn || '.' || k, CASE WHEN sa.text IS NULL THEN 'insert' WHEN bs.text IS NULL THEN 'delete' ELSE 'change' END
      FROM (SELECT * FROM bs SEMI JOIN common USING (doc_id, predecessor, turn)) bs FULL JOIN (SELECT * FROM sa SEMI JOIN common USING (doc_id, predecessor, turn)) sa USING (doc_id, predecessor, turn, k) WHERE bs.text IS DISTINCT FROM sa.text""",
)
def dif4_nested(spark, sf_dir):
    n, pairs = dialogues(spark, sf_dir)
    return tree.redline(n, n, pairs).select("doc_id", "predecessor", scalar.path_text("path").alias("path"), "change")


@register(
    "red2_items_and_cells",
    f"""WITH b AS (SELECT conv_id AS doc_id, '0.' || turn AS up, turn, role, text, sha256('p' || chr(31) || text) AS h FROM conversations),
    c AS (SELECT doc_id, i, generate_subscripts(string_split(text, ' | '), 1) - 1 AS k, unnest(string_split(text, ' | ')) AS text FROM ({LINES}) WHERE contains(text, ' | '))
    SELECT 'list' AS place, doc_id, '0' AS path, 'list' AS kind, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS proof FROM b GROUP BY doc_id
    UNION ALL SELECT 'list', doc_id, up || '.0', 'p', text, NULL FROM b WHERE role <> 'user'
    UNION ALL SELECT 'list', doc_id, up, 'redacted', NULL, sha256(h) FROM b WHERE role = 'user'
    UNION ALL SELECT 'table', doc_id, i || '.' || k, 'cell', text, NULL FROM c WHERE NOT regexp_matches(text, '[0-9]')
    UNION ALL SELECT 'table', doc_id, i || '.' || k, 'redacted', NULL, sha256(sha256('cell' || chr(31) || text)) FROM c WHERE regexp_matches(text, '[0-9]')""",
)
def red2(spark, sf_dir):
    """List items (with all they hold) and table cells go by their paths: [list, item] and [table, cell]."""
    t, turn = table(spark, sf_dir, "conversations"), F.col("turn").cast("int")
    lists = t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.lit("list").alias("kind")).select("doc_id", F.array(F.lit(0)).alias("path"), F.lit(0).cast("bigint").alias("ord"), "kind", F.lit(None).cast("string").alias("text"))
    items = t.select(F.col("conv_id").alias("doc_id"), F.array(F.lit(0), turn, F.lit(0)).alias("path"), (turn + 1).cast("bigint").alias("ord"), F.lit("p").alias("kind"), "text")
    wanted = t.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.array(F.lit(0), turn).alias("path"), F.lit("private").alias("reason"))
    rows = tree.nodes_of_lines(docs_of(spark, sf_dir)).where("kind = 'row'").select("doc_id", F.col("path")[0].alias("i"), F.posexplode(F.split("text", " \\| ")).alias("k", "text"))
    cells = rows.select("doc_id", F.array("i", "k").alias("path"), F.col("k").cast("bigint").alias("ord"), F.lit("cell").alias("kind"), "text")
    from docledger.operators import disclosure

    own = cells.where(F.col("text").rlike("[0-9]")).select("doc_id", "path", F.lit("number").alias("reason"))
    out = disclosure.redact(lists.unionByName(items), wanted).withColumn("place", F.lit("list")).unionByName(disclosure.redact(cells, own).withColumn("place", F.lit("table")))
    return out.select("place", "doc_id", scalar.path_text("path").alias("path"), "kind", "text", "proof")


# -- wire records, files ----------------------------------------------------------------------------


@register("enc6_records", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'unknown keys' WHEN 2 THEN 'lacks' WHEN 3 THEN 'bad' WHEN 4 THEN 'bytes' ELSE 'same' END AS verdict FROM documents")
def enc6(spark, sf_dir):
    """A document's manifest, metadata, resources, cache, index, provenance and page, to bytes and back; some of them broken."""

    def run(batches):
        for b in batches:
            for part in codecs.slices(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(record_verdicts(part.column(1).to_pylist()), pa.string())], names=["doc_id", "verdict"])

    d = docs_of(spark, sf_dir).select("doc_id", F.concat((F.col("doc_id") % 6).cast("string"), F.coalesce("text", F.lit(""))).alias("text"))
    return d.mapInArrow(run, "doc_id bigint, verdict string")


def record_verdicts(texts):
    """What becomes of the records of each text, which begins with 0 to 5; ids of all texts are computed together."""
    texts = [t or "" for t in texts]
    *own, x = codecs.blake3_many([*(t[1:].encode() for t in texts), b"x"])
    return [record_verdict(int(t[0]), t[1:], [i, x]) for t, i in zip(texts, own, strict=True)]


def record_verdict(k, text, ids):
    chain = [{"kind": "created", "claims": {"by": text[:9]}, "manifest": ids[1]}]
    records = {
        "manifest": {"version": [1, 0], "root": ids[0], "profile": "base", "metadata": ids[1]}, "metadata": {"title": text[:40], "authors": ["a", "b"], "custom": {"k": text[:5]}},
        "resources": {"items": [{"id": ids[0], "mime": "image/png"}]}, "blob": {"mime": "text/plain", "data": text.encode()}, "render_cache": {"engine": "1.4", "pages": ids, "hash": ids[0]},
        "page_index": {"pages": [ids, []]}, "provenance": {"chain": chain},
        "page": {"width": 210000, "height": 297000, "ops": [{"op": "text", "x": 1, "y": 2, "size": 11, "text": text[:30]}, {"op": "image", "x": 0, "y": 0, "w": 5, "h": 5, "res": ids[1]}]},
    }
    for kind, v in records.items():
        try:
            raw = wire.encode_record(kind, v)
            if k == 1:
                raw = codecs.encode({**v, "more": 1})
            elif k == 2 and kind == "manifest":
                raw = codecs.encode({x: y for x, y in v.items() if x != "root"})
            elif k == 3 and kind == "page":
                raw = codecs.encode({**v, "ops": [{"op": "text", "x": -1, "y": 2, "size": 11, "text": ""}]})
            elif k == 4:
                raw += b"\0"
            if wire.encode_record(kind, wire.decode_record(kind, raw)) != raw:
                return "other bytes"
        except codecs.CodecError as e:
            return next((x for x in ("unknown keys", "lacks", "bad") if x in str(e)), "bytes")
    return "same"


def stage_folder(spark, what):
    return f"{storage.shared_dir(spark)}/docledger/{what}-{uuid.uuid4().hex}"


@register("snk3_write_files", f"SELECT sha256(text) AS object_id, count(DISTINCT doc_id) AS documents FROM ({LINES}) GROUP BY 1")
def snk3(spark, sf_dir):
    """Containers written as files by the executors and read back from the folder."""
    folder = stage_folder(spark, "containers")
    packed = container.pack(objects_of(spark, sf_dir).select("doc_id", "bytes"))
    files.write_files(packed.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".box")).alias("name"), "content"), folder).agg(F.sum("n_bytes")).collect()
    got = container.objects_of_files(spark, folder).where("problem is null")
    return got.select(F.sha2("bytes", 256).alias("object_id"), "path").distinct().groupBy("object_id").agg(F.count("*").alias("documents"))


@register("src31_migrate", "SELECT 'html' AS ext, count(*) AS files, CAST(0 AS BIGINT) AS failed FROM pages UNION ALL SELECT 'json', count(*), count(*) FILTER (doc_id % 2 = 1) FROM documents")
def src31(spark, sf_dir):
    """Files of a folder by their extensions; every second JSON file is none, and files of unknown kinds have no rows."""
    folder = stage_folder(spark, "migrate")
    name = lambda key, ext: F.concat(F.lit(ext[:1]), F.col(key).cast("string"), F.lit(f".{ext}")).alias("name")
    good = F.to_json(F.struct(F.split("text", "\n").alias("content")))
    d = docs_of(spark, sf_dir).select(name("doc_id", "json"), F.when(F.col("doc_id") % 2 == 0, good).otherwise(F.concat(F.lit("{"), "text")).cast("binary").alias("content"))
    p = table(spark, sf_dir, "pages").select(name("page_id", "html"), F.col("html").cast("binary").alias("content"))
    other = docs_of(spark, sf_dir).where("doc_id < 10").select(name("doc_id", "xyz"), F.col("text").cast("binary").alias("content"))
    files.write_files(d.union(p).union(other), folder).agg(F.sum("n_bytes")).collect()
    rows = corpus.migrate(spark, folder).where("depth = 0").withColumn("ext", F.regexp_extract("path_of", "([a-z]+)$", 1))
    return rows.groupBy("ext").agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@register("src2_container_integrity", "SELECT doc_id, doc_id % 5 = 0 AS whole FROM documents")
def src2(spark, sf_dir):
    """Containers as packed, with a byte changed in the middle, cut short, with another magic, with bytes behind them."""
    packed = container.pack(objects_of(spark, sf_dir).select("doc_id", "bytes"))
    k, n, c = F.col("doc_id") % 5, F.octet_length("content"), F.col("content")
    at = F.floor(n / 2).cast("int")
    other = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(c, at, 1)), 16, 10).cast("bigint").bitwiseXOR(F.lit(255))), 2, "0"))
    sent = F.when(k == 1, F.concat(F.substring(c, F.lit(1), at - 1), other, F.substring(c, at + 1, n))).when(k == 2, F.substring(c, F.lit(1), n - 7)).when(k == 3, F.concat(F.lit(b"?"), F.substring(c, F.lit(2), n))).when(k == 4, F.concat(c, F.lit(b"more"))).otherwise(c)

    def run(batches):
        for b in batches:
            got = container.read_many(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([not isinstance(x, container.BadContainer) for x in got], pa.bool_())], names=["doc_id", "whole"])

    return packed.select("doc_id", sent.alias("content")).mapInArrow(run, "doc_id bigint, whole boolean")


def wire_verdict(enc, dec, value):
    """For a text that begins with 0 to 3: same, unknown key, missing key, more bytes; what the decoder says."""

    def verdict(t):
        v = value(t[1:])
        raw, first = enc(v), sorted(v)[0]
        if t[0] == "1":
            raw = codecs.encode({**v, "zz": [1]})
        elif t[0] == "2":
            raw = codecs.encode({k: x for k, x in v.items() if k != first})
        elif t[0] == "3":
            raw += b"\0"
        try:
            return "same" if enc(dec(raw)) == raw else "other bytes"
        except codecs.CodecError:
            return "refused"

    return verdict


def wire_query(name, enc, dec, value, dropped="refused"):
    @register(name, f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'same' WHEN 2 THEN '{dropped}' ELSE 'refused' END AS verdict FROM documents")
    def q(spark, sf_dir):
        d = docs_of(spark, sf_dir).select("doc_id", F.concat((F.col("doc_id") % 4).cast("string"), F.substring("text", 1, 200)).alias("text"))
        return mapped(d, "doc_id", "text", wire_verdict(enc, dec, value)).select("doc_id", F.col("v").alias("verdict"))

    return q


# a layer may lack any field, so one without its first field is whole
wire_query("frm20_layer_wire", wire.encode_layer, wire.decode_layer, lambda t: {"a": len(t), "b": t, "c": len(t) % 2 == 0}, "same")
wire_query("sig6_signature_wire", wire.encode_signature, wire.decode_signature, lambda t: {"scope": "document", "alg": "ed25519", "target": t.encode()[:32], "key": b"k" * 32, "sig": b"s" * 64})
wire_query("dsc4_bundle_wire", wire.encode_bundle, wire.decode_bundle, lambda t: {"doc": b"d" * 32, "i": 0, "content": t.encode(), "leaves": [b"l" * 32]})


REFERENCES = " &#169; &#x2014; &#xD800; &#38;lt; &bogus; &#x; &#1114112; &unfinished"


@register("fn1_character_references", f"SELECT page_id, {plain_sql('html')} || ' © — &#xD800; &lt; &bogus; &#x; &#1114112; &unfinished' AS v FROM pages")
def fn1_references(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(scalar.collapse_trim(scalar.decode_entities("html")), scalar.decode_entities(F.lit(REFERENCES))).alias("v"))


@register(
    "lay16_columns",
    """WITH RECURSIVE b AS (SELECT conv_id, list(CAST(length(text) * 100 AS BIGINT) ORDER BY turn) AS h FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, h, 1 AS k, 1 AS no, CAST(0 AS BIGINT) AS y, 0 AS done FROM b
      UNION ALL SELECT conv_id, h, k + 1, CASE WHEN y > 0 AND y + 3000 + h[k] > 90000 THEN no + 1 ELSE no END, CASE WHEN y = 0 THEN h[k] WHEN y + 3000 + h[k] > 90000 THEN h[k] ELSE y + 3000 + h[k] END, k FROM p WHERE k <= len(h))
    SELECT conv_id, CAST(done - 1 AS INT) AS pos, CAST((no - 1) // 2 + 1 AS INT) AS page, CAST((no - 1) % 2 AS INT) AS col FROM p WHERE done > 0""",
)
def lay16(spark, sf_dir):
    h = (F.char_length("text") * 100).cast("bigint")
    b = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", h.alias("h")))).alias("b"))
    blocks = F.transform("b", lambda x: F.struct(x["h"].alias("h"), F.lit(3000).cast("bigint").alias("gap"), F.lit(False).alias("force")))
    return b.select("conv_id", F.posexplode(layout.flow_columns(blocks, 90000, 2)).alias("pos", "at")).select("conv_id", "pos", "at.page", F.col("at.column").alias("col"))


@register(
    "lay14_keep_and_force",
    """WITH RECURSIVE b AS (SELECT conv_id, list({'h': CAST(length(text) * 100 AS BIGINT), 'f': role = 'system', 'k': turn % 3 = 0, 'b': 2000 + 1000 * (turn % 3), 'a': 3000 - 500 * (turn % 4)} ORDER BY turn) AS x FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, x, 0 AS k, 1 AS no, CAST(0 AS BIGINT) AS y, true AS top, CAST(0 AS BIGINT) AS aft, CAST(NULL AS INT) AS page FROM b
      UNION ALL SELECT conv_id, x, k + 1, CASE WHEN new THEN no + 1 ELSE no END,
        CASE WHEN f THEN CASE WHEN new THEN 0 ELSE y END WHEN new THEN h ELSE y + gap + h END, f AND (new OR top), CASE WHEN f THEN aft ELSE a END, CASE WHEN f THEN NULL WHEN new THEN no + 1 ELSE no END
      FROM (SELECT *, NOT top AND (f OR y + gap + h + CASE WHEN kp THEN 5000 ELSE 0 END > 60000) AS new FROM (
        SELECT *, CASE WHEN top THEN 0 ELSE greatest(aft, x[k + 1].b) END AS gap, x[k + 1].h AS h, x[k + 1].f AS f, x[k + 1].k AS kp, x[k + 1].a AS a FROM p WHERE k < len(x))))
    SELECT conv_id, CAST(k - 1 AS INT) AS pos, CAST(page AS INT) AS page FROM p WHERE k > 0""",
)
def lay14_keep(spark, sf_dir):
    """System turns force a page, every third block keeps with the next, spaces before and after differ."""
    turn = F.col("turn").cast("bigint")
    block = F.struct("turn", (F.char_length("text") * 100).cast("bigint").alias("h"), (2000 + 1000 * (turn % 3)).alias("before"), (3000 - 500 * (turn % 4)).alias("after"), (F.col("role") == "system").alias("force"), (turn % 3 == 0).alias("keep"))
    b = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return b.select("conv_id", F.posexplode(layout.place_blocks(F.col("b"), 60000, 5000)).alias("pos", "page"))


@register(
    "trv1_nested_extract",
    f"""WITH t AS (SELECT conv_id, turn, role, {plain_sql('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id AS doc_id, 'Talk ' || conv_id || chr(10) || chr(10) || string_agg(n || '. ' || t, chr(10) ORDER BY n) || chr(10) || chr(10)
      || string_agg('- ' || role, chr(10) ORDER BY n) || chr(10) || chr(10) || 'no' || chr(9) || 'who' || chr(10) || string_agg(turn || chr(9) || role, chr(10) ORDER BY n) || chr(10) || chr(10) || '[pic]' || chr(10) AS text FROM t GROUP BY conv_id""",
)
def trv1_nested(spark, sf_dir):
    """Conversations as pages of a heading, a numbered list in a section, bullets, a table and a figure; read back as text."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", scalar.html_escape(F.col("text")).alias("t"))
    turn = F.col("turn").cast("string")
    listed = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<li><p>"), "t", F.lit("</p></li>")).alias("a"), F.concat(F.lit("<li>"), "role").alias("b"), F.concat(F.lit("<tr><td>"), turn, F.lit("<td>"), "role").alias("c"))))
    by = t.groupBy("conv_id").agg(listed.alias("x"))
    part = lambda k: F.array_join(F.transform("x", lambda r: r[k]), "\n")
    page = F.concat(F.lit("<h1>Talk "), F.col("conv_id").cast("string"), F.lit("</h1><section><ol>"), part("a"), F.lit("</ol></section><ul>"), part("b"), F.lit("</ul><table><tr><th>no<th>who</tr>"), part("c"), F.lit("</table><figure><img src=x alt=pic></figure>"))
    return tree.extract_trees(corpus.ingest(by.select(F.col("conv_id").alias("doc_id"), page.alias("text")), "html"))
