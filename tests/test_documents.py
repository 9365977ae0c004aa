import json

import pytest

from docledger.operators import disclosure, merkle, store, tree, validate
from docledger.sinks import interchange
from docledger.sources import authoring, corpus, geometry, html, markdown
from docledger.sources.content import inline_text

PAGE = """<html><head><title>never used</title></head><body><div><h1>Head &amp; more</h1><p>First <b>bold</b> <a href="/x">link</a><p>Second
<ul><li>one<li>two <em>it</em></ul><blockquote><p>said</p></blockquote><pre>a
 b
</pre><table><thead><tr><th>k<th>v</thead><tr><td>a<td>1<tr><td>b<td>2</table>loose <i>text</i><script>var x = "</p>";</script>
<figure><img src="i.png" alt="pic"></figure></div></body></html>"""


def test_html():
    got = html.parse(PAGE)
    assert [b["kind"] for b in got] == ["h", "p", "p", "list", "sec", "code", "table", "p", "fig"]
    assert inline_text(got[0]["inlines"]) == "Head & more"
    assert inline_text(got[1]["inlines"]) == "First bold link"
    assert len(got[3]["items"]) == 2 and got[4]["role"] == "quote" and got[5]["text"] == "a\n b"
    assert [p for p, _ in got[6]["rows"]] == ["head", "body", "body"]
    assert got[8]["alt"] == "pic"


def test_html_references_end_in_a_semicolon():
    got = html.parse('<h1>a&&amp</h1><p>&copy2 &copy; &amp;lt; &#65 &#65; &#x42; &#128; &eacute; &notanentity; &ampx; AT&T&lt<a href="/?a=1&copy=2&amp;b">l</a>\ufdd0</p><pre>&amp &amp;</pre>')
    assert [inline_text(b["inlines"]) if "inlines" in b else b["text"] for b in got] == ["a&&amp", "&copy2 © &lt; &#65 A B € é &notanentity; &ampx; AT&T&ltl\ufdd0", "&amp &"]
    assert [x["href"] for x in got[1]["inlines"] if isinstance(x, dict)] == ["/?a=1&copy=2&b"]


def test_markdown():
    text = "# Title\n\nA *b* **c** `d` [e](/f)\nnext\n\n> quoted\n\n- x\n- y\n  more\n\n1. one\n2. two\n\n```py\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n<div>raw</div>\n\nUnder\n-----\n"
    got = markdown.parse(text)
    assert [b["kind"] for b in got] == ["h", "p", "sec", "list", "list", "code", "table", "h"]
    assert inline_text(got[1]["inlines"]) == "A b c d e next"
    assert got[4]["ordered"] and not got[3]["ordered"] and got[7]["level"] == 2
    assert got[6]["rows"][1] == ("body", [["1"], ["2"]])


def test_authoring_json_and_problems():
    doc = {"content": ["plain", {"type": "heading", "level": 2, "text": "H"}, {"type": "section", "role": "terms", "content": [{"type": "list", "ordered": True, "items": ["a", ["b", "c"]]}]}, {"type": "field", "id": "po", "kind": "text", "label": "Order"}]}
    got = authoring.parse_json(json.dumps(doc))
    assert [b["kind"] for b in got] == ["p", "h", "sec", "field"]
    for bad in ("[]", "{", '{"content":[{"type":"nope"}]}', '{"content":[{"type":"heading","level":9}]}'):
        with pytest.raises(authoring.ImportProblem):
            authoring.parse_json(bad)


def test_pandoc_round_trip_and_typst():
    blocks = html.parse(PAGE)
    back = authoring.parse_pandoc(interchange.to_pandoc(blocks, "T"))
    assert [inline_text(b["inlines"]) for b in back if "inlines" in b][:3] == [inline_text(b["inlines"]) for b in blocks if "inlines" in b][:3]
    assert [b["kind"] for b in back][:7] == [b["kind"] for b in blocks][:7]
    assert interchange.typst_escape("a*b_#[x]") == "a\\*b\\_\\#\\[x\\]"
    assert "````" in interchange.to_typst([{"kind": "code", "text": "```"}])


def test_builder():
    _, blocks = authoring.Compose().title("Invoice").h1("Invoice").para("Thanks").numbered(["Pay"]).table(["a"], [["1"]]).section("s", lambda c: c.para("in")).finish()
    assert [b["kind"] for b in blocks] == ["h", "p", "list", "table", "sec"]


def test_ingest_keeps_bad_documents_as_rows(spark):
    df = spark.createDataFrame([(1, '{"content":["a","b"]}'), (2, "broken"), (3, None)], "doc_id bigint, text string")
    rows = corpus.ingest(df, "json").collect()
    assert sorted((r.doc_id, r.kind, tuple(r.path)) for r in rows if r.kind == "p") == [(1, "p", (0,)), (1, "p", (1,))]
    assert {r.doc_id for r in rows if r.error} == {2, 3}


def test_migrate_by_extension(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# One\n\npara")
    (tmp_path / "sub" / "b.html").write_text("<h1>Two</h1>")
    (tmp_path / "c.json").write_text("no json")
    (tmp_path / "d.bin").write_bytes(b"x")
    got = corpus.migrate(spark, str(tmp_path)).collect()
    assert {r.text for r in got if r.kind == "h"} == {"One", "Two"}
    assert sum(r.error is not None for r in got) == 1 and len({r.path_of for r in got}) == 3


def test_page_geometry(spark):
    frag = geometry.Fragment
    lines = [frag(50, 700, 24, "Big title"), frag(50, 660, 10, "First line of"), frag(125, 660, 10, "text"), frag(50, 646, 10, "goes on")]
    rows = [frag(x, 600 - 14 * i, 10, t) for i, r in enumerate([("Item", "Price", "No"), ("Pen", "1.20", "3"), ("Ink", "4.00", "5")]) for x, t in zip((50, 200, 350), r, strict=True)]
    got = geometry.page_blocks(lines + rows)
    assert got[0] == ("h", 1, "Big title") and got[1][2] == "First line of text goes on"
    assert [x for x in got if x[0] == "row"] == [("row", None, "Item\tPrice\tNo"), ("row", None, "Pen\t1.20\t3"), ("row", None, "Ink\t4.00\t5")]
    columns = [frag(50, 700 - 12 * i, 10, f"left line number {i}") for i in range(8)] + [frag(300, 700 - 12 * i, 10, f"right words line {i} here") for i in range(8)]
    text = [t for _, _, t in geometry.page_blocks(columns)]
    assert text[0].startswith("left line number 0 left") and text[-1].startswith("right words")
    df = spark.createDataFrame([(1, 1, f.x + 0.0, f.y + 0.0, f.size + 0.0, f.text) for f in lines], "doc_id bigint, page_no int, x double, y double, size double, text string")
    assert geometry.recover(df).where("kind = 'h'").count() == 1


def test_pages_are_recovered_many_a_batch(spark):
    rows = [(d, 1, 50.0 + 5 * k, 700.0 - 14 * k, 10.0, f"line {k}") for d in range(3000) for k in (2, 0, 1)]
    rows += [(None, None, 1.0, 9.0, 10.0, "b"), (None, None, 1.0, 10.0, 10.0, "a"), (None, None, None, None, 10.0, "c"), (9000, 1, 1.0, 1.0, 10.0, None), (9001, 1, 1.0, 1.0, 10.0, " ")]
    got = geometry.recover(spark.createDataFrame(rows, "doc_id bigint, page_no int, x double, y double, size double, text string"))
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    texts = {}
    for r in sorted(got.collect(), key=lambda r: r.ord):
        texts.setdefault(r.doc_id, []).append((r.kind, r.text))
    assert texts == {None: [("p", "a b c")]} | {d: [("p", "line 0 line 1 line 2")] for d in range(3000)}


@pytest.mark.parametrize("n", range(1, 21))
def test_consistency_proof_ranges(n):
    for m in range(1, n):
        covered = merkle.consistency_proof(m, n)
        assert all(a < b <= n for a, b in covered)
        assert any(b == m or a == m for a, b in covered)


def plain_root(entries):
    import hashlib

    h = lambda x: hashlib.sha256(x).digest()
    if not entries:
        return hashlib.sha256(b"").hexdigest()
    level = [h(b"\x00" + e) for e in entries]
    while len(level) > 1:
        level = [h(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8])
def test_merkle_heads_and_proofs(spark, n):
    entries = [bytes([i]) * 32 for i in range(n)]
    log = spark.createDataFrame(list(enumerate(entries)), "idx bigint, entry binary")
    levels = merkle.levels(log)
    head = merkle.head(levels).first()
    assert (head.size, head.root) == (n, plain_root(entries))
    if n:
        paths = merkle.inclusion_paths(levels, log)
        assert [r.ok for r in merkle.verify_inclusion(paths, log, head.root).collect()] == [True] * n
        wrong = log.selectExpr("idx", "cast('other' as binary) as entry")
        assert not any(r.ok for r in merkle.verify_inclusion(paths, wrong, head.root).collect())


def test_proofs_broadcast_no_nodes(spark):
    log = spark.createDataFrame([(i, bytes([i])) for i in range(5)], "idx bigint, entry binary")
    levels = merkle.levels(log)
    paths = merkle.inclusion_paths(levels, log)
    for df in (paths, merkle.verify_inclusion(paths, log, merkle.head(levels).first().root)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_log_grows_consistently(spark):
    rows = spark.createDataFrame([(i, bytes([i])) for i in range(6)], "k bigint, entry binary")
    log = merkle.append(rows, ["k"]).cache()
    assert sorted((r.idx, bytes(r.entry)) for r in log.collect()) == [(i, bytes([i])) for i in range(6)]
    r4, r6 = merkle.root_of_prefix(log, 4), merkle.root_of_prefix(log, 6)
    assert merkle.consistency(log, 4, 6, r4, r6) and not merkle.consistency(log, 4, 6, r6, r6)


def test_closure_of_shared_and_cyclic_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    got = sorted(tuple(r) for r in store.closure(e, spark.createDataFrame([("a",), ("x",)], "root string")).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("x", "x"), ("x", "y")]


def conversation(spark):
    rows = [(1, 0, "user", "my secret"), (1, 1, "assistant", "ok"), (2, 0, "user", "my secret")]
    return tree.nodes_of_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))


def test_redaction_leaves_no_trace_and_proofs_hold(spark):
    n = conversation(spark)
    out = disclosure.redact(n, spark.createDataFrame([(1, [0], "why"), (2, [0, 0], "why")], "doc_id bigint, path array<int>, reason string"))
    assert sorted((r.doc_id, tuple(r.path), r.kind) for r in out.collect()) == [(1, (0,), "redacted"), (1, (1,), "sec"), (1, (1, 0), "p"), (2, (0,), "sec"), (2, (0, 0), "redacted")]
    from pyspark.sql import functions as F

    assert disclosure.leaks(out, F.lit("secret")).first().leaks == 0
    assert disclosure.leaks(n, F.lit("secret")).first().leaks == 2


def test_disclosure_detects_changes_and_salts_hide(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nx\nc")], "doc_id bigint, text string")
    n = tree.nodes_of_lines(docs)
    salts = n.select("doc_id", F.element_at("path", 1).alias("i"), F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("salt"))
    plain, salted = disclosure.seal(n), disclosure.seal(n, salts)
    leaf = lambda d: {(r.doc_id, r.i): r.leaf for r in d.collect()}
    assert leaf(plain)[1, 0] == leaf(plain)[2, 0] and leaf(salted)[1, 0] != leaf(salted)[2, 0]
    b = disclosure.disclose(salted, n, spark.createDataFrame([(1, 1), (1, 9), (7, 0)], "doc_id bigint, i int"), salts)
    assert {(r.doc_id, r.i): r.problem for r in b.collect()} == {(1, 1): None, (1, 9): "block out of range", (7, 0): "no such document"}
    roots = disclosure.roots(salted)
    r = disclosure.verify_disclosure(b, roots).first()
    assert r.valid and r.hidden == 2 and r.salted
    assert not disclosure.verify_disclosure(b.withColumn("text", F.lit("forged")), roots).first().valid


def test_validation_gates_and_roll_up(spark):
    docs = spark.createDataFrame([(1, "en", 1), (2, "", 1), (3, None, 9)], "doc_id bigint, lang string, major int")
    stop = validate.version(docs, 1)
    rest = validate.gated(validate.language(docs), stop)
    out = {r.doc_id: (r.valid, r.errors) for r in validate.roll_up(docs, validate.report(stop, rest)).collect()}
    assert out == {1: (True, 0), 2: (False, 1), 3: (False, 1)}


def test_nested_diffs_stop_at_the_topmost_place(spark):
    from docledger.operators import tree

    schema = "doc_id bigint, path array<int>, kind string, text string"
    a = [([0], "sec", None), ([0, 0], "p", "x"), ([0, 1], "sec", None), ([0, 1, 0], "p", "deep"), ([1], "list", None), ([1, 0, 0], "p", "one"), ([2], "p", "same"), ([3], "p", "t")]
    b = [([0], "sec", None), ([0, 0], "p", "x"), ([0, 1], "sec", None), ([0, 1, 0], "p", "deeper"), ([1], "list", None), ([1, 0, 0], "p", "two"), ([2], "p", "same"), ([3], "code", "t")]
    c = [*b[:4], ([0, 2], "p", "more"), *b[4:]]
    rows = [(k, *x) for k, doc in enumerate((a, b, c, [])) for x in doc]
    n = spark.createDataFrame(rows, schema)
    pairs = spark.createDataFrame([(1, 0), (2, 1), (2, 2)], "doc_id bigint, predecessor bigint")
    diff = {(r.doc_id, r.path) for r in tree.structural_diff(n, n, pairs).collect()}
    assert diff == {(1, "0.1.0"), (1, "1"), (1, "3"), (2, "0")}
    red = {(r.doc_id, tuple(r.path), r.change) for r in tree.redline(n, n, pairs).collect()}
    assert red == {(1, (0, 1, 0), "change"), (1, (1,), "change"), (1, (3,), "change"), (2, (0, 2), "insert")}


def test_shared_folder_is_demanded_on_a_cluster():
    from docledger.plans import storage

    class Session:
        def __init__(self, master, place, named=None):
            self.sparkContext = type("C", (), {"master": master})
            self.conf = type("F", (), {"get": staticmethod(lambda k, d=None: named if k == "spark.checkpoint.dir" else place)})

    assert storage.shared_dir(Session("spark://a", "/x", "hdfs:///s")) == "hdfs:///s"
    assert storage.shared_dir(Session("local[4]", "/x")) == "/x/docledger-stage"
    assert storage.shared_dir(Session("spark://a", "s3a://b/w")).startswith("s3a://b/w")
    for place in ("/x", "file:/x"):
        with pytest.raises(ValueError):
            storage.shared_dir(Session("spark://a", place))


def test_links_and_strikeout_in_exchange_formats():
    from docledger.sinks import interchange
    from docledger.sources import authoring

    assert interchange.typst_inlines([{"kind": "link", "href": 'a"b\\c', "children": ["x*"]}]) == '#link("a\\"b\\\\c")[x\\*]'
    got = authoring.parse_pandoc('{"pandoc-api-version":[1,23],"meta":{},"blocks":[{"t":"Para","c":[{"t":"Strikeout","c":[{"t":"Str","c":"gone"}]},{"t":"Strikeout","c":[]}]}]}')
    assert got == [{"kind": "p", "inlines": ["gone"]}]
