from docledger.corpus import Corpus
from docledger.operators import merkle

PAGES = [(1, "<h1>A</h1><p>shared</p><img src='x'>"), (2, "<p>shared</p><p>own secret</p>"), (3, None)]


def test_a_corpus_end_to_end(spark):
    c = Corpus.ingest(spark.createDataFrame(PAGES, "page_id bigint, html string"), "html", "html", "page_id")
    texts = {r.doc_id: r.text for r in c.extract().collect()}
    assert texts == {1: "A\n\nshared\n\n[]\n", 2: "shared\n\nown secret\n"}
    report = c.dedup_report().first()
    assert (report.total_objects, report.unique_objects) == (5, 4)
    assert {(r.doc_id, r.code) for r in c.validate().collect()} == {(1, "E_ALT_TEXT")}
    assert {r.doc_id: r.valid for r in c.verdicts().collect()} == {1: False, 2: True, 3: True}
    assert {(r.doc_id, r.hits) for r in c.search("SECRET").collect()} == {(2, 1)}
    less = c.redact(spark.createDataFrame([(2, [1], "private")], "doc_id bigint, path array<int>, reason string"))
    assert less.nodes.where("text like '%secret%'").count() == 0
    d = c.diff(less).first()
    assert (d.shared, d.removed) == (3, 1)
    bundles = c.disclose(spark.createDataFrame([(1, 1)], "doc_id bigint, i int"))
    assert c.verify_disclosure(bundles).first().valid
    assert merkle.head(merkle.levels(c.log())).first().size == 2
    assert c.pack().count() == 2 and c.info().count() == 2
    assert c.failures().count() == 0


def test_lines_and_failures(spark):
    df = spark.createDataFrame([(1, "a\nb | c")], "doc_id bigint, text string")
    assert Corpus.ingest(df, "lines").extract().first().text == "a\n\nb\tc\n"
    bad = Corpus.ingest(df, "json")
    assert bad.failures().count() == 1 and not bad.verdicts().first().valid
