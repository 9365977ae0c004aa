import pathlib
import random

import duckdb
import pytest

import corpus_pipeline
from docledger.llm import mixing, sharding, toxicity
from docledger.llm.registry import CATEGORIES, category_labels

from llm_data import DOCS, prose
from test_decontaminate import plain
from test_simhash import similar_pairs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(21)
    root = tmp_path_factory.mktemp("sf")
    items = [(i, prose(rnd, 30) + ". " + prose(rnd, 6) + ".") for i in range(8)]
    texts = [prose(rnd, rnd.randint(60, 200)) for _ in range(240)]
    toxic = set(range(0, 240, 6))
    for i in toxic:
        texts[i] += " vilehead grubby vilefoot"
    leaked = {1, 31, 61}
    for k, i in enumerate(sorted(leaked)):
        texts[i] += "\n" + items[k][1]
    near = {}
    for i in (2, 3, 4):
        words = texts[i].split()
        words[10] = "changed"
        near[len(texts)] = i
        texts += [" ".join(words)]
        near[len(texts)] = i
        texts += [texts[i]]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None)]
    labels = [(i, 1, int(i in toxic)) for i in range(240)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), toxic, leaked, near, rows


def test_stages_one_by_one(spark, tables):
    path, toxic, leaked, near, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, path)
    assert kept.columns == columns
    got = {r.doc_id for r in kept.collect()}
    assert got == ids - toxic
    kept = stages["simhash_near_dedup"](spark, docs, path)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == ids - set(near)
    kept = stages["decontamination"](spark, docs, path)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == ids - leaked
    assert stages["mixing"](spark, docs, path).columns == columns
    assert stages["sharding"](spark, docs, path).columns == [*columns, "slot", "shard"]


def test_run_applies_all_stages(spark, tables):
    path, toxic, leaked, near, rows = tables
    out = corpus_pipeline.run(spark, path).collect()
    left = {r[0] for r in rows} - toxic - leaked - {k for k, v in near.items() if v not in toxic}
    assert {r.doc_id for r in out} <= left
    assert len({r.doc_id for r in out}) > len(left) / 3
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    assert all(table[r.slot] == r.shard for r in out)
    assert toxicity.THRESHOLD == 0.5


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for f in (root / "docledger").rglob("*.py"):
        if "llm" not in f.parts:
            assert "docledger.llm" not in f.read_text() and "import llm" not in f.read_text()


def test_run_against_a_plain_version(spark, tables, tmp_path):
    """All stages by other means: scores row by row, all pairs of texts, every item, and SQL for mix and shards."""
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    models = toxicity.train(docs, category_labels(spark.read.parquet(f"{path}/labels.parquet")), CATEGORIES)
    scorer = toxicity.Scorer(models)
    rows = [tuple(r) for r in docs.collect() if scorer.score((r.text or "").encode())[-1] < toxicity.THRESHOLD]
    named = [r for r in rows if r[0] is not None]
    texts = [r[1] or "" for r in named]
    root = list(range(len(named)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    pairs = similar_pairs(texts) + [(i, first[t]) for i, t in enumerate(texts) if first.setdefault(t, i) != i]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)), key=lambda x: named[x][0])
        root[b] = a
    rows = [r for i, r in enumerate(named) if find(i) == i] + [r for r in rows if r[0] is None]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    leaked = {d for d, _ in plain([(r[0], r[1]) for r in rows], items)}
    rows = [r for r in rows if r[0] not in leaked]
    con = duckdb.connect()
    kept = str(tmp_path / "kept.parquet")
    spark.createDataFrame(rows, docs.schema).coalesce(1).write.parquet(kept)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{kept}/*.parquet'")
    con.execute(f"CREATE TABLE mix AS SELECT doc_id, text, lang, source, n_chars FROM ({mixing.ORACLE})")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM mix")
    want = sorted(map(str, con.execute(sharding.ORACLE).fetchall()))
    assert want == sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, path).collect())
