import random

import numpy as np

from docledger.llm import toxicity as tx

from llm_data import prose

CATS = ["low_quality", "toxic"]


def labelled(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, low = rnd.random() < 0.2, rnd.random() < 0.2
        words = prose(rnd, rnd.randint(30, 80)).split()
        for _ in range(rnd.randint(1, 3) * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vilehead", "vilefoot", "grubby"]))
        if low:
            words += ["zzjunk" + rnd.choice("abc")] * 2
        rows.append((i, " ".join(words)))
        labels.append((i, int(low), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    return d, spark.createDataFrame(labels, "doc_id bigint, low_quality int, toxic int"), labels


def test_held_out_accuracy(spark):
    d, labels, _ = labelled(spark)
    test, _, truth = labelled(spark, 200, 2)
    models = tx.train(d, labels, CATS)
    got = {r.doc_id: r for r in tx.scores(test, models, CATS).collect()}
    wrong = sum(got[i].toxic != bool(t) for i, _, t in truth)
    assert wrong <= 4
    assert sum((got[i].p_low_quality >= 0.5) != bool(q) for i, q, _ in truth) <= 4
    kept = {r.doc_id for r in tx.accepted(test, models).collect()}
    assert kept == {i for i, r in got.items() if not r.toxic}


def test_training_and_scoring_agree(spark):
    d, labels, _ = labelled(spark, 60, 3)
    models = tx.train(d, labels, CATS)
    again = tx.train(d.repartition(7), labels.repartition(3), CATS)
    for a, b in zip(models, again, strict=True):
        assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))
    texts = [r.text.encode() for r in d.collect()]
    scorer = tx.Scorer(models)
    f = [tx.np.unique(np.array([x for w in tx.distinct_words(t) for x in tx.features_of(w)], dtype=np.int64), return_counts=True) for t in texts]
    data = tx.Data(np.concatenate(([0], np.cumsum([len(u) for u, _ in f]))), np.concatenate([u for u, _ in f]), np.concatenate([n for _, n in f]), least=1)
    extra = np.zeros((len(texts), 0))
    for k, m in enumerate(models):
        p = tx.predict(m, data, extra)
        assert np.allclose(p, [scorer.score(t)[k] for t in texts], atol=1e-5)
        extra = np.column_stack((extra, p))


def test_later_models_use_earlier_probabilities():
    rnd = np.random.default_rng(0)
    n = 400
    first = (rnd.random(n) < 0.5).astype(float)
    f = np.array([10 + int(x) for x in first], dtype=np.int64)
    data = tx.Data(np.arange(n + 1), f, np.ones(n, dtype=np.int64))
    models = tx.fit_chain(data, np.column_stack((first, first)), np.arange(n) % 4)
    assert models[1][2].shape == (1,) and models[1][2][0] > 0


def test_defined_cases(spark, docs, none, odd):
    labels = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (1, 1, 0), (2, None, 1), (None, 0, 0), (999, 1, 1)], "doc_id bigint, low_quality int, toxic int")
    models = tx.train(docs, labels, CATS)
    assert tx.scores(docs, models, CATS).count() == docs.count()
    empty = tx.train(none, labels, CATS)
    got = tx.scores(docs, empty, CATS).collect()
    assert {round(r.p_toxic, 6) for r in got} == {0.5}
    assert tx.scores(none, models, CATS).count() == 0
    assert tx.accepted(odd, models).columns == odd.columns
    long = spark.createDataFrame([(1, "word " * 200_000), (2, None), (3, "")], "doc_id bigint, text string")
    p = {r.doc_id: r.p_toxic for r in tx.scores(long, models, CATS).collect()}
    assert p[2] == p[3]


def test_features_chosen_by_counts_are_those_that_fit_chooses(spark):
    d, labels, truth = labelled(spark, 300, 5)
    rows = tx.training_rows(d, labels, CATS, 1000, "doc_id", "text").orderBy("doc_id").collect()
    offsets = np.concatenate(([0], np.cumsum([len(r.f) for r in rows])))
    data = tx.Data(offsets, np.array([x for r in rows for x in r.f], dtype=np.int64), np.array([x for r in rows for x in r.n], dtype=np.int64))
    y, fold = np.array([r.y for r in rows], dtype=float), np.array([r.fold for r in rows])
    plain = tx.fit_chain(data, y, fold)
    for a, b in zip(tx.train(d, labels, CATS), plain, strict=True):
        assert all(np.allclose(x, z) for x, z in zip(a, b, strict=True))


def test_held_out_accuracy_on_the_table(spark):
    """Half of the labelled documents of sf0.1 fit the chain, the other half judge it."""
    path = "/root/testdata/sf0.1"
    docs, raw = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    labels = raw.selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    models = tx.train(docs, labels.where("doc_id % 2 = 0"), CATS)
    seen = tx.scores(docs, models, CATS).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    yes, no = [r for r in seen if r.toxic], [r for r in seen if not r.toxic]
    assert len(yes) > 20 and len(no) > 500
    assert sum(r.said for r in yes) >= 0.9 * len(yes)
    assert sum(r.said for r in no) <= 0.02 * len(no)


def test_bytes_that_are_not_utf8(spark):
    d, labels, _ = labelled(spark, 60, 3)
    bad = spark.createDataFrame([(0, b"\xff vilehead \xc3"), (1000, b"\xc3\x28")], "doc_id bigint, b binary").selectExpr("doc_id", "cast(b as string) as text")
    assert tx.scores(bad, tx.train(d.unionByName(bad), labels, CATS), CATS).count() == 2
