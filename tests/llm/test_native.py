import bisect
import collections
import hashlib
import math
import re

import duckdb
import pytest

from docledger.llm import mixing, quality, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def base(text):
    words, text = WORD.findall(text or ""), text or ""
    n = len(words)
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {k for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_against_the_definition(spark, docs, corpus):
    more = [(900, "a b c d e f g h " * 3 + "z", "en", "s", 1), (901, "x|y #$%\n\nline one\nline one\r\nline one", "en", "s", 1), (902, "über 漢字 " * 30, "en", "s", 1)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    good = spark.createDataFrame([(i,) for i in range(40)], "doc_id bigint")
    out = quality.verdicts(df, good)
    assert no_python(out)
    got = sorted(str(tuple(r[:7])) for r in out.collect())
    assert got == sorted(str((r[0], *base(r[1]))) for r in [*corpus, *more])


def test_quality_ratio_against_a_plain_version(spark):
    rows = [(i, " ".join(f"good{(i + k) % 9}" for k in range(30))) for i in range(8)] + [(8 + i, " ".join(f"bad{(i * k) % 7}" for k in range(30))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in quality.verdicts(df, df.where("doc_id < 8"), buckets=97).collect()}
    h = {r[0]: (r[1], r[2]) for r in quality.with_hashes(quality.with_words(df, "doc_id", "text")).select("doc_id", "h", "h2").collect()}
    raw, good = collections.Counter(), collections.Counter()
    for d, (a, b) in h.items():
        own = [x % 97 for x in a + b]
        raw.update(own)
        if d < 8:
            good.update(own)
    for d, (a, b) in h.items():
        left = int(d < 8)  # an occurrence does not count for itself
        want = sum(math.log((good[x % 97] - left + 1) / (sum(good.values()) + 97)) - math.log((raw[x % 97]) / (sum(raw.values()) + 97)) for x in a + b) / len(a + b)
        assert out[d].llr == pytest.approx(want)
        assert out[d].kept == (not out[d].base_failed and out[d].llr >= quality.THRESHOLD)
    assert min(out[i].llr for i in range(8)) > max(out[i].llr for i in range(8, 12))


def test_quality_defined_cases(none, odd, docs):
    assert quality.verdicts(none, none).count() == 0
    assert quality.verdicts(odd, odd).count() == 6
    assert {r.llr for r in quality.verdicts(docs.where("doc_id < 5"), none).collect()} == {0.0}


def test_mixing_counts_follow_the_inverted_distribution(spark):
    rows = [(i, "x" * 10, "en", "a" if i % 3 else "b", 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = mixing.mixed(df, spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double"), total=60000.0)
    assert no_python(out)
    got = out.select("doc_id", "source", "copy", "mix_key").collect()
    count = collections.Counter(r.doc_id for r in got)
    rate = {r.source: r.rate for r in mixing.rates(df, spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double"), total=60000.0).collect()}
    assert rate == pytest.approx({"a": 0.75, "b": 4.5})
    for s, lam in rate.items():
        own = [count[r[0]] for r in rows if r[3] == s]
        assert abs(sum(own) / len(own) - lam) < 5 * math.sqrt(lam / len(own))
        for k in range(3):
            p = math.exp(-lam) * lam**k / math.factorial(k)
            assert abs(own.count(k) / len(own) - p) < 5 * math.sqrt(p / len(own))
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert sorted(r.copy for r in got if r.doc_id == got[0].doc_id) == list(range(count[got[0].doc_id]))


def test_mixing_large_rates_and_defined_cases(spark, docs, none, odd):
    one = spark.createDataFrame([(1, "ab", "en", "s", 2)], docs.schema)
    n = mixing.mixed(one, total=2.0 * 5000).count()
    assert 4700 < n < 5300
    assert mixing.mixed(none).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == [*odd.columns, "copy_", "mix_key_"]  # the input has copy and mix_key
    held = {tuple(r) for r in odd.collect()}
    assert {tuple(r)[:-2] for r in out.collect()} <= held
    assert mixing.mixed(docs).columns == [*docs.columns, "copy", "mix_key"]
    twice = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert twice[5] % 2 == 0


def test_mixing_draws_large_rates_from_the_whole_distribution(spark, tmp_path, docs):
    lam, n = 1000.0, 300
    df = spark.createDataFrame([(i, "ab", "en", "s", 2) for i in range(n)], docs.schema)
    got = {r[0]: r[1] for r in mixing.mixed(df, total=2.0 * n * lam).groupBy("doc_id").count().collect()}
    cdf, c = [], 0.0
    for k in range(1500):
        c += math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1))
        cdf.append(c)
    for i in range(n):
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert got[i] == bisect.bisect_right(cdf, u)
    assert 0.7 < sum((x - lam) ** 2 for x in got.values()) / n / lam < 1.4
    rows = [(0, "a", "en", "tiny", 1), (1, "b" * 90000, "en", "large", 90000), (2, "c" * 400000, "en", "large", 400000)]
    spark.createDataFrame(rows, docs.schema).write.parquet(path := str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT doc_id, copy FROM ({mixing.ORACLE}) ORDER BY 1, 2").fetchall()
    assert [tuple(r) for r in mixing.mixed(spark.read.parquet(path)).select("doc_id", "copy").orderBy("doc_id", "copy").collect()] == want and len(want) > 600


def test_sharding_table_and_placement(spark, docs, odd, none):
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 101)
    load = collections.Counter(table)
    assert max(load.values()) - min(load.values()) <= 1
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 40
    out = sharding.sharded(odd)
    assert no_python(out)
    assert out.columns == [*odd.columns, "slot_", "shard_"]  # the input has Slot and shard
    assert {tuple(r)[:-2] for r in out.collect()} == {tuple(r) for r in odd.collect()}
    got = sharding.sharded(docs)
    assert got.count() == docs.count()
    assert got.where("doc_id = 5").select("shard").distinct().count() == 1
    assert sharding.sharded(none).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


@pytest.mark.parametrize("name", ["mixing", "sharding"])
def test_sql_agrees(spark, tmp_path, docs, name):
    path = str(tmp_path / "documents.parquet")
    df = docs.where("doc_id is not null")
    df.write.parquet(path)
    module = {"mixing": mixing, "sharding": sharding}[name]
    got = (mixing.mixed if name == "mixing" else sharding.sharded)(spark.read.parquet(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(module.ORACLE)
    names = [x[0] for x in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want


def test_one_very_long_text(spark, docs):
    text = " ".join(f"w{i % 9973}" for i in range(400_000)) + "\nline\nline"
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short text", "en", "t", 10)], docs.schema)
    r = {x.doc_id: x for x in quality.verdicts(df, df.where("false")).collect()}[1]
    assert tuple(r)[1:7] == base(text)
    assert {x.n for x in mixing.mixed(df, total=5.0 * len(text)).selectExpr("length(text) as n").collect()} <= {len(text), 10}
    assert sharding.sharded(df).where("doc_id = 1").selectExpr("length(text) as n").first()[0] == len(text)


def test_mix_is_in_order_over_all_partitions(spark, docs):
    out = mixing.mixed(docs, total=200_000.0, part_chars=5_000)
    parts = out.selectExpr("spark_partition_id() as p", "mix_key as k").collect()
    assert len({r.p for r in parts}) > 20
    assert [r.k for r in parts] == sorted(r.k for r in parts)


def test_quality_judges_labelled_and_unlabelled_alike(spark):
    """On the tables: nearly all good documents stay, most bad ones go, and a label does not help its own document."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0").select("doc_id")
    half, other = good.where("doc_id % 2 = 0"), good.where("doc_id % 2 = 1").select("doc_id")
    kept = {r.doc_id: r.kept for r in quality.verdicts(docs, half).collect() if not r.base_failed}

    def share(of):
        got = [kept[r.doc_id] for r in of.collect() if r.doc_id in kept]
        return sum(got) / len(got)

    told, untold = share(half), share(other)
    assert told > 0.97 and untold > 0.97 and abs(told - untold) < 0.02
    assert share(bad) < 0.4


def test_quality_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    good = spark.createDataFrame([(i,) for i in range(20)], "doc_id bigint")
    want = sorted(map(str, quality.verdicts(docs, good).collect()))
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert sorted(map(str, quality.verdicts(docs, good).collect())) == want
