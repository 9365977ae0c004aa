import hashlib
import random

import pyarrow as pa
import pytest

from docledger.llm import phrases


def plain(rows, width=20):
    """The definition: doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        cut = set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                cut.update(range(i, i + width))
            seen.add(w)
        kept = [x for i, x in enumerate(words) if i not in cut]
        out[doc] = (len(words), len(cut), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r[0]: tuple(r[1:]) for r in phrases.digest(df, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_the_definition(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c"] if seed == 1 else [f"w{i}" for i in range(40)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))]
        sep = rnd.choice([" ", "\n", " \t "])
        rows.append((i * 3, sep.join(words)))
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (2, None), (4, ""), (5, "x " * 50)]
    assert run(spark, rows, shard_words=300) == plain(rows)


def test_small_windows_and_tiny_bitmaps_change_nothing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(30))) for i in range(25)]
    want = plain(rows, 6)
    assert run(spark, rows, width=6, gram=3) == want
    assert run(spark, rows, width=6, gram=3, max_log2=16, shard_words=50) == want


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_GROUPS", 0)
    rows = [(i, " ".join(str(k % 50) for k in range(i % 3, 60))) for i in range(9)]
    assert run(spark, rows) == plain(rows)


def test_defined_cases(spark, docs, none, odd):
    got = {r[0]: r for r in phrases.deduplicated(docs).collect() if r[0] is not None}
    assert got[46].n_words == 0 and got[46].kept_text == ""
    assert got[40].n_removed == got[40].n_words > 0  # an exact copy
    assert got[0].n_removed == 0
    assert phrases.deduplicated(none).count() == 0
    assert phrases.digest(odd).count() == 6
    rows = [(None, "k " * 30), (3, "k " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r[0]: r.n_removed for r in phrases.digest(df).collect()}
    assert out == {3: 29, None: 30}  # a null id comes last


def shared_seed(n, rnd):
    """Texts of one phrase in many recurring contexts: their windows share few seeds."""
    phrase = [f"p{k}" for k in range(12)]
    before, after = [[f"b{rnd.randrange(40)}" for _ in range(9)] for _ in range(12)], [[f"a{rnd.randrange(40)}" for _ in range(9)] for _ in range(12)]
    return [(i, " ".join([*rnd.choice(before), *phrase, *rnd.choice(after), f"own{i}"])) for i in range(n)]


@pytest.mark.parametrize(("shard_words", "symbols"), [(10, phrases.SYMBOLS), (phrases.SHARD_WORDS, 7), (15, 5)])
def test_crowded_seeds_are_split_and_words_may_outnumber_symbols(spark, shard_words, symbols):
    rows = shared_seed(150, random.Random(8)) + [(200 + i, " ".join(f"z{k}" for k in range(i % 3, 40))) for i in range(9)]
    kept = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id as doc", "cast(text as binary) as text")
    assert phrases.removed_ranges(kept, shard_words=shard_words).count() > 0
    assert run(spark, rows, shard_words=shard_words, symbols=symbols) == plain(rows)
    assert run(spark, rows, width=6, gram=3, shard_words=shard_words, symbols=symbols, max_log2=16) == plain(rows, 6)


def test_symbols_of_several_characters_stay_apart():
    s = phrases.Symbols(100, 5)
    assert s.parts == 3 and len({s[f"w{i}".encode()] for i in range(100)}) == 100
    assert all(len(x) == 3 for x in s.values())
    one = phrases.Symbols(phrases.SYMBOLS - 1)
    assert one.parts == 1 and phrases.Symbols(phrases.SYMBOLS).parts == 2


def test_a_shard_of_more_words_than_characters():
    """1.2 million distinct words in one shard, two equal windows far apart."""
    words = [b"w%d" % i for i in range(1_200_000)]
    tail = words[600_000:600_030]
    table = pa.table({"seg": [1, 2], "seg2": [1, 2], "doc": [1, 2], "start": [0, 0], "text": [b" ".join(words), b"x " + b" ".join(tail)]})
    out = phrases.confirm_shard(20)(None, table).to_pylist()
    assert [r["cuts"] for r in out] == [[], [{"a": 1, "z": 31}]]


def test_whole_table_against_the_definition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in phrases.digest(df).collect()}
    assert got == plain([(r.doc_id, r.text) for r in df.collect()])
