import pytest
from pyspark.sql import functions as F

from docledger.functions import wire
from docledger.functions.codecs import CodecError, encode
from docledger.operators import layout
from docledger.sinks import container
from docledger.sources import authoring, html


def test_documents_round_trip():
    blocks = html.parse("<h1>A</h1><p>b <a href='/x'>c</a> <em>d</em></p><ul><li>e</li></ul><table><tr><td>1</td></tr></table><blockquote><p>q</p></blockquote><pre>z</pre><figure><img src=a alt=b></figure>")
    raw = wire.encode_document(blocks, "en", "rtl")
    lang, direction, back = wire.decode_document(raw)
    assert (lang, direction) == ("en", "rtl") and wire.encode_document(back, lang, direction) == raw
    _, built = authoring.Compose().code("x", "py").page_break().finish()
    assert wire.decode_document(wire.encode_document(built, "en"))[2] == built


@pytest.mark.parametrize("v", [{"t": "p"}, {"t": "p", "inlines": [], "x": 1}, {"t": "nope"}, {"t": "h", "level": 7, "inlines": []}, {"t": "p", "inlines": [{"t": "span"}]}, []])
def test_strictness(v):
    with pytest.raises(CodecError):
        wire.decode_document(encode({"t": "doc", "lang": "en", "dir": "ltr", "children": [v]}))


@pytest.mark.parametrize("objects", [[b"text " * 50], [b"x"], []])
def test_every_changed_bit_of_a_container_is_noticed(objects):
    data = container.write(encode({"version": [1, 0]}), {container.digest(x): x for x in objects})
    assert not isinstance(container.read_many([data])[0], container.BadContainer)
    changed = [data[:i] + bytes([data[i] ^ x]) + data[i + 1 :] for i in range(len(data)) for x in (1, 2, 4, 8, 16, 32, 64, 128, 255)]
    assert [k for k, got in enumerate(container.read_many(changed)) if not isinstance(got, container.BadContainer)] == []


def test_layers_signatures_bundles():
    assert wire.decode_layer(wire.encode_layer({"a": 4, "b": "x", "c": True, "d": None})) == {"a": 4.0, "b": "x", "c": True}
    with pytest.raises(CodecError):
        wire.decode_layer(encode({"a": 4}))
    sig = {"scope": "document", "alg": "ed25519", "target": b"t", "key": b"k", "sig": b"s"}
    assert wire.decode_signature(wire.encode_signature(sig)) == sig
    with pytest.raises(CodecError):
        wire.encode_signature(sig | {"scope": "all"})
    bundle = {"doc": b"d", "i": 0, "content": b"c", "leaves": [b"l"], "salt": b"s" * 16}
    assert wire.decode_bundle(wire.encode_bundle(bundle)) == bundle


def test_layout_columns(spark):
    df = spark.createDataFrame([("a\tb\r\n\tx\n1234\ty", "漢字、仮名（か）", "<math><mi>x</mi><mtable/></math>")], "code string, cjk string, m string")
    r = df.select(
        layout.code_lines(F.col("code")).alias("code"), layout.cjk_breaks(F.col("cjk")).alias("cjk"), layout.unsupported_math(F.col("m")).alias("m"),
        layout.flow_columns(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.lit(60).cast("bigint").alias("h"), F.lit(5).cast("bigint").alias("gap"), F.lit(False).alias("force"))), 100, 2).alias("flow"),
        layout.break_lines(F.lit("aa bb cccccccc d"), 5).alias("lines"),
    ).first()
    assert r.code == ["a   b", "    x", "1234    y"]
    assert r.cjk == [1, 3, 4, 5]
    assert r.m == ["mtable"]
    assert [tuple(x) for x in r.flow] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert r.lines == ["aa bb", "cccccccc", "d"]


def test_ed25519_published_values():
    from docledger.functions import ed25519 as ed

    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert ed.public_key(seed).hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    sig = ed.sign(seed, b"\x72")
    assert sig.hex().startswith("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da")
    key = ed.public_key(seed)
    assert ed.verify(key, b"\x72", sig) and not ed.verify(key, b"\x73", sig)
    assert not ed.verify(key, b"\x72", sig[:63]) and not ed.verify(b"\xff" * 32, b"\x72", sig)
    assert ed.public_key(bytes([42]) * 32).hex() == "197f6b23e16c8532c6abc838facd5ea789be0c76b2920334039bfa8b3d368d61"


def test_justify(spark):
    r = spark.range(1).select(layout.justify(F.lit("a bb  c"), 10).alias("x"), layout.justify(F.lit("word"), 10).alias("y"), layout.justify(F.lit("too long line"), 5).alias("z")).first()
    assert tuple(r) == ("a   bb   c", "word", "too long line")


def test_records_of_many_documents_are_hashed_together(monkeypatch):
    from docledger import queryset3
    from docledger.functions import codecs

    calls, plain = [], codecs.blake3_many
    monkeypatch.setattr(codecs, "blake3_many", lambda x: calls.append(len(x)) or plain(x))
    texts = [f"{i % 6}text {i} ä" for i in range(50)] + ["0", "5" + "long " * 2000]
    got = queryset3.record_verdicts(texts)
    assert calls == [len(texts) + 1]
    assert got == [{"1": "unknown keys", "2": "lacks", "3": "bad", "4": "bytes"}.get(t[0], "same") for t in texts]
    assert queryset3.record_verdicts([]) == []


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    from docledger.functions import codecs

    b = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * 1000] * 100)], names=["k", "v"])
    parts = list(codecs.slices(b, 10_000))
    assert len(parts) > 9 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(100))
    assert [p.num_rows for p in codecs.slices(b, 1)] == [1] * 100 and list(codecs.slices(b.slice(0, 0))) == []
