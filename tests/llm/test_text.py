import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from docledger.llm import _text
from docledger.llm._bitmap import member

texts = st.text(alphabet=st.sampled_from(list("ab \t\né漢x")), max_size=200)


@given(texts)
def test_word_bounds_and_hashes_follow_words(t):
    raw = t.encode()
    buf = np.frombuffer(raw, dtype=np.uint8)
    for step in (1 << 20, 7):
        s, e, h = _text.word_hashes(buf, step)
        assert [raw[a:b] for a, b in zip(s, e, strict=True)] == raw.split()
        by = {}
        for w, x in zip(raw.split(), h.tolist(), strict=True):
            assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 21))
def test_gram_hashes_are_equal_for_equal_grams(xs, k):
    h = _text.mix(np.array(xs, dtype=np.uint64) + np.uint64(1))
    g = _text.gram_hashes(h, k)
    grams = [tuple(xs[i : i + k]) for i in range(max(0, len(xs) - k + 1))]
    assert len(g) == len(grams)
    assert len(set(g.tolist())) == len(set(grams))


def test_member_reads_high_bits():
    bits = np.zeros(1 << 13, dtype=np.uint8)
    h = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(50)], dtype=np.uint64)
    place = h >> np.uint64(48)
    np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(int), (1 << (place & np.uint64(7))).astype(np.uint8))
    assert member(bits, 16, h).all()
