"""Invented words and the documents schema for the tests of this folder."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in "ka lo mi ru te sa ne vo".split() for b in "ra lin dor mek tus pan gil".split()]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))
