import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_data import DOCS, prose  # noqa: E402

@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages, junk, nulls and ties."""
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randint(25, 120)) for _ in range(40)]
    passage = prose(rnd, 45)
    for i in (3, 9, 14):
        texts[i] = f"{texts[i]}\n{passage} {texts[i][:20]}"
    texts += [texts[0]] * 3  # exact copies
    words = texts[1].split()
    words[len(words) // 2] = "changed"
    texts += [" ".join(words), texts[1] + " extra"]  # near copies
    texts += ["ka " * 60, "", None, "one", "  \n\t ", "lo mié über naïve " * 12]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id " * 10, None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Extra columns with names the operators use themselves."""
    rows = [(i, prose(random.Random(i), 30), "en", "s", 1, 1, 2, "x", 3.0, True, 4, 5, *"abcdefgh", "quoted") for i in range(6)]
    more = ", key string, mix_key string, Slot string, shard string, of string, gone string, __gone string, `row` string, `a``b.c` string"
    return spark.createDataFrame(rows, DOCS + ", fp bigint, component_id bigint, words string, u double, copy boolean, id bigint, k int" + more)
