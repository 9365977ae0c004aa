"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; the model of each category sees the words of
the text and the probabilities of the earlier categories. For training, those earlier
probabilities are out-of-fold: they come from models that have not seen the document,
so later models learn to trust them as far as they deserve.

A text's features are its distinct words and their prefixes (a word adds one to each of
its features); words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.
Models are fitted on at most ``sample`` labelled documents, those with the smallest hash
of doc_id; every document is then scored over its whole text.

Features are counted by fold and class where the documents are, and each model's features are
chosen from those counts; only the chosen columns of the sample reach the driver, which bounds them by
``sample`` times the number of chosen features, however long the texts are.

Defined cases: a null or empty text has no features and gets the intercepts' probabilities; bytes
that are not UTF-8 count as replacement characters;
documents without labels are scored but not fitted; a null label counts as no label;
repeated labels of a document count once each; without labelled documents, or with one class
only, the probability is the smoothed base rate. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm._columns import map_rows
from docledger.llm._text import ALNUM_LOWER, small
from docledger.plans.storage import discard, materialize

#: Labelled documents used for fitting, at most.
SAMPLE = 6_000
PREFIXES = (4, 5, 6)
FOLDS, FEATURES, STEPS, RIDGE = 4, 512, 250, 1e-5
THRESHOLD = 0.5
#: A feature of fewer sampled documents is not used.
LEAST = 4
#: Words a worker remembers.
CACHE = 100_000


def features_of(word: bytes) -> list[int]:
    """Hashes of a word and its prefixes."""
    import xxhash

    text = word.decode(errors="replace")
    names = [text, *(text[:k] + "*" for k in PREFIXES if len(text) > k)]
    return [xxhash.xxh64_intdigest(x.encode()) >> 1 for x in names]


def distinct_words(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(ALNUM_LOWER).split())


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, fold, y array<int>, f array<bigint>, n array<int>)`` of the sampled labelled documents."""
    y = labels.select(F.col("doc_id").cast("bigint").alias("lab_id"), F.array(*[F.col(c).cast("int") for c in categories]).alias("y"))
    y = y.where("lab_id is not null and not exists(y, x -> x is null)").orderBy(F.xxhash64("lab_id"), "lab_id", "y").limit(sample)
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = text.join(F.broadcast(y), F.col("doc_id") == F.col("lab_id")).select("doc_id", "y", "text")

    def run(batches):
        for b in small(batches):
            fs, ns = [], []
            for t in b.column(2).to_pylist():
                f = [x for w in distinct_words(t) for x in features_of(w)]
                u, n = np.unique(np.array(f, dtype=np.int64), return_counts=True)
                fs.append(u)
                ns.append(n.astype(np.int32))
            fold = (b.column(0).to_numpy() * 2654435761 >> 8) % FOLDS
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fold), b.column(1), pa.array(fs, pa.list_(pa.int64())), pa.array(ns, pa.list_(pa.int32()))], names=["doc_id", "fold", "y", "f", "n"])

    return rows.mapInArrow(run, "doc_id bigint, fold bigint, y array<int>, f array<bigint>, n array<int>")


def chosen_features(rows: DataFrame, categories: int) -> np.ndarray:
    """The sorted union of the features that any model of the chain will use, by the rule in ``fit``.

    A model of one category is fitted without one fold, or on all; counts by fold and class give its gains.
    """
    hit = lambda k, c: F.sum(F.when(F.col("fold") == k, F.col("y")[c]).otherwise(0))
    sums = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(FOLDS)]
    for c in range(categories):
        sums += [hit(k, c).alias(f"h{k}_{c}") for k in range(FOLDS)]
    size = rows.agg(*sums).first()
    counts = rows.select("fold", "y", F.explode("f").alias("f")).groupBy("f").agg(*sums)
    counts = materialize(counts.where(sum(F.col(f"n{k}") for k in range(FOLDS)) >= LEAST), "toxicity-counts")
    found: set[int] = set()
    for out in [None, *range(FOLDS)]:
        folds = [k for k in range(FOLDS) if k != out]
        have, n = sum(F.col(f"n{k}") for k in folds), sum(size[f"n{k}"] or 0 for k in folds)
        for c in range(categories):
            base = (sum(size[f"h{k}_{c}"] or 0 for k in folds) + 0.5) / (n + 1)
            gain = F.abs(sum(F.col(f"h{k}_{c}") for k in folds) - have * base) / F.sqrt(have * base * (1 - base) + 1e-9)
            best = counts.where(have >= LEAST).select("f", gain.alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "f").limit(FEATURES)
            found.update(r.f for r in best.collect())
    discard(counts)
    return np.array(sorted(found), dtype=np.int64)


def columns_of(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``rows`` with only the features in ``chosen``."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for b in small(batches):
            fs, ns = [], []
            for f, n in zip(b.column(3), b.column(4), strict=True):
                f, n = f.values.to_numpy(), n.values.to_numpy()
                m = np.isin(f, shared.value, assume_unique=True)
                fs.append(f[m])
                ns.append(n[m])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fs, pa.list_(pa.int64())), pa.array(ns, pa.list_(pa.int32()))], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


class Data:
    """A sparse matrix: row i has the features f[offsets[i]:offsets[i + 1]]; rare ones are left out."""

    def __init__(self, offsets: np.ndarray, f: np.ndarray, n: np.ndarray, least: int = LEAST):
        self.n = len(offsets) - 1
        names, have = np.unique(f, return_counts=True)
        self.names = names[have >= least]
        del names, have
        cols = np.searchsorted(self.names, f).astype(np.int32)
        keep = np.flatnonzero(self.names[np.minimum(cols, max(0, len(self.names) - 1))] == f) if len(self.names) else np.zeros(0, np.int64)
        self.cols, self.vals = cols[keep], n[keep].astype(np.float32)
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(offsets))[keep]


def fit(data: Data, extra: np.ndarray, y: np.ndarray, use: np.ndarray):
    """(names, weights, extra weights, intercept) of a logistic model on the rows of ``use``."""
    base = (y[use].sum() + 0.5) / (use.sum() + 1)
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(extra.shape[1]), float(np.log(base / (1 - base)))
    if not 0 < y[use].sum() < use.sum():
        return none
    m = use[data.rows]
    rows, cols, vals = data.rows[m], data.cols[m], data.vals[m]
    size = len(data.names)
    have, hit = np.bincount(cols, minlength=size), np.bincount(cols, weights=y[rows], minlength=size)
    spread = np.sqrt(have * base * (1 - base) + 1e-9)
    gain = np.where(have >= LEAST, np.abs(hit - have * base) / spread, 0.0)
    best = np.sort(np.lexsort((data.names, -gain))[: min(FEATURES, int((gain > 0).sum()))])
    to = np.full(size, -1)
    to[best] = np.arange(len(best))
    m = to[cols] >= 0
    rows, cols, vals = rows[m], to[cols[m]], vals[m]
    scale = np.log1p(vals)
    w = np.zeros(len(best) + extra.shape[1] + 1)
    w[-1] = none[3]
    mean, var = np.zeros_like(w), np.zeros_like(w)
    # the rarer class counts more, by the root of the ratio of the classes
    share = np.where(use, np.where(y > 0.5, np.sqrt((1 - base) / base), 1.0), 0.0)
    share /= share.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, weights=scale * w[cols], minlength=data.n) + extra @ w[len(best) : -1] + w[-1]
        err = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.concatenate((np.bincount(cols, weights=scale * err[rows], minlength=len(best)), extra.T @ err, [err.sum()]))
        g[:-1] += RIDGE * w[:-1]
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return data.names[best], w[: len(best)], w[len(best) : -1], float(w[-1])


def predict(model, data: Data, extra: np.ndarray) -> np.ndarray:
    names, w, we, b = model
    if not len(names):
        return 1 / (1 + np.exp(-(extra @ we + b)))
    at = np.minimum(np.searchsorted(names, data.names), len(names) - 1)
    full = np.where(names[at] == data.names, w[at], 0.0)
    z = np.bincount(data.rows, weights=np.log1p(data.vals) * full[data.cols], minlength=data.n)
    return 1 / (1 + np.exp(-np.clip(z + extra @ we + b, -40, 40)))


def fit_chain(data: Data, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS):
    """One model for each column of y; earlier columns enter later models out of fold."""
    models, extra = [], np.zeros((data.n, 0))
    for k in range(y.shape[1]):
        held = np.zeros(data.n)
        for f in range(folds):
            part = fold == f
            held[part] = predict(fit(data, extra, y[:, k], ~part), data, extra)[part]
        models.append(fit(data, extra, y[:, k], np.ones(data.n, dtype=bool)))
        extra = np.column_stack((extra, held))
    return models


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """The chain's models, fitted on the driver over the chosen features of the bounded sample."""
    rows = materialize(training_rows(docs, labels, categories, sample, id_col, text_col), "toxicity-sample")
    got = columns_of(rows, chosen_features(rows, len(categories))).toArrow().combine_chunks()
    discard(rows)
    # by doc_id, repeated rows by their features: the order of partitions must not matter
    size = pa.compute.list_value_length(got["f"])
    got = got.append_column("size", size).sort_by([("doc_id", "ascending"), ("size", "ascending")]).combine_chunks()
    fold, y = got["fold"].to_numpy(), np.array(got["y"].to_pylist(), dtype=np.float64).reshape(-1, len(categories))
    offsets = np.concatenate(([0], np.cumsum(got["size"].to_numpy(), dtype=np.int64)))
    f, n = (np.concatenate([c.flatten().to_numpy() for c in got[x].chunks] or [np.zeros(0, np.int64)]) for x in ("f", "n"))
    del got
    return fit_chain(Data(offsets, f, n), y, fold)


class Scorer:
    """Probabilities of whole texts. Features enter as log1p of their count over distinct words."""

    def __init__(self, models):
        self.models, self.slot = models, {}
        for k, (names, w, _, _) in enumerate(models):
            for n, x in zip(names.tolist(), w.tolist(), strict=True):
                self.slot.setdefault(n, []).append((k, x))
        self.cache: dict[bytes, tuple] = {}

    def known(self, word: bytes) -> tuple:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[word] = tuple(f for f in features_of(word) if f in self.slot)
        return got

    def score(self, text: bytes | None) -> list[float]:
        count: dict[int, int] = {}
        cache = self.cache
        for w in distinct_words(text):
            got = cache.get(w)
            for f in self.known(w) if got is None else got:
                count[f] = count.get(f, 0) + 1
        z = [0.0] * len(self.models)
        for f, n in sorted(count.items()):
            x = np.log1p(n)
            for k, w in self.slot[f]:
                z[k] += w * x
        out: list[float] = []
        for k, (_, _, we, b) in enumerate(self.models):
            out.append(float(1 / (1 + np.exp(-np.clip(z[k] + sum(p * e for p, e in zip(out, we, strict=True)) + b, -40, 40)))))
        return out


def scores(docs: DataFrame, models, categories: list[str], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, p_<category>..., <last category> boolean)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in small(batches):
            p = np.array([scorer.score(t) for t in b.column(1).to_pylist()]).reshape(-1, len(categories))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(len(categories))), pa.array(p[:, -1] >= threshold)], names=names)

    names = ["doc_id", *(f"p_{c}" for c in categories), categories[-1]]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"`p_{c}` double" for c in categories) + f", `{categories[-1]}` boolean")


def accepted(docs: DataFrame, models, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose last category stays below the threshold, all columns kept, no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in small(batches):
            yield b.filter(pa.array([scorer.score(t)[-1] < threshold for t in b.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return map_rows(docs, run)
