"""Quality rules: text counts and a hashed n-gram log-likelihood ratio, with built-in functions only.

The ratio compares two multinomials over hashed word unigrams and bigrams: the trusted
target (documents labelled good) and the raw corpus, both counted over all documents. A
document's score is its mean log ratio per n-gram; the threshold decides, with no draw. Each
occurrence is left out of the counts it is judged by (of the raw ones, and of the target's where its document
is labelled), so no document, labelled or not, vouches for itself.

Counts are partial sums per bucket before the shuffle, so neither a hot source nor a frequent
n-gram gathers rows. The weights are one array of ``buckets`` numbers whatever the data.
Repeated windows are found inside each row by sorted 64-bit hashes of word windows.

Defined cases: a null or empty text has no words, score null, base_failed true; repeated rows are
scored alike (each counts in the corpus); a null doc_id is never labelled; without any labelled
document the score is 0 for all; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.plans.storage import materialize

BUCKETS = 1 << 14
#: Pseudo-count for each bucket.
SMOOTHING = 1.0
#: Mean log ratio per n-gram below which a document is not kept.
THRESHOLD = -0.1
#: Labelled ids up to this number may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SPACE = "\\x09-\\x0D\\x20"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once even where a lambda uses it often."""
    return F.transform(F.array(value), body)[0]


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    base = base.withColumn("norm", F.trim(F.regexp_replace("text", f"[{SPACE}]+", " ")))
    return base.withColumn("words", F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " ")))


def with_hashes(rows: DataFrame) -> DataFrame:
    """Adds ``h`` and ``h2``: hashes of words and of word pairs."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("h2", _pairs("h", 1))


def _pairs(name: str, shift: int) -> Column:
    a, m = F.col(name), F.size(name) - shift
    joined = F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(1 + shift), m), lambda x, y: F.xxhash64(x, y))
    return F.when(m > 0, joined).otherwise(F.array().cast("array<bigint>"))


def repeated_words(name: str, width: int) -> Column:
    """Words covered by windows whose hash (column ``name``, one per window) occurs twice or more."""

    def found(t):
        hits = F.filter(t, lambda x, k: ((k > 0) & (F.get(t, k - 1)["x"] == x["x"])) | (F.get(t, k + 1)["x"] == x["x"]))
        at = F.array_sort(F.transform(hits, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).cast("bigint").alias("last"))
        return F.aggregate(at, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(width).cast("bigint"), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    marked = F.array_sort(F.transform(F.col(name), lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i"))))
    return F.when(F.size(F.array_distinct(name)) == F.size(name), F.lit(0).cast("bigint")).otherwise(_let(marked, found))


def labelled_ids(good: DataFrame) -> DataFrame:
    """Stored ``good_id``: the distinct labelled ids."""
    return materialize(good.select(F.col("doc_id").cast("bigint").alias("good_id")).where("good_id is not null").distinct(), "quality-ids")


def weights(docs: DataFrame, ids: DataFrame, buckets: int, smoothing: float, id_col: str, text_col: str) -> DataFrame:
    """One row ``(as_raw array<double>, as_own array<double>)``: by bucket the log ratio target against raw, an occurrence of an unlabelled and of a labelled document left out."""
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("good_id"), "left")
    target = rows.select("text", F.col("good_id").isNotNull().alias("good"))
    hashed = with_hashes(with_words(target.withColumn("doc_id", F.when(F.col("good"), 1)), "doc_id", "text"))
    grams = hashed.select("doc_id", F.explode(F.concat("h", "h2")).alias("g"))
    counts = grams.groupBy(F.pmod("g", F.lit(buckets)).alias("b")).agg(F.count("*").alias("raw"), F.count("doc_id").alias("good"))
    full = grams.sparkSession.range(buckets).join(materialize(counts, "quality-counts"), F.col("id") == F.col("b"), "left").select("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    rows = F.array_sort(F.collect_list(F.struct("id", "raw", "good")))
    all_in = full.agg(rows.alias("t"), F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))
    share = lambda n, total: F.log((F.greatest(n, F.lit(0)) + smoothing) / (F.col(total) + smoothing * buckets))
    ratio = lambda left: F.when(F.col("all_good") == 0, F.transform("t", lambda x: F.lit(0.0))).otherwise(F.transform("t", lambda x: share(x["good"] - left, "all_good") - share(x["raw"] - 1, "all_raw")))
    return all_in.select(ratio(0).alias("as_raw"), ratio(1).alias("as_own"))


def verdicts(docs: DataFrame, good: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr)``."""
    ids = labelled_ids(good)
    # literals of seven places, folded once per plan: lambdas take no subquery, and their size is `buckets`
    w = weights(docs, ids, buckets, smoothing, id_col, text_col).select(*[F.array_join(F.transform(c, lambda x: F.format_string("%.7f", x)), ",") for c in ("as_raw", "as_own")]).first()
    raw, own = (F.split(F.lit(x), ",").cast("array<double>") for x in w)
    rows = with_hashes(with_words(docs, id_col, text_col))
    n = F.size("words").cast("bigint")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = rows.select(
        "doc_id",
        n.alias("n_words"),
        F.greatest(F.length("norm") - F.greatest(n - 1, F.lit(0)), F.lit(0)).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.concat("h", "h2").alias("grams"),
        _pairs("h2", 2).alias("h4"),
    )
    rows = rows.withColumn("h8", _pairs("h4", 4))

    def total(ws):
        return F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(ws, F.pmod(g, F.lit(buckets)).cast("int")))

    mean = lambda table: F.when(F.col("n_words") > 0, total(table) / F.size("grams"))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words("h8", 8).alias("n_repeat_words"), mean(raw).alias("as_raw"), mean(own).alias("as_own"))
    # joined by the numbers alone: no text is shuffled, however many labels there are
    rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("good_id"), "left")
    rows = rows.withColumn("llr", F.when(F.col("good_id").isNull(), F.col("as_raw")).otherwise(F.col("as_own")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")
