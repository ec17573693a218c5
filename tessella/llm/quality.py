"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted target and raw corpus.

Features of a text are its words and word pairs, hashed into BUCKETS. Two multinomials are counted over them: one over
all documents, one over half of the trusted ones (every label good and not toxic). A document's score is the mean over
its features of log(p_target / p_raw). The cut is a fixed quantile of the scores of the other half, which the target has
not seen, less a margin; so the same tables always give the same verdicts. Every trusted document takes part, in the half that
a hash of its doc_id gives it. Everything is a DataFrame expression.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import file_count, stored, table

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Values that an exact quantile gathers at most, and cells that it counts more of them in.
GATHERED, CELLS = 10_000, 1_000
#: The cut is this quantile of the held-out trusted scores, less MARGIN times its distance to their median.
QUANTILE, MARGIN = 0.005, 0.25
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_BLANK = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds __h, the hash of each word, and __p, the hash of each word pair."""
    bare = F.btrim(text_of(), F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK))
    hashed = docs.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("__h")
    return hashed.withColumn("__p", F.when(n > 1, F.zip_with(F.slice("__h", 1, n - 1), F.slice("__h", 2, n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))


def features() -> Column:
    return F.transform(F.concat("__h", "__p"), lambda h: h.bitwiseAND(BUCKETS - 1).cast("int"))


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. Needs with_words."""
    t = text_of()
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    n = F.size("__h")
    fours = F.zip_with(F.slice("__p", 1, n - 4), F.slice("__p", 3, n - 4), lambda a, b: F.xxhash64(a, b))
    windows = F.when(n > 4, F.zip_with(fours, F.slice("__h", 5, n - 4), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    out = docs.withColumn("__w", windows).withColumn("__lines", lines)
    placed = F.zip_with("__w", F.sequence(F.lit(1), F.size("__w")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    again = F.size(F.array_distinct("__w")) < F.size("__w")
    out = out.withColumn("__s", F.when(again, F.sort_array(placed)))
    m = F.size("__s")
    twins = F.zip_with(F.slice("__s", 1, m - 1), F.slice("__s", 2, m - 1), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("__at", F.when(F.col("__s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(twins)))))
    k = F.size("__at")
    steps = F.zip_with("__at", F.slice("__at", 2, F.greatest(k - 1, F.lit(0))), lambda x, y: F.least(F.lit(5), F.coalesce(y - x, F.lit(5))))
    return (
        out.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("__at").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, fits) of all documents whose labels all say good and none toxic; the target is fitted on those that fit."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("q = 1 and t = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fits"))


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, fits) of the trusted rows of docs, stored. Dealt by key: their number grows with docs."""
    own = docs.select("doc_id", "text").join(trusted_ids(labels).hint("merge"), "doc_id")
    return stored(own, "trusted", file_count(docs))


def log_ratios(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, ratio) for each bucket: log(p_target / p_raw), smoothed. Counts cover all of docs and target (both with_words)."""
    flat = docs.select(F.explode(features()).alias("bucket"), F.lit(False).alias("__target"))
    flat = flat.unionAll(target.select(F.explode(features()).alias("bucket"), F.lit(True).alias("__target")))
    counts = flat.groupBy("bucket").agg(F.count_if(~F.col("__target")).alias("raw"), F.count_if("__target").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    every = stored(every, "ngrams")
    sums = every.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    p = lambda n: F.log((F.col(n) + SMOOTHING) / (sums[n] + SMOOTHING * BUCKETS))
    return stored(every.select("bucket", (p("target") - p("raw")).alias("ratio")), "ratios", 1)


def scored(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Adds score: the mean log ratio of a document's features, 0 without any. Needs with_words."""
    # BUCKETS numbers, whatever the input; folded into one literal
    numbers = ",".join(repr(r.ratio) for r in ratios.orderBy("bucket").select("ratio").collect())
    table_of = F.split(F.lit(numbers), ",").cast("array<double>")
    f = features()
    return docs.withColumn("score", F.when(F.size("__h") > 0, F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(table_of, b)) / (F.size("__h") + F.size("__p"))).otherwise(F.lit(0.0)))


def quantiles(values: DataFrame, shares: list[float]) -> list[float] | None:
    """Exact quantiles, interpolated, of the one column of values; None without any. At most GATHERED values, or counts of CELLS cells, meet."""
    v = F.col(values.columns[0])
    n, least, most = values.agg(F.count(v), F.min(v), F.max(v)).first()

    @cache
    def cells(lo: float, hi: float) -> list[tuple[int, float, float]]:
        cell = F.least(F.floor((v - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1)).alias("cell")
        return [tuple(r)[1:] for r in values.where(v.between(lo, hi)).groupBy(cell).agg(F.count(v), F.min(v), F.max(v)).orderBy("cell").collect()]

    @cache
    def gathered(lo: float, hi: float) -> list[float]:
        return sorted(r[0] for r in values.where(v.between(lo, hi)).collect())

    def ranked(rank: int) -> float:
        lo, hi, held = least, most, n
        while held > GATHERED and lo < hi:
            for count, a, b in cells(lo, hi):
                if rank < count:
                    break
                rank -= count
            lo, hi, held = a, b, count
        return lo if lo == hi else gathered(lo, hi)[rank]

    if not n:
        return None
    at = [(n - 1) * share for share in shares]
    return [ranked(int(x)) * (1 - x % 1) + ranked(min(int(x) + 1, n - 1)) * (x % 1) for x in at]


def threshold(held_out: DataFrame, ratios: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> float:
    """The cut from the scores of all held-out trusted documents, before any other is taken apart."""
    # the row number keeps the filters above it: pushed below, they would hold every expression again
    own = held_out.withColumn("__nr", F.monotonically_increasing_id())
    scores = stored(scored(with_words(own), ratios).where((F.size("__h") >= 10) & (F.col("__nr") >= 0)).select("score"), "scores")
    found = quantiles(scores, [quantile, 0.5])
    return float("-inf") if found is None else found[0] - margin * (found[1] - found[0])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the base columns, score and kept.

    A null text has no words; fewer than ten fail the base rules. A document whose labels disagree is not trusted. Without
    any trusted document no score rejects. Rows with a null or repeated doc_id are judged like any other, and very long
    texts whole. An empty table gives no rows. Names that the operator adds win over columns of docs with the same names; any
    other name may occur.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    own = [c for c in docs.columns if c not in added]
    # the caller's columns as one, so that no name of theirs meets one of the operator's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = with_words(rows)
    trusted = trusted_texts(rows, labels)
    ratios = log_ratios(words, with_words(trusted.where("fits")))
    cut = threshold(trusted.where("not fits"), ratios)
    out = base_rules(scored(words, ratios)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in own], *added)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names; see judged."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the row number keeps the filter above the verdict: pushed below, it would hold every expression again
    return judged(rows, labels).withColumn("__nr", F.monotonically_increasing_id()).where("kept and __nr >= 0").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]).coalesce(file_count(docs))


def op1_ngram_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(docs, table(spark, sf_dir, "labels")).drop("text").coalesce(file_count(docs))
