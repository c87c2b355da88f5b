"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.text import SPACE, SPACE_CLASS, lines_of, text_or_empty, words_of
from cardloom.operators.quantiles import exact_quantiles
from cardloom.session import table, written

SYMBOLS = r"[#*$%&|<>]"
#: Hash buckets of words and word pairs.
BUCKETS = 1 << 16


def gram_buckets(words: Column, buckets: int) -> Column:
    """The hash buckets of a text's words and word pairs."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.transform(words, lambda w, at: F.pmod(F.xxhash64(w, F.get(words, at + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, max_trusted: int | None = None, key: str = "doc_id") -> DataFrame:
    """The ids of all rows of quality 1, with _fold 0 for a quarter of them that sets the threshold; if max_trusted is given, those first by hash of the id."""
    good = labels.filter((F.col("quality") == 1) & F.col(key).isNotNull()).select(key).distinct()
    good = good if max_trusted is None else good.orderBy(F.xxhash64(key), key).limit(max_trusted)
    return good.withColumn("_fold", F.pmod(F.xxhash64(F.lit(7), key), F.lit(4)))


def trusted_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and _fold of the documents that labels trust, written: the ratio and the threshold both read them, and texts are shuffled once.

    The plan is the same at any size: ids are hashed where the texts of their range lie, so texts are never sorted and no id is broadcast.
    """
    return written(docs.select(key, text).join(trusted_ids(labels, key=key).hint("shuffle_hash"), key))


def fit_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0, key: str = "doc_id", text: str = "text", trusted: DataFrame | None = None) -> DataFrame:
    """One row, model: for each bucket the log ratio of its share among trusted texts to its share among all.

    The trusted multinomial comes from three quarters of all documents that labels trust; the raw one counts every n-gram of every document.
    Labels with a null id or quality, and labels of unknown documents, teach nothing; null texts
    count as empty. Counts are summed in each task before at most buckets rows of it are shuffled. trusted: trusted_texts, if they are there already.
    """
    trusted = trusted_texts(docs, labels, key, text) if trusted is None else trusted
    # words are a column of their own, else they would be found anew for each pair
    grams = lambda rows: rows.select(words_of(text_or_empty(text)).alias("_words")).select(F.explode(gram_buckets(F.col("_words"), buckets)).alias("_bucket")).groupBy("_bucket")
    raw = grams(docs.select(text)).agg(F.count(F.lit(1)).alias("_raw"))
    good = grams(trusted.filter("_fold > 0").select(text)).agg(F.count(F.lit(1)).alias("_good"))
    every = docs.sparkSession.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("_bucket"))
    filled = every.join(raw, "_bucket", "left").join(good, "_bucket", "left").select("_bucket", F.coalesce("_raw", F.lit(0)).alias("_raw"), F.coalesce("_good", F.lit(0)).alias("_good"))
    gathered = filled.groupBy().agg(F.array_sort(F.collect_list(F.struct("_bucket", "_raw", "_good"))).alias("_all"), F.sum("_raw").alias("_raws"), F.sum("_good").alias("_goods"))
    share = lambda n, total: (n + F.lit(smoothing)) / (F.col(total) + F.lit(smoothing * buckets))
    return gathered.select(F.transform("_all", lambda x: F.log(share(x["_good"], "_goods")) - F.log(share(x["_raw"], "_raws"))).alias("model"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _words.

    Repeats are found within the row: the hashes of its 3-word windows are sorted with their
    positions, equal neighbours are windows found twice, and each of those covers the words up to
    the next one, three at most. A long text costs n log n.
    """
    body = text_or_empty(text)
    filled = F.filter(lines_of(body), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    out = docs.withColumn("_words", words_of(body)).withColumns(
        {
            "word_chars": (F.char_length(body) - F.regexp_count(body, F.lit(SPACE_CLASS))).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(filled) - F.size(F.array_distinct(filled))).cast("long"),
            "n_words": F.size("_words").cast("long"),
        }
    )
    words = F.col("_words")
    windows = F.transform(words, lambda w, at: F.struct(F.xxhash64(w, F.get(words, at + 1), F.get(words, at + 2)).alias("h"), at.alias("at")))
    out = out.withColumn("_windows", F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))))
    found = F.col("_windows")
    twice = F.filter(found, lambda x, at: (x["h"] == F.get(found, at - 1)["h"]) | (x["h"] == F.get(found, at + 1)["h"]))
    out = out.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["at"])))
    at_twice = F.col("_twice")
    covered = F.transform(at_twice, lambda x, at: F.least(F.lit(3), F.coalesce(F.get(at_twice, at + 1) - x, F.lit(3))))
    return out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")).drop("_windows", "_twice")


def ratio_of(model: Column, buckets: int) -> Column:
    """The mean log ratio over the grams of _words; 0 without words."""
    grams = gram_buckets(F.col("_words"), buckets)
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.element_at(model, b + 1))
    return total / F.greatest(2 * F.size("_words") - 1, F.lit(1))


def base_failed() -> Column:
    """Under 50 words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_threshold(trusted: DataFrame, model: DataFrame, drop_share: float, buckets: int, text: str) -> DataFrame:
    """One row, threshold: what a share of drop_share of the held-out trusted documents (of trusted_texts) falls below; null without any.

    Only the quarter of the trusted documents that the ratio did not learn from counts, of these those that pass the base rules.
    """
    counted = base_counts(trusted.filter("_fold = 0").select(text), text).withColumn("_model", model.scalar())
    # written, as a filter on these columns would repeat their expressions; three numbers for each document
    scored = written(counted.select("n_words", "n_repeat_words", ratio_of(F.col("_model"), buckets).alias("llr")))
    found = exact_quantiles(scored.filter(~base_failed()), [], "llr", {"llr": F.lit(True)}, {"least": drop_share})
    return found.select(F.col("llr_least").alias("threshold"))


def judge(
    docs: DataFrame, labels: DataFrame, threshold: float | None = None, drop_share: float = 0.001, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with base counts, llr, base_failed and kept.

    llr is the mean log-likelihood ratio of a text's hashed words and word pairs between the
    trusted and the raw multinomial; a text without words has 0. base_failed: under 50 words, or
    more than half of them in repeated 3-word windows. kept: not base_failed and llr >= threshold;
    unless given, the threshold is the ratio that a share of drop_share of trusted documents which
    the ratio did not learn from falls below. A null text counts as an empty one, repeated rows are
    judged alike, and other columns stay but for those named like the added ones. Without held-out trusted
    documents nothing is dropped for its ratio. An empty table gives an empty result.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    trusted = trusted_texts(docs, labels, key, text)
    model = written(fit_ratio(docs, labels, buckets, key=key, text=text, trusted=trusted))
    least = F.lit(threshold) if threshold is not None else fit_threshold(trusted, model, drop_share, buckets, text).scalar()
    counted = base_counts(docs.drop(*added), text).withColumn("_model", model.scalar())
    scored = counted.withColumn("llr", ratio_of(F.col("_model"), buckets)).drop("_words", "_model")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.coalesce(least, F.lit(float("-inf")))))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged against the documents that the labels trust."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES: dict[str, str] = {}
