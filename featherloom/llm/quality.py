"""Quality rules: hashed n-gram log-likelihood ratio, and base rules.

Texts are cut into runs of letters and runs of punctuation. Their unigrams and
bigrams are hashed into ``BUCKETS`` buckets, over which two multinomials are
counted: one of all documents, one of trusted ones. Both get PRIOR more counts
in each bucket, at the trusted one's scale, so that rare n-grams say little. A
document's score is its mean log-likelihood ratio per n-gram, and a fixed
threshold decides. Ratios
are rounded to whole steps of 1 / SCALE, so sums are exact and a rerun decides
alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: BUCKETS is a power of two.
BUCKETS, PRIOR, SCALE = 65_536, 20.0, 1_000_000
THRESHOLD = -0.1
#: The trusted multinomial is counted on so many trusted documents at most, those whose ids hash lowest.
TRUSTED = 20_000
PUNCT = "\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def spaced(text: Column) -> Column:
    """A text whose spaces are all alike."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed to ``docs`` (text). Null text counts as empty.

    Repeats of 3-word windows show in their 64-bit hashes: where these are not
    all different, they are sorted with their places, and equal neighbours are
    repeats.
    """
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_w", words(F.col("_t"))).withColumn("_n", F.size("_w"))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    d = d.withColumn("_h", F.expr("CASE WHEN _n >= 4 THEN slice(transform(_h, (x, i) -> xxhash64(x, get(_h, i + 1), get(_h, i + 2))), 1, _n - 2) END"))
    d = d.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < _n - 2 THEN sort_array(transform(_h, (x, i) -> named_struct('h', x, 'i', i))) END"))
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, i) -> x.h = get(_s, i - 1).h OR x.h = get(_s, i + 1).h), x -> x.i))"))
    covered = F.expr("coalesce(aggregate(_p, named_struct('n', 0L, 'end', -1), (a, p) -> named_struct('n', a.n + (p + 3) - greatest(p, a.end), 'end', p + 3), a -> a.n), 0L)")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    d = d.withColumn("_lines", lines)
    d = d.select(
        "_row.*", F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.replace(spaced(F.col("_t")), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def with_ngrams(docs: DataFrame) -> DataFrame:
    """Adds _uni and _bi: hashes of the unigrams and bigrams of ``text``."""
    d = docs.withColumn("_tok", words(F.regexp_replace(F.coalesce("text", F.lit("")), f"([{PUNCT}]+)", " $1 ")))
    d = d.withColumn("_uni", F.transform("_tok", lambda x: F.xxhash64(x)))
    rest = F.greatest(F.size("_uni") - 1, F.lit(0))
    return d.withColumn("_bi", F.zip_with(F.slice("_uni", F.lit(1), rest), F.slice("_uni", F.lit(2), rest), lambda x, y: F.xxhash64(x, y))).drop("_tok")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, ratio) of every bucket, times SCALE: log((own + prior) / (all * share + prior)),
    share being that of the trusted n-grams in all."""
    few = trusted.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)  # the bound of this broadcast
    mark = docs.select("doc_id", "text").join(F.broadcast(few.withColumn("_trusted", F.lit(1))), "doc_id", "left")
    each = with_ngrams(mark).select("_trusted", F.explode(F.concat("_uni", "_bi")).alias("gram"))
    each = each.select("_trusted", F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket"))
    n = each.groupBy("bucket").agg(F.count("*").alias("all"), F.count("_trusted").alias("own"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").select("bucket", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("own", F.lit(0)).alias("own"))
    whole = Window.partitionBy(F.lit(1))  # one row per bucket
    every = every.withColumn("n_all", F.sum("all").over(whole)).withColumn("n_own", F.sum("own").over(whole))
    share = F.col("n_own") / F.greatest(F.lit(1), F.col("n_all"))
    return every.select("bucket", F.round(F.ln((F.col("own") + prior) / (F.col("all") * share + prior)) * SCALE).cast("int").alias("ratio"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id of at most ``most`` documents labelled good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


#: Columns that judge adds; those of the same name in its input give way.
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base rules' columns, score and kept.

    ``trusted`` has the doc_ids of the trusted multinomial, TRUSTED at most.
    Without n-grams a score is 0. With no trusted documents all ratios are 0 and
    the base rules decide. Repeated rows get the same verdict.
    """
    docs = docs.drop(*OWN)
    ratios = log_ratios(docs, trusted)
    # One array of BUCKETS whole numbers, whatever the input.
    array = ratios.agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("x")).select(F.transform("x", lambda x: x["ratio"])).scalar()
    # The caller's columns stay apart from those of the work.
    d = with_ngrams(base_rules(docs.select(F.struct(*docs.columns).alias("row"), "text"))).withColumn("_llr", array)
    looked_up = lambda grams: F.expr(f"aggregate({grams}, 0L, (a, x) -> a + get(_llr, cast(x & {BUCKETS - 1} AS INT)))")
    d = d.withColumn("_sum", looked_up("_uni") + looked_up("_bi"))
    grams = F.greatest(F.lit(1), 2 * F.size("_uni") - 1)
    found = [c for c in d.columns if c not in ("row", "text") and c[0] != "_"]
    d = d.withColumn("score", F.col("_sum") / grams / SCALE).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # A filter on the verdict must not move below what it is made of: pushed into the
    # expressions over word arrays, it would be worked out again for each word. No
    # filter passes a generator, so the verdict comes out of one, as its only row.
    return d.select("row.*", F.inline(F.array(F.struct(*found, "score", "kept"))))


def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
