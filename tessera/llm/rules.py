"""Quality rules: base counts of a text, and a log-likelihood ratio of hashed n-grams between a trusted target
and the raw corpus, normalised by length and held against a fixed threshold. DataFrame functions only.

The raw multinomial counts every document. The trusted target is a bounded sample of rows labelled good
(``TARGET_ROWS``, by a hash of the id), which makes it fit to broadcast; so are the 2**16 log ratios. Scoring
is a projection: no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, bound

BUCKETS = 1 << 16
TARGET_ROWS = 50_000
#: Added to every bucket's count, as a share of the mean count.
SMOOTHING = 0.05
THRESHOLD = -0.35
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOL = "[#*$%&|<>]"


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null, in order."""
    pieces = F.split(text, BLANKS)
    return F.filter(pieces, lambda w: w != "")


def sorted_windows(grams: Column) -> Column:
    """(hash, place) of a text's 3-word windows, sorted; nothing if all differ, as in most texts, which costs
    one hash set."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))


def base_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to every row. Null
    counts as the empty text."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_text", _text()).withColumn("_words", words_of(text)).withColumn("_lines", lines)
    starts = F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))
    grams = F.transform(starts, lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_grams", grams).withColumn("_sorted", sorted_windows(F.col("_grams")))
    same = lambda e, j, by: F.coalesce(F.get(F.col("_sorted"), j + by)["g"] == e["g"], F.lit(False))
    found = F.filter("_sorted", lambda e, j: same(e, j, -1) | same(e, j, 1))
    out = out.withColumn("_at", F.sort_array(F.transform(found, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    counted = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.size(F.split(text, SYMBOL)) - 1).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size("_sorted") == 0, F.lit(0)).otherwise(covered).cast("long"),
    }
    out = out.withColumns(counted).drop("_text", "_words", "_lines", "_grams", "_sorted", "_at")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets(text: Column) -> Column:
    """The buckets of a text's hashed unigrams and bigrams, as an array. The hashes are bound once: a column of
    them would be worked out again for each use."""

    def grams(h: Column) -> Column:
        less = F.greatest(F.size(h) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(h, F.lit(1), less), F.slice(h, F.lit(2), less), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
        return F.concat(F.transform(h, lambda a: F.pmod(a, F.lit(BUCKETS)).cast("int")), pairs)

    return bound(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)), grams)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """ln(target / raw) of each bucket. ``trusted``: (doc_id) of at most ``TARGET_ROWS`` rows. Without any
    trusted text all ratios are 0, so the method keeps everything."""
    mark = F.broadcast(trusted.select("doc_id").distinct().withColumn("_trusted", F.lit(1)))
    marked = docs.select("doc_id", "text").join(mark, "doc_id", "left")
    counts = marked.select(F.explode(buckets(_text())).alias("bucket"), "_trusted").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():  # a row for each bucket at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0.0] * BUCKETS

    def shares(counted: list[int]) -> list[float]:
        more = SMOOTHING * sum(counted) / BUCKETS
        return [(c + more) / (sum_all + BUCKETS * more) for sum_all in [sum(counted)] for c in counted]

    return [math.log(t / r) for t, r in zip(shares(target), shares(raw), strict=True)]


def add_ratio(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Add ``llr``: the mean log ratio over a text's n-grams, 0 for a text without any."""
    table = F.split(F.lit(" ".join(map(repr, ratios))), " ").cast("array<double>")

    def mean(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(found)).otherwise(F.lit(0.0))

    return docs.withColumn("llr", bound(buckets(_text()), mean))


def trusted_rows(labels: DataFrame) -> DataFrame:
    """Ids of rows labelled good, at most ``TARGET_ROWS``, by a hash of the id."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(TARGET_ROWS)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept, for every row of ``docs``. Null and empty texts fail
    the base rules; very long texts are counted in whole, within one row; repeated rows are judged each and alike; a ratio
    that ties with the threshold is kept; an empty table gives no rows; other columns are ignored."""
    ratios = log_ratios(docs, trusted_rows(labels))
    out = add_ratio(base_counts(docs.select("doc_id", "text")), ratios)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*names, "llr", (~F.col("base_failed") & (F.col("llr") >= THRESHOLD)).alias("kept"))
