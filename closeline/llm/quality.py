"""Quality rules: how much likelier a text is in the trusted target than in the corpus.

Texts are cut into runs of ASCII punctuation and runs of other characters between white
space.  Their unigrams and bigrams (after the last token, that token alone) are hashed into `buckets` counters, once over every document and once over the
trusted ones.  A document's score is the mean, over its n-grams, of the logarithm of the
smoothed probability ratio of their buckets; a document under `threshold` is rejected.  The
verdict has no random draw, and weights are whole micro-nats, so sums have no order.

Nulls and empty texts have no words and fail the base rule.  Repeated rows are judged row
by row and give equal verdicts.  An empty table gives an empty result; without a trusted
document all weights are equal and only the base rule rejects.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import bind, broadcast_if_few, checkpointed, one_space, space_words

#: Least words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
BUCKETS = 1 << 14
#: Nats per n-gram below which a text is rejected.
THRESHOLD = -0.25
#: Pseudo-count of every bucket.
SMOOTHING = 1.0
#: Bits for a window's place beside its hash.
PLACE_BITS = 20
#: Trusted ids up to so many are broadcast; more meet the documents by a shuffle.
BROADCAST_IDS = 1 << 20


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids whose labels all say quality 1, each once."""
    ids = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    good = ids.agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    return checkpointed(good.where("least = 1 AND most = 1").select("doc_id"))


def _with_grams(docs: DataFrame) -> DataFrame:
    """`docs` with `_grams`, the hashes of all unigrams, then of all bigrams, of the tokens."""
    spaced = F.regexp_replace(one_space(F.col("text")), r"(\p{Punct}+)", " $1 ")
    tokens = F.array_remove(F.split(spaced, " "), "")
    hashed = docs.withColumn("_uni", F.transform(tokens, lambda x: F.xxhash64(x)))
    grams = F.concat("_uni", F.zip_with("_uni", _from("_uni", 2), lambda x, y: F.xxhash64(x, y)))
    return hashed.withColumn("_grams", grams).drop("_uni")


def _from(array: str, place: int) -> Column:
    """The elements from the one at `place`, counted from 1."""
    return F.slice(array, place, F.greatest(F.size(array), F.lit(1)))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with an array of `buckets` weights, in micro-nats.

    The counts cover every document and every trusted one, and combine before the shuffle;
    `buckets` rows reach the last step.
    """
    ids = broadcast_if_few(trusted.select("doc_id").distinct(), BROADCAST_IDS)
    marked = docs.select("doc_id", "text").join(ids.withColumn("is_target", F.lit(1)), "doc_id", "left")
    marked = _with_grams(marked)
    # An inner explode would have `_grams` computed once more, by a filter on its size.
    each = marked.select("is_target", F.explode_outer("_grams").alias("gram")).where("gram IS NOT NULL")
    counts = each.groupBy(F.pmod("gram", F.lit(buckets)).alias("bucket"))
    counts = counts.agg(F.count("*").alias("raw"), F.count("is_target").alias("target"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    rows = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    ordered = rows.agg(
        F.sum("raw").alias("raws"),
        F.sum("target").alias("targets"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("counts"),
    )
    s, even = SMOOTHING, SMOOTHING * buckets
    weight = f"""if(targets = 0, 0L, cast(round(1e6 * (
        ln((c.target + {s}) / (targets + {even})) - ln((c.raw + {s}) / (raws + {even})))) AS bigint))"""
    return ordered.selectExpr(f"transform(counts, c -> {weight}) AS weights")


def log_ratio(weights: Column, buckets: int = BUCKETS) -> Column:
    """Mean weight of the hashes in `_grams`, in nats; null without any."""

    def add(total: Column, gram: Column) -> Column:
        return total + F.get(weights, F.pmod(gram, F.lit(buckets)).cast("int"))

    total = F.aggregate("_grams", F.lit(0).cast("long"), add)
    return F.when(F.size("_grams") > 0, total / F.size("_grams") / 1e6)


def base_counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn("_words", space_words(F.col("text"))).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "_hashes": F.transform("_words", lambda x: F.xxhash64(x)),
        }
    )
    two = F.zip_with("_hashes", _from("_hashes", 2), lambda x, y: F.xxhash64(x, y))
    three = F.zip_with(two, _from("_hashes", 3), lambda x, y: F.xxhash64(x, y))
    whole = F.slice(three, F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0)))
    counted = counted.withColumn("_windows", whole)
    counted = counted.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    counted = counted.withColumn("n_repeat_words", F.expr(_repeat_words()).cast("long"))
    failed = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
    return counted.withColumn("base_failed", F.expr(failed)).drop(
        "_words", "_hashes", "_windows", "_repeats"
    )


def _repeat_words() -> str:
    """Words covered by three-word windows that the text holds twice or more.

    Windows are told apart by 64-bit hashes.  Only where those repeat they are sorted with
    their places: packed into one number (hash above, place below) while places fit there,
    as pairs in longer texts.  Neighbours with equal hashes are repeats.
    """
    low = PLACE_BITS
    packed = f"""sort_array(transform(_windows,
        (x, i) -> shiftleft(shiftright(x, {low}), {low}) + cast(i AS bigint)))"""
    places = f"transform({packed}, x -> cast(pmod(x, {1 << low}L) AS int))"
    pairs = "transform(sort_array(transform(_windows, (x, i) -> struct(x AS x, i AS i))), p -> p.i)"
    ordered = f"if(size(_windows) <= {1 << low}, {places}, {pairs})"
    hashes = "transform(s, i -> _windows[i])"
    starts = f"""sort_array(flatten(transform(array({ordered}), s -> flatten(transform(array({hashes}), h ->
        filter(s, (i, k) -> h[k] <=> get(h, k - 1) OR h[k] <=> get(h, k + 1)))))))"""
    covered = f"""aggregate({starts}, struct(0 AS words, 0 AS reached),
        (a, i) -> struct(a.words + i + 3 - greatest(i, a.reached) AS words, i + 3 AS reached),
        a -> a.words)"""
    return f"if(_repeats, {covered}, 0)"


def judged(
    docs: DataFrame,
    labels: DataFrame,
    *,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`docs` with the base counts, log_ratio and kept, a row per row.

    The fitted model, `buckets` whole numbers, passes by the driver into the plan.
    """
    plain = docs.select("doc_id", "text")
    fitted = bucket_weights(plain, trusted_ids(labels), buckets).first()["weights"]
    weights = F.split(F.lit(",".join(map(str, fitted))), ",").cast("array<bigint>")
    scored = _with_grams(base_counts(docs)).withColumn("log_ratio", log_ratio(weights, buckets))
    passes = ~F.col("base_failed") & (F.coalesce("log_ratio", F.lit(0.0)) >= threshold)
    return scored.withColumn("kept", passes).drop("_grams")
