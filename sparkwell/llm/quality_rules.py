"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import global_rank, running_sum
from .store import staged
from .words import word_array

#: Buckets of words and word pairs; micro-nats are whole numbers, so sums do not
#: depend on their order.
N_BUCKETS, MICRO = 1 << 16, 1_000_000
#: Mean micro-nats of an n-gram below which a text is dropped, where labels do
#: not tell.
THRESHOLD = -100_000
SYMBOLS = r"[^#*$%&|<>]+"


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``w`` (words), ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words`` and ``base_failed`` added.

    Each text is looked at in its own row: nothing is exploded or shuffled.
    Three-word windows are compared by hash; only texts in which some window
    occurs twice sort theirs, to find the words that such windows cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("w", word_array(F.col("text"))).withColumn(
        "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    rows = rows.withColumn("n_words", F.size("w").cast("long")).withColumn(
        "windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.slice("w", F.lit(1), (F.col("n_words") - 2).cast("int")),
                lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    rows = rows.withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.col("twice"), placed))
    same = F.filter(
        "placed",
        lambda p, i: (p["x"] == F.get("placed", i - 1)["x"]) | (p["x"] == F.get("placed", i + 1)["x"]),
    )
    # null neighbours at the ends make the test null, which filter drops only if no side is true
    at = F.sort_array(F.transform(same, lambda p: p["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        at,
        start,
        lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n")),
        lambda s: s["n"],
    )
    rows = rows.withColumns(
        {
            "word_chars": F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)),
            "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("twice"), covered).otherwise(F.lit(0).cast("long")),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.drop("lines", "windows", "twice", "placed").withColumn("base_failed", failed)


def _bucket(*words) -> F.Column:
    return F.pmod(F.xxhash64(*words), F.lit(N_BUCKETS))


def _grams(rows: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """A row for each word: buckets ``b1`` of the word, ``b2`` of it and the next
    one (null for the last)."""
    each = F.posexplode_outer("w") if outer else F.posexplode("w")
    second = F.get("w", F.col("pos") + 1)
    return rows.select(*keep, "w", each.alias("pos", "word")).select(
        *keep,
        F.when(F.col("word").isNotNull(), _bucket("word")).alias("b1"),
        F.when(second.isNotNull(), _bucket("word", second)).alias("b2"),
    )


def labelled_ids(labels: DataFrame, most: int | None = None, label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """Ids to learn from: trusted ones (label 1, an even hash) for the counts, and
    ``doc_id``, ``good`` of those with an odd hash for the threshold.  All labelled
    documents count; only if the caller gives ``most`` are those with the smallest
    hashes taken, about that many."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.min(label_col) > 0).alias("good")
    )
    if most is not None:
        share = min(1.0, most / max(1, known.count()))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    even = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    return known.where(even & F.col("good")).select("doc_id"), known.where(~even)


def gram_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``bucket``, ``weight``: micro-nats of the log-likelihood ratio between the
    trusted texts and the whole corpus, for all ``N_BUCKETS`` buckets.

    Corpus counts cover all documents.  ``trusted``: a table of different ids.
    Both multinomials have one count added to each bucket.  Counts are added up
    before the shuffle, so hot words cost one row a task.
    """
    marked = docs.select("doc_id", "text").join(trusted.select("doc_id", F.lit(1).alias("trusted")), "doc_id", "left")
    rows = marked.select("trusted", word_array(F.col("text")).alias("w"))
    grams = _grams(rows, "trusted").select("trusted", F.explode(F.array("b1", "b2")).alias("bucket"))
    counts = staged(
        grams.where("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("good")),
        "gram-counts",
    )
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    every = docs.sparkSession.range(N_BUCKETS).toDF("bucket").join(counts, "bucket", "left").fillna(0)
    ratio = F.log((F.col("good") + 1) / (total["good"] + N_BUCKETS)) - F.log((F.col("raw") + 1) / (total["raw"] + N_BUCKETS))
    return staged(every.select("bucket", F.round(ratio * MICRO).cast("long").alias("weight")), "gram-weights")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _scored(docs: DataFrame, weights: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the base counts and ``score``, the mean micro-nats of a word or
    word pair, of every row."""
    # Nothing moves the rows before they are numbered, so a task that runs again
    # gives them the same numbers.
    rows = base_counts(docs.select("text", *keep)).withColumn("row", F.monotonically_increasing_id())
    # the table has N_BUCKETS rows whatever the input
    one = F.broadcast(weights.toDF("b1", "w1"))
    two = F.broadcast(weights.toDF("b2", "w2"))
    keys = ["row", *keep, *_COUNTS]
    grams = _grams(rows, *keys, outer=True).join(one, "b1", "left").join(two, "b2", "left")
    n_grams = F.count("w1") + F.count("w2")
    total = F.coalesce(F.sum("w1"), F.lit(0)) + F.coalesce(F.sum("w2"), F.lit(0))
    per_row = grams.groupBy(*keys).agg(total.alias("total"), n_grams.alias("n_grams"))
    score = F.when(F.col("n_grams") > 0, F.expr("total div n_grams")).otherwise(F.lit(0).cast("long"))
    return per_row.select(*keep, *_COUNTS, score.alias("score"))


def best_threshold(scores: list[tuple[int, bool]], default: int = THRESHOLD) -> int:
    """The score that parts good from bad texts with the best mean of both shares;
    of equals the one in the widest gap, then the lowest.  ``default`` if one
    kind is missing."""
    n_good = sum(g for _, g in scores)
    n_bad = len(scores) - n_good
    if not n_good or not n_bad:
        return default
    ordered = sorted(scores)
    best, below_good, below_bad = None, 0, 0
    for (s, good), (following, _) in zip(ordered, ordered[1:] + [ordered[-1]], strict=True):
        below_good, below_bad = below_good + good, below_bad + (not good)
        if following > s:
            found = ((n_good - below_good) / n_good + below_bad / n_bad, following - s, -s)
            if best is None or found > best[0]:
                best = found, (s + following) // 2
    return best[1] if best and best[0][0] > 1 else default


def learned_threshold(scores: DataFrame, default: int = THRESHOLD) -> int:
    """``best_threshold`` of a table of ``score``, ``good``: equal scores are counted,
    and running counts over the different ones are worked out by ranges."""
    one = F.when(F.col("good"), 1).otherwise(0).cast("long")
    cells = staged(scores.groupBy("score").agg(F.sum(one).alias("n_good"), F.sum(1 - one).alias("n_bad")), "scores")
    good = running_sum(cells, [], ["score"], "n_good", "below_good", "all_good").select("score", "below_good", "all_good")
    bad = running_sum(cells, [], ["score"], "n_bad", "below_bad", "all_bad").select("score", "below_bad", "all_bad")
    placed = staged(global_rank(good.join(bad, "score"), ["score"], "place"), "placed-scores")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("score").alias("following"))
    share = (F.col("all_good") - F.col("below_good")) / F.col("all_good") + F.col("below_bad") / F.col("all_bad")
    cut = placed.where("all_good > 0 AND all_bad > 0").join(after, "place")
    best = cut.agg(F.max(F.struct(share.alias("share"), (F.col("following") - F.col("score")).alias("gap"), (-F.col("score")).alias("low"))).alias("m")).first()["m"]
    if best is None or best["share"] <= 1:
        return default
    return (best["gap"] - 2 * best["low"]) // 2


def quality(docs: DataFrame, labels: DataFrame, threshold: int | None = None, most_labels: int | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, the four counts, ``base_failed``, ``kept`` and
    ``score`` of every row.

    A text is kept if it passes the base rules and its score is ``threshold``
    or more; without one given, the threshold is that which best parts labelled
    texts that did not take part in the counts.  Texts without words score 0 and
    fail the base rules; null counts as empty.  Each row is judged by itself,
    repeated rows and rows without a ``doc_id`` too.  Without labels of both
    kinds the threshold is ``THRESHOLD``.  An empty table gives no rows.  Other
    columns are ignored.
    """
    # as tables, whose size tells Spark whether to send them
    trusted, others = (staged(ids, "labelled") for ids in labelled_ids(labels, most_labels))
    weights = gram_weights(docs, trusted)
    if threshold is None:
        held = staged(docs.select("doc_id", "text").join(others, "doc_id").select("text", "good"), "held")
        threshold = learned_threshold(_scored(held, weights, "good").where("NOT base_failed").select("score", "good"))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return _scored(docs, weights, "doc_id").select("doc_id", *_COUNTS, kept.alias("kept"), "score")
