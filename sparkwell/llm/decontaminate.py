"""Benchmark passages in documents, by SimHash of item-sized windows.

All of it is DataFrame functions.  A window is as long as a benchmark item, in
words.  Its SimHash is looked up in an index of the items' fingerprints: both
are cut into blocks, items are filed under every block value within
``RADIUS // BLOCKS`` bits, and two fingerprints at most ``RADIUS`` bits apart
have such a block, so no pair within the radius is missed.  A block value of a
random window meets one item in 26, all blocks together one in seven, of which
one in 1,200 is within the radius.  Each different fingerprint is looked up
once, however many copies of a text there are.  Pairs within the radius are
verified by the weighted Jaccard similarity of their shingles, with counts.

Pairs at a similarity of exactly ``SIMILARITY`` differ in 9.7 bits on average,
with a deviation of 2.9; of 90,000 drawn pairs of 15 to 59 words 18 were beyond the radius, of
more similar pairs fewer, of equal ones none.

A window that shares no shingle with an item cannot be similar to it, so only
windows around shingles of the benchmark are formed; this leaves out nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import staged
from .words import shingle_hash, word_array

WIDTH, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
#: Shingles of a benchmark, or ids, up to which they are sent to all executors;
#: more are joined by a shuffle.
MOST_SENT = 1_000_000


def _hashes(words: Column) -> Column:
    """Shingle hashes of a word array; with fewer than ``WIDTH`` words, none.  The
    array is bound to a variable, else it is made anew for every shingle."""

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(
            n >= WIDTH,
            F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), lambda i: shingle_hash(w, i, WIDTH)),
        ).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), of), 0)


def _simhash(hashes: Column, longest: int) -> Column:
    """Bits set in more than half of the hashes, of which there are up to
    ``longest``.  Arrays that 8-bit counts cannot hold have wider ones."""
    narrow = _counted(hashes, 8)
    if longest < 1 << 8:
        return narrow
    wide = _counted(hashes, 16)
    if longest >= 1 << 16:
        wide = F.when(F.size(hashes) < 1 << 16, wide).otherwise(_counted(hashes, 32))
    return F.when(F.size(hashes) < 1 << 8, narrow).otherwise(wide)


def _counted(hashes: Column, lane: int) -> Column:
    """One long counts several bits at once, each in a lane of ``lane`` bits; an
    array has fewer hashes than a lane can count.  Higher-order functions keep
    the expression small; spelled out for 64 bits it would take the compiler
    hundreds of megabytes."""
    mask = sum(1 << k for k in range(0, 64, lane))
    zero = F.lit(0).cast("long")

    def ones(b: int) -> Column:
        return F.aggregate(hashes, zero, lambda s, h: s + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(mask)))

    def bit(s: Column, b: Column) -> Column:
        lanes = F.get(s["lanes"], F.pmod(b, F.lit(lane)))
        count = F.call_function("shiftrightunsigned", lanes, (b - F.pmod(b, F.lit(lane))).cast("int"))
        most = 2 * count.bitwiseAND(F.lit((1 << lane) - 1)) > F.size(hashes)
        value = F.when(most, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero)
        return F.struct(s["lanes"].alias("lanes"), s["fp"].bitwiseOR(value).alias("fp"))

    start = F.struct(F.array(*[ones(b) for b in range(lane)]).alias("lanes"), zero.alias("fp"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, bit, lambda s: s["fp"])


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _near_values() -> list[int]:
    """Block values within ``RADIUS // BLOCKS`` bits of zero."""
    bits = range(BLOCK_BITS)
    return [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(bits, k)]


def _overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        F.array_distinct(b),
        F.lit(0),
        lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def items(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``n`` (words), ``shingles`` of items that have any."""
    words = benchmark.select("item_id", word_array(F.lower("text")).alias("w"))
    return words.select("item_id", F.size("w").alias("n"), _hashes(F.col("w")).alias("shingles")).where(F.size("shingles") > 0)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``window_start`` (word number),
    ``distance``: for each document and item the most similar window, if its
    similarity is ``SIMILARITY`` or more; the first of equals.

    Words are runs without white space, in lower case; shingles are ``WIDTH``
    words.  Documents shorter than an item are one window.  Items and documents
    of fewer than ``WIDTH`` words, null and empty texts match nothing.  Repeated
    rows, of documents or items, give one row; rows without a ``doc_id`` are
    reported under null.  An empty table gives no rows.  Other columns are
    ignored.
    """
    return _most_similar(_text_leaks(docs, benchmark), "doc_id", "item_id")


def _most_similar(found: DataFrame, *keys: str) -> DataFrame:
    best = F.max(F.struct("similarity", (-F.col("window_start")).alias("s"), (-F.col("distance")).alias("d"))).alias("m")
    return found.groupBy(*keys).agg(best).select(*keys, "m.similarity", (-F.col("m.s")).alias("window_start"), (-F.col("m.d")).alias("distance"))


def _text_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` of each text under an id, with ``h``, the text's hash."""
    known = staged(items(benchmark), "items")
    size = known.agg(F.max(F.size("shingles")), F.sum(F.size("shingles"))).first()
    longest, n_shingles = size[0] or 0, size[1] or 0
    maybe_sent = F.broadcast if n_shingles <= MOST_SENT else (lambda x: x)

    marks = known.select(F.explode("shingles").alias("shingle"), "n").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), word_array(F.lower("text")).alias("w"))
    # one stage of generated code: words, hashes and the lookup
    found = (
        rows.where(F.size("w") >= WIDTH)
        .select("doc_id", "h", "w", F.posexplode("w").alias("at", "_"))
        .where(F.col("at") <= F.size("w") - WIDTH)
        .select("doc_id", "h", "at", F.size("w").alias("n_words"), shingle_hash(F.col("w"), F.col("at"), WIDTH).alias("shingle"))
        .join(maybe_sent(marks), "shingle")
    )
    last = F.greatest(F.lit(0), F.col("n_words") - F.col("n"))
    # a hit beyond the last start belongs to the last window
    begin = F.least(F.greatest(F.lit(0), F.col("at") - F.col("n") + WIDTH), last)
    starts = F.sequence(begin, F.least(F.col("at"), last))
    places = found.select("doc_id", "h", "n", F.explode(starts).alias("start")).distinct()
    wanted = staged(places.groupBy("doc_id", "h").agg(F.collect_list(F.struct("n", "start")).alias("places")), "windows")

    # Only documents around which windows lie are read again: their ids are sent
    # to the scan if they are few enough, else both sides are shuffled.
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    if wanted.count() <= MOST_SENT:
        hit = F.broadcast(wanted.select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")))
        texts = texts.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left_semi")
    there = wanted.select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h"), "places")
    texts = texts.hint("merge").join(there, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")))
    # a row that is repeated is one text
    texts = texts.dropDuplicates(["doc_id", "h"])
    # few documents with much work: as many tasks as the session has partitions
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(parts, "doc_id", "h")
    texts = texts.select("doc_id", "h", word_array(F.lower("text")).alias("w"), "places")
    hashed = staged(texts.select("doc_id", "h", _hashes(F.col("w")).alias("all"), "places"), "shingles")
    windows = hashed.select("doc_id", "h", "all", F.explode("places").alias("p")).select(
        "doc_id",
        "h",
        F.col("p.n").alias("n"),
        F.col("p.start").alias("window_start"),
        F.slice("all", F.col("p.start") + 1, F.col("p.n") - WIDTH + 1).alias("shingles"),
    )
    prints = windows.withColumn("fp", _simhash(F.col("shingles"), longest)).drop("shingles")
    prints = staged(prints, "window-prints")
    pairs = staged(near_items(prints.select("n", "fp").distinct(), known, longest), "candidates")
    near = prints.join(pairs, ["n", "fp"]).groupBy("doc_id", "h").agg(F.collect_list(F.struct("item_id", "n", "window_start", "distance")).alias("near"))
    near = near.select(F.col("doc_id").alias("near_id"), F.col("h").alias("near_h"), "near")
    again = hashed.join(near, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("h") == F.col("near_h")))
    again = again.select("doc_id", "h", "all", F.explode("near").alias("c")).select(
        "doc_id", "h", "c.*", F.slice("all", F.col("c.window_start") + 1, F.col("c.n") - WIDTH + 1).alias("shingles")
    )
    # a benchmark may repeat an item, or its number
    wanted_items = known.select(F.col("item_id").alias("known_id"), F.col("n").alias("known_n"), F.col("shingles").alias("item")).distinct()
    shared = again.join(maybe_sent(wanted_items), F.col("item_id").eqNullSafe(F.col("known_id")) & (F.col("n") == F.col("known_n")))
    shared = shared.withColumn("both", _overlap(F.col("shingles"), F.col("item")))
    similar = F.col("both") / (F.size("shingles") + F.size("item") - F.col("both"))
    found = shared.withColumn("similarity", similar).where(F.col("similarity") >= SIMILARITY)
    return _most_similar(found, "doc_id", "h", "item_id")


def near_items(prints: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """``n``, ``fp``, ``item_id``, ``distance`` of all pairs of a window's
    fingerprint and an item's of the same number of words within ``RADIUS``
    bits.  ``prints``: distinct ``n`` and ``fp``; ``known``: ``items``."""
    keyed = prints.select("*", F.posexplode(F.array(*[_block(F.col("fp"), i) for i in range(BLOCKS)])).alias("block", "value"))
    flips = F.expr(f"array({', '.join(map(str, _near_values()))})")  # one constant
    index = (
        known.select("item_id", "n", _simhash(F.col("shingles"), longest).alias("item_fp")).distinct()
        .select("*", F.posexplode(F.array(*[_block(F.col("item_fp"), i) for i in range(BLOCKS)])).alias("block", "v"))
        .select("item_id", "n", "item_fp", "block", F.explode(flips).alias("flip"), "v")
        .select("item_id", "n", "item_fp", "block", F.col("v").bitwiseXOR(F.col("flip").cast("long")).alias("value"))
    )
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # a pair is found once for each block that is near; the first one counts
    near = [
        F.bit_count(_block(F.col("fp"), i).bitwiseXOR(_block(F.col("item_fp"), i))) <= RADIUS // BLOCKS for i in range(BLOCKS)
    ]
    first = F.array_position(F.array(*near), True) - 1
    # a sort-merge join: the index grows with the benchmark, and no value is hot, for
    # each side has every fingerprint once
    pairs = keyed.hint("merge").join(index, ["n", "block", "value"]).where(distance <= RADIUS).where(first == F.col("block"))
    return pairs.select("n", "fp", "item_id", distance.alias("distance")).groupBy("n", "fp", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item.  A row is its id, or none,
    and its text: other texts under the id of a row that goes stay."""
    hit = _text_leaks(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("hit_id")) & (F.xxhash64(docs["text"]) == F.col("hit_h")), "left_anti")
