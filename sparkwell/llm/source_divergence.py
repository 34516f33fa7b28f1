"""Source divergence audit: how differently the sources of a language use its terms.

Terms are counted once over all texts.  Each kept term has a sparse vector of counts
by source; terms with the same vector are one column with a multiplicity, every pair
of sources is evaluated once for each distinct column, and the product with the
multiplicity is summed.  Where both sources have no count, the difference is the same
for all columns; where only one has a count, it depends on that count alone; so only
pairs that a column holds leave it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import narrow_batches, staged, tidy

#: Documents of a language that must hold a term, and the counts added to each.
LEAST_DOCUMENTS, PRIOR = 30, 5
#: Ranks of the term report.
TOP_TERMS = 50
#: Counted terms that a task holds before it hands them on, and bytes split at once.
MOST_HELD, PIECE = 200_000, 1 << 22
_COUNTS = "lang string, source string, term string, n long, docs long"

#: Bytes of a term as they are, A-Z lower-cased; all others end a term.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A folded text in pieces that end between terms."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _table(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    langs, sources, terms, counts, docs = [], [], [], [], []
    for (lang, source), (n, d) in held.items():
        langs += [lang] * len(n)
        sources += [source] * len(n)
        terms += n.keys()
        counts += n.values()
        docs += [d[t] for t in n]
    return pa.record_batch(
        [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())],
        ["lang", "source", "term", "n", "docs"],
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, added up
    within the task as far as ``MOST_HELD`` goes."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        lang, source, text = batch.columns
        for key, raw in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.binary()).to_pylist(), strict=True):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            size -= len(n)
            seen: set[bytes] = set()
            for piece in _pieces(raw.translate(_FOLD)):
                words = piece.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n)
            if size > MOST_HELD:
                yield _table(held)
                held.clear()
                size = 0
    if held:
        yield _table(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (rows with the
    term) over whole texts; nulls are read as empty."""
    narrow_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = read.mapInArrow(tidy(_counted), _COUNTS)
    return parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def count_columns(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang``, ``term``, ``vec`` (pairs of ``source`` and count ``n``, by source) and
    ``total`` of each term that ``least`` documents of the language hold."""
    by = term_counts(docs).groupBy("lang", "term")
    column = by.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return column.where(F.col("docs") >= least).select("lang", "term", "vec", "total")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 5) / total), exactly; null where ``total`` is 0."""
    a = (count + PRIOR).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", a, F.nullif(total, F.lit(0)).cast("decimal(20,0)")) + 1


def source_totals(docs: DataFrame, columns: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``d`` (smoothed total of the group), ``dl`` (of the language),
    ``terms`` (kept terms of the language) and ``p0`` (share of an absent term) of
    each language and source that occurs."""
    occurring = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    held = columns.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    langs = columns.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("nl"))
    all_ = occurring.join(held, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "nl", "terms"])
    prior = PRIOR * F.col("terms")
    sums = all_.select("lang", "source", "terms", (F.col("n") + prior).alias("d"), (F.col("nl") + prior).alias("dl"))
    return sums.withColumn("p0", _share(F.lit(0), F.col("d")))


def _as(groups: DataFrame, side: str) -> DataFrame:
    return groups.select("lang", *[F.col(c).alias(f"{side}_{c}") for c in ("source", "d", "p0")])


def pair_values(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``a_source``, ``b_source`` (``a`` before ``b``) and ``value``, the sum
    of the differences of their shares over all kept terms."""
    a, b = _as(groups, "a"), _as(groups, "b")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    absent = gap("a_p0", "b_p0")
    distinct = columns.groupBy("lang", "vec").agg(F.count("*").alias("m"))
    # a source counted, whatever the other: what a count of the other adds comes below
    one = distinct.select("lang", "m", F.inline("vec").alias("a_source", "n")).groupBy("lang", "a_source", "n").agg(F.sum("m").alias("m"))
    one = one.join(a, ["lang", "a_source"]).withColumn("p", _share(F.col("n"), F.col("a_d")))
    one = one.join(b, "lang").where("a_source <> b_source")
    first, second = F.least("a_source", "b_source"), F.greatest("a_source", "b_source")
    one = one.select("lang", first.alias("a_source"), second.alias("b_source"), (F.col("m") * (gap("p", "b_p0") - absent)).alias("v"))
    # both counted: each pair of entries of a column
    at = distinct.select("lang", "m", "vec", F.posexplode("vec").alias("i", "x"))
    both = at.select("lang", "m", "x", F.explode(F.slice("vec", F.col("i") + 2, F.size("vec"))).alias("y"))
    both = both.groupBy("lang", *[F.col(f"{e}.{f}").alias(f"{s}_{f}") for e, s in (("x", "a"), ("y", "b")) for f in ("source", "n")]).agg(F.sum("m").alias("m"))
    both = both.join(a, ["lang", "a_source"]).join(b, ["lang", "b_source"])
    both = both.withColumns({"ap": _share(F.col("a_n"), F.col("a_d")), "bp": _share(F.col("b_n"), F.col("b_d"))})
    each = gap("ap", "bp") - gap("ap", "b_p0") - gap("bp", "a_p0") + absent
    both = both.select("lang", "a_source", "b_source", (F.col("m") * each).alias("v"))
    none = a.join(b, "lang").where("a_source < b_source").join(groups.select("lang", "terms").distinct(), "lang")
    none = none.select("lang", "a_source", "b_source", (F.col("terms") * F.coalesce(absent, F.lit(0))).alias("v"))
    return none.union(one).union(both).groupBy("lang", "a_source", "b_source").agg(F.sum("v").alias("value"))


def term_values(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (term), ``value`` of every term that a source
    uses more than its language does."""
    each = columns.select("lang", "term", "total", F.inline("vec").alias("source", "n")).join(groups, ["lang", "source"])
    more = _share(F.col("n"), F.col("d")) - _share(F.col("total"), F.col("dl"))
    return each.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: each other source of the language, by the sum of the differences of
    smoothed shares over all kept terms (0 if there are none).  Part ``term``: the
    ``top`` terms whose share in the source exceeds that in the language.

    Null text, lang or source is read as ''.  Each row is a document, repeated rows
    and rows without a ``doc_id`` as well; other columns are not read.  Ties go by the
    item's UTF-8 bytes.  A language with one source has no pairs, no rows give an
    empty table.  The pairs are as many as the contract's rows, the square of the
    sources of a language; a column holds each source once.
    """
    columns = staged(count_columns(docs, least), "count-columns")
    groups = staged(source_totals(docs, columns), "source-totals")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = staged(pair_values(columns, groups), "source-pairs")
    ways = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "value").union(
        pairs.select("lang", "b_source", "a_source", "value")
    )
    pair = ways.withColumn("rank", F.row_number().over(order))
    term = term_values(columns, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pair, "pair").union(named(term, "term"))
