"""Running sums and ranks over an order, without one task that holds it all.

Rows are dealt out by ranges of the order and staged with the range's number;
each range is summed by itself, and only one total a range (and group) is
brought into one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import staged


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "_hi", total: str = "_n") -> DataFrame:
    """``df`` with the sum of ``value`` up to each row in ``order``, within groups
    ``by``, and the group's ``total``.  ``order`` must tell rows apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    ranged = df.repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id())
    rows = staged(ranged, "ranges")
    sums = rows.groupBy(*by, "_p").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_p").alias("_range"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"),
        F.sum("_t").over(Window.partitionBy(*by)).alias(total),
    )
    match = F.col("_p") == F.col("_range")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    upto = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.join(offsets, match).select(*rows.columns, "_before", total)
    return local.withColumn(name, F.sum(value).over(upto) + F.col("_before")).drop("_p", "_before")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the rows' numbers in ``order``, from 1 on."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, [], order, "_one", name, "_total").drop("_one", "_total")


def lower_sums(cells: DataFrame, x: str, y: str, weight: str, strict: bool = True) -> DataFrame:
    """``x``, ``y`` of each row of ``cells`` (which tell rows apart) with sums of
    ``weight`` over the rows whose ``x`` is smaller: ``_all`` of them, ``_upto``
    those with ``y`` no greater and, if ``strict``, ``_below`` those with ``y``
    smaller.  Null where no row has a smaller ``x``.

    No pairs are formed.  A row is filed once for each binary digit of the rank of
    its ``x``, under the digits before it: the rows with a smaller ``x`` are those
    with a zero under the same leading digits as one of its own ones.  So ``n``
    rows become ``n log n``, and one running sum answers all.
    """
    ranks = staged(global_rank(cells.select(x).distinct(), [x], "_r").select(F.col(x).alias("_v"), (F.col("_r") - 1).alias("_d")), "dense-ranks")
    digits = max(1, int(ranks.agg(F.coalesce(F.max("_d"), F.lit(0))).first()[0]).bit_length())
    filed = cells.join(ranks, F.col(x) == F.col("_v")).select(x, y, weight, "_d", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("_l"))
    one = F.expr("shiftright(_d, _l) & 1") == 1
    asks = F.array(F.lit(0), F.lit(2)) if strict else F.array(F.lit(2))
    # equal y: a question for smaller ones, then what counts, then a question for no greater ones
    filed = filed.select(x, y, weight, "_d", "_l", F.expr("shiftright(_d, _l + 1)").alias("_g"), F.explode(F.when(one, asks).otherwise(F.array(F.lit(1)))).alias("_m"))
    filed = filed.withColumn("_w", F.when(F.col("_m") == 1, F.col(weight)).otherwise(F.lit(0)))
    summed = running_sum(filed, ["_l", "_g"], [y, "_m", "_d"], "_w", "_hi", "_t").where("_m <> 1")
    out = [F.sum(F.when(F.col("_m") == 2, F.col(c))).alias(n) for c, n in (("_t", "_all"), ("_hi", "_upto"))]
    if strict:
        out.append(F.sum(F.when(F.col("_m") == 0, F.col("_hi"))).alias("_below"))
    return summed.groupBy(x, y).agg(*out)


def _blocks(rank: Column, digits: int) -> tuple[Column, Column]:
    """The blocks (level ``l``, number ``g``) of ranks that hold a rank, and those that
    together hold all ranks up to it."""
    levels, upto = F.sequence(F.lit(0), F.lit(digits - 1)), rank + 1
    part = lambda v, level: F.call_function("shiftright", v, level)
    ones = F.filter(levels, lambda level: part(upto, level).bitwiseAND(F.lit(1)) == 1)
    return (
        F.transform(levels, lambda level: F.struct(level.alias("l"), part(rank, level).alias("g"))),
        F.transform(ones, lambda level: F.struct(level.alias("l"), (part(upto, level) - 1).alias("g"))),
    )


def dominated_counts(cells: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """``columns`` (which tell the rows of ``cells`` apart) and ``_n``, the sum of
    ``weight`` over the rows that are at or below a row in every column.

    No pairs are formed.  In all columns but the last, a row is filed under every
    block of ranks of a power of two that holds it; the ranks up to a row's own are one
    block for each binary one of their number.  Blocks of several columns are nested, and
    within each nest one running sum over the last column answers: ``n`` rows of ``p``
    columns become ``n log^(p-1) n``.  The column of the most different values is the last
    one, since the logarithms are those of the others' numbers.
    """
    sizes = cells.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    *outer, last = sorted(columns, key=lambda c: sizes[c])
    filed, asked = cells, cells
    keys = []
    for k, c in enumerate(outer):
        # ties have one rank; the number of ranks up to it is one more
        ranks = staged(global_rank(cells.select(c).distinct(), [c], "_r").select(F.col(c).alias("_v"), (F.col("_r") - 1).alias(f"_d{k}")), "dense-ranks")
        digits = max(1, int(ranks.agg(F.coalesce(F.max(f"_d{k}"), F.lit(0)) + 1).first()[0]).bit_length())
        every, below = _blocks(F.col(f"_d{k}"), digits)
        filed, asked = (df.join(ranks, F.col(c) == F.col("_v")).drop("_v").withColumn(f"_b{k}", F.explode(b)) for df, b in ((filed, every), (asked, below)))
        keys.append(f"_b{k}")
    at = [F.col(f"{b}.{part}").alias(f"{b}{part}") for b in keys for part in ("l", "g")]
    both = filed.select(*columns, *at, F.col(weight).alias("_w"), F.lit(0).alias("_m")).union(asked.select(*columns, *at, F.lit(0).cast(cells.schema[weight].dataType).alias("_w"), F.lit(1).alias("_m")))
    by = [f"{b}{part}" for b in keys for part in ("l", "g")]
    # a row's own count comes before its question
    summed = running_sum(both, by, [last, "_m", *outer], "_w", "_hi", "_t").where("_m = 1")
    return summed.groupBy(*columns).agg(F.sum("_hi").alias("_n"))
