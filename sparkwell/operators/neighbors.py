"""Nearest neighbours and kernel smoothers for a stated set of queries.

Queries are a bounded set against all rows: they are sent to the rows, each task
keeps its own ``k`` best for every query (a partial top-k before the shuffle),
and only those meet.  Large query sets are taken in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import block_distances, distances, kernels
from ..functions.block_distances import BlockMetric
from ..sources.store import staged
from . import blocks, kernel_sums

Metric = Callable[[Column, Column], Column]
#: Queries in a block that is sent to all executors.
MOST_QUERIES = 10_000
#: Nodes of a polynomial.
MOST_NODES = 1000
#: Cells in the width of a compact kernel.
CELLS = 8
#: Distances that are worked out by blocks (``operators.blocks``).
BY_BLOCKS: dict[Metric, BlockMetric] = {
    distances.euclidean: block_distances.euclidean,
    distances.manhattan: block_distances.manhattan,
    distances.chebyshev: block_distances.chebyshev,
}


def _blocks(queries: DataFrame) -> list[DataFrame]:
    n = queries.count()
    k = -(-n // MOST_QUERIES)
    return [queries.where(F.pmod(F.xxhash64("query"), F.lit(k)) == i) for i in range(k)] if k > 1 else [queries]


def pairs(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row with every query (``query``, ``q``), block by block: no more than
    about ``MOST_QUERIES`` queries are sent to the executors at once."""
    out = None
    for block in _blocks(queries):
        both = rows.crossJoin(F.broadcast(block.select("query", "q")))
        out = both if out is None else out.unionByName(both)
    return out


def pair_values(queries: DataFrame, rows: DataFrame, key: str, metric: Metric, block: BlockMetric, digits: int | None = None) -> DataFrame:
    """``key``, ``query``, ``value``: ``metric`` of every row (``key``, ``x``) and every
    query (``query``, ``q``), rounded to ``digits``.

    ``block`` is the same metric in NumPy; it works out the pairs of whole vectors of the
    commonest length, block by block.  Pairs with another vector take ``metric``."""
    whole = blocks.split(rows, "x")
    asked = blocks.split(queries, "q", whole.d)
    out = []
    if whole.n and asked.n:
        for part, n in _even(asked.whole, asked.n):
            out.append(blocks.pair_values(part, whole.whole, key, whole.d, whole.n, n, block, digits))
    odd = [(queries, whole.others)] if whole.others is not None else []
    odd += [(asked.others, whole.whole)] if asked.others is not None else []
    for q, r in odd or ([] if out else [(queries, rows)]):
        value = metric(F.col("x"), F.col("q"))
        out.append(pairs(q, r).select(key, "query", (value if digits is None else F.round(value, digits) + F.lit(0.0)).alias("value")))
    return reduce(DataFrame.unionByName, out)


def _even(queries: DataFrame, n: int) -> list[tuple[DataFrame, int]]:
    """Blocks of queries that are sent at once, with about how many each holds."""
    parts = _blocks(queries)
    return [(p, -(-n // len(parts))) for p in parts]


def _nearest_by_blocks(queries: DataFrame, rows: DataFrame, k: int, metric: Metric, keep: list[str]) -> DataFrame:
    """As ``nearest``; vectors that are not whole or of another length by ``metric``."""
    whole = blocks.split(rows, "x")
    asked = blocks.split(queries, "q", whole.d)
    columns = ["query", "id", "distance", *keep]
    out = []
    if whole.n and asked.n:
        for part, n in _even(asked.whole, asked.n):
            out.append(blocks.nearest_candidates(part, whole.whole, whole.d, whole.n, n, k, BY_BLOCKS[metric], keep))
    odd = [(queries, whole.others)] if whole.others is not None else []
    odd += [(asked.others, whole.whole)] if asked.others is not None else []
    for q, r in odd or ([] if out else [(queries, rows)]):
        out.append(pairs(q, r).select("query", "id", metric(F.col("x"), F.col("q")).alias("distance"), *keep).where("distance IS NOT NULL").select(*columns))
    near = reduce(DataFrame.unionByName, out)
    w = Window.partitionBy("query").orderBy("distance", "id")
    return near.select("query", "id", "distance", *keep, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: Metric, keep: list[str] | None = None) -> DataFrame:
    """``query``, ``id``, ``distance``, ``rank`` and ``keep`` of the ``k`` nearest
    rows; equal distances go by ``id``.

    ``queries``: ``query``, ``q`` (array); ``rows``: ``id``, ``x`` (array), ``keep``.
    """
    keep = keep or []
    if metric in BY_BLOCKS:
        return _nearest_by_blocks(queries, rows, k, metric, keep)
    out = None
    for block in _blocks(queries):
        near = rows.crossJoin(F.broadcast(block.select("query", "q")))
        near = near.select("query", "id", metric(F.col("x"), F.col("q")).alias("distance"), *keep).where("distance IS NOT NULL")
        # row_number() <= k becomes a top-k in each task before the shuffle
        w = Window.partitionBy("query").orderBy("distance", "id")
        best = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def _weight(alpha: float | None, scale: float, case: str | None) -> Column:
    w = F.lit(1.0) if alpha is None else scale / (1 + F.pow("distance", F.lit(float(alpha))))
    return w * F.col(case) if case else w


def knn_regression(queries: DataFrame, rows: DataFrame, k: int, metric: Metric, y: str = "y", alpha: float | None = None, weight: str | None = None) -> DataFrame:
    """``query``, ``prediction``: mean of ``y``, by inverse distance if ``alpha``
    is given and by a case weight if one is."""
    near = nearest(queries, rows, k, metric, [y, *([weight] if weight else [])])
    w = _weight(alpha, 2.0, weight)
    return near.groupBy("query").agg((F.sum(w * F.col(y)) / F.nullif(F.sum(w), F.lit(0.0))).alias("prediction"))


def knn_classification(queries: DataFrame, rows: DataFrame, k: int, metric: Metric, y: str = "y", alpha: float | None = None, weight: str | None = None) -> DataFrame:
    """``query``, ``prediction``: the class with most (weighted) votes, the lowest
    of equals."""
    near = nearest(queries, rows, k, metric, [y, *([weight] if weight else [])])
    votes = near.groupBy("query", y).agg(F.round(F.sum(_weight(alpha, 1.0, weight)), 9).alias("v"))
    best = F.min(F.struct((-F.col("v")).alias("v"), F.col(y).alias("y"))).alias("m")
    return votes.groupBy("query").agg(best).select("query", F.col("m.y").alias("prediction"))


def nearest_one(queries: DataFrame, rows: DataFrame, metric: Metric) -> DataFrame:
    """``query``, ``id``, ``distance`` of the nearest row, by a partial minimum."""
    if metric in BY_BLOCKS:
        return nearest(queries, rows, 1, metric).select("query", "id", "distance")
    near = pairs(queries, rows).select("query", F.struct(metric(F.col("x"), F.col("q")).alias("distance"), "id").alias("c"))
    return near.groupBy("query").agg(F.min("c").alias("c")).select("query", "c.id", "c.distance")


def near_pairs(queries: DataFrame, rows: DataFrame, width: float, x: Column, q: Column) -> DataFrame:
    """Rows with the queries whose number ``q`` is no more than ``width`` from their
    ``x``, by a join on cells of a part of that width: a query is dealt to its own cell and
    ``CELLS`` on each side.  Nothing is sent to all tasks, and no pair further apart than
    the width and a cell is formed.  Pairs with a null or NaN on either side are left out."""
    reach = width * (1 + 1e-9)  # so that rounding cannot part what is just in reach
    at = lambda c: F.floor(c / (reach / CELLS))
    dealt = queries.select("query", "q", q.alias("_q")).where(F.col("_q").isNotNull() & ~F.isnan("_q"))
    dealt = dealt.withColumn("_cell", F.explode(F.sequence(at(F.col("_q")) - CELLS, at(F.col("_q")) + CELLS)))
    placed = rows.withColumn("_x", x).where(F.col("_x").isNotNull() & ~F.isnan("_x")).withColumn("_cell", at(F.col("_x")))
    return placed.join(dealt, "_cell").where(F.abs(F.col("_x") - F.col("_q")) <= reach).drop("_cell", "_x", "_q")


def _smoothed(queries: DataFrame, rows: DataFrame, width: float, compact: bool) -> DataFrame:
    """Pairs that a kernel may weigh.  With ``compact`` only those that the first
    coordinate does not put out of reach, which distances with missing coordinates
    scaled up do not bring nearer; where it is missing, all pairs."""
    if not compact:
        return pairs(queries, rows)
    lost = lambda c: F.coalesce(F.isnan(F.get(c, 0)), F.lit(True))
    near = near_pairs(queries, rows, width, F.get("x", 0), F.get("q", 0)).select(*rows.columns, "query", "q")
    return near.unionByName(pairs(queries.where(lost("q")), rows)).unionByName(pairs(queries.where(~lost("q")), rows.where(lost("x"))))


def local_average(queries: DataFrame, rows: DataFrame, kernel: Callable[[Column], Column], width: float, y: str = "y", compact: bool = False) -> DataFrame:
    """Nadaraya and Watson's estimate ``query``, ``prediction``.  Coordinates that
    are missing on either side are left out and the distance scaled up for them.
    ``compact``: the kernel is zero beyond ``width``, and pairs beyond it are not
    formed; a query without any then has no row.  Rows of one ``x`` are added up first,
    and equal queries are asked once."""
    points = rows.select("x", F.col(y).alias("y"))
    asked = _different(queries)
    if kernel is kernels.gaussian and not compact:
        weighed = lambda both: _weighed(both, kernel, width).select("query", F.col("s").alias("s0"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), F.col("t").alias("t0"), F.lit(0.0).alias("t1"))
        sums = _gauss_parts(asked, points, width, _single("q", width), _single("x", width), _first, weighed)
        parts = [p.select("query", F.col("s0").alias("s"), F.col("t0").alias("t")) for p in sums]
    elif compact and kernel in kernel_sums.POLYNOMIALS:
        parts = _polynomial_parts(asked, points, kernel, width)
    else:
        parts = [_weighed(_smoothed(asked, _summed(points), width, compact), kernel, width)]
    found = reduce(DataFrame.unionByName, parts).groupBy("query").agg(_ratio("s", "t").alias("prediction"))
    return _to_each(queries, asked, found)


def _ratio(s: str, t: str) -> Column:
    return F.sum(t) / F.nullif(F.sum(s), F.lit(0.0))


def _summed(points: DataFrame) -> DataFrame:
    """Rows of one ``x`` added up, dealt out over tasks: few bytes may be many pairs."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y")).repartition(parts)


def _weighed(both: DataFrame, kernel: Callable[[Column], Column], width: float) -> DataFrame:
    """``query``, ``s``, ``t``: the kernel times ``n`` and times ``y`` of each pair."""
    d = F.zip_with("x", "q", lambda a, b: F.when(~F.isnan(a - b), (a - b) * (a - b)))
    usable = F.filter(d, lambda v: v.isNotNull())
    total = F.aggregate(usable, F.lit(0.0), lambda s, v: s + v)
    k = kernel(F.sqrt(total * F.size("x") / F.nullif(F.size(usable), F.lit(0))) / width)
    return both.select("query", k.alias("k"), "n", "y").select("query", (F.col("k") * F.col("n")).alias("s"), (F.col("k") * F.col("y")).alias("t"))


def _single(c: str, width: float) -> Column:
    """Whether an array is of one number that has a cell."""
    return F.coalesce(F.size(c) == 1, F.lit(False)) & kernel_sums.placed(F.get(c, 0), width)


def _gauss_parts(asked: DataFrame, points: DataFrame, width: float, q: Column, x: Column, number: Callable[[DataFrame, str], DataFrame], by_pairs: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Parts of the sums of ``kernel_sums.gauss_sums``; queries ``q`` and rows ``x`` that
    have cells take those, all others ``by_pairs``."""
    x = x & kernel_sums.finite(F.col("y"))
    n, odd = _parted(asked, q)
    m, others, known = points.agg(F.count_if(x), F.count_if(~x), F.count_if(x & F.col("y").isNotNull())).first()
    parts = []
    if n and m:
        queries = number(asked.where(q), "q")
        sums = kernel_sums.gauss_sums(queries, number(points.where(x), "x"), width, n)
        # a query out of reach has sums of zero
        sums = sums.unionByName(queries.select("query", *[F.lit(0.0).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")]))
        parts.append(sums if known else sums.withColumns({c: F.lit(None).cast("double") for c in ("t0", "t1")}))
    if odd:
        parts.append(by_pairs(pairs(asked.where(~q), _summed(points))))
    if others and n:
        parts.append(by_pairs(pairs(asked.where(q), _summed(points.where(~x)))))
    return parts or [by_pairs(pairs(asked, _summed(points)))]


def _parted(rows: DataFrame, inside: Column) -> tuple[int, int]:
    return tuple(rows.agg(F.count_if(inside), F.count_if(~inside)).first())


def _first(rows: DataFrame, c: str) -> DataFrame:
    return rows.withColumn(c, F.get(c, 0))


def _polynomial_parts(asked: DataFrame, points: DataFrame, kernel: Callable[[Column], Column], width: float) -> list[DataFrame]:
    """``query``, ``s``, ``t``: of single numbers by ``kernel_sums``, of others by pairs."""
    q, x = _single("q", width), _single("x", width)
    (n, odd), (m, others) = _parted(asked, q), _parted(points, x)
    parts = []
    if n and m:
        sums = _first(points.where(x), "x").groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
        whole, cut = kernel_sums.polynomial_sums(_first(asked.where(q), "q"), sums, width, kernel)
        k = kernel((F.col("x") - F.col("q")) / width)
        parts += [whole, cut.select("query", (k * F.col("n")).alias("s"), (k * F.col("y")).alias("t"))]
    if odd:
        parts.append(_weighed(_smoothed(asked.where(~q), _summed(points), width, True), kernel, width))
    if others and n:
        parts.append(_weighed(_smoothed(asked.where(q), _summed(points.where(~x)), width, True), kernel, width))
    return parts or [_weighed(_smoothed(asked, _summed(points), width, True), kernel, width)]


def _different(queries: DataFrame) -> DataFrame:
    """The different ``q``, each with one of its ``query`` for a name, as a table."""
    return staged(queries.groupBy("q").agg(F.min("query").alias("query")).select("query", "q"), "queries")


def _to_each(queries: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """``query``, ``prediction`` of all queries from those of the different ones."""
    named = asked.select(F.col("query").alias("_name"), F.col("q").alias("_q"))
    each = queries.select("query", "q").join(named, F.col("q").eqNullSafe(F.col("_q")))
    known = found.select(F.col("query").alias("_found"), "prediction")
    return each.join(known, F.col("_name").eqNullSafe(F.col("_found"))).select("query", "prediction")


def local_linear(queries: DataFrame, rows: DataFrame, kernel: Callable[[Column], Column], width: float, x: str = "x", y: str = "y", compact: bool = False) -> DataFrame:
    """Local line at each query of one coordinate: ``query``, ``prediction``.
    ``compact`` as for ``local_average``.  Rows of one ``x`` are added up first, and
    equal queries are asked once."""
    points = rows.select(F.col(x).alias("x"), F.col(y).alias("y"))
    points = points.dropna() if compact else points
    asked = _different(queries)
    z = F.col("x") - F.col("q")

    def by_pairs(both: DataFrame) -> DataFrame:
        return both.select("query", kernel(z / width).alias("k"), z.alias("z"), "y", "n").select(
            "query",
            (F.col("k") * F.col("n")).alias("s0"),
            (F.col("k") * F.col("n") * F.col("z")).alias("s1"),
            (F.col("k") * F.col("n") * F.col("z") * F.col("z")).alias("s2"),
            (F.col("k") * F.col("y")).alias("t0"),
            (F.col("k") * F.col("z") * F.col("y")).alias("t1"),
        )

    if kernel is kernels.gaussian and not compact:
        placed = lambda c: kernel_sums.placed(F.col(c), width)
        parts = _gauss_parts(asked, points, width, placed("q"), placed("x"), lambda t, c: t, by_pairs)
    elif compact:
        sums = points.groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
        parts = [by_pairs(near_pairs(asked, sums, width, F.col("x"), F.col("q")))]
    else:
        parts = [by_pairs(pairs(asked, _summed(points)))]
    s = reduce(DataFrame.unionByName, parts).groupBy("query").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")])
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / F.nullif(det, F.lit(0.0))
    return _to_each(queries, asked, s.select("query", line.alias("prediction")))


def lagrange(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lagrange's polynomial through ``nodes`` (``x``, ``y``; a bounded set in
    [-1, 1]) at ``queries`` (``query``, ``q``): ``query``, ``value``; null outside.
    ValueError if there are more than ``MOST_NODES``."""
    if nodes.count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    other = nodes.select(F.col("x").alias("x2"))
    basis = queries.crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(other)).where("x <> x2")
    term = basis.groupBy("query", "q", "x", "y").agg(F.product((F.col("q") - F.col("x2")) / (F.col("x") - F.col("x2"))).alias("l"))
    value = F.when(F.max(F.abs("q")) <= 1, F.sum(F.col("y") * F.col("l")))
    return term.groupBy("query").agg(value.alias("value"))


def kendall_distance(df: DataFrame, x: str, y: str, mode: str = "standard") -> DataFrame:
    """``kendall``: (1 - tau) / 2 for standard; the reference's 1 - 2 tau.

    tau is the mean sign over pairs.  Equal points are counted first, and sums over
    the points with a smaller ``x`` (``plans.ranks.lower_sums``) take the place
    of pairs.  Rows with a null are left out; fewer than two rows have tau 0."""
    from ..plans.ranks import lower_sums

    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    cells = staged(rows.groupBy("_x", "_y").agg(F.count("*").alias("_c")), "points")
    n = cells.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    lower = lower_sums(cells, "_x", "_y", "_c").join(cells, ["_x", "_y"])
    # smaller in both less smaller in x and greater in y; as doubles, n^2 may exceed a long
    signs = (F.col("_below") + F.col("_upto") - F.col("_all")).cast("double") * F.col("_c")
    tau = F.coalesce(F.sum(signs), F.lit(0.0)) * 2 / F.lit(max(1.0, float(n) * (n - 1)))
    return lower.agg((1 - 2 * tau if mode == "reference" else (1 - tau) / 2).alias("kendall"))


def spearman_distance(df: DataFrame, key: str, x: str, y: str, mode: str = "standard") -> DataFrame:
    """``spearman``: 1 - rho of ordinal ranks (ties by ``key``); the reference gives
    rho itself."""
    from ..plans.ranks import global_rank

    rows = df.select(key, F.col(x).alias("_a"), F.col(y).alias("_b")).dropna()
    ranked = global_rank(global_rank(rows, ["_a", key], "_ra"), ["_b", key], "_rb")
    d = (F.col("_ra") - F.col("_rb")).cast("double")
    s, n = F.sum(d * d), F.count("*").cast("double")
    rho = 1 - 6 * s / F.nullif(n * (n * n - 1), F.lit(0.0))
    return ranked.agg((rho if mode == "reference" else 1 - rho).alias("spearman"))


def distance_variance_bounds(columns: list[str], eps: float) -> Column:
    """Array of ``(1 - eps)`` and ``(1 + eps)`` times the mean squared distance of
    unordered pairs over n^2: a sum of variances, no pairs are formed."""
    v = sum((F.var_pop(c) for c in columns), F.lit(0.0))
    return F.array(F.greatest(F.lit(0.0), (1 - eps) * v), (1 + eps) * v)
