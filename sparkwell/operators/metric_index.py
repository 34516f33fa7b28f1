"""Nearest neighbours by a metric tree that is kept as tables.

Rows fall level by level to the nearest of their node's pivots, by one join on the node;
each node keeps its centre and the distance of its farthest row.  Queries go down by
joins on the node as well, and leave out balls that cannot hold a neighbour: all of them
by the triangle inequality (exact), or all but the nearest few (approximate).  No pairs
are formed beyond the balls that a query enters.

Under a distance that ``blocks`` knows, the rows of a last parent are kept as pieces, which
blocks of queries meet in the tasks that hold them: the balls are tried and the distances
worked out there by NumPy, and only what is near enough leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import staged
from . import blocks
from .neighbors import BY_BLOCKS, _even

Metric = Callable[[Column, Column], Column]
#: Share of a distance by which a bound gives way, for rounding.
SLACK = 1e-9
#: Rows of a piece.
PIECE = 2048


@dataclass(frozen=True)
class MetricIndex:
    """``rows``: ``id``, ``x``, ``node`` (leaf), ``away`` (from its centre).  ``nodes``:
    ``parent`` and its ``children`` (``node``, ``x``, ``radius``, ``n``) for each level.
    Of equal vectors the ``most`` with the least ids are kept, which is all that ``most``
    or fewer neighbours can need.  ``pieces``: the rows by last parent, for vectors of one
    length ``d`` without infinities."""

    rows: DataFrame
    nodes: list[DataFrame]
    most: int
    pieces: DataFrame | None = None
    d: int = 0
    parts: int = 1

    @property
    def levels(self) -> int:
        return len(self.nodes)


def _usable(c: str) -> Column:
    return F.col(c).isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))


def build_index(rows: DataFrame, metric: Metric, branch: int = 16, leaf: int = 256, most: int = 64) -> MetricIndex:
    """Index ``rows`` (``id``, ``x``) under ``metric``.

    Nodes have up to ``branch`` children, whose pivots are those of the node's different
    vectors with the least hash of their id; there are so many levels that leaves hold
    about ``leaf`` rows.  Vectors that are null or hold a null or NaN are left out.
    A level costs one pass over the rows, with one shuffle by node once the nodes are
    too many to be sent.
    """
    copy = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    kept = rows.select("id", F.col("x").cast("array<double>").alias("x")).where(_usable("x")).withColumn("copy", copy).where(F.col("copy") <= most)
    at = staged(kept.select("id", "x", (F.col("copy") == 1).alias("first"), F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("away")), "index")
    levels = max(1, math.ceil(math.log(max(1.0, at.count() / leaf), branch)))
    nodes = []
    for level in range(levels):
        order = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(level), "id"), "id")
        chosen = at.where("first").select("node", "x", F.row_number().over(order).alias("i")).where(F.col("i") <= branch)
        pivots = staged(chosen.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").alias("p")))).alias("pivots")), "pivots")
        near = F.array_min(F.transform("pivots", lambda v: F.struct(metric(F.col("x"), v["p"]).alias("d"), v["i"].alias("i"))))
        fallen = at.join(pivots, "node").select("id", "x", "first", F.col("node").alias("parent"), near.alias("near"))
        child = F.col("parent") * branch + F.col("near.i") - 1
        at = staged(fallen.select("id", "x", "first", "parent", child.alias("node"), F.col("near.d").alias("away")), "index")
        balls = at.groupBy("parent", "node").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        centre = pivots.select(F.col("node").alias("parent"), F.inline("pivots")).select("parent", (F.col("parent") * branch + F.col("i") - 1).alias("node"), F.col("p").alias("x"))
        children = balls.join(centre, ["parent", "node"]).groupBy("parent").agg(F.collect_list(F.struct("node", "x", "radius", "n")).alias("children"))
        nodes.append(staged(children, "nodes"))
    rows = at.select("id", "x", "node", "away")
    big = F.lit(math.inf)
    low, high, whole = at.agg(F.min(F.size("x")), F.max(F.size("x")), F.min(F.forall("x", lambda v: F.abs(v) < big))).first()
    if metric not in BY_BLOCKS or not low or low != high or not whole:
        return MetricIndex(rows, nodes, most)
    sizes = nodes[-1].select("parent", F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("n"))
    pieces = staged(blocks.leaf_pieces(at.select("parent", "node", "id", "x"), sizes, nodes[-1], PIECE), "pieces")
    return MetricIndex(rows, nodes, most, pieces, low, min(blocks.MOST_PARTS, max(1, pieces.count())))


def _balls(at: DataFrame, children: DataFrame, metric: Metric) -> DataFrame:
    """Each query with each child of its nodes: ``d``, ``radius``, ``n``."""
    below = at.join(children.withColumnRenamed("parent", "node"), "node").select("query", "q", "most", F.explode("children").alias("c"))
    return below.select("query", "q", "most", F.col("c.node").alias("node"), metric(F.col("q"), F.col("c.x")).alias("d"), F.col("c.radius").alias("radius"), F.col("c.n").alias("n"))


def _enter(index: MetricIndex, at: DataFrame, metric: Metric, probe: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves that each query enters, and the balls whose centres it was compared with."""
    seen = []
    nearest_first = Window.partitionBy("query").orderBy("d", "node")
    for children in index.nodes:
        balls = _balls(at, children, metric)
        seen.append(balls)
        if probe is None:
            at = balls.where(F.col("d") - F.col("radius") <= F.col("most") + SLACK * (F.col("d") + F.col("radius")))
        else:
            at = balls.withColumn("_r", F.row_number().over(nearest_first)).where(F.col("_r") <= probe).drop("_r")
    return at, seen


def _leaves(index: MetricIndex, asked: DataFrame, metric: Metric, probe: int) -> tuple[DataFrame, list[DataFrame]]:
    """``asked`` with the ``probe`` nearest ``leaves`` of each query, and the balls it was
    compared with.  Vectors do not move with the balls."""
    seen, at = [], asked
    nearest_first = Window.partitionBy("query").orderBy("d", "node")
    for level, children in enumerate(index.nodes):
        balls = _balls(at, children, metric)
        seen.append(balls)
        near = balls.select("query", "node", "d").withColumn("_r", F.row_number().over(nearest_first)).where(F.col("_r") <= probe)
        if level + 1 < index.levels:
            at = near.select("query", "node").join(asked.drop("node"), "query")
    held = near.groupBy("query").agg(F.collect_list("node").alias("leaves"))
    return staged(asked.drop("node").join(held, "query").select("query", "q", "most", "leaves"), "leaves"), seen


def _by_blocks(index: MetricIndex, asked: DataFrame, k: int | None, metric: Metric) -> DataFrame:
    """What the pieces give for ``asked`` (``query``, ``q``, ``most``, ``leaves``): a block
    of queries after the other is sent to them."""
    found = [blocks.leaf_candidates(index.pieces, part, index.d, index.parts, n, k, BY_BLOCKS[metric], SLACK) for part, n in _even(asked, asked.count())]
    return reduce(DataFrame.unionByName, found)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounded_by_blocks(index: MetricIndex, at: DataFrame, k: int, metric: Metric) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """As ``_bounded`` with no ``leaves``; and the two leaves of each query and the balls it was
    compared with."""
    two, seen = _leaves(index, at, metric, 2)
    bound = _nearest(_by_blocks(index, two, k, metric), k).where(F.col("rank") == k).select("query", F.col("distance").alias("bound"))
    most = at.drop("node", "most").join(bound, "query", "left").select("query", "q", F.coalesce("bound", F.lit(math.inf)).alias("most"))
    return staged(most.withColumn("leaves", F.lit(None).cast("array<long>")), "bounds"), two, seen


def _rows(index: MetricIndex, leaves: DataFrame) -> DataFrame:
    """Rows of the leaves, less those that the distance from the centre rules out."""
    held = leaves.select("query", "q", "most", "node", "d").join(index.rows, "node")
    return held.where(F.abs(F.col("d") - F.col("away")) <= F.col("most") + SLACK * (F.col("d") + F.col("away")))


def _best(rows: DataFrame, k: int, metric: Metric) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    each = rows.select("query", "id", metric(F.col("q"), F.col("x")).alias("distance"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _start(queries: DataFrame) -> DataFrame:
    at = queries.select("query", F.col("q").cast("array<double>").alias("q")).where(_usable("q"))
    return at.select("query", "q", F.lit(math.inf).alias("most"), F.lit(0).cast("long").alias("node"))


def _bounded(index: MetricIndex, queries: DataFrame, k: int, metric: Metric) -> DataFrame:
    """Queries with ``most``, a distance that k rows do not exceed: the k-th in the two
    nearest leaves, infinite if they hold fewer."""
    at = _start(queries)
    found = _best(_rows(index, _enter(index, at, metric, 2)[0]), k, metric)
    bound = found.where(F.col("rank") == k).select("query", F.col("distance").alias("bound"))
    return staged(at.join(bound, "query", "left").select("query", "q", F.coalesce("bound", "most").alias("most"), "node"), "bounds")


def nearest_indexed(index: MetricIndex, queries: DataFrame, k: int, metric: Metric, probe: int | None = None) -> DataFrame:
    """``query``, ``id``, ``distance``, ``rank`` of the ``k`` nearest rows to each of
    ``queries`` (``query``, different; ``q``); equal distances go by ``id``.

    Exact without ``probe``, for every distance with the triangle inequality; with it,
    each level keeps a query's ``probe`` nearest balls.  Queries with a null or NaN have no
    rows.  ValueError if ``k`` exceeds what the index keeps of equal vectors.
    """
    if k > index.most:
        raise ValueError(f"the index keeps {index.most} of equal vectors")
    if index.pieces is not None:
        at = _start(queries).where(F.size("q") == index.d)
        asked = _leaves(index, at, metric, probe)[0] if probe is not None else _bounded_by_blocks(index, at, k, metric)[0]
        return _nearest(_by_blocks(index, asked, k, metric), k)
    at = _bounded(index, queries, k, metric) if probe is None else _start(queries)
    return _best(_rows(index, _enter(index, at, metric, probe)[0]), k, metric)


def search_work(index: MetricIndex, queries: DataFrame, k: int, metric: Metric, probe: int | None = None) -> DataFrame:
    """``computed``: distances that ``nearest_indexed`` works out for the queries, and
    ``share`` of all pairs of queries and indexed rows."""
    parts = []
    at = _start(queries)
    if index.pieces is not None:
        whole = at.where(F.size("q") == index.d)
        asked, two, seen = _bounded_by_blocks(index, whole, k, metric) if probe is None else (None, *_leaves(index, whole, metric, probe))
        counted = [p.agg(F.count("*").alias("n")) for p in seen]
        counted += [_by_blocks(index, a, None, metric).agg(F.coalesce(F.sum(F.col("rows") + F.col("balls")), F.lit(0)).alias("n")) for a in (two, asked) if a is not None]
        return _share(reduce(DataFrame.union, counted), index, at)
    if probe is None:
        leaves, seen = _enter(index, at, metric, 2)
        parts += [*seen, _rows(index, leaves)]
        at = _bounded(index, queries, k, metric)
    leaves, seen = _enter(index, at, metric, probe)
    parts += [*seen, _rows(index, leaves)]
    total = parts[0].agg(F.count("*").alias("n"))
    for p in parts[1:]:
        total = total.union(p.agg(F.count("*")))
    return _share(total, index, at)


def _share(total: DataFrame, index: MetricIndex, at: DataFrame) -> DataFrame:
    pairs = float(index.rows.count()) * at.count()
    return total.agg(F.sum("n").alias("computed")).withColumn("share", F.col("computed") / F.lit(max(1.0, pairs)))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``recall``: share of the (``query``, ``id``) pairs of ``truth`` in ``found``."""
    hit = truth.select("query", "id").join(found.select("query", "id", F.lit(1.0).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
