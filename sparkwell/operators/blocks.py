"""Blocks of vectors against blocks of queries.

Rows are dealt out evenly and packed, some hundred to a block; so are the queries.  Each
pair of blocks is one row of a join, of which a task works out all distances by NumPy,
a few rows at a time.  Memory is bounded by the blocks, not by the tables, and no vector
is copied once a pair.  Only whole vectors of one length are packed; ``split`` parts
them from the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..functions.block_distances import BlockMetric, Quick

#: Numbers in a block, and rows of one that meet a block of queries at a time.
BLOCK, TILE = 1 << 15, 64
#: Rows of a task.
MOST_PARTS = 2000


def _whole(c: str) -> Column:
    big = F.lit(float("inf"))
    return F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)), F.lit(False))


@dataclass(frozen=True)
class Split:
    """Vectors of the commonest length ``d`` without nulls, NaN or infinities, ``n`` of
    them, and the ``others``, None if there are none."""

    d: int
    n: int
    whole: DataFrame
    others: DataFrame | None


def split(rows: DataFrame, x: str, d: int | None = None) -> Split:
    kind = F.when(_whole(x), F.size(x)).otherwise(F.lit(-1))
    counts = {k: n for k, n in rows.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(3).collect()}
    if d is None:
        d = next((k for k in counts if k > 0), 0)
    inside = kind == d
    whole, odd = rows.where(inside), rows.where(~inside)
    n = counts[d] if d in counts else whole.count()
    return Split(d, n, whole, None if set(counts) <= {d} else odd)


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches of ``size``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - sum(b.num_rows for b in held))
            batch = batch.slice(part.num_rows)
            held.append(part)
            if sum(b.num_rows for b in held) == size:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def packed(rows: DataFrame, x: str, keep: list[str], n: int, size: int, names: list[str]) -> DataFrame:
    """Blocks of up to ``size`` rows: for ``keep`` arrays, for ``x`` the bytes of its
    numbers; called ``names``, ``x`` last."""
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([*(StructField(o, ArrayType(fields[c])) for c, o in zip(keep, names, strict=False)), StructField(names[-1], BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, size):
            ends = pa.array([0, batch.num_rows], pa.int32())
            cols = [pa.ListArray.from_arrays(ends, batch.column(i)) for i in range(len(keep))]
            numbers = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
            yield pa.record_batch([*cols, pa.array([np.ascontiguousarray(numbers, float).tobytes()], pa.binary())], names)

    parts = min(MOST_PARTS, max(1, -(-n // size)))
    return rows.select(*keep, F.col(x).cast("array<double>").alias(x)).repartition(parts).mapInArrow(pack, schema)


def _matrix(column: pa.Array, i: int, d: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), float).reshape(-1, d)


def _list(column: pa.Array, i: int) -> pa.Array:
    return column.slice(i, 1).flatten()


def half_up(v: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded, halves away from zero, and no minus zero; huge numbers have no such digits."""
    if digits is None:
        return v
    scaled = v * 10.0**digits
    rounded = np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**digits
    huge = not (scaled.size == 0 or max(scaled.max(), -scaled.min()) < 2.0**52)  # or NaN
    return (np.where(np.abs(scaled) < 2.0**52, rounded, v) if huge else rounded) + 0.0


def rounded_values(metric: BlockMetric, x: np.ndarray, q: np.ndarray, digits: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Values of all pairs, rounded, and a mask of the nulls if there may be any.

    A ``Quick`` metric takes its quick way; the pairs whose rounding its bound leaves open
    are worked out again, so that the result is that of the metric itself."""
    if digits is None or not isinstance(metric, Quick):
        got = metric(x, q)
        value, lost = got if isinstance(got, tuple) else (got, None)
        return half_up(value, digits), lost if lost is None else np.broadcast_to(lost, value.shape)
    value, far = metric.near(x, q)
    with np.errstate(all="ignore"):
        scaled = np.multiply(value, 10.0**digits, out=value)
        out = np.rint(scaled)
        part = np.subtract(scaled, out, out=scaled)
        open_ = ~(np.abs(part, out=part) < 0.5 - far * 10.0**digits)  # halves and NaN too
        out /= 10.0**digits
        out += 0.0
    r, c = np.nonzero(open_)
    if 16 * len(r) > out.size:
        return half_up(metric(x, q), digits), None
    for i in np.unique(r):
        at = c[r == i]
        out[i, at] = half_up(metric(x[i : i + 1], q[at]), digits)[0]
    return out, None


def block_size(d: int, most: int = BLOCK) -> int:
    return max(16, most // max(1, d))


def listed(schema: StructType) -> StructType:
    """``key``, ``query``, ``value`` with the latter two as arrays."""
    return StructType([schema[0], *(StructField(f.name, ArrayType(f.dataType)) for f in schema[1:])])


def rows_of(ids: pa.Array, asks: pa.Array, value: np.ndarray, lost: np.ndarray | None, ends: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each of ``ids`` with its queries and values as arrays, which ``ends`` part."""
    offsets = pa.array(ends[: len(ids) + 1], pa.int32())
    values = pa.array(value, pa.float64(), mask=lost)
    return pa.record_batch([ids, pa.ListArray.from_arrays(offsets, asks.slice(0, len(value))), pa.ListArray.from_arrays(offsets, values)], names)


def one_a_pair(rows: DataFrame) -> DataFrame:
    """A row for each query and value of the arrays: made in the JVM, where a row costs
    less than one that Python hands over."""
    key, query, value = rows.columns
    each = rows.select(key, F.col(query).alias("_asked"), F.posexplode(value).alias("_at", value))
    return each.select(key, F.get("_asked", F.col("_at")).alias(query), value)


def pair_values(queries: DataFrame, rows: DataFrame, key: str, d: int, n: int, n_queries: int, metric: BlockMetric, digits: int | None) -> DataFrame:
    """``key``, ``query``, ``value`` of each whole row (``key``, ``x``) and query
    (``query``, ``q``)."""
    size = block_size(d)
    blocks = packed(rows, "x", [key], n, size, ["ids", "x"])
    asked = packed(queries, "q", ["query"], n_queries, size, ["queries", "q"])
    kinds = {f.name: f.dataType for f in [*rows.schema.fields, *queries.schema.fields]}
    schema = StructType([StructField(key, kinds[key]), StructField("query", kinds["query"])]).add("value", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = _list(batch.column(0), i), _matrix(batch.column(1), i, d)
                qs, q = _list(batch.column(2), i), _matrix(batch.column(3), i, d)
                ends = np.arange(min(TILE, len(x)) + 1, dtype=np.int32) * len(q)
                asks = qs.take(pa.array(np.tile(np.arange(len(q)), min(TILE, len(x)))))
                for at in range(0, len(x), TILE):
                    part = x[at : at + TILE]
                    value, lost = rounded_values(metric, part, q, digits)
                    yield rows_of(ids.slice(at, len(part)), asks, value.ravel(), None if lost is None else lost.ravel(), ends, [key, "query", "value"])

    # blocks of the stated queries are sent, as the queries themselves are by neighbors.pairs
    return one_a_pair(blocks.crossJoin(F.broadcast(asked)).mapInArrow(work, listed(schema)))


def _least(value: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` least of each column; equal ones go by ``ids``, and
    NaN is none."""
    most = np.partition(value, k - 1, axis=0)[k - 1] if k <= len(value) else np.full(value.shape[1], np.inf)
    r, c = np.nonzero(~(value > most) & ~np.isnan(value))
    first = _first(value[r, c], r, c, ids, k)
    return r[first], c[first]


def _first(value: np.ndarray, r: np.ndarray, c: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Which of the values at rows ``r`` and columns ``c`` are the ``k`` least of their
    column; equal ones go by ``ids``."""
    order = pc.sort_indices(pa.table([ids], ["v"]), sort_keys=[("v", "ascending")], null_placement="at_start").to_numpy()
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    by = np.lexsort((rank[r], value, c))
    c = c[by]
    return by[np.arange(len(c)) - np.searchsorted(c, c) < k]


def _nearest(metric: BlockMetric, x: np.ndarray, q: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the ``k`` nearest rows to each query.

    A ``Quick`` metric orders by its quick way; the rows that its bound lets be among
    the nearest are worked out by the metric itself."""
    if isinstance(metric, Quick) and metric.order is not None and k <= len(x):
        value, far = metric.order(x, q)
        most = np.partition(value, k - 1, axis=1)[:, k - 1]
        c, r = np.nonzero(~(value > (most + 2 * far)[:, None]))  # NaN may be any
        if 32 * len(r) <= value.size:
            value = metric.pairs(x[r], q[c])
            first = _first(value, r, c, ids, k)
            return r[first], c[first], value[first]
    value = np.empty((len(x), len(q)))
    for at in range(0, len(x), TILE):
        got = metric(x[at : at + TILE], q)
        # a null distance is none
        value[at : at + TILE] = np.where(got[1], np.nan, got[0]) if isinstance(got, tuple) else got
    r, c = _least(value, ids, k)
    return r, c, value[r, c]


def nearest_candidates(queries: DataFrame, rows: DataFrame, d: int, n: int, n_queries: int, k: int, metric: BlockMetric, keep: list[str]) -> DataFrame:
    """``query``, ``id``, ``distance`` and ``keep`` of the ``k`` nearest whole rows of each
    block to each query; equal distances go by ``id``."""
    size = min(block_size(d, 8 * BLOCK), max(block_size(d), n // 64))
    blocks = packed(rows, "x", ["id", *keep], n, size, ["ids", *(f"_k{i}" for i in range(len(keep))), "x"])
    asked = packed(queries, "q", ["query"], n_queries, block_size(d), ["queries", "q"])
    kinds = {f.name: f.dataType for f in [*rows.schema.fields, *queries.schema.fields]}
    schema = StructType([StructField("query", kinds["query"]), StructField("id", kinds["id"])]).add("distance", "double")
    for c in keep:
        schema = schema.add(c, kinds[c])
    names = schema.names
    m = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, kept = _list(batch.column(0), i), [_list(batch.column(1 + j), i) for j in range(m)]
                x = _matrix(batch.column(1 + m), i, d)
                qs, q = _list(batch.column(2 + m), i), _matrix(batch.column(3 + m), i, d)
                r, c, value = _nearest(metric, x, q, ids, k)
                yield pa.record_batch([qs.take(pa.array(c)), ids.take(pa.array(r)), pa.array(value), *(v.take(pa.array(r)) for v in kept)], names)

    return blocks.crossJoin(F.broadcast(asked)).mapInArrow(work, schema)


def leaf_pieces(rows: DataFrame, sizes: DataFrame, children: DataFrame, size: int) -> DataFrame:
    """Rows of a metric tree (``parent``, ``node``, ``id``, ``x``) in pieces of about
    ``size`` of one parent (``sizes``: ``parent``, ``n``), by leaf; each with its parent's
    ``children``."""
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("parent", LongType()), StructField("ids", ArrayType(kind)), StructField("leaves", ArrayType(LongType())), StructField("x", BinaryType())])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("node").combine_chunks()
        one = lambda c: pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type))
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table([pa.array([t.column("parent")[0].as_py()], pa.int64()), one("id"), one("node"), pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary())], schema.names)

    piece = F.pmod(F.xxhash64("id", "x"), F.ceil(F.col("n") / size))
    dealt = rows.join(sizes, "parent").select("parent", piece.alias("piece"), "node", "id", "x")
    return dealt.groupBy("parent", "piece").applyInArrow(pack, schema).join(children, "parent")


def leaf_candidates(pieces: DataFrame, queries: DataFrame, d: int, parts: int, n_queries: int, k: int | None, metric: BlockMetric, slack: float) -> DataFrame:
    """``query``, ``id``, ``distance`` of the ``k`` nearest rows of each piece to each
    of ``queries`` (``query``, ``q``, ``most``, ``leaves``), none further than ``most``.

    A query enters its ``leaves``; without them, all whose balls may hold a row within
    ``most``.  Without ``k`` only the distances are counted: ``rows`` and ``balls``."""
    asked = packed(queries, "q", ["query", "most", "leaves"], n_queries, block_size(d), ["queries", "most", "chosen", "q"])
    kinds = {"query": queries.schema["query"].dataType, "id": pieces.schema["ids"].dataType.elementType}
    schema = StructType([StructField("query", kinds["query"]), StructField("id", kinds["id"])]).add("distance", "double")
    if k is None:
        schema = StructType().add("rows", "long").add("balls", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = _list(batch.column(0), i), _matrix(batch.column(2), i, d)
                leaves, first = np.unique(_list(batch.column(1), i).to_numpy(), return_index=True)
                ends = [*first[1:], len(x)]
                balls = _list(batch.column(3), i)
                at = {int(n): j for j, n in enumerate(balls.field("node").to_numpy())}
                centres = balls.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                radius = balls.field("radius").to_numpy(zero_copy_only=False)
                qs, q = _list(batch.column(4), i), _matrix(batch.column(7), i, d)
                most = _list(batch.column(5), i).to_numpy(zero_copy_only=False)
                chosen = _list(batch.column(6), i)
                asks = np.repeat(np.arange(len(q)), np.asarray(pc.fill_null(pc.list_value_length(chosen), 0)))
                held, free = chosen.flatten().to_numpy(zero_copy_only=False), np.asarray(chosen.is_null())
                value = np.full((len(x), len(q)), np.nan) if k is not None else None
                computed = tried = 0
                for leaf, low, high in zip(leaves, first, ends, strict=True):
                    enter = np.zeros(len(q), bool)
                    enter[asks[held == leaf]] = True
                    if free.any():
                        j = at[int(leaf)]
                        away = metric(centres[j : j + 1], q)[0]
                        tried += int(free.sum())
                        enter |= free & (away - radius[j] <= most + slack * (away + radius[j]))
                    inside = np.flatnonzero(enter)
                    computed += len(inside) * (high - low)
                    if value is not None and len(inside):
                        for a in range(low, high, TILE):
                            b = min(a + TILE, high)
                            value[a:b, inside] = metric(x[a:b], q[inside])
                if value is None:
                    yield pa.record_batch([pa.array([computed], pa.int64()), pa.array([tried], pa.int64())], ["rows", "balls"])
                    continue
                value[value > most * (1 + slack)] = np.nan
                r, c = _least(value, ids, k)
                yield pa.record_batch([qs.take(pa.array(c)), ids.take(pa.array(r)), pa.array(value[r, c])], ["query", "id", "distance"])

    held = pieces.select("ids", F.col("leaves").alias("nodes"), "x", "children").repartition(parts)
    return held.crossJoin(F.broadcast(asked)).mapInArrow(work, schema)
