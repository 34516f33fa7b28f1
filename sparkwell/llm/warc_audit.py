"""Fixity audit of WARC replicas by Merkle trees.

Each replica is hashed where it lies and gets a tree of its own, from its own
records, order and offsets; nothing of one replica enters the tree of another.
Leaves are records.  A node stands for a range of ids and hashes, in archive
order, its children's hashes with the ranges of offsets that they span,
relative to its own beginning.  So what is lost in one branch does not change
the hashes of the others.  Two trees are compared from their roots down; a
branch whose hashes agree is not looked into, so the work below the roots
follows the damage, not the archive.  Offsets are added up on the way down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import dropped, staged

#: Children of a node, as a power of two, and bits of a digest that order the
#: records of one id.
FAN_BITS, PREFIX_BITS = 6, 60
#: Mismatching nodes up to which their numbers go into the filter of the scan.
MOST_LISTED = 100


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """Bytes of a WARC 1.1 response record; null payloads count as empty."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def leaves(*replicas: DataFrame) -> DataFrame:
    """The leaves of the trees of all replicas, in ranges of ids: ``side`` (the
    replica's number), ``id``, ``p`` (the digest's first bits), ``digest``
    (SHA-256, hex), ``size`` (of one record), ``n`` (equal records), ``bytes``,
    ``begin``, ``gap`` (bytes of others between them) and ``sum``, what the
    parent hashes.

    Equal records under one id are counted before anything moves.  ``begin`` is
    null if there is no ``offset`` column.
    """

    def hashed(side: int, records: DataFrame) -> DataFrame:
        offset = F.col("offset").cast("long") if "offset" in records.columns else F.lit(None).cast("long")
        return records.select(
            F.lit(side).alias("side"),
            F.col("record_id").cast("long").alias("id"),
            F.coalesce(F.sha2("record", 256), F.lit("none")).alias("digest"),
            F.coalesce(F.length("record"), F.lit(0)).cast("long").alias("size"),
            offset.alias("o"),
        )

    every = reduce(DataFrame.unionAll, [hashed(i, r) for i, r in enumerate(replicas)])
    rows = every.groupBy("side", "id", "digest", "size").agg(F.count("*").alias("n"), F.min("o").alias("begin"), F.max("o").alias("last"))
    rows = rows.select(
        "side",
        "id",
        F.coalesce(F.conv(F.substring("digest", 1, PREFIX_BITS // 4), 16, 10).cast("long"), F.lit(0)).alias("p"),
        "digest",
        "size",
        "n",
        (F.col("n") * F.col("size")).alias("bytes"),
        "begin",
        (F.col("last") + F.col("size") - F.col("begin") - F.col("n") * F.col("size")).alias("gap"),
    )
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("sum", _sum()).repartitionByRange(parts, "id", "p").sortWithinPartitions("id", "p")
    return staged(ordered, "leaves")


def _sum() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "p", "n", "bytes", "gap", "digest")


#: A level: shifts of ``id`` and ``p`` that give a node's key; None gives one node.
Level = tuple[int | None, int]


def levels(rows: DataFrame) -> list[Level]:
    """Levels above the leaves that all trees share.  First the records of one id
    are gathered by their digests, if ids repeat; then ids by ranges of
    ``2**FAN_BITS``, up to one root."""
    of_id = rows.groupBy("side", "id").count()
    most, low, high = (x or 0 for x in of_id.agg(F.max("count"), F.min("id"), F.max("id")).first())
    found: list[Level] = []
    same = 0
    while 1 << FAN_BITS * same < most:
        same += 1
    found += [(0, PREFIX_BITS - FAN_BITS * (same - j)) for j in range(1, same + 1)]
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << FAN_BITS:
        shift += FAN_BITS
        found.append((shift, PREFIX_BITS))
    return [*found, (None, PREFIX_BITS)]


def _key(level: Level) -> list[Column]:
    of_id, of_p = level
    up = F.lit(None).cast("long") if of_id is None else F.shiftright("id", of_id)
    return [up.alias("up"), F.shiftright("p", of_p).alias("up_p")]


def tree(rows: DataFrame, shape: list[Level]) -> list[DataFrame]:
    """Levels of the trees over ``leaves``, leaves first; each node of the others
    has ``side``, ``id``, ``p`` (its least), ``up``, ``up_p`` (its own key at that
    level), ``n``, ``bytes``, ``begin``, ``gap`` and ``sum``.  A node gathers
    ``2**FAN_BITS`` children or, where digests order them, about that many."""
    out = [rows]
    for level in shape:
        up, up_p = _key(level)
        child = F.struct("begin", "id", "p", "sum")
        below = out[-1].select("side", "id", "p", "n", "bytes", "begin", "gap", "sum", up, up_p)
        node = below.groupBy("side", "up", "up_p").agg(
            F.min("id").alias("id"),
            F.min("p").alias("p"),
            F.sum("n").alias("n"),
            F.sum("bytes").alias("bytes"),
            F.min("begin").alias("begin"),
            (F.max(F.col("begin") + F.col("bytes") + F.col("gap")) - F.min("begin") - F.sum("bytes")).alias("gap"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["sum"]), "\n"), 256).alias("digest"),
        )
        of_node = F.concat_ws(":", F.coalesce(F.col("up").cast("string"), F.lit("null")), "up_p", "n", "bytes", "gap", "digest")
        out.append(staged(node.withColumn("sum", of_node), "merkle"))
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[f"{k}_"]) for k in keys])


def below(nodes: DataFrame, level: Level, wrong: DataFrame) -> DataFrame:
    """Rows of ``nodes`` whose parent at ``level`` is among ``wrong`` (``up``,
    ``up_p``, ``base``), with the parent's key as ``of`` and ``of_p`` and its
    ``base``.  If there are few parents the scan itself is told which ids to
    read; ranges of ids lie together in the leaves."""
    up, up_p = _key(level)
    if level[0] is not None:
        listed = wrong.select("up").distinct().limit(MOST_LISTED + 1).collect()
        if len(listed) <= MOST_LISTED:
            ids = sorted(r[0] for r in listed if r[0] is not None)
            runs: list[list[int]] = []
            for x in ids:
                if runs and runs[-1][1] + 1 == x:
                    runs[-1][1] = x
                else:
                    runs.append([x, x])
            shift = level[0]
            known = [F.col("id").between(a << shift, (b << shift) + (1 << shift) - 1) for a, b in runs]
            if len(ids) < len(listed):
                known.append(F.col("id").isNull())
            nodes = nodes.where(reduce(Column.__or__, known, F.lit(False)))
    own = [c for c in nodes.columns if c not in ("up", "up_p")]
    mine = [F.col(c).alias(f"own_{c}") for c in ("up", "up_p") if c in nodes.columns]
    rows = nodes.select(*own, *mine, up.alias("of"), up_p.alias("of_p"))
    parents = wrong.select(F.col("up").alias("of_"), F.col("up_p").alias("of_p_"), "base")
    return rows.join(parents, _same(rows, parents, ["of", "of_p"])).drop("of_", "of_p_")


def _placed(rows: DataFrame) -> DataFrame:
    """With ``at``: the offset given, or the parent's and what its earlier children hold."""
    earlier = Window.partitionBy("side", "of", "of_p").orderBy("id", "p").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce("begin", F.col("base") + F.coalesce(F.sum("bytes").over(earlier), F.lit(0))))


def mismatches(nodes: list[DataFrame], shape: list[Level]) -> DataFrame:
    """Leaves under the nodes whose hashes differ between sides 0 and 1, from the
    roots down."""

    def sides(rows: DataFrame) -> list[DataFrame]:
        other = rows.select("side", *(F.col(c).alias(f"{c}_") for c in ("up", "up_p", "sum")))
        return [rows.where("side = 0"), other.where("side = 1").drop("side")]

    mine, other = sides(nodes[-1].select("side", "up", "up_p", "sum"))
    differs = ~F.col("sum").eqNullSafe(F.col("sum_"))
    root = [F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("up_p"), F.lit(0).cast("long").alias("base")]
    wrong = staged(mine.join(other, F.lit(True), "full").where(differs).select(*root), "mismatch")
    for depth in range(len(shape) - 1, 0, -1):
        children = _placed(below(nodes[depth], shape[depth], wrong))
        mine, other = sides(children.select("side", F.col("own_up").alias("up"), F.col("own_up_p").alias("up_p"), "sum", "at"))
        both = mine.join(other, _same(mine, other, ["up", "up_p"]), "full")
        gone = F.col("sum").isNull()
        found = both.where(differs).select(
            F.when(gone, F.col("up_")).otherwise(F.col("up")).alias("up"),
            F.when(gone, F.col("up_p_")).otherwise(F.col("up_p")).alias("up_p"),
            F.col("at").alias("base"),
        )
        wrong = staged(found, "mismatch")
    return below(nodes[0], shape[0], wrong)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``record_id``, ``offset``, ``length``, ``fault``, ``digest``,
    ``replica_digest``, ``copies`` of every record in which ``replica`` differs.

    Both hold ``record_id`` (long), ``record`` (bytes) and, where they know it,
    ``offset``, the record's place; without it the archive is in ascending order
    of ``record_id``, null first, then of the digest.  ``offset`` and ``length``
    returned are those of ``primary``.  ``fault``: ``changed``, ``missing`` (not
    in the replica), ``extra`` (only there; offset, length and digest are null)
    or ``moved`` (the same bytes, but not after the same record of its range, or
    at another place and not where that one ends).

    Records that repeat a ``record_id``, or have none, are audited like others:
    equal ones are counted, and ``copies`` says how many are concerned.  If just
    one record of an id has no equal on either side it is ``changed``; else
    those of ``primary`` are missing and those of the replica extra.  A null
    record is told apart from an empty one.  Two empty archives agree.  Other
    columns are ignored.
    """
    rows = leaves(primary, replica)
    shape = levels(rows)
    nodes = tree(rows, shape)
    by = Window.partitionBy("side", "of", "of_p").orderBy("begin", "id", "p")
    end = F.lag(F.col("begin") + F.col("bytes") + F.col("gap")).over(by)
    found = _placed(mismatches(nodes, shape)).withColumn("hole", F.col("begin") - end)
    names = ["of", "of_p", "id", "digest", "size", "n", "at", "gap", "begin", "hole"]
    mine = found.where("side = 0").select(*names)
    other = found.where("side = 1").select(*(F.col(c).alias(f"{c}_") for c in names))
    both = mine.join(other, _same(mine, other, ["id", "digest", "size"]), "full")
    lost = F.coalesce("n", F.lit(0)) - F.coalesce("n_", F.lit(0))
    both = staged(both.withColumn("lost", lost).withColumn("key", F.when(F.col("n").isNull(), F.col("id_")).otherwise(F.col("id"))), "compared")
    dropped(*nodes)

    kept = both.where("lost = 0")
    follows = [F.lag(F.struct("id", "digest")).over(Window.partitionBy("of", "of_p").orderBy(c, "id", "digest")) for c in ("begin", "begin_")]
    kept = kept.withColumn("after", follows[0]).withColumn("after_", follows[1])
    # a hole that a lost neighbour leaves is no move, nor a shift with the neighbours
    shifted = (F.col("begin") != F.col("begin_")) & ~F.col("hole").eqNullSafe(F.col("hole_"))
    moved = ~F.col("after").eqNullSafe(F.col("after_")) | ~F.col("gap").eqNullSafe(F.col("gap_")) | shifted
    knows = F.col("begin").isNotNull() & F.col("begin_").isNotNull()
    elsewhere = kept.where(knows & moved)

    differ = both.where("lost <> 0")
    sums = differ.groupBy(F.col("key").alias("key_")).agg(
        F.sum(F.greatest("lost", F.lit(0))).alias("a"), F.sum(F.greatest(-F.col("lost"), F.lit(0))).alias("b"), F.max(F.when(F.col("lost") < 0, F.col("digest_"))).alias("instead")
    )
    told = differ.join(sums, F.col("key").eqNullSafe(F.col("key_")))
    one = (F.col("a") == 1) & (F.col("b") == 1)
    record = ["key", "at", "size"]
    missing = told.where("lost > 0").select(
        *record,
        F.when(one, "changed").otherwise("missing").alias("fault"),
        "digest",
        F.when(one, F.col("instead")).alias("replica_digest"),
        F.col("lost").alias("copies"),
    )
    none, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    extra = told.where((F.col("lost") < 0) & ~one).select(
        "key", none.alias("at"), none.alias("size"), F.lit("extra").alias("fault"), no_text.alias("digest"), F.col("digest_").alias("replica_digest"), (-F.col("lost")).alias("copies")
    )
    place = elsewhere.select(*record, F.lit("moved").alias("fault"), "digest", F.col("digest_").alias("replica_digest"), F.col("n").alias("copies"))
    return missing.unionByName(extra).unionByName(place).toDF("record_id", "offset", "length", "fault", "digest", "replica_digest", "copies")
