"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import narrow_batches, staged, tidy

BITS = 64
#: Shingles whose bits are counted at once; longer texts are counted in turns.
TURN = 65536


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included.

    A-Z is lower-cased; words are runs of bytes other than ASCII white space.
    A bit is set if more than half the shingles' XXH64 have it.  With fewer
    words than ``width`` the whole sequence is the only shingle; a text without
    words, or null, has fingerprint zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())),
        np.uint64,
        len(starts),
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), TURN):
        part = hashes[at : at + TURN].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hashed: bool = False) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row, and if
    ``hashed`` also ``h``, a hash of the text.  One narrow Arrow pass over two columns; no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names)

    names = ["doc_id", "fp", "h"][: 3 if hashed else 2]
    narrow_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), *[F.xxhash64(text_col).alias("h")] * hashed)
    return chosen.mapInArrow(tidy(rows), ", ".join(f"{c} long" for c in names))


def _blocks(n: int) -> list[int]:
    """Masks of ``n`` blocks that split the 64 bits as evenly as possible."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_links(prints: DataFrame, radius: int = 2, n_blocks: int = 5, pair_group: int = 64) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints within ``radius`` bits.

    ``prints``: distinct ``fp``.  Two fingerprints at that distance agree on at
    least ``n_blocks - radius`` blocks, so each one is filed once under every
    choice of that many blocks; those that share a file are compared.

    Files of up to ``pair_group`` members are joined with themselves and each
    pair's distance is verified.  Members of larger files, which only many
    fingerprints of almost the same value make, are not paired: each is filed
    under every value one bit away and under its own, and all that share a
    value are linked to the smallest of them.  Values at most two bits apart
    share one, and two that share one are at most two apart, so this gives the
    same components (``radius`` must be 2 then) with rows in proportion to the
    fingerprints.
    """
    if radius != 2 or n_blocks <= radius:
        raise ValueError("radius must be 2 and n_blocks larger")
    masks = [_signed(sum(chosen)) for chosen in combinations(_blocks(n_blocks), n_blocks - radius)]
    filed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("file", "block"),
    )
    sizes = filed.groupBy("file", "block").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(filed.join(sizes, ["file", "block"]), "blocks")

    few = shared.where(F.col("n") <= pair_group)
    a, b = few.select("file", "block", F.col("fp").alias("u")), few.select("file", "block", F.col("fp").alias("v"))
    pairs = a.join(b, ["file", "block"]).where("u > v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)

    many = shared.where(F.col("n") > pair_group).select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)]
    points = many.select("fp", F.explode(F.array(*near)).alias("point"))
    centre = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(centre, "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints within two bits are linked; ``component_id`` is the smallest
    ``doc_id`` reachable, the row's own included.  Equal fingerprints collapse
    to one value before any comparison, so a group of exact copies of any size
    costs one row.  Null and empty texts have fingerprint zero and are linked
    like any other.  Rows with a null ``doc_id`` are kept; they get their
    group's smallest id, or null if the group has none.  Repeated rows stay.
    Other columns are ignored.
    """
    groups = _grouped(docs, id_col, text_col, width, False)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, hashed: bool) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row, and if ``hashed`` also ``h``
    and ``group``, which differs between groups that share their smallest id."""
    held = staged(fingerprints(docs, id_col, text_col, width, hashed), "fingerprints")
    values = staged(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(near_links(values.select("fp")))
    members = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    named = members.join(values, "fp")
    first = named.groupBy("root").agg(F.min("least").alias("linked"))
    linked = named.join(first, "root").select("fp", "root", "linked")
    group = [F.coalesce("root", "fp").alias("group")] * hashed
    of_value = values.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"), *group)
    of_value = staged(of_value, "components")  # so that Spark can split the join at a very common value
    return held.join(of_value, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each near-duplicate group the row with the smallest ``doc_id``; of several
    texts with that id, the one with the smallest hash.  A row is its id and its
    text: other texts under the same id stay, equal rows count once.  Rows without
    an id stay."""
    groups = _grouped(docs, "doc_id", "text", 3, True).where("doc_id = component_id")
    kept = groups.groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("m")).select(F.col("m.doc_id").alias("kept_id"), F.col("m.h").alias("kept_h"))
    h = F.xxhash64("text")
    same = (F.col("doc_id") == F.col("kept_id")) & (h == F.col("kept_h"))
    rows = docs.join(kept, same, "left_semi").unionByName(docs.where("doc_id IS NULL"))
    named = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept_id"), h.alias("kept_h"))
    repeated = staged(named.count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, same, "left_semi").withColumn("_hash", h).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return rows.join(repeated, same, "left_anti").unionByName(once)
