"""Compression distances of byte strings (Arrow)."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import staged
from .blocks import one_a_pair, rows_of

#: Phrases of the stated queries that one block sends to the tasks.
MOST_PHRASES = 2_000_000
#: Phrases that are counted by a matrix product, and one in how many queries has them.
COMMON, SHARE = 4096, 20
#: Pairs, and hits of other phrases, that are worked out at once.
PAIRS, HITS = 1 << 19, 1 << 21


def lz_phrases(data: bytes) -> set[bytes]:
    """Phrases of the Lempel-Ziv parse: each the shortest not met before."""
    seen: set[bytes] = set()
    start = 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def lz_jaccard(a: bytes, b: bytes) -> float:
    x, y = lz_phrases(a), lz_phrases(b)
    union = len(x | y)
    return 1 - len(x & y) / union if union else 0.0


def _compression(size: Callable[[bytes], int]) -> Callable[[bytes, bytes], float]:
    def distance(a: bytes, b: bytes) -> float:
        x, y = size(a), size(b)
        return (size(a + b) - min(x, y)) / max(x, y)

    return distance


ncd_zlib = _compression(lambda d: len(zlib.compress(d, 9)))
ncd_lzma = _compression(lambda d: len(lzma.compress(d, preset=9)))


def as_udf(distance: Callable[[bytes, bytes], float]):
    """Two binary (or string) columns to a double; null if either is."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            return distance(*(v.encode() if isinstance(v, str) else bytes(v) for v in (x, y)))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def lzjd(a, b) -> Column:
    return as_udf(lz_jaccard)(a, b)


def ncd_z(a, b) -> Column:
    return as_udf(ncd_zlib)(a, b)


def ncd_x(a, b) -> Column:
    return as_udf(ncd_lzma)(a, b)


def phrase_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``phrases`` (null of a null text), each text parsed once, in
    time that grows with its length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [None if t is None else _parse(t.encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.binary()))], ["key", "phrases"])

    kind = dict(df.dtypes)[key]
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if texts.rdd.getNumPartitions() < parts:  # a file of one row group is one task
        texts = texts.repartition(parts)
    return texts.mapInArrow(rows, f"key {kind}, phrases array<binary>")


def _parse(data: bytes) -> list[bytes]:
    """The phrases of ``lz_phrases`` by a walk down their trie."""
    trie: dict[tuple[int, int], int] = {}
    out: list[bytes] = []
    node = start = 0
    for end, byte in enumerate(data, 1):
        below = trie.get((node, byte))
        if below is None:
            out.append(data[start:end])
            trie[node, byte] = len(out)
            node, start = 0, end
        else:
            node = below
    return out


def lz_jaccard_to(df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", digits: int | None = None) -> DataFrame:
    """``key``, ``query``, ``value``: the Lempel-Ziv Jaccard distance of each row
    of ``df`` to each row of ``queries``, whole texts; rounded to ``digits``.

    Phrases are found once a text and kept as a table.  Queries go to the tasks
    in blocks of about ``MOST_PHRASES`` phrases (one longer text is a block by
    itself), numbered.  Some rows at a time count their phrases against all queries of
    a block: the phrases of many queries by a matrix product, the others by an index
    from phrase to queries.  Nothing is shuffled.  The result has rows times queries
    rows, as asked.  A null text has a null distance; empty texts are 0 apart;
    repeated rows come out as often as they occur; other columns are ignored.
    """
    rows = staged(phrase_table(df, key, text), "phrases")
    asked = staged(phrase_table(queries, key, text), "queries")
    kind = dict(df.dtypes)[key]
    total = asked.agg(F.sum(F.greatest(F.size("phrases"), F.lit(1)))).first()[0] or 0
    k = max(1, -(-total // MOST_PHRASES))
    out = None
    for i in range(k):
        block = asked.where(F.pmod(F.xxhash64("key"), F.lit(k)) == i).toArrow().combine_chunks()
        task = _against(key, block.column("key").combine_chunks(), block.column("phrases").combine_chunks(), digits)
        part = one_a_pair(rows.mapInArrow(task, f"`{key}` {kind}, query array<{kind}>, value array<double>"))
        out = part if out is None else out.unionByName(part)
    return out


def _rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    """As Spark's ``round``, which takes the shortest decimals: next to a half these tell."""
    if digits is None:
        return v
    scaled = v * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for i in np.argwhere(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[*i] = float(Decimal(repr(float(v[*i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class _Index:
    """Numbered phrases of a block of queries: a matrix of the common ones, and for each
    of the others its queries."""

    def __init__(self, phrases: pa.Array) -> None:
        lengths = pc.fill_null(pc.list_value_length(phrases), 0).to_numpy(zero_copy_only=False)
        self.n = len(phrases)
        owner = np.repeat(np.arange(self.n), lengths)
        coded = phrases.flatten().dictionary_encode()
        self.known = coded.dictionary
        ids = coded.indices.to_numpy(zero_copy_only=False)
        spread = np.bincount(ids, minlength=len(self.known))
        common = np.flatnonzero(spread * SHARE >= self.n)
        common = common[np.argsort(-spread[common], kind="stable")[:COMMON]]
        self.slot = np.full(len(self.known), -1)
        self.slot[common] = np.arange(len(common))
        often = self.slot[ids] >= 0
        self.matrix = np.zeros((len(common), self.n), np.float32)
        self.matrix[self.slot[ids[often]], owner[often]] = 1
        ids, owner = ids[~often], owner[~often]
        self.owner = owner[np.argsort(ids, kind="stable")]
        self.count = np.bincount(ids, minlength=len(self.known))
        self.start = np.cumsum(self.count) - self.count

    def shared(self, ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """Phrases that ``m`` rows and the queries have in common; the row ``at[i]`` has
        the phrase ``ids[i]``."""
        slot = self.slot[ids]
        mine = np.zeros((m, len(self.matrix)), np.float32)
        mine[at[slot >= 0], slot[slot >= 0]] = 1
        out = (mine @ self.matrix).astype(float)
        ids, at = ids[slot < 0], at[slot < 0]
        upto = np.concatenate([[0], np.cumsum(self.count[ids])])
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + HITS, "right")) - 1)
            c = self.count[ids[low:high]]
            hits = np.repeat(self.start[ids[low:high]] - (upto[low:high] - upto[low]), c) + np.arange(upto[high] - upto[low])
            out += np.bincount(np.repeat(at[low:high] * self.n, c) + self.owner[hits], minlength=m * self.n).reshape(m, self.n)
            low = high
        return out


def _against(key: str, names: pa.Array, phrases: pa.Array, digits: int | None):
    """The task that holds rows against one block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(phrases)
        sizes = pc.fill_null(pc.list_value_length(phrases), -1).to_numpy(zero_copy_only=False).astype(float)
        n = len(names)
        step = max(1, PAIRS // max(1, n))
        asks = names.take(pa.array(np.tile(np.arange(n), step)))
        ends = np.arange(step + 1, dtype=np.int32) * n
        for batch in batches if n else ():
            numbers = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=index.known), -1).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lengths = pc.list_value_length(part.column(1))
                mine = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
                ids = numbers[upto[low] : upto[low + len(mine)]]
                at = np.repeat(np.arange(len(mine)), mine)
                both = index.shared(ids[ids >= 0], at[ids >= 0], len(mine))
                union = mine[:, None] + sizes - both
                value = _rounded(np.where(union > 0, 1 - both / np.maximum(union, 1), 0.0), digits)
                missing = (sizes < 0) | np.asarray(lengths.is_null())[:, None]
                yield rows_of(part.column(0), asks, value.ravel(), missing.ravel() if missing.any() else None, ends, [key, "query", "value"])

    return run
