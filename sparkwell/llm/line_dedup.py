"""Incremental line dedup: sharded cuckoo filters backed by exact reference counts.

An index keeps three tables.  ``postings`` holds each long line's key once for each
document.  ``refs`` counts the documents of each key and names the last of them.
``filters`` holds, in shards, cuckoo filters of the keys that documents must lose: a
fingerprint of 16 bits in one of two buckets of four.  A line that misses its shard's
filter stays for certain; one that hits is looked up in ``refs``.  Documents can be
inserted and deleted; both give back exactly the tables of the documents that are left,
since counts are exact and a filter gives up a fingerprint when its key's count falls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import narrow_batches, staged, tidy

#: Code points of a line that can be dropped, documents that must hold it.
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: Keys of a shard on average, slots of a bucket, moves before a filter is enlarged.
SHARD_KEYS, SLOTS, MOVES = 1024, 4, 500
#: Keys that hold this share of all postings or more are looked up by themselves;
#: there cannot be more than its inverse.
HOT_SHARE = 1 / 4096
_EDGES = " \t\n\x0b\x0c\r"
_POSTING = "key binary, doc_id long"
_REFS = "key binary, refs long, last long"
_FILTER = "shard long, buckets int, cells binary"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_EDGES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digest(key: Column) -> Column:
    """16 bytes of a key's SHA-256."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def postings(docs: DataFrame) -> DataFrame:
    """``key``, ``doc_id`` of each long line, once for each document."""
    line = F.explode(F.split("text", "\n")).alias("line")
    keys = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), line)
    keys = keys.where(F.char_length("line") >= LEAST_CHARS).select("doc_id", line_key(F.col("line")).alias("k"))
    return keys.where(F.char_length("k") >= LEAST_CHARS).select(_digest(F.col("k")).alias("key"), "doc_id").distinct()


def _word(key: Column, at: int) -> Column:
    """Four bytes of a key as a number."""
    return F.conv(F.hex(F.substring(key, at, 4)), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(_word(key, 1), F.lit(shards))


def fingerprint(key: Column) -> Column:
    """16 bits of a key, never zero."""
    return F.pmod(_word(key, 5), F.lit(65535)) + 1


def _moved(fp: Column | int, buckets: Column | int) -> Column | int:
    """Distance, by exclusive or, from one bucket of a fingerprint to the other."""
    if isinstance(fp, Column):
        return F.shiftright(fp * 1540483477, 15).bitwiseAND(buckets - 1)
    return (fp * 1540483477 >> 15) & (buckets - 1)


def in_filter(key: Column, buckets: Column, cells: Column) -> Column:
    """Whether the key's fingerprint is in one of its two buckets; false where the
    shard has no filter."""
    fp = fingerprint(key)
    first = _word(key, 9).bitwiseAND(buckets.cast("long") - 1)
    second = first.bitwiseXOR(_moved(fp, buckets.cast("long")))
    want = F.lpad(F.hex(fp), 4, "0")
    held = lambda b: F.hex(F.substring(cells, (b * 2 * SLOTS + 1).cast("int"), F.lit(2 * SLOTS)))
    any_ = F.lit(False)
    for b in (first, second):
        h = held(b)
        for i in range(SLOTS):
            any_ = any_ | (F.substring(h, 4 * i + 1, 4) == want)
    return F.coalesce(any_, F.lit(False))


class Cuckoo:
    """One shard's filter: ``cells`` of shape (buckets, SLOTS), zero where free."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.cells = np.frombuffer(cells, ">u2").reshape(buckets, SLOTS).copy() if cells else np.zeros((buckets, SLOTS), ">u2")
        self.buckets = buckets

    def insert(self, fp: int, at: int) -> bool:
        """False if no place was found after ``MOVES`` moves; the filter is then spoilt."""
        for step in range(MOVES):
            for b in (at, at ^ _moved(fp, self.buckets)):
                free = np.flatnonzero(self.cells[b] == 0)
                if len(free):
                    self.cells[b, free[0]] = fp
                    return True
            at ^= _moved(fp, self.buckets)
            slot = step % SLOTS
            fp, self.cells[at, slot] = int(self.cells[at, slot]), fp
            at ^= _moved(fp, self.buckets)
        return False

    def delete(self, fp: int, at: int) -> bool:
        """Whether a copy of the fingerprint was there to be taken out."""
        for b in (at, at ^ _moved(fp, self.buckets)):
            held = np.flatnonzero(self.cells[b] == fp)
            if len(held):
                self.cells[b, held[0]] = 0
                return True
        return False


def _places(keys: list[bytes], buckets: int) -> list[tuple[int, int]]:
    """Fingerprint and first bucket of each key, as the columns above have them."""
    return [(int.from_bytes(k[4:8], "big") % 65535 + 1, int.from_bytes(k[8:12], "big") & (buckets - 1)) for k in keys]


def _built(keys: list[bytes], buckets: int = 1) -> Cuckoo:
    """A filter of ``keys``, enlarged until all have a place."""
    while buckets * SLOTS * 0.9 < len(keys):
        buckets *= 2
    while True:
        made = Cuckoo(buckets)
        if all(made.insert(fp, at) for fp, at in _places(sorted(keys), buckets)):
            return made
        buckets *= 2


def _filters(dropped: DataFrame, shards: int) -> DataFrame:
    """Filters of the keys in ``dropped``, one row a shard."""

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        made = _built([bytes(k) for k in p["key"]])
        return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "cells": [made.cells.tobytes()]})

    return dropped.select("key", shard_of(F.col("key"), shards).alias("shard")).groupBy("shard").applyInPandas(build, _FILTER)


def _changed(filters: DataFrame, changes: DataFrame, live: DataFrame, shards: int) -> DataFrame:
    """``filters`` after ``changes`` (``key``, ``on``: true to insert, false to delete).
    A shard that overflows, and one that has lost its filter, is built again from
    its keys in ``live``, the exact table."""
    on = lambda df: df.withColumn("shard", shard_of(F.col("key"), shards))

    def change(key: tuple, old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        if len(old):
            made = Cuckoo(int(old["buckets"][0]), bytes(old["cells"][0]))
            places = _places([bytes(k) for k in moves["key"]], made.buckets)
            # what goes makes room first
            done = all(made.delete(*p) for p, add in zip(places, moves["on"], strict=True) if not add)
            done = done and all(made.insert(*p) for p, add in zip(places, moves["on"], strict=True) if add)
            full = np.count_nonzero(made.cells) > 0.9 * made.cells.size
        else:
            made, done, full = Cuckoo(1), not len(moves), False
        ok = done and not full
        return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "cells": [made.cells.tobytes() if ok else None]})

    tried = staged(filters.groupBy("shard").cogroup(on(changes).groupBy("shard")).applyInPandas(change, _FILTER), "filters-tried")
    again = on(live).join(tried.where("cells IS NULL").select("shard"), "shard", "left_semi")
    return tried.where("cells IS NOT NULL").union(_filters(again, shards))


@dataclass(frozen=True)
class LineIndex:
    """The tables of an index; each change gives a new one, and old ones stay valid.

    A change reads postings by document and key and writes the tables whole; filters
    are changed in place, shard by shard, and only shards that overflow are rebuilt.
    """

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def empty(spark: SparkSession) -> LineIndex:
        made = [spark.createDataFrame([], s) for s in (_POSTING, _REFS, _FILTER)]
        return LineIndex(*made, 0)

    def dropped(self) -> DataFrame:
        """Reference counts of the keys that all documents but the last lose."""
        return self.refs.where(F.col("refs") >= LEAST_DOCUMENTS)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the lines of ``docs``; what is in the index already changes nothing."""
        new = postings(docs)
        if not self.shards:
            return self._from(staged(new, "postings"))
        new = staged(new.join(self.postings, ["key", "doc_id"], "left_anti"), "postings")
        both = self.postings.union(new)
        return self._after(both, self.refs.union(_counted(new)).groupBy("key").agg(F.sum("refs").alias("refs"), F.max("last").alias("last")))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Without the documents whose ``doc_id`` is in ``docs``."""
        if not self.shards:
            return self
        gone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        left, lost = (staged(self.postings.join(gone, "doc_id", how).select("key", "doc_id"), tag) for how, tag in (("left_anti", "postings"), ("left_semi", "postings-lost")))
        touched = lost.select("key").distinct()
        # counts of untouched keys stay; of touched ones they are taken again
        again = _counted(left.join(touched, "key", "left_semi"))
        return self._after(left, self.refs.join(touched, "key", "left_anti").unionByName(again))

    def _from(self, lines: DataFrame) -> LineIndex:
        refs = staged(_counted(lines), "refs")
        found = LineIndex(lines, refs, self.filters, 1)
        shards = max(1, found.dropped().count() // SHARD_KEYS)
        return LineIndex(lines, refs, staged(_filters(found.dropped(), shards), "filters"), shards)

    def _after(self, lines: DataFrame, refs: DataFrame) -> LineIndex:
        refs = staged(refs, "refs")
        found = LineIndex(lines, refs, self.filters, self.shards)
        live, was = found.dropped().select("key"), self.dropped().select("key")
        if live.count() > 4 * SHARD_KEYS * self.shards:
            return self._from(lines)
        changes = live.join(was, "key", "left_anti").withColumn("on", F.lit(True))
        changes = changes.union(was.join(live, "key", "left_anti").withColumn("on", F.lit(False)))
        return LineIndex(lines, refs, staged(_changed(self.filters, changes, live, self.shards), "filters"), self.shards)

    def losses(self) -> DataFrame:
        """``doc_id`` and ``keys``, those of its lines that the document loses."""
        total = self.postings.count()
        most = max(LEAST_DOCUMENTS, int(total * HOT_SHARE))
        hot = F.broadcast(self.dropped().where(F.col("refs") > most).select("key", "last"))  # at most 1 / HOT_SHARE rows
        rest = self.dropped().where(F.col("refs") <= most).select("key", "last")
        lines = self.postings.withColumn("shard", shard_of(F.col("key"), max(1, self.shards)))
        common = self.postings.join(hot, "key")
        hits = lines.join(hot.select("key"), "key", "left_anti").join(self.filters, "shard").where(in_filter(F.col("key"), F.col("buckets"), F.col("cells")))
        known = common.union(hits.select("key", "doc_id").join(rest, "key"))
        return known.where("doc_id < last").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``n_lines``, ``n_dropped``, ``kept`` (text) of each row of ``docs``."""
        narrow_batches(docs.sparkSession)
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        return read.join(self.losses(), "doc_id", "left").mapInArrow(tidy(_without), "doc_id long, n_lines long, n_dropped long, kept string")


def _counted(lines: DataFrame) -> DataFrame:
    """Documents of each key and the last of them."""
    return lines.groupBy("key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = _EDGES.encode()
    for batch in batches:
        ids, texts, keys = batch.columns
        n_lines, n_dropped, kept = [], [], []
        for raw, gone in zip(texts.cast(pa.binary()).to_pylist(), keys.to_pylist(), strict=True):
            lines = raw.split(b"\n")
            n_lines.append(len(lines))
            if gone:
                lose = set(gone)
                stay = [x for x in lines if hashlib.sha256(x.strip(edges).lower()).digest()[:16] not in lose]
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            else:
                n_dropped.append(0)
                kept.append(raw)
        yield pa.record_batch([ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept`` of each row.

    Lines of at least 20 code points (their key: stripped, A-Z lower-cased) that three
    documents or more hold go, except from the document with the largest ``doc_id``.
    A document is a ``doc_id``: rows that repeat one count once, and each loses the
    lines that the document loses.  Rows without a ``doc_id`` count for nothing and
    stay as they are.  A null or empty text is one empty line; if all lines go, the
    text is empty.  Other columns are not read.  Keys are told apart by 16 bytes of
    their SHA-256.
    """
    return LineIndex.empty(docs.sparkSession).insert(docs).clean(docs)


def line_digest(cleaned: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept_sha256``."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
