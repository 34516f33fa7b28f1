"""Removal of long repeated byte strings with run-compressed text indexes.

A string of ``LENGTH`` bytes that starts at two places is found in three steps,
none of which brings the corpus, or an unbounded part of it, into one task.

1. Anchors.  In every window of ``LENGTH`` bytes the gram of ``GRAM`` bytes with
   the smallest hash (the leftmost of equals) is its anchor.  Equal windows have
   equal anchors, so only windows with one anchor need to be compared.  The
   windows that share one anchor occurrence are consecutive; the bytes that they
   cover are its context.
2. Contexts.  Counts by anchor and context are added up before the shuffle.  If
   a context occurs twice, all its windows do.  If an anchor has one context
   only, nothing else can match.
3. Indexes.  The different contexts of one anchor are gathered; as many anchors
   as fit in ``BATCH`` bytes are indexed together: a Burrows-Wheeler transform
   stored as runs, suffixes sampled at the run ends, and from these the matching
   statistics of every position against all others, in one stream.  Windows
   with a match of ``LENGTH`` bytes or more are repeated.

An anchor with more than ``MOST_CONTEXTS`` different contexts, as at the edges
of a passage that very many documents share, is not gathered.  Its contexts are
halved again and again: a part whose bytes occur twice is repeated, a part whose
core, the bytes that all its windows share, occurs once is not, and only what
lies between goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, narrow_batches, staged, tidy

LENGTH, GRAM = 200, 32
BATCH, MOST_CONTEXTS = 1 << 19, 2048
#: Bytes of a text that are looked at together; a power of two below 2**24.
CHUNK = 1 << 22
_POSITION = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM`` consecutive bytes, by doubling."""
    h, factor, span = _BYTES[data], 0x9E3779B97F4A7C15, 1
    while span < GRAM:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        span *= 2
    return _mix(h)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start and place of each anchor occurrence."""
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(text) - LENGTH + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, CHUNK + LENGTH - 1), at)
        n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
        h = gram_hashes(data)
        key = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max)
        key[: len(h)] = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        rows = key.reshape(-1, width)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        behind = np.minimum.accumulate(rows, axis=1).ravel()[width - 1 : width - 1 + n]
        place = (np.minimum(ahead, behind) & _POSITION).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        found.append((h[place[first]], first + at, last + at, place[first] + at))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context the starts of its windows of ``LENGTH`` bytes that start
    anywhere else in ``contexts``, by a run-compressed Burrows-Wheeler transform.

    Suffix order comes from prefix doubling.  Only at the ends of the
    transform's runs is the match with the neighbouring suffix measured; at
    every other position it is one less than at the position before, so one
    running maximum streams the statistics of all positions.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # each context is closed by an own sign below all bytes
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    n = len(owner)
    signs = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    signs[ends] = 0
    left = ends[owner] - np.arange(n)  # bytes before the closing sign
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[: n - k] += np.where(left[: n - k] > k, signs[k:], 0)
    order = np.argsort(key)
    # closed within the seven signs: equals are told apart by their context
    closed = np.flatnonzero(left < 7)
    order[(left < 7)[order]] = closed[np.lexsort((closed, key[closed]))]
    sorted_key = key[order]
    new = np.concatenate(([False], (sorted_key[1:] != sorted_key[:-1]) | (left[order[1:]] < 7)))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    span = 7
    while np.count_nonzero(new) < n - 1:
        key = rank << 32
        key[: n - span] += np.where(left[: n - span] >= span, rank[span:] + 1, 0)
        order = np.argsort(key)
        sorted_key = key[order]
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(new)
        span *= 2
    # The transform, as runs: the sign before each suffix in suffix order.
    before = np.where(order > 0, signs[order - 1], 0)
    # What stands before a context's first byte differs from all else.
    heads = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
    longest = np.zeros(n, np.int64)
    for sampled, shift in ((np.flatnonzero(heads), -1), (np.flatnonzero(np.concatenate((heads[1:], [True]))), 1)):
        j = sampled[(sampled + shift >= 0) & (sampled + shift < n)]
        a, b = order[j], order[j + shift]
        match = np.zeros(len(j), np.int64)
        going = np.arange(len(j))
        limit = np.minimum(left[a], left[b])
        while len(going):
            at = match[going]
            going = going[at < limit[going]]
            same = signs[a[going] + match[going]] == signs[b[going] + match[going]]
            going = going[same]
            match[going] += 1
        statistic = np.full(n, -n, np.int64)
        statistic[a] = match + a
        longest = np.maximum(longest, np.maximum.accumulate(statistic) - np.arange(n))
    ok = longest >= LENGTH
    starts = ends - sizes
    return [np.flatnonzero(ok[s : s + max(0, m - LENGTH + 1)]) for s, m in zip(starts, sizes, strict=True)]


def _intervals(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive window starts: first start, and end of the bytes covered."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + LENGTH


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``h``, ``t`` (bytes).  ``h`` tells rows of one id apart; rows
    that agree in both are alike and have the same result."""
    narrow_batches(docs.sparkSession)
    t = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("t"))


def _same_row(a: DataFrame, b: DataFrame) -> F.Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def find_anchors(rows: DataFrame) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "anchor", "ctx", "a", "b", "d"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                row: list[np.ndarray] = []
                hashes: list[np.ndarray] = []
                first: list[np.ndarray] = []
                last: list[np.ndarray] = []
                away: list[np.ndarray] = []
                ctx: list[int] = []
                for i, t in enumerate(part.column(2)):
                    text = t.as_py()
                    x, a, b, place = anchors(text)
                    row.append(np.full(len(x), i))
                    hashes.append(x)
                    first.append(a)
                    last.append(b)
                    away.append(place - a)
                    ctx += [xxhash.xxh3_64_intdigest(text[p:q]) for p, q in zip(a.tolist(), (b + LENGTH).tolist(), strict=True)]
                if not ctx:
                    continue
                of = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(of),
                        part.column(1).take(of),
                        pa.array(np.concatenate(hashes).view(np.int64)),
                        pa.array(np.array(ctx, np.uint64).view(np.int64)),
                        pa.array(np.concatenate(first)),
                        pa.array(np.concatenate(last)),
                        pa.array(np.concatenate(away)),
                    ],
                    names,
                )

    return rows.mapInArrow(tidy(found), "doc_id long, h long, anchor long, ctx long, a long, b long, d long")


def _indexed(contexts: DataFrame) -> DataFrame:
    """Step 3 for ``anchor``, ``doc_id``, ``h``, ``a``, ``bytes``: repeated
    stretches ``doc_id``, ``h``, ``s``, ``e``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def result() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for (doc_id, h, a, _), starts in zip(held, repeated_windows([x[3] for x in held]), strict=True):
                if len(starts):
                    out += [(doc_id, h, a + s, a + e) for s, e in zip(*(x.tolist() for x in _intervals(starts)), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "h", "s", "e"])

        for batch in batches:
            for anchor, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size >= BATCH:
                    yield from result()
                    held, size = [], 0
                held.append(tuple(rest))
                size += len(rest[3]) + 1
                last = anchor
        if held:
            yield from result()

    grouped = contexts.select("anchor", "doc_id", "h", "a", "bytes").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "h", "a")
    return grouped.mapInArrow(tidy(found), "doc_id long, h long, s long, e long")


def _halved(contexts: DataFrame) -> DataFrame:
    """The same for anchors with any number of contexts, by halving.

    ``d`` is the distance from a part's first window to its anchor.  Parts are
    cut at multiples of ``2**k`` of that distance, so that windows of one
    distance are in parts of one place, whose cores can be compared.  Counts
    are added up before the shuffle, and nothing is gathered.
    """
    parts = contexts.select("anchor", "doc_id", "h", "a", "d", "bytes")
    done = None
    for k in range(7, -1, -1):
        # each step is a column of its own, so that the generated code stays small
        cut = parts.withColumn("n", F.length("bytes") - LENGTH + 1)  # windows
        cut = cut.withColumn("first", F.shiftleft(F.shiftright("d", k), k))
        cut = cut.withColumn("n_far", F.least(F.col("d") - F.col("first") + 1, F.col("n")))
        far = F.struct("a", "d", F.substr("bytes", F.lit(1), F.col("n_far") + LENGTH - 1).alias("bytes"))
        near = F.struct(
            (F.col("a") + F.col("n_far")).alias("a"),
            (F.col("d") - F.col("n_far")).alias("d"),
            F.substr("bytes", F.col("n_far") + 1, F.length("bytes")).alias("bytes"),
        )
        halves = F.when(F.col("n_far") < F.col("n"), F.array(far, near)).otherwise(F.array(far))
        parts = cut.select("anchor", "doc_id", "h", F.explode(halves).alias("p"))
        parts = parts.select("anchor", "doc_id", "h", "p.a", "p.d", "p.bytes")
        parts = parts.withColumn("first", F.shiftleft(F.shiftright("d", k), k))
        size = LENGTH - F.least(F.lit((1 << k) - 1), LENGTH - GRAM - F.col("first"))
        parts = parts.withColumn("core", F.substr("bytes", F.col("d") - F.col("first") + 1, size))
        parts = parts.withColumn("x", F.xxhash64("bytes", "d")).withColumn("y", F.xxhash64("core", "first"))
        parts = parts.drop("core", "first")
        whole = parts.groupBy("anchor", "x").agg(F.count("*").alias("nx"))
        core = parts.groupBy("anchor", "y").agg(F.count("*").alias("ny")).where("ny > 1")
        counted = staged(parts.join(core, ["anchor", "y"]).join(whole, ["anchor", "x"]), "halves")
        covered = ["doc_id", "h", F.col("a").alias("s"), (F.col("a") + F.length("bytes")).alias("e")]
        twice = counted.where("nx > 1").select(*covered)
        done = twice if done is None else done.union(twice)
        # one copy of what is settled stays, for others to match
        one = counted.where("nx > 1").dropDuplicates(["anchor", "x"])
        parts = counted.where("nx = 1").unionByName(one).drop("x", "y", "nx", "ny")
    return done


def repeats(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` and the stretches ``s``, ``e`` (bytes) of ``_keyed``
    rows that strings of ``LENGTH`` bytes which start twice cover; stretches of
    a row may overlap."""
    found = staged(find_anchors(rows), "anchors")
    shared = found.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("ctx") < F.max("ctx")).alias("several")
    ).where("n > 1")
    # a table of its own: Spark can then split the join where an anchor is very common
    shared = staged(shared.select("anchor", "several"), "anchor-counts")
    again = staged(found.join(shared, "anchor"), "shared-anchors")
    dropped(found)
    covered = ["doc_id", "h", F.col("a").alias("s"), (F.col("b") + LENGTH).alias("e")]
    alike = again.where("NOT several").select(*covered)

    several = again.where("several")
    one = F.min(F.struct("doc_id", "h", "a", "b", "d")).alias("at")
    kinds = several.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), one).select("anchor", "ctx", "n", "at.*")
    kinds = staged(kinds, "contexts")
    # a sort-merge join of two tables that is written as it is: Spark can then split
    # the rows of a very common context, as of a passage that many documents share
    twice = kinds.where("n > 1").select("anchor", "ctx")
    copied = staged(several.hint("merge").join(twice, ["anchor", "ctx"]).select(*covered), "copied")

    many = kinds.groupBy("anchor").agg(F.count("*").alias("n_ctx")).where(F.col("n_ctx") > MOST_CONTEXTS)
    wanted = kinds.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "a", "b", "d")).alias("at"))

    def cut(x: F.Column) -> F.Column:
        size = (x["b"] - x["a"] + LENGTH).cast("int")
        return F.struct(
            x["anchor"].alias("anchor"),
            x["a"].alias("a"),
            x["d"].cast("int").alias("d"),
            F.substr("t", (x["a"] + 1).cast("int"), size).alias("bytes"),
        )

    texts = rows.join(wanted, _same_row(rows, wanted)).select(
        wanted["doc_id"], wanted["h"], F.explode(F.transform("at", cut)).alias("c")
    )
    # a row that is repeated gives each of its contexts once; its copies are marked above
    contexts = texts.select("doc_id", "h", "c.*").dropDuplicates(["doc_id", "h", "anchor", "a"]).join(many.select("anchor", F.lit(True).alias("hot")), "anchor", "left")
    contexts = staged(contexts, "context-bytes")
    out = alike.union(copied).union(_indexed(contexts.where("hot IS NULL")))
    hot = contexts.where("hot")
    return out if hot.isEmpty() else out.union(_halved(hot))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``h``, ``kept`` (bytes left), ``n_bytes``, ``n_removed``,
    ``n_spans`` of every row.

    Each byte goes that a string of ``LENGTH`` bytes covers which also starts
    elsewhere, in the same row or another; overlapping occurrences count, and
    strings are judged on the input.  Null text counts as empty; texts shorter
    than ``LENGTH`` stay as they are.  Repeated rows match each other and lose
    everything if they are long enough.  Rows without a ``doc_id`` take part
    like others.  An empty table gives no rows.  Other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    marks = repeats(rows).groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    marked = rows.join(marks, _same_row(rows, marks), "left").select(
        rows["doc_id"], rows["h"], "t", F.col("marks.s").alias("s"), F.col("marks.e").alias("e")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "h", "kept", "n_bytes", "n_removed", "n_spans"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for t, s, e in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True):
                    kept, removed, spans, end = [], 0, 0, 0
                    for a, b in sorted(zip(s or (), e or (), strict=True)):
                        if a > end or not spans:
                            kept.append(t[end:a])
                            spans += 1
                            end = a
                        removed += max(0, b - end)
                        end = max(end, b)
                    kept.append(t[end:])
                    out.append((b"".join(kept), len(t), removed, spans))
                made = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names)

    return marked.mapInArrow(tidy(cut), "doc_id long, h long, kept binary, n_bytes long, n_removed long, n_spans long")


def repeat_digest(cut: DataFrame) -> DataFrame:
    """``without_repeats``'s rows with ``kept_sha256`` in place of the bytes."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated stretches taken out of ``text`` and ``n_chars``
    counted anew.  A character that a cut splits goes as a whole."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.decode("utf-8", "ignore") for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "h", "new_text"]
            )

    cut = without_repeats(docs).where("n_removed > 0").select("doc_id", "h", "kept")
    changed = cut.mapInArrow(tidy(decoded), "id long, h long, new_text string").dropDuplicates(["id", "h"])
    texts = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("h"),
        F.struct(*docs.columns).alias("row"),
    )
    same = texts["id"].eqNullSafe(changed["id"]) & (texts["h"] == changed["h"])
    both = texts.join(changed, same, "left").select("row", "new_text")
    new = F.coalesce("new_text", "row.text")
    count = {f.name: F.length(new).cast(f.dataType) for f in docs.schema if f.name == "n_chars"}
    return both.select(*(({"text": new} | count).get(c, F.col("row")[c]).alias(c) for c in docs.columns))
