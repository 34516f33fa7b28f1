"""Token ids in a binary format: static range ANS with shared frequencies.

File format.  A dataset is a Parquet table of blocks, so Spark's writers commit
it and a lost task is simply run again.  Each row is one block that can be
decoded alone.  Little-endian throughout:

====================  ======================================================
magic, version        4 bytes ``RTOK``, u32
crc32                 u32 of all bytes that follow it
counts                u32 documents, u32 tokens, u32 lanes, u32 tokens between
                      checkpoints, u32 payload words
first                 u64 tokens of the same range partition before the block
ids, lengths          i64 document id, u32 token count of each document
checkpoints           for each: u32 payload position, u64 state of each lane
payload               u32 words
====================  ======================================================

Token ``i`` of a block belongs to lane ``i mod lanes``; all lanes advance
together, so one step of array arithmetic codes ``lanes`` tokens.  A checkpoint
holds what a decoder needs to begin at its token, so the parts of one block can
be decoded in parallel.  Frequencies are counted over all documents, scaled to
``2**SCALE`` with at least one for each id that occurs, and shared by all
blocks; the table has at most one entry for each id of the vocabulary, which
bounds what is sent to the executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, narrow_batches, staged, tidy
from .word_cache import tokenizer

SCALE, LOW = 20, np.uint64(1 << 31)
LANES, BLOCK_TOKENS, CHECKPOINT_TOKENS = 2048, 1 << 18, 1 << 17
MAGIC, VERSION = b"RTOK", 1
#: Stands in a block for a null document id.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sII5IQ")
_WORD, _LOW_WORD = np.uint64(32), np.uint64(0xFFFFFFFF)
_SLOT = np.uint64((1 << SCALE) - 1)


class Frequencies:
    """Scaled counts ``f`` and their running sums ``c``; ``slots`` maps each of
    the ``2**SCALE`` values back to its id."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(ids) > 1 << SCALE:
            raise ValueError(f"more than {1 << SCALE} different ids")
        size = int(ids.max()) + 1 if len(ids) else 1
        scaled = np.zeros(size, np.int64)
        if len(ids):
            scaled[ids] = np.maximum(1, counts.astype(np.float64) * (1 << SCALE) / counts.sum()).astype(np.int64)
            spare = (1 << SCALE) - int(scaled.sum())
            order = ids[np.lexsort((ids, -counts))]
            if spare >= 0:
                scaled[order[0]] += spare
            for i in order if spare < 0 else ():  # the most frequent ids give first
                take = min(-spare, int(scaled[i]) // 2)
                scaled[i] -= take
                spare += take
                if spare == 0:
                    break
        self._set(scaled.astype(np.uint64))

    def _set(self, f: np.ndarray) -> None:
        self.f = f
        self.c = np.concatenate(([0], np.cumsum(f)[:-1])).astype(np.uint64)
        self.both = (self.f << np.uint64(32)) | self.c  # one lookup instead of two
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            ids = np.arange(len(self.f), dtype=np.uint16 if len(self.f) <= 1 << 16 else np.uint32)
            self._slots = np.repeat(ids, self.f.astype(np.int64))
        return self._slots

    def __getstate__(self) -> dict:
        return {"f": self.f.astype(np.uint32)}

    def __setstate__(self, state: dict) -> None:
        self._set(state["f"].astype(np.uint64))


def encode_ids(ids: np.ndarray, table: Frequencies) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Checkpoints (payload position and lane states, first token first) and
    payload words of ``ids``."""
    steps = -(-len(ids) // LANES)
    every = CHECKPOINT_TOKENS // LANES
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    written = 0
    marks: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES : (step + 1) * LANES]
        x, both = state[: len(part)], table.both[part]
        f, c = both >> _WORD, both & _LOW_WORD
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            words.append((x[full] & _LOW_WORD).astype("<u4"))
            written += len(words[-1])
            x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(part)] = (q << np.uint64(SCALE)) + (x - q * f) + c
        if step % every == 0:
            marks.append((written, state.copy()))
    payload = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return [(written - at, s) for at, s in reversed(marks)], payload


def decode_ids(n: int, mark: tuple[int, np.ndarray], payload: np.ndarray, table: Frequencies) -> np.ndarray:
    """``n`` ids from a checkpoint on."""
    at, state = mark[0], mark[1].copy()
    out = np.empty(n, np.uint32)
    for first in range(0, n, LANES):
        x = state[: min(LANES, n - first)]
        slot = x & _SLOT
        got = table.slots[slot.astype(np.int64)]
        out[first : first + len(x)] = got
        both = table.both[got]
        x = (both >> _WORD) * (x >> np.uint64(SCALE)) + slot - (both & _LOW_WORD)
        low = x < LOW
        need = int(np.count_nonzero(low))
        if need:
            x[low] = (x[low] << _WORD) | payload[at : at + need].astype(np.uint64)
            at += need
        state[: len(x)] = x
    return out


def encode_block(doc_ids: list[int], lengths: list[int], ids: np.ndarray, first: int, table: Frequencies) -> bytes:
    marks, payload = encode_ids(ids, table)
    body = [np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<u4").tobytes()]
    for at, state in marks:
        body += [struct.pack("<I", at), state.astype("<u8").tobytes()]
    body.append(payload.tobytes())
    counts = struct.pack("<5IQ", len(doc_ids), len(ids), LANES, CHECKPOINT_TOKENS, len(payload), first)
    rest = b"".join([counts, *body])
    return MAGIC + struct.pack("<II", VERSION, zlib.crc32(rest)) + rest


def decode_block(block: bytes, table: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, lengths, all ids and the block's first token number.
    Raises ValueError if the block is damaged."""
    magic, version, crc, n_docs, n, lanes, every, n_words, first = _HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION or lanes != LANES or zlib.crc32(block[12:]) != crc:
        raise ValueError("damaged block")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    lengths = np.frombuffer(block, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    marks = []
    for _ in range(-(-n // every)):
        marks.append((struct.unpack_from("<I", block, at)[0], np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)))
        at += 4 + 8 * lanes
    payload = np.frombuffer(block, "<u4", n_words, at)
    parts = [decode_ids(min(every, n - i * every), m, payload, table) for i, m in enumerate(marks)]
    return doc_ids, lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32), first


def token_table(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 16-bit integers, ``end_id``
    last) and ``counts``.  Null text counts as empty.  Each task's last row holds
    no document but, in ``counts``, how often it wrote each id: pairs of an id
    and a count as unsigned 64-bit integers.  A task that runs again writes both
    anew, so counts always match the documents."""
    names, kinds = ["doc_id", "ids", "counts"], [pa.int64(), pa.binary(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(vocabulary), np.array([end_id], "<u2").tobytes()
        total = np.zeros(1 << 16, np.uint64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = [x + end for x in coder.ids([t or "" for t in part.column(1).to_pylist()])]
                total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=1 << 16).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, kinds[1]), pa.nulls(len(ids), kinds[2])], names)
        seen = np.nonzero(total)[0]
        counts = np.column_stack([seen.astype("<u8"), total[seen].astype("<u8")]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([None], [None], [counts]), kinds, strict=True)], names)

    narrow_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return chosen.mapInArrow(tidy(rows), "doc_id long, ids binary, counts binary")


def count_ids(tokens: DataFrame) -> Frequencies:
    """Counts of all ids from a staged ``token_table``; only its ``counts`` are
    read, and added up in each task before they are shuffled.  The result has
    one row for each id of the vocabulary at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pairs = np.frombuffer(raw, "<u8").reshape(-1, 2).astype(np.int64)
                total[pairs[:, 0]] += pairs[:, 1]
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    rows = tokens.select("counts").where("counts IS NOT NULL")
    totals = rows.mapInArrow(tidy(counted), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = totals.toPandas().sort_values("id")
    return Frequencies(got["id"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def write_blocks(tokens: DataFrame, table: Frequencies) -> DataFrame:
    """Blocks of ``token_table`` rows in ascending ``doc_id`` order, written in
    the shared folder: ``part`` (range partition), ``seq``, ``n_tokens``,
    ``block``.  A block ends with the first document that brings it to
    ``BLOCK_TOKENS``; no document is split."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("block", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            data = encode_block(doc_ids, [len(x) for x in held], np.concatenate(held), first, table)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_tokens": size, "block": data}], schema)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                held.append(np.frombuffer(raw.as_py(), "<u2"))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    seq, first, size = seq + 1, first + size, 0
                    doc_ids, held = [], []
        if held:
            yield block()

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.where("ids IS NOT NULL").select("doc_id", "ids")
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return staged(ordered.mapInArrow(tidy(blocks), "part int, seq int, n_tokens long, block binary"), "rans-blocks")


def read_blocks(blocks: DataFrame, table: Frequencies) -> DataFrame:
    """Decoded documents: ``doc_id``, ``start`` (ids of all documents before
    it), ``ids`` (little-endian unsigned 32-bit integers).

    Only the token totals of the range partitions, one number each, reach the
    driver; within a partition each block knows its own first token.
    """
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids, first = decode_block(raw.as_py(), table)
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                whole = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids.astype(np.int64), mask=doc_ids == NO_ID),
                        pa.array(starts + first + base[part]),
                        pa.array([whole[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    return blocks.select("part", "block").mapInArrow(tidy(pieces), "doc_id long, start long, ids binary")


def token_digest(pieces: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of decoded documents."""
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Tokenise ``docs``, write them as blocks, read the blocks back: ``doc_id``,
    ``start``, ``ids`` of each document.

    Each row counts as a document, repeated rows too (those with one id follow
    each other in the order of their ids).  Null and empty texts hold the end
    id alone.  Rows without a ``doc_id`` come first.  An empty table gives no
    blocks and no rows.  Other columns are ignored.
    """
    tokens = staged(token_table(docs, vocabulary, end_id), "tokens")
    table = count_ids(tokens)
    blocks = write_blocks(tokens, table)
    dropped(tokens)
    return read_blocks(blocks, table)
