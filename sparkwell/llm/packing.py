"""Sum-of-squares online packing of documents into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import narrow_batches, tidy
from .word_cache import tokenizer

WINDOW = 4096
#: Chunks of text whose ids a worker remembers.
MOST_CHUNKS = 200_000
#: Windows that a task may hold open in all, and closed windows for each of them.
MOST_OPEN, CLOSED_PER_OPEN = 2048, 32
_NEVER = np.iinfo(np.int64).max

#: A piece: document number of the task, start, ids.
Piece = tuple[int, int, np.ndarray]


class SumOfSquares:
    """Online packing into windows of ``size`` tokens.

    ``count[h]`` is the number of open windows filled to ``h``.  A piece goes
    to the level for which the sum of squared counts becomes smallest (a new
    window is level zero; full windows do not count; the fullest level wins a
    tie).  That spreads the open windows over many levels, so that most pieces
    find one that they fill.

    Windows may be open up to one for every ``closed_per_open`` closed so far,
    two more, and ``most_open`` in all.  When that many are open a piece opens
    no new one: it takes the best level that has room for it or, if none has,
    it is cut where it fills a window, the one whose level and whose rest's
    level give the smallest sum, and the rest is placed like a piece.  So what
    is open at the end is a small share of what a task packed, and memory is
    bounded, by the same rule at every size.

    ``finish`` joins what is left of the open windows and cuts it into full
    ones; the tail becomes windows whose lengths are powers of two, which need
    no padding.
    """

    def __init__(self, size: int = WINDOW, most_open: int = MOST_OPEN, closed_per_open: int = CLOSED_PER_OPEN) -> None:
        self.size, self.most_open, self.closed_per_open = size, most_open, closed_per_open
        self.n_open = self.n_closed = 0
        self.count = np.zeros(size + 1, np.int64)
        self._open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def may_open(self) -> bool:
        return self.n_open < min(self.most_open, 2 + self.n_closed // self.closed_per_open)

    def level(self, n: int, new: bool = True) -> int:
        """The level that a piece of ``n`` tokens goes to as a whole; zero is a new
        window, or, without ``new``, says that no open one has room."""
        here = self.count[: self.size - n + 1]
        change = 2 * self.count[n:] - 2 * here + 2
        change[-1] = 1 - 2 * here[-1]  # the window becomes full and leaves the sum
        change[1:][here[1:] == 0] = _NEVER
        change[0] = (2 * self.count[n] + 1 if n < self.size else 0) if new else _NEVER
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best if change[best] < _NEVER else 0

    def cut_level(self, n: int) -> int:
        """The level of the window that a piece too long for every open one fills;
        its rest counts as opened."""
        here = self.count[self.size - n + 1 : self.size]
        change = 2 * self.count[1:n] - 2 * here + 2
        change[here == 0] = _NEVER
        return self.size - 1 - int(np.argmin(change[::-1]))

    def _taken(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.n_open -= 1
        return self._open[level].pop()

    def place(self, piece: Piece) -> list[list[Piece]]:
        """Windows that are complete once ``piece`` (at most ``size`` ids) is placed."""
        out: list[list[Piece]] = []
        while True:
            n, new = len(piece[2]), self.may_open()
            at = self.level(n, new)
            if at or new:
                break
            at = self.cut_level(n)
            number, start, ids = piece
            room = self.size - at
            out.append([*self._taken(at), (number, start, ids[:room])])
            self.n_closed += 1
            piece = (number, start + room, ids[room:])
        window = [*(self._taken(at) if at else ()), piece]
        if at + n == self.size:
            self.n_closed += 1
            return [*out, window]
        self._open[at + n].append(window)
        self.count[at + n] += 1
        self.n_open += 1
        return out

    def finish(self) -> list[list[Piece]]:
        """Windows cut from all open ones."""
        pieces = [p for level in reversed(self._open) for w in level for p in w]
        self._open = [[] for _ in range(self.size + 1)]
        self.count[:] = 0
        self.n_open = 0
        full, rest = divmod(sum(len(p[2]) for p in pieces), self.size)
        sizes = [self.size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        out: list[list[Piece]] = []
        queue = iter(pieces)
        piece: Piece | None = None
        for size in sizes:
            window: list[Piece] = []
            while size:
                number, start, ids = piece or next(queue)
                window.append((number, start, ids[:size]))
                piece = (number, start + size, ids[size:]) if len(ids) > size else None
                size -= len(window[-1][2])
            out.append(window)
        return out


def pack(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces ``doc_id``, ``start``, ``ids`` (little-endian unsigned 32-bit
    integers), ``doc_tokens``, ``sequence_id``, ``offset``.

    Each input partition is tokenised and packed where it lies: nothing is
    shuffled, and a lost task repeats only its own windows, with the same
    result.  A document longer than ``window`` fills whole windows first; its
    rest is packed.  ``sequence_id`` is the partition's number times 2**32 plus
    the window's number in it.

    Null and empty texts hold the end id alone.  Each row counts as a
    document, repeated rows and rows without a ``doc_id`` too.  An empty table
    gives no rows.  Other columns are ignored.
    """
    if window & (window - 1) or end_id >= 1 << 16:
        raise ValueError("window must be a power of two and end_id below 65536")
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, end = tokenizer(vocabulary, MOST_CHUNKS), np.array([end_id], "<u2").tobytes()
        packer = SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 32
        about: dict[int, list[int | None]] = {}  # of documents with pieces in open windows: id, tokens, tokens to come
        number = 0

        def table(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in windows:
                offset = 0
                for of, start, ids in pieces:
                    info = about[of]
                    out.append((info[0], start, ids.astype("<u4").tobytes(), info[1], sequence, offset))
                    offset += len(ids)
                    info[2] -= len(ids)
                    if not info[2]:
                        del about[of]
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                done: list[list[Piece]] = []
                for doc_id, raw in zip(part.column(0).to_pylist(), coder.ids(texts), strict=True):
                    ids = np.frombuffer(raw + end, "<u2")
                    about[number] = [doc_id, len(ids), len(ids)]
                    whole = len(ids) - len(ids) % window
                    done += [[(number, s, ids[s : s + window])] for s in range(0, whole, window)]
                    if whole < len(ids):
                        done += packer.place((number, whole, ids[whole:]))
                    number += 1
                if done:
                    yield table(done)
        if done := packer.finish():
            yield table(done)

    narrow_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return chosen.mapInArrow(
        tidy(rows), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def piece_digest(pieces: DataFrame) -> DataFrame:
    """``pack``'s rows with ``length`` and ``ids_crc32`` in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
