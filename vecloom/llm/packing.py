"""Sum-of-squares online packing of documents into token windows.

Each document is split into whole windows and a rest; the rest goes to the fill
level (or a new window) that minimises the sum of squared counts of partially
filled windows, kept in an array of counts by level. Every partition packs its
own rows in order with bounded memory: while as many windows are open as fit, the
same rule chooses among the open ones alone, where a rest that is too long for a window
fills it and the remainder is placed next. Windows left at the end are closed by cutting
the emptiest to fill the fullest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

_OPEN = 1024  # open windows of a partition at most: 16 MB of ids


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens); windows are lists of pieces."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)  # open windows by fill
        self.windows: dict[int, list[list[tuple]]] = {}
        self.n_open = 0

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """Places a document; yields the windows that became full."""
        n, at = len(ids) // 4, 0
        while n - at >= self.size:
            yield [(doc, at, ids[4 * at : 4 * (at + self.size)], n)]
            at += self.size
        while at < n:
            rest = n - at
            if self.n_open < _OPEN:
                yield from self._place((doc, at, ids[4 * at :], n), rest)
                break
            take = self._open_level(rest)
            used = min(rest, self.size - take)
            window = self._take(take)
            window.append((doc, at, ids[4 * at : 4 * (at + used)], n))
            at += used
            if take + used == self.size:
                yield window
            else:
                self._put(take + used, window)

    def _open_level(self, n: int) -> int:
        """The open level at which up to n tokens raise the sum of squares least, of equal ones the fullest."""
        levels = np.flatnonzero(self.count)
        to = np.minimum(levels + n, self.size)
        gain = 2 - 2 * self.count[levels] + np.where(to < self.size, 2 * self.count[to], -1)
        return int(levels[gain == gain.min()][-1])

    def _place(self, piece: tuple, n: int) -> Iterator[list[tuple]]:
        count, size = self.count, self.size
        # Change of the sum of squares when a window of level h goes to h + n; counts of levels 0 and size don't matter.
        rise = 2 * count[n:size] + 1
        gain = np.empty(size - n + 1, dtype=np.int64)
        gain[0] = rise[0] if n < size else 0
        gain[1 : size - n] = rise[1:] - 2 * count[1 : size - n] + 1
        if n < size:
            gain[size - n] = 1 - 2 * count[size - n]
        able = count[: size - n + 1] > 0
        able[0] = True
        levels = np.flatnonzero(able)
        best = levels[gain[levels] == gain[levels].min()][-1]  # of equal ones the fullest
        window = [] if best == 0 else self._take(int(best))
        window.append(piece)
        if best + n == size:
            yield window
        else:
            self._put(int(best) + n, window)

    def _take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.n_open -= 1
        found = self.windows[level].pop(0)
        if not self.windows[level]:
            del self.windows[level]
        return found

    def _put(self, level: int, window: list[tuple]) -> None:
        self.count[level] += 1
        self.n_open += 1
        self.windows.setdefault(level, []).append(window)

    def _settle(self, keep: int) -> Iterator[list[tuple]]:
        """Fills the fullest windows with pieces cut from the emptiest until ``keep`` are open."""
        while self.n_open > max(keep, 1):
            levels = sorted(self.windows)
            high, low = levels[-1], levels[0]
            target = self._take(high)
            source = self._take(low)
            room, moved = self.size - high, 0
            while room and source:
                doc, start, ids, n = source.pop()
                have = len(ids) // 4
                if have > room:
                    source.append((doc, start, ids[: 4 * (have - room)], n))
                    target.append((doc, start + have - room, ids[4 * (have - room) :], n))
                    moved, room = moved + room, 0
                else:
                    target.append((doc, start, ids, n))
                    moved, room = moved + have, room - have
            if room:
                self._put(self.size - room, target)
            else:
                yield target
            if source:
                self._put(low - moved, source)

    def finish(self) -> Iterator[list[tuple]]:
        """Closes all windows: full ones, and the last one's tokens cut to powers of two, which take no padding."""
        yield from self._settle(keep=1)
        if self.n_open:
            (level,) = self.windows
            left = self._take(level)[::-1]
            power = 1 << (level.bit_length() - 1)
            while left:
                while power > level:
                    power >>= 1
                window, room = [], power
                while room:
                    doc, start, ids, n = left.pop()
                    have = min(len(ids) // 4, room)
                    window.append((doc, start, ids[: 4 * have], n))
                    if 4 * have < len(ids):
                        left.append((doc, start + have, ids[4 * have :], n))
                    room -= have
                level -= power
                yield window


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, remembered: int = tokens._MOST) -> DataFrame:
    """Packed pieces: (id, start, length, ids, doc_tokens, sequence_id, offset), ids as little-endian unsigned 32-bit bytes.

    A document is its text's ids and ``end_id``; a null text is empty. Map-only:
    sequences never span partitions, a partition's last tokens fill sequences whose
    lengths are powers of two, so that no sequence needs padding. Order within a
    partition is that of its rows, so a task run again gives the same sequences.
    Repeated rows and rows that share an id are packed as often as they occur, null ids too.
    Other columns aren't read, whatever their names; an empty table gives no pieces. A worker
    remembers the ids of up to ``remembered`` words: fewer take less memory and more time, with equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, packer, end = tokens.counter(path, remembered), Packer(size), np.uint32(end_id).astype("<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)
            rows.clear()
            return out

        def emit(windows: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for window in windows:
                at = 0
                for doc, start, ids, n in window:
                    rows.append((doc, start, len(ids) // 4, ids, n, sequence, at))
                    at += len(ids) // 4
                sequence += 1

        for batch in batches:
            for doc, ids in zip(batch.column(0), c.ids_of(batch.column(1))):
                emit(packer.add(doc.as_py(), ids + end))
                if len(rows) >= 512:
                    yield flush()
        c.forget()
        emit(packer.finish())
        yield flush()

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    slim = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"{id_col} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    first = pieces.columns[0]
    return pieces.select(first, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
