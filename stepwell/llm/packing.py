"""Packing of tokenised documents into windows of fixed size by the sum-of-squares rule.

A document's ids, with the end id, are cut into full windows as long as they fill one; what remains is an item of less
than a window. Items are placed online: the level array holds, for each fill level 1 .. size - 1, how many open windows
stand at that level. An item goes where the sum of the squared counts becomes least: for item w that is the level h
(0: a new window) that minimises N[h + w] - N[h], as moving a window from h to h + w changes the sum by
2 (N[h + w] - N[h] + 1), less where h + w closes the window or h opens one. Ties go to the fullest window. The choice is
one NumPy pass over the level array.

A task packs the documents of its partition and never shuffles. When it ends, some windows are still open. The emptiest
of them is taken apart and its pieces are placed in the others by the same rule, until one is left. A piece for which
no window has room is cut, so that it closes a window: the level is again the one that makes the sum of squares least
(closing a window at level h changes it by 1 - 2 N[h]), and the rest is placed as a piece of its own. The pieces of the
one window left, less than a window for a partition, go into windows of powers of two, which need no padding. So the
cost of a partition's end is some cuts. A partition's windows carry its number in their id, so ids are unique and a
lost task gives the same rows again.

Defined results: null and empty text have the end id alone. Rows with equal ids are packed row by row. An empty table
gives no rows. Every id lies in exactly one piece; pieces of a document appear in order of ``start``.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.bpe import codec_of, read_vocabulary, texts_of
from stepwell.llm.common import text_bytes

SIZE = 2048
END_ID = 1
#: Ids in open windows beyond which the emptiest are taken apart, so that memory stays bounded even where no two documents
#: fit into one window.
OPEN_IDS = 8 << 20
#: Bits of a window's id that count within a partition.
WINDOW_BITS = 40


class Packer:
    """Sum-of-squares packing of one stream of documents. Pieces are (doc, start, length); full windows leave at once."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)  # windows at each level
        self.contents: dict[int, list[tuple[int, int, int]]] = {}  # pieces of each open window
        self.windows = 0
        self.waiting = 0  # ids in open windows

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def level_for(self, w: int, new: bool = True) -> int:
        """The level of the window that takes an item of w, 0 for a new one (or for none, where a new one may not be)."""
        n, size = self.levels, self.size
        top = size - w
        if top < 1:
            return 0
        # What each level with windows and room would add to the sum of squares; a window that becomes full leaves it.
        change = 2 * (n[w + 1 : size + 1] - n[1 : top + 1]) + 2
        change[top - 1] = 1 - 2 * n[top]
        change = np.where(n[1 : top + 1] > 0, change, np.iinfo(np.int64).max)
        best = top - 1 - int(np.argmin(change[::-1]))
        if not new:
            return best + 1 if n[best + 1] else 0
        return best + 1 if change[best] <= 2 * n[w] + 1 else 0

    def add(self, doc: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Place a document of that many ids; yields (window, offset, doc, start, length) of windows that became full."""
        start = 0
        while length - start >= self.size:
            yield self._new(), 0, doc, start, self.size
            start += self.size
        w = length - start
        if not w:
            return
        level = self.level_for(w)
        yield from self._put(self._take(level) if level else self._new(), level, doc, start, w)
        while self.waiting > OPEN_IDS:
            yield from self._dissolve()

    def _put(self, window: int, level: int, doc: int, start: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Lay a piece into a window taken from that level; yields the window if that makes it full."""
        self.contents.setdefault(window, []).append((doc, start, length))
        self.waiting += length
        level += length
        if level == self.size:
            self.waiting -= level
            yield from self._close(window)
        else:
            self.open[level].append(window)
            self.levels[level] += 1

    def _take(self, level: int) -> int:
        self.levels[level] -= 1
        return self.open[level].pop()

    def _close(self, window: int) -> Iterator[tuple[int, int, int, int, int]]:
        offset = 0
        for doc, start, length in self.contents.pop(window):
            yield window, offset, doc, start, length
            offset += length

    def _dissolve(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Take the emptiest open window apart and place its pieces in the others by the same rule. A piece that no window
        has room for is cut to close the window whose closing makes the sum of squares least; the rest is placed in turn."""
        level = int(np.flatnonzero(self.levels)[0])
        window = self._take(level)
        self.waiting -= level
        for doc, start, length in sorted(self.contents.pop(window), key=lambda x: -x[2]):
            while length:
                level = self.level_for(length, new=False)
                n = length
                if not level and self.levels.any():
                    level = self._to_close()
                    n = self.size - level
                yield from self._put(self._take(level) if level else self._new(), level, doc, start, n)
                start += n
                length -= n

    def _to_close(self) -> int:
        """The level whose window, when closed, lowers the sum of squares most: the fullest of those with most windows."""
        return self.size - int(np.argmax(self.levels[::-1]))

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Place what is in open windows into ever fewer of them, until all but one are full. That last one's pieces go
        into windows at powers of two."""
        while self.levels.sum() > 1:
            yield from self._dissolve()
        for level in np.flatnonzero(self.levels):
            rest = int(level)
            loose = self.contents.pop(self._take(rest))
            self.waiting = 0
            while rest:
                room = 1 << rest.bit_length() - 1
                rest -= room
                window, offset = self._new(), 0
                while offset < room:
                    doc, start, length = loose.pop(0)
                    n = min(length, room - offset)
                    yield window, offset, doc, start, n
                    offset += n
                    if n < length:
                        loose.insert(0, (doc, start + n, length - n))


def pack_documents(
    docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian unsigned 32-bit integers, if asked for), ids_crc32,
    doc_tokens, sequence_id, offset."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = codec_of(shipped.value, library=True)
        packer = Packer(size)
        base = TaskContext.get().partitionId() << WINDOW_BITS
        held: dict[int, list] = {}  # number of a document -> [id, ids not yet given out, where they start, all its ids]
        rows: list[tuple] = []
        kind = pa.int64()

        def take(placed) -> Iterator[pa.RecordBatch]:
            for window, offset, doc, start, length in placed:
                doc_id, ids, first, total = held[doc]
                piece = ids[start - first : start - first + length].tobytes()
                rows.append((doc_id, start, length, zlib.crc32(piece), total, base + window, offset, piece if with_ids else None))
                left[doc] = left.get(doc, total) - length
                if not left[doc]:
                    del held[doc], left[doc]
                if len(rows) >= 2000:
                    yield flush()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            out = {"id": pa.array(cols[0], kind)} | {c: pa.array(x, pa.int64()) for c, x in zip(names, cols[1:7], strict=True)}
            if with_ids:
                out["ids"] = pa.array(cols[7], pa.binary())
            return pa.RecordBatch.from_pydict(out)

        left: dict[int, int] = {}  # ids of a document that are not yet given out
        number = 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for doc_id, text in zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids = np.append(codec.encode(text), np.uint32(end_id)).astype("<u4")
                held[number] = [doc_id, ids, 0, len(ids)]
                yield from take(packer.add(number, len(ids)))
                if number in held and left.get(number, len(ids)) < len(ids):  # only the rest of a long document waits
                    held[number][1:3] = ids[-left[number] :].copy(), len(ids) - left[number]
                number += 1
        yield from take(packer.finish())
        if rows:
            yield flush()

    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    packed = docs.select(F.col(id_column).alias("id"), text_bytes(text_column)).mapInArrow(run, schema)
    return packed.withColumnRenamed("id", id_column)


def padding(fill: int, size: int = SIZE) -> int:
    """Padding of a window with that fill: none at a power of two, else up to the size."""
    return 0 if fill & (fill - 1) == 0 else size - fill
