"""Operator 1: best-fit packing of tokenised documents into sequences of a fixed capacity.

Bounded-space online best fit: each task keeps at most ``open_bins`` open sequences in a bitset keyed by
free space. A piece goes to the open sequence with the least free space that holds it; when the bound is
passed, the fullest open sequence closes. Tokenising is a narrow pass over the texts; only the small table
of pieces (no ids) is dealt out again, evenly and without a key, so that each packing task sees enough
pieces and no hot source or document matters.

Cases: null or empty text is the end token alone; null ids are kept as null; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns of the input are not read, so their names
cannot clash. A document longer than the capacity is cut into full pieces, the first of which may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from embedlake.llm import _segments as S
from embedlake.llm import _text as T
from embedlake.llm._work import Workspace

#: Pieces that one packing task gets; what stays open at its end is spread over so many.
PIECES_PER_TASK = 200_000
OPEN_BINS = 4096


class BestFit:
    """Online best fit over at most ``open_bins`` open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.made, self.open = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``length`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            at, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32 and, if asked for, ``ids`` (array of int)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = S.coder("tokenizers", tokenizer)
        for batch in batches:
            for a, _, data, offsets in T.slices(batch.column(1), S.SLICE):
                ids, begin = coder.tokens(data, offsets)
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for k in range(len(offsets) - 1):
                    own = np.append(ids[begin[k] : begin[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    lo, hi, p = 0, first, 0
                    while lo < len(own):
                        rows.append(a + k)
                        piece.append(p)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(own[lo:hi].tobytes()))
                        if keep_ids:
                            kept.append(own[lo:hi].astype(np.int32))
                        lo, hi, p = hi, hi + capacity, p + 1
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                names = [id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(
    pieces: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK,
    rows: int | None = None,
) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    tasks = max(1, -(-(pieces.count() if rows is None else rows) // pieces_per_task))
    at = pieces.columns.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(n) for n in batch.column(at).to_pylist()]
            ids = pa.array([base + b for b, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    # the order within a task is fixed, so a task that runs again packs alike
    dealt = pieces.repartition(tasks).sortWithinPartitions(*[c for c in pieces.columns if c != "ids"])
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``; see the module's text for the cases."""
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.save(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    return pack(pieces, capacity)
