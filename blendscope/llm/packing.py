"""Packing documents into training sequences (bounded-space online best fit).

Each partition keeps ``windows`` open sequences. A document's full lengths become sequences of their own; its rest
goes to the open sequence it fits best. When none fits, a new one is opened, or, once all are open, the fullest is
filled up with the head of the piece and emitted. What is open at the end of a partition is merged there; the less
than one sequence that remains goes to a merge of ``MERGE`` partitions, and the last tokens of that are cut
into lengths that are powers of two, which need no padding. So no sequence holds padding and no task sees more
than a partition, or ``MERGE`` remainders.

Defined cases: null or empty text is one piece, the end id alone; a null doc_id stays null; repeated rows are packed
each; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope.session import materialize

from .textvec import token_slices

SEQUENCE = 2048
WINDOWS = 16
MERGE = 64

PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "ids binary, task bigint")
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("task", pa.int64())])

ID_BYTES = 4


class Packer:
    """Best fit over a fixed number of open sequences; a piece is [doc_id, start, length, doc_tokens, ids bytes]."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next_id = size, windows, first_id
        self.open: list[list] = []  # [free, pieces]
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, length, total, ids in pieces:
            self.done.append((doc, start, length, total, self.next_id, offset, bytes(ids)))
            offset += length
        self.next_id += 1

    @staticmethod
    def cut(piece, length: int):
        doc, start, whole, total, ids = piece
        return ((doc, start, length, total, ids[:length * ID_BYTES]),
                (doc, start + length, whole - length, total, ids[length * ID_BYTES:]))

    def add(self, piece) -> None:
        while piece[2] >= self.size:
            head, piece = self.cut(piece, self.size)
            self.emit([head])
        while piece[2]:
            fitting = [w for w in self.open if w[0] >= piece[2]]
            if fitting:
                window = min(fitting, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                window = [self.size, []]
                self.open.append(window)
            else:
                window = min(self.open, key=lambda w: w[0])
            head, piece = self.cut(piece, min(window[0], piece[2]))
            window[0] -= head[2]
            window[1].append(head)
            if not window[0]:
                self.open.remove(window)
                self.emit(window[1])

    def merge(self) -> list:
        """Emit full sequences made of all open ones, fullest first; the rest comes back as pieces."""
        rest = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open, held, free = [], [], self.size
        for piece in rest:
            while piece[2]:
                head, piece = self.cut(piece, min(free, piece[2]))
                held.append(head)
                free -= head[2]
                if not free:
                    self.emit(held)
                    held, free = [], self.size
        return held

    def finish(self, rest: list) -> None:
        """Emit the last pieces as sequences whose lengths are powers of two, longest first."""
        left = sum(p[2] for p in rest)
        rest = list(rest)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            held = []
            while want:
                head, tail = self.cut(rest[0], min(want, rest[0][2]))
                want -= head[2]
                held.append(head)
                rest[:1] = [tail] if tail[2] else []
            self.emit(held)

    def take(self, task: int) -> pa.RecordBatch:
        rows, self.done = [(*r, task) for r in self.done], []
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(ARROW)], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, spaced: bool = True, end_id: int = 1, size: int = SEQUENCE,
         windows: int = WINDOWS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (little-endian uint32).

    ``tokenizer`` is a file path every executor has. Partitions are packed in the order their rows come.
    """
    def place(batches):
        task = TaskContext.get().partitionId()
        packer = Packer(size, windows, task << 33)
        for doc_ids, ids, counts in token_slices(batches, tokenizer, spaced, end_id):
            raw, at = memoryview(ids.astype("<u4").tobytes()), 0
            for doc, n in zip(doc_ids, counts.tolist()):
                packer.add((doc, 0, n, n, raw[at * ID_BYTES:(at + n) * ID_BYTES]))
                at += n
            for window in packer.open:  # what stays open keeps only its own bytes
                window[1] = [(*p[:4], bytes(p[4])) for p in window[1]]
            yield packer.take(task)
        rest = packer.merge()
        packer.done += [(doc, start, n, total, None, None, bytes(ids)) for doc, start, n, total, ids in rest]
        yield packer.take(task)

    def merge(frame: pa.Table) -> pa.Table:
        rows = frame.sort_by([("task", "ascending"), ("place", "ascending")]).to_pylist()
        packer = Packer(size, 1, (1 << 62) + (rows[0]["task"] // MERGE << 20))
        packer.open = [[0, [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids"]) for r in rows]]]
        packer.finish(packer.merge())
        return pa.Table.from_batches([packer.take(rows[0]["task"])])

    pieces = materialize(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(place, PIECES), "pieces")
    left = pieces.where("sequence_id is null").withColumn("place", F.monotonically_increasing_id())
    merged = left.groupBy(F.expr(f"task div {MERGE}")).applyInArrow(merge, PIECES)
    return pieces.where("sequence_id is not null").unionByName(merged).drop("task")
