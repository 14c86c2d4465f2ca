"""Token-id output: best-fit-decreasing packing into rows of a fixed length.

Documents longer than a row are split into full rows and a rest, so no token is
lost. Within a window of ``WINDOW_TOKENS`` tokens of a partition, segments go in
decreasing order to the fullest row that takes them, found by a segment tree
over remaining capacities. Windows are packed where they are read: there is no
shuffle, and memory is one window whatever the partition is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.llm.bpe import TOKENIZER_DIR, bpe
from logdistill.llm.common import slices

LENGTH = 2048
PAD = 50_256
WINDOW_TOKENS = 4_000_000
TOKENIZER = "byte_bpe_50k"
ROWS = pa.schema(
    [
        ("row_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("parts", pa.list_(pa.int32())),
    ]
)
DDL = "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>"


class Capacities:
    """Segment tree over capacities 0..length; a node tells how many rows have room in its range."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) with the least room that is at least ``need``."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of the segments in each row; every size is from 1 to ``length``. Equal sizes keep their order."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_rows.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            open_rows.add(room - sizes[i], row)
    return rows


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position of every token of a row, starting again at each segment; padding has 0."""
    out = np.zeros(length, dtype=np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out


def pack(
    docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, directory: str = TOKENIZER_DIR, pad: int = PAD,
    window: int = WINDOW_TOKENS,
) -> DataFrame:
    """Rows of ``length`` ids from ``docs(doc_id, text)``.

    ids: the row's ids as little-endian uint16 (uint32 if an id needs it), padded
    with ``pad``; cu_seqlens: 0 and the end of each segment; position_resets: where
    positions start at 0 again (a later part of a split document also starts at 0);
    doc_ids and parts: whose segment it is, and which part of the document, from 0.
    Null and empty texts have no tokens and no segment. Repeated rows are packed
    as often as they come. row_id is unique within the result.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe(tokenizer, directory)
        kind = "<u2" if max(tok.vocabulary, pad) < 1 << 16 else "<u4"
        seq = TaskContext.get().partitionId() << 36
        segments: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            rows = best_fit([len(x) for _, _, x in segments], length)
            for k in range(0, len(rows), 512):
                cols: list[list] = [[] for _ in ROWS]
                for row in rows[k : k + 512]:
                    parts = [segments[i] for i in row]
                    ends = np.cumsum([len(x) for _, _, x in parts]).tolist()
                    line = np.full(length, pad, dtype=kind)
                    line[: ends[-1]] = np.concatenate([x for _, _, x in parts])
                    values = (seq, ends[-1], line.tobytes(), [0, *ends], [0, *ends[:-1]], [d for d, _, _ in parts], [p for _, p, _ in parts])
                    for c, v in zip(cols, values):
                        c.append(v)
                    seq += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROWS)], schema=ROWS)

        for b in slices(it):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.frombuffer(tok.ids(text), dtype="<i4").astype(kind)
                for part, at in enumerate(range(0, len(ids), length)):
                    segments.append((doc, part, ids[at : at + length]))
                held += len(ids)
                if held >= window:
                    yield from flush()
                    segments, held = [], 0
        if segments:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, DDL)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the rows as Parquet; ``ids`` of a file read in order is a matrix of fixed-length rows."""
    packed.write.mode("overwrite").parquet(path)
