"""Vector bin packing of logs into training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rankscope.llm import words as W
from rankscope.llm.tokens import encoder

SEQUENCE = 4096      # tokens
SEGMENTS = 128       # pieces of logs in a sequence
LOSS = 4096 - 1      # tokens that bear loss: all of a piece but its first, which has nothing before it
POOL = 1024          # logs that wait for a place
END = 2              # id after each log


class Packer:
    """Places pieces into sequences under limits on tokens, segments and loss-bearing tokens.

    The next piece of a sequence is, of those that fit, the one whose vector of demands has the largest dot product with
    what is left of the limits, both as shares of the limits. Where none fits the longest waiting one is cut.
    A sequence that cannot be filled ends at a power of two, which needs no padding; what is cut off waits on.
    """

    def __init__(self, sequence: int = SEQUENCE, segments: int = SEGMENTS, loss: int = LOSS):
        self.limits = np.array([sequence, segments, loss], np.float64)
        self.waiting: list[tuple[object, int, int]] = []  # log, place in it, tokens
        self.sizes = np.empty(0, np.int64)

    def add(self, log: object, tokens: int) -> Iterator[list[tuple[object, int, int]]]:
        """Sequences that the log fills alone; the rest of it waits."""
        room = int(min(self.limits[0], self.limits[2] + 1))
        start = 0
        if room == self.limits[0]:
            while tokens - start >= room:
                yield [(log, start, room)]
                start += room
        if start < tokens:
            self._wait(log, start, tokens - start)

    def _wait(self, log: object, start: int, size: int) -> None:
        self.waiting.append((log, start, size))
        self.sizes = np.append(self.sizes, size)

    def _take(self, i: int) -> tuple[object, int, int]:
        """Remove a waiting piece; the last one takes its place."""
        piece, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.sizes[i] = self.sizes[-1]
        self.sizes = self.sizes[:-1]
        return piece

    def fill(self) -> list[tuple[object, int, int]]:
        """The next sequence from what waits."""
        left, out = self.limits.copy(), []
        while self.waiting and left[0] >= 1 and left[1] >= 1 and left[2] >= 0:
            demand = np.stack([self.sizes, np.ones(len(self.sizes)), self.sizes - 1]) / self.limits[:, None]
            fits = (self.sizes <= left[0]) & (self.sizes - 1 <= left[2])
            if fits.any():
                i = int(np.argmax(np.where(fits, (left / self.limits) @ demand, -1)))
                piece = self._take(i)
            else:
                log, start, size = self._take(int(np.argmax(self.sizes)))
                part = int(min(left[0], left[2] + 1))
                self._wait(log, start + part, size - part)
                piece = (log, start, part)
            out.append(piece)
            left -= (piece[2], 1, piece[2] - 1)
        total = sum(size for _, _, size in out)
        if total < self.limits[0]:
            over = total - (1 << (total.bit_length() - 1))
            while over:
                log, start, size = out.pop()
                back = min(over, size)
                if back < size:
                    out.append((log, start, size - back))
                self._wait(log, start + size - back, back)
                over -= back
        return out


def pack_logs(logs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Pack the token ids of all logs into sequences of ``SEQUENCE`` tokens without padding.

    ``logs`` has ``log_id`` and ``log`` string; null is empty. A log is its ids and one ``END``. Each task packs the logs of its own
    partition while it reads them: at most ``POOL`` wait, and no row moves. A sequence shorter than ``SEQUENCE`` is as long as a power of two; there are a few of these per partition.

    Returns a row per piece: ``log_id``, ``start`` (ids of its log before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``log_tokens``,
    ``sequence_id`` (partition number times 2 to the 40 plus a count) and ``offset`` (ids before it in the sequence). Repeated and null ``log_id`` are
    packed row by row. No rows give no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer), Packer()
        number = TaskContext.get().partitionId() << 40
        names = ["log_id", "start", "length", "ids", "log_tokens", "sequence_id", "offset"]

        def rows(sequences: list) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in names]
            for sequence in sequences:
                offset = 0
                for (log_id, ids), start, length in sequence:
                    for column, value in zip(out, (log_id, start, length, ids[start:start + length].astype("<u4").tobytes(), len(ids), number, offset)):
                        column.append(value)
                    offset += length
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        for batch in W.blocks(batches, "log"):
            ids, begins = coder.encode(batch.column("log"))
            full = []
            for i, log_id in enumerate(batch.column("log_id").to_pylist()):
                own = np.append(ids[begins[i]:begins[i + 1]], np.uint32(END))
                full += packer.add((log_id, own), len(own))
                while len(packer.waiting) > POOL:
                    full.append(packer.fill())
            yield rows(full)
        while packer.waiting:
            yield rows([packer.fill()])

    return logs.select(F.col("log_id").cast("long").alias("log_id"), "log").mapInArrow(
        run, "log_id long, start long, length long, ids binary, log_tokens long, sequence_id long, offset long")
