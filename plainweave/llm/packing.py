"""Cost-balanced packing of tokenised documents into sequences of at most ``capacity`` tokens.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention within a piece). A task
packs what it reads in blocks of about ``block_tokens`` tokens, so nothing is shuffled:

* a document's full pieces of ``capacity`` tokens are sequences of their own;
* the block's remainders, longest first, each go to the lowest-cost sequence that still has room for
  them. Only if none has, a remainder is cut, and fills the sequence with the most room first.
* A block opens as many full sequences as its remainders fill, and one of each
  power of two in what is left over. All of them end up full, so nothing is padded.

Nulls: a null text is empty; it, like an empty one, still has the end token. Repeated rows are documents of their own.
A null doc_id is returned as null. Remainders of equal length go in the order in which they were read, and of sequences of equal cost the first takes one.
A long text is cut into full sequences; its ids are one array in its task. An empty table gives an empty result. Columns other than doc_id and text are not read, whatever their names.
Where a block ends depends on how the table is split into tasks; what each piece holds, and that nothing is padded, doesn't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainweave.llm.ragged import SMALL_CHUNK_BYTES, chunks, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places pieces of fewer than ``capacity`` tokens: rows (piece, start in it, length, sequence, offset) and the number of sequences."""
    total = int(lengths.sum())
    bits = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if bits >> b & 1], np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out = []
    for i in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[i])
        while left:
            s = int(np.where(room >= left, cost, np.inf).argmin())
            if room[s] < left:
                s = int(room.argmax())
            n = min(left, int(room[s]))
            out.append((int(i), start, n, s, int(used[s])))
            room[s] -= n
            used[s] += n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out, len(room)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: where it is in its document and in which sequence at which offset, see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plainweave.llm.bpe import Bpe

        bpe, base, made = Bpe(tokenizer), TaskContext.get().partitionId() << 40, 0
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

        def block(held: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
            nonlocal made
            rows = []

            def row(k: int, start: int, n: int, sequence: int, offset: int) -> None:
                doc_id, ids = held[k]
                rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), base + sequence, offset))

            full = np.array([len(ids) // capacity * capacity for _, ids in held], np.int64)
            for k, n in enumerate(full):
                for start in range(0, n, capacity):
                    row(k, start, capacity, made, 0)
                    made += 1
            rest = np.array([len(ids) for _, ids in held], np.int64) - full
            placed, sequences = place(rest, capacity)
            for k, start, n, s, offset in placed:
                row(k, int(full[k]) + start, n, made + s, offset)
            made += sequences
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

        held, tokens = [], 0
        for batch, _, _ in chunks(batches, most=SMALL_CHUNK_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts), strict=True):
                held.append((doc_id, np.append(ids, np.uint32(end_id))))
                tokens += len(ids) + 1
                if tokens >= block_tokens:
                    yield block(held)
                    held, tokens = [], 0
        if held:
            yield block(held)
        del bpe, held
        tidy()

    return docs.select("doc_id", F.col("text")).mapInArrow(run, SCHEMA)
