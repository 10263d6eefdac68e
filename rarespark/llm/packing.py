"""Packing documents into token sequences by multiway differencing.

Each task cuts its documents into pieces and packs them in groups of about
``GROUP_WINDOWS`` windows, so nothing is shuffled, no group grows with the data
and a lost task is redone from its own input. Long documents give full windows;
what is left of each document, and every shorter one, is cut into pieces of at
most ``PIECE`` tokens. The Karmarkar-Karp step then starts with one partial
partition for each piece, and again and again merges the two with the largest
imbalance so that the fullest windows of the one meet the emptiest of the other.
If a window holds more than the capacity, the group is packed anew with one more
window.

Null text counts as empty (a document of one end token), a null ``doc_id`` stays
null, repeated rows are packed as often as they occur, an empty table gives no
sequence. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.rows import few_rows
from rarespark.llm.tokens import encoder

WINDOW = 2048
PIECE = 512
GROUP_WINDOWS = 192
# tokens by which a group should stay below its windows' capacity, for each window
MARGIN = 3

PIECES = "array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>>"
SCHEMA = f"sequence_id bigint, n_tokens bigint, padded_to bigint, input_ids binary, pieces {PIECES}"
_ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("padded_to", pa.int64()), ("input_ids", pa.binary()),
        ("pieces", pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset", "doc_tokens")]))),
    ]
)


def difference_partition(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers in each of ``windows`` subsets with nearly equal sums.

    A partial partition holds a sum and a set for each window, sums from high to
    low with the lowest subtracted. Sets are nodes of a binary forest: joining
    two of them makes a node.
    """
    n = len(sizes)
    if windows == 1 or n == 0:
        return [list(range(n))] + [[] for _ in range(windows - 1)]
    # joined sets are numbered from n on, in the order of these parts
    lefts, rights = [], []
    made = n
    # only the windows in use are kept; the others have sum 0 and no set
    heap = [(-size, i, np.array([size]), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heap[0]
        a, b = len(sums_a), len(sums_b)
        width = min(windows, a + b)
        apart = width - b  # windows that the second partition leaves alone
        sums, sets = np.zeros(width, np.int64), np.full(width, -1)
        sums[:a], sets[:a] = sums_a, sets_a
        sums[apart:] += sums_b[::-1]
        if a <= apart:
            sets[apart:] = sets_b[::-1]
        else:
            other, here = sets_b[::-1], sets[apart:]
            merged = np.maximum(here, other)
            both = np.flatnonzero(np.minimum(here, other) >= 0)
            if len(both):
                lefts.append(here[both]), rights.append(other[both])
                merged[both] = np.arange(made, made + len(both))
                made += len(both)
            sets[apart:] = merged
        down = (-sums).argsort(kind="stable")
        sums, sets = sums[down], sets[down]
        if width == windows:
            sums -= sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), order, sums, sets))
        order += 1
    left, right = (np.concatenate([np.empty(n, np.int64), *parts]).tolist() for parts in (lefts, rights))
    out = []
    for node in heap[0][3].tolist():
        items, stack = [], [node] if node >= 0 else []
        while stack:
            top = stack.pop()
            if top < n:
                items.append(top)
            else:
                stack += [left[top], right[top]]
        out.append(sorted(items))
    return out + [[] for _ in range(windows - len(out))]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers; one more window whenever one exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = difference_partition(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in packed):
            return [items for items in packed if items]
        windows += 1


class _Packer:
    """Sequences of one task."""

    def __init__(self, task: int, window: int, piece: int, group_windows: int):
        self.next_id = task << 33
        self.window, self.piece = window, piece
        self.full = group_windows * (window - MARGIN)
        self.waiting: list[tuple] = []
        self.size = 0
        self.rows: list[tuple] = []
        self.row_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.window:
            self._sequence([(doc_id, start, self.window, n, ids[4 * start : 4 * (start + self.window)])])
            start += self.window
        rest = n - start
        cuts = -(-rest // self.piece)
        for i in range(cuts):
            # equal parts, so that no document ends in a scrap of a few tokens
            a, b = start + rest * i // cuts, start + rest * (i + 1) // cuts
            if self.size + b - a > self.full:
                self.flush()
            self.waiting.append((doc_id, a, b - a, n, ids[4 * a : 4 * b]))
            self.size += b - a

    def flush(self) -> None:
        for items in pack_sizes([piece[2] for piece in self.waiting], self.window) if self.waiting else []:
            self._sequence([self.waiting[i] for i in items])
        self.waiting, self.size = [], 0

    def _sequence(self, pieces: list[tuple]) -> None:
        offset, said = 0, []
        for doc_id, start, length, doc_tokens, _ in pieces:
            said.append({"doc_id": doc_id, "start": start, "length": length, "offset": offset, "doc_tokens": doc_tokens})
            offset += length
        padded = offset if offset & (offset - 1) == 0 else self.window
        ids = b"".join(piece[4] for piece in pieces)
        self.rows.append((self.next_id, offset, padded, ids, said))
        self.row_bytes += len(ids)
        self.next_id += 1

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.row_bytes >= least:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), _ARROW)]
            self.rows, self.row_bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def pack_documents(
    docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 1, window: int = WINDOW, piece: int = PIECE,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """One row per sequence: its ids (little-endian unsigned 32-bit, without
    padding), the length to pad to, and the document pieces it is made of.

    ``vocabulary`` is a tokenizers file that every executor can read.
    """
    end = array("I", [end_id]).tobytes()

    def pack(batches):
        from pyspark import TaskContext

        encode = encoder(vocabulary, kind).encode
        packer = _Packer(TaskContext.get().partitionId(), window, piece, group_windows)
        for batch in few_rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, encode(text) + end)
                yield from packer.take(8 << 20)
        packer.flush()
        yield from packer.take(0)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(pack, SCHEMA)


def piece_rows(sequences: DataFrame) -> DataFrame:
    """One row per document piece, with the checksum of its ids as they lie in the sequence."""
    each = sequences.select("sequence_id", "input_ids", F.explode("pieces").alias("p"))
    part = F.expr("substring(input_ids, CAST(4 * p.offset + 1 AS INT), CAST(4 * p.length AS INT))")
    return each.select(
        "p.doc_id", "p.start", "p.length", F.crc32(part).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset"
    )
