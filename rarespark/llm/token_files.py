"""Token files: one zstandard frame per document, a shared dictionary, an index.

A folder holds ``dictionary`` and one file per shard. A shard has, in this order:

    magic "RTOK1\\0\\0\\0" | sha256 of the dictionary (32 bytes) | frames
    doc_ids int64[n] | null marks uint8[n] | frame ends uint64[n] | token counts uint64[n]
    n uint64 | bytes per id uint64 | magic

so that one document costs two small reads and the decompression of its own
frame. The dictionary is trained on serialized id arrays of at most
``SAMPLE_DOCS`` documents, those whose ``doc_id`` has the lowest hashes, with at
most ``SAMPLE_IDS`` ids of each; every document is encoded whole.

Shards follow ascending ``doc_id`` (nulls first, then by the text's hash among
equal ids). A shard is named by a random name, and only the names that finished
tasks report are in the manifest, so a task that is run again leaves no trace.
Null text is an empty document with its end id only; repeated rows are written
as often as they occur; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rarespark.llm.rows import KEY, keyed
from rarespark.llm.tokens import encoder
from rarespark.session import materialize

MAGIC = b"RTOK1\0\0\0"
SAMPLE_DOCS = 1_000
SAMPLE_IDS = 16_384
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
MANIFEST = "first_id bigint, first_hash bigint, path string, n_docs bigint, n_tokens bigint, dictionary string"


def _open(path: str, mode: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if mode == "r":
        return store.open_input_file(name)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return store.open_output_stream(name)


def _uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{folder}"


def train_dictionary(docs: DataFrame, vocabulary: str, kind: str, width: int = 2) -> bytes:
    """Dictionary bytes (empty if there is too little text to train on)."""
    import zstandard

    ids = keyed(docs).select(*KEY)
    chosen = ids.orderBy(F.xxhash64(*KEY), *KEY).limit(SAMPLE_DOCS).distinct()
    # at most SAMPLE_DOCS keys
    texts = keyed(docs).join(F.broadcast(chosen), KEY, "left_semi").select("text")

    def encode(batches):
        code = encoder(vocabulary, kind).encode
        for batch in batches:
            some = [_narrow(code(text)[: 4 * SAMPLE_IDS], width) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["ids"])

    samples = [bytes(row.ids) for row in texts.mapInArrow(encode, "ids binary").limit(SAMPLE_DOCS).collect() if row.ids]
    samples.sort()
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()


def _narrow(ids: bytes, width: int) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >> 8 * width:
        raise ValueError(f"id {wide.max()} does not fit {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def id_width(vocabulary: str, end_id: int, vocabulary_size: int | None = None) -> int:
    """Bytes that hold all ids of the tokenizer file, added ones too, and the end id."""
    from tokenizers import Tokenizer

    last = max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(last, end_id, (vocabulary_size or 1) - 1) < 1 << 16 else 4


class _Shard:
    def __init__(self, folder: str, dictionary: bytes, width: int):
        import zstandard

        self.path = f"{folder}/{uuid.uuid4().hex}.rtok"
        self.file = _open(self.path, "w")
        self.file.write(MAGIC + hashlib.sha256(dictionary).digest())
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        self.width, self.at = width, 0
        self.doc_ids, self.nulls, self.ends, self.counts = array("q"), array("B"), array("Q"), array("Q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(_narrow(ids, self.width))
        self.file.write(frame)
        self.at += len(frame)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.at)
        self.counts.append(len(ids) // 4)

    def close(self) -> None:
        for column in (self.doc_ids, self.nulls, self.ends, self.counts):
            self.file.write(column.tobytes())
        self.file.write(struct.pack("<QQ", len(self.counts), self.width) + MAGIC)
        self.file.close()


class ShardReader:
    """Reads single documents or all documents of a shard."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        self.file = _open(path, "r")
        size = self.file.size()
        head = self.file.read_at(len(MAGIC) + 32, 0)
        foot = self.file.read_at(24, size - 24)
        if head[:8] != MAGIC or foot[16:] != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        n, self.width = struct.unpack("<QQ", foot[:16])
        index = self.file.read_at(25 * n, size - 24 - 25 * n)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n)
        self.ends = np.frombuffer(index, "<u8", n, 9 * n)
        self.counts = np.frombuffer(index, "<u8", n, 17 * n)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def ids(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document of the shard."""
        start = int(self.ends[i - 1]) if i else 0
        frame = self.file.read_at(int(self.ends[i]) - start, len(MAGIC) + 32 + start)
        return np.frombuffer(self.decompress(frame), f"<u{self.width}").astype("<u4")


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, kind: str = "byte", end_id: int = 2, vocabulary_size: int | None = None
) -> DataFrame:
    """Write all documents; returns the manifest, one row per shard (stored, so it can be read again).

    The width of the ids follows from the tokenizer file; ``vocabulary_size`` can only raise it."""
    folder = _uri(folder)
    width = id_width(vocabulary, end_id, vocabulary_size)
    dictionary = train_dictionary(docs, vocabulary, kind, width)
    with _open(f"{folder}/dictionary", "w") as file:
        file.write(dictionary)
    said = hashlib.sha256(dictionary).hexdigest()
    end = array("I", [end_id]).tobytes()

    def write(batches):
        shard = first = None
        code = encoder(vocabulary, kind).encode
        with _open(f"{folder}/dictionary", "r") as file:
            shared = file.read()
        for batch in batches:
            for doc_id, text, key, th in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard is None:
                    shard, first = _Shard(folder, shared, width), (key, th)
                shard.add(doc_id, code(text) + end)
        if shard is not None:
            shard.close()
            row = (*first, shard.path, len(shard.counts), sum(shard.counts), said)
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST, row))])

    ordered = keyed(docs).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


_MANIFEST = ["first_id", "first_hash", "path", "n_docs", "n_tokens", "dictionary"]


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of every document, a task per shard.

    ``start`` counts the ids of all documents before it. The running sum over
    the manifest has one row per shard, not per document.
    """
    folder = _uri(folder)
    before = Window.orderBy("first_id", "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = shards.select("path", "base", F.monotonically_increasing_id().alias("i"))

    def read(batches):
        with _open(f"{folder}/dictionary", "r") as file:
            dictionary = file.read()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, rows, size = ShardReader(path, dictionary), [], 0
                for i in range(len(shard.counts)):
                    ids = shard.ids(i)
                    if len(ids) != shard.counts[i]:
                        raise ValueError(f"{path}: document {i} is damaged")
                    doc_id = None if shard.nulls[i] else int(shard.doc_ids[i])
                    rows.append((doc_id, start, len(ids), ids.tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    tasks = manifest.count()
    spread = shards.repartition(max(1, tasks), "i").select("path", "base")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])


def read_document(manifest: DataFrame, folder: str, doc_id: int) -> list[int] | None:
    """Ids of one document: the manifest names the shard, its index the frame."""
    row = manifest.where(F.col("first_id") <= doc_id).orderBy(F.desc("first_id"), F.desc("first_hash")).first()
    if row is None:
        return None
    with _open(f"{_uri(folder)}/dictionary", "r") as file:
        shard = ShardReader(row.path, file.read())
    found = np.flatnonzero((shard.doc_ids == doc_id) & (shard.nulls == 0))
    return shard.ids(int(found[0])).tolist() if len(found) else None


