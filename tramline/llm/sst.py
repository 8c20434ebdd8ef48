"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers:

    block*   entries of (varint shared key bytes, varint further key bytes,
             varint value bytes, further key bytes, value), then a crc32
    index    per block: its last key, offset and size
    bloom    a Bloom filter over the keys
    footer   offsets, counts, width of an id, magic

Keys are big-endian with the sign bit flipped, so bytes sort as numbers do, and
keys share prefixes within a block.  A document without an identifier has the
empty key, which comes first.  Values are little-endian ids of 2 bytes, or
4 where the vocabulary needs them.  A lookup asks the Bloom filter, searches the
index by halves and scans one block.

Shards are written by executors into a folder that all of them share, each
attempt under a name of its own; only shards that the manifest names count, so
a task that runs twice does no harm.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm import bpe
from tramline.llm import kernel as K
from tramline.llm.graph import Scratch, shared_dir

MAGIC = b"TLSST\x00\x00\x01"
_FOOTER = struct.Struct("<QQQQQIIQ8s")  # index, bloom, blocks, documents, ids, width, hashes, Bloom bytes
_INDEX = struct.Struct(">8sQI")
_MANIFEST = "shard int, path string, n_docs long, n_ids long, first long, last long, bytes long"


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_value(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, width: int, block_bytes: int = 1 << 16, bits_per_key: int = 10) -> None:  # noqa: ANN001
        self.sink, self.width, self.block_bytes, self.bits_per_key = sink, width, block_bytes, bits_per_key
        self.block, self.size, self.last, self.offset = [], 0, b"", 0
        self.index: list[bytes] = []
        self.keys: list[int] = []
        self.n_docs = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_bytes(doc_id), ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        while self.block and shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.n_docs += 1
        if doc_id is not None:
            self.keys.append(doc_id)
        self.n_ids += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.sink.write(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append(_INDEX.pack(self.last or key_bytes(-(1 << 63)), self.offset, len(data)))
            self.offset += len(data) + 4
            self.block, self.size = [], 0

    def close(self) -> int:
        """Index, Bloom filter and footer; returns the shard's bytes."""
        self._flush()
        index = b"".join(self.index)
        hashes = max(1, round(self.bits_per_key * 0.69))
        bloom = _bloom(np.array(self.keys, np.int64), len(self.keys) * self.bits_per_key // 8 + 8, hashes)
        self.sink.write(index + bloom)
        self.sink.write(
            _FOOTER.pack(self.offset, self.offset + len(index), len(self.index), self.n_docs, self.n_ids, self.width, hashes, len(bloom), MAGIC)
        )
        return self.offset + len(index) + len(bloom) + _FOOTER.size


def _places(keys: np.ndarray, size: int, hashes: int) -> np.ndarray:
    a, b = K.mix(keys.view(K.U64), 1), K.mix(keys.view(K.U64), 2) | K.U64(1)
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=K.U64)) % K.U64(size * 8)


def _bloom(keys: np.ndarray, size: int, hashes: int) -> bytes:
    bits = np.zeros(size * 8, np.uint8)
    bits[_places(keys, size, hashes).ravel().astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class ShardReader:
    """Reads a shard by blocks; holds only its index and Bloom filter."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        index, bloom, blocks, self.n_docs, self.n_ids, self.width, self.hashes, bloom_size, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(index)
        self.index = list(_INDEX.iter_unpack(source.read(blocks * _INDEX.size)))
        source.seek(bloom)
        self.bloom = source.read(bloom_size)

    def _block(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        _, offset, size = self.index[i]
        self.source.seek(offset)
        data = self.source.read(size + 4)
        if zlib.crc32(data[:size]) != struct.unpack("<I", data[size:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < size:
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key_value(key), np.frombuffer(data, f"<u{self.width}", length // self.width, at).astype("<u4")
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_contain(self, doc_id: int) -> bool:
        place = _places(np.array([doc_id], np.int64), len(self.bloom), self.hashes)[0]
        return all(self.bloom[int(p) >> 3] >> (int(p) & 7) & 1 for p in place)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents with this identifier."""
        out: list[np.ndarray] = []
        if not self.may_contain(doc_id):
            return out
        key = key_bytes(doc_id)
        i = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        while i < len(self.index):
            last = doc_id
            for found, ids in self._block(i):
                last = doc_id if found is None else found
                if found == doc_id:
                    out.append(ids)
            if last > doc_id:
                break
            i += 1
        return out


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int | None, block_bytes: int) -> Iterator[pa.RecordBatch]:
    v = bpe.vocabulary(path)
    width = 2 if max(len(v.names), (end_id or 0) + 1) <= 1 << 16 else 4
    end = np.array([] if end_id is None else [end_id], np.int32)
    store, base = fs.FileSystem.from_uri(folder)
    shard = TaskContext.get().partitionId()
    name = f"{base}/shard-{shard:05d}-{uuid.uuid4().hex}.sst"
    writer = sink = None
    for whole in batches:
        for batch in K.slices(whole, most=1 << 19):
            if writer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(name)
                writer = ShardWriter(sink, width, block_bytes)
            docs = batch.column("doc_id").to_pylist()
            for doc, ids in zip(docs, bpe.encode_texts(v, [t or "" for t in batch.column("text").to_pylist()]), strict=True):
                writer.add(doc, np.concatenate([ids, end]))
    if writer is not None:
        size = writer.close()
        sink.close()
        scheme = folder[: -len(base)] if folder.endswith(base) else ""
        yield pa.RecordBatch.from_pylist(
            [
                {"shard": shard, "path": scheme + name, "n_docs": writer.n_docs, "n_ids": writer.n_ids, "bytes": size}
                | ({"first": writer.keys[0], "last": writer.keys[-1]} if writer.keys else {})
            ],
            schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "first", "last", "bytes"))]),
        )


def _open(path: str) -> ShardReader:
    store, name = fs.FileSystem.from_uri(path)
    return ShardReader(store.open_input_file(name))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        docs, starts, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
            names=["doc_id", "start", "n_tokens", "ids"],
        )

    for shards in batches:
        for shard in shards.to_pylist():
            at, rows, size = shard["start"], [], 0
            for doc, ids in _open(shard["path"]):
                rows.append((doc, at, ids))
                at, size = at + len(ids), size + len(ids)
                if size > 1 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def write_shards(
    documents: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, block_bytes: int = 1 << 16
) -> DataFrame:
    """Encode all texts and write them in ascending order of their identifiers; returns the manifest.

    The manifest has one row per shard: shard, path, n_docs, n_ids, first, last
    and bytes; first and last are null in a shard of rows without identifiers.
    end_id, if given, is appended to each document.  Null texts count as empty and
    texts of any length are written whole.  Rows without an identifier come first
    and can be read but not looked up; rows that repeat one are all kept, next to
    each other, in the order of their texts' hashes.  Other columns are left out.
    An empty table gives an empty manifest.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The texts' hashes deal out what repeats one identifier or has none.
    sorted_ = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return Scratch(spark).keep(sorted_.mapInArrow(lambda it: _write(it, folder, path, end_id, block_bytes), _MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; start counts the ids of all documents before."""
    shards = manifest.select("shard", "path", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = shards.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted identifiers, by Bloom filter and binary search in the shards that may hold them.

    The driver reads the manifest, one row per file, as it does for any table's files.
    """
    files = sorted((r["first"], r["last"], r["path"]) for r in manifest.select("first", "last", "path").where("first IS NOT NULL").toLocalIterator())
    lows = [f[0] for f in files]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc in b.column(0).to_pylist():
                i = bisect.bisect_right(lows, doc) - 1
                while i >= 0 and files[i][1] >= doc:
                    rows.append((doc, files[i][2]))
                    i -= 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "path"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for b in batches:
            rows = []
            for doc, file in zip(b.column("doc_id").to_pylist(), b.column("path").to_pylist(), strict=True):
                if file != path:
                    path, reader = file, _open(file)
                rows += [(doc, x.tobytes()) for x in reader.get(doc)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "ids"])

    keys = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return keys.mapInArrow(place, "doc_id long, path string").repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(fetch, "doc_id long, ids binary")
