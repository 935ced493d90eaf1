"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier. Layout, all numbers little-endian::

    block*   zstd frame of entries; an entry is varint shared, varint unshared, varint length of the value, the
             unshared end of the key, the value (a width byte, 2 or 4, and the ids in that width)
    index    per block: varint length of its first key, the key, u64 offset, u32 length, u32 crc32, u32 entries
    bloom    u32 number of hashes, then the bits
    footer   u64 offset and length of the index, of the filter; u64 documents, u64 ids; 8 bytes of magic

A key is one byte 0 for a null identifier, or byte 1 and the identifier big-endian with its sign bit turned, so
that keys sort as identifiers do. A lookup asks the filter, searches the index by bisection and reads one block
(more if identifiers repeat). A task streams its shard to the shared folder under a name of its own; only shards
that the manifest of successful tasks names are ever read, so retried and speculative tasks do no harm.

Rows are dealt to shards by ranges of the identifier, then of a hash of the text, then of the row's place in the
input, so neither one identifier (or none) nor one repeated row can fill a shard; the manifest keeps the shards' order.
A null text is one end id, and so is an empty one; repeated rows are repeated entries; texts of any length are encoded
whole; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.llm.common import Work, over_batches
from tarnworks.llm.tokens import encoder

MAGIC = b"TWSST\x00\x01\n"
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, HASHES = 10, 7
FOOTER = struct.Struct("<6Q8s")
PLACE = struct.Struct("<QIII")
END = b"\x00\x00\x00\x00"
MANIFEST = "shard int, path string, first binary, last binary, n_docs long, n_tokens long, n_bytes long"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n, shift, at = n | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return n, at


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (int(doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def packed(ids: bytes) -> bytes:
    """Ids given in 32 bits, in 16 if all fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if len(wide) and int(wide.max()) < 1 << 16 else b"\x04" + ids


def unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + k * b) % bits for k in range(HASHES)]


class ShardWriter:
    def __init__(self, sink):
        self.sink, self.offset, self.places, self.keys = sink, 0, [], []
        self.n_docs = self.n_tokens = 0
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.fresh()

    def fresh(self) -> None:
        self.block, self.last, self.first, self.entries, self.held = [], b"", None, 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        for a, b in zip(self.last, key):
            if a != b:
                break
            shared += 1
        value = packed(ids)
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.first = key if self.first is None else self.first
        self.last, self.entries, self.held = key, self.entries + 1, self.held + len(entry)
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(ids) // 4
        self.keys.append(key)
        if self.held >= BLOCK_BYTES:
            self.flush()

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def flush(self) -> None:
        if self.block:
            data = self.compress(b"".join(self.block))
            self.places.append((self.first, self.offset, len(data), zlib.crc32(data), self.entries))
            self.put(data)
            self.fresh()

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + PLACE.pack(*place) for k, *place in self.places)
        bits = max(64, BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = self.offset
        self.put(index)
        self.put(struct.pack("<I", HASHES) + bytes(bloom))
        self.put(FOOTER.pack(at, len(index), at + len(index), len(bloom) + 4, self.n_docs, self.n_tokens, MAGIC))


class ShardReader:
    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        index, n_index, bloom, n_bloom, self.n_docs, self.n_tokens, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        data, at, self.blocks = self.part(index, n_index), 0, []
        while at < len(data):
            n, at = read_varint(data, at)
            self.blocks.append((data[at : at + n], *PLACE.unpack_from(data, at + n)))
            at += n + PLACE.size
        self.bloom = self.part(bloom, n_bloom)[4:]
        self.firsts = [b[0] for b in self.blocks]

    def part(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def entries(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, crc, count = self.blocks[k]
        data = self.part(offset, length)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data), 0, b""
        for _ in range(count):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self.entries(k):
                yield id_of(key), unpacked(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier."""
        key, bits = key_of(doc_id), len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, bits)):
            return []
        found, k = [], max(0, bisect_left(self.firsts, key) - 1)
        while k < len(self.blocks) and self.firsts[k] <= key:
            found += [unpacked(v) for name, v in self.entries(k) if name == key]
            k += 1
        return found


def write_shards(docs: DataFrame, work: Work, vocabulary: str, shards: int | None = None) -> DataFrame:
    """Encode all of ``docs`` (doc_id, text) into shards under the work folder; returns their manifest.

    A null text is empty; each document ends with id 0. Equal identifiers follow each other, ordered by a hash of the
    text, in one shard or in several that follow each other.
    """
    root = work.path("shards")
    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))

    def run(batches):
        sink = writer = None
        encode = encoder(vocabulary).encode
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                key = key_of(doc_id)
                if writer is None:
                    fs, folder = pafs.FileSystem.from_uri(root)
                    fs.create_dir(folder, recursive=True)
                    name, first = f"{uuid.uuid4().hex}.sst", key
                    sink = fs.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(sink)
                writer.add(key, encode(text) + END)
        if writer is not None:
            writer.close()
            sink.close()
            shard = TaskContext.get().partitionId()
            yield {"shard": [shard], "path": [f"{root}/{name}"], "first": [first], "last": [key], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_bytes": [writer.offset]}

    place = F.monotonically_increasing_id()  # tells apart only rows that are equal in both columns
    dealt = kept.withColumn("place", place).repartitionByRange(shards or kept.rdd.getNumPartitions(), "doc_id", "h", "place")
    return work.cut(over_batches(dealt.sortWithinPartitions("doc_id", "h").select("doc_id", "text"), run, MANIFEST), "manifest")


def shards_of(manifest: DataFrame, doc_id: int | None) -> list[str]:
    """Paths of the shards whose range of keys holds an identifier, in order: those that a lookup asks."""
    key = bytearray(key_of(doc_id))
    return [r.path for r in manifest.where((F.col("first") <= F.lit(key)) & (F.col("last") >= F.lit(key))).orderBy("shard").collect()]


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards that ``manifest`` names."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                rows: list[tuple] = []
                for doc_id, ids in ShardReader(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield framed(rows)
                        rows = []
                if rows:
                    yield framed(rows)

    def framed(rows):
        return dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*rows)))

    n = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return over_batches(placed.select("path", "start").repartition(n, "path"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str) -> DataFrame:
    work = Work(docs.sparkSession, "sstable")
    return read_shards(write_shards(docs, work, vocabulary))
