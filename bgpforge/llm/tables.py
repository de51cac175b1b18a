"""Token ids in sorted-string-table shards.

A shard holds documents in key order. Layout: data blocks, bloom filter, block index, footer.

* key: doc_id as 8 bytes, big-endian with the sign bit flipped, so bytes sort as numbers; a missing doc_id is the empty
  key, which sorts first. Equal keys may repeat.
* entry: u8 bytes shared with the key before it in the block, u8 further key bytes, u8 width of an id (2 or 4), u32
  number of ids, the further key bytes, the ids little-endian. A block restarts at shared = 0 and is zstandard-compressed.
* index: for each block u8 key length, its first key, u64 offset, u32 stored bytes, u32 documents, u64 ids before it.
* Bloom filter: u32 bits, then the bit array; HASHES positions from the halves of xxh3-64 of the key.
* footer: u64 offset of the filter, u64 offset of the index, u64 documents, u64 ids, 8 magic bytes.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"SSTIDS01"
BLOCK = 1 << 18
SHARD = 1 << 28
HASHES = 6
BITS_A_KEY = 10
_FOOT = struct.Struct("<QQQQ8s")
_ENTRY = struct.Struct("<BBBI")
_SPAN = struct.Struct("<QIIQ")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _spots(key: bytes, bits: int):
    import xxhash

    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Writes one shard to an open binary stream; add() takes documents in key order."""

    def __init__(self, out):
        import zstandard

        self.out, self.at, self.block, self.index, self.keys = out, 0, bytearray(), [], []
        self.last, self.docs, self.ids, self.pack = b"", 0, 0, zstandard.ZstdCompressor(level=1)
        self.opened: tuple[bytes, int, int] | None = None

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import numpy as np

        key = key_of(doc_id)
        if self.opened is None:
            self.opened, self.last = (key, self.ids, self.docs), b""
        shared = next((i for i, (x, y) in enumerate(zip(self.last, key, strict=False)) if x != y), min(len(self.last), len(key)))
        wide = np.frombuffer(ids, "<u4")
        width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
        self.block += _ENTRY.pack(shared, len(key) - shared, width, len(wide)) + key[shared:] + (wide.astype("<u2").tobytes() if width == 2 else ids)
        self.keys.append(key)
        self.last = key
        self.docs += 1
        self.ids += len(wide)
        if len(self.block) >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        if self.opened is not None:
            data = self.pack.compress(bytes(self.block))
            key, before, docs = self.opened
            self.index.append(bytes([len(key)]) + key + _SPAN.pack(self.at, len(data), self.docs - docs, before))
            self.out.write(data)
            self.at += len(data)
            self.block, self.opened = bytearray(), None

    def close(self) -> None:
        self._close_block()
        bits = max(64, BITS_A_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for x in _spots(key, bits):
                bloom[x >> 3] |= 1 << (x & 7)
        filter_at = self.at
        index_at = filter_at + 4 + len(bloom)
        self.out.write(struct.pack("<I", bits) + bytes(bloom) + b"".join(self.index) + _FOOT.pack(filter_at, index_at, self.docs, self.ids, MAGIC))


class Reader:
    """Reads a shard from a seekable binary stream of known size."""

    def __init__(self, source, size: int):
        self.source = source
        filter_at, index_at, self.docs, self.ids, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        data = self._at(filter_at, index_at - filter_at)
        self.bits, self.bloom = struct.unpack_from("<I", data)[0], data[4:]
        self.blocks, data, at = [], self._at(index_at, size - _FOOT.size - index_at), 0
        while at < len(data):
            n = data[at]
            self.blocks.append((data[at + 1 : at + 1 + n], *_SPAN.unpack_from(data, at + 1 + n)))
            at += 1 + n + _SPAN.size

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, block):
        import numpy as np
        import zstandard

        _, at, n, _, before = block
        data, key, at = zstandard.ZstdDecompressor().decompress(self._at(at, n)), b"", 0
        while at < len(data):
            shared, more, width, count = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + more]
            at += more
            ids = np.frombuffer(data, f"<u{width}", count, at).astype("<u4").tobytes()
            at += width * count
            yield key, before, ids
            before += count

    def __iter__(self):
        """(doc_id, ids of the shard before it, ids as bytes) of every document."""
        for block in self.blocks:
            for key, before, ids in self._entries(block):
                yield id_of(key), before, ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document with this doc_id: Bloom filter, binary search of the index, then one block or few."""
        from bisect import bisect_left

        key = key_of(doc_id)
        if not all(self.bloom[x >> 3] >> (x & 7) & 1 for x in _spots(key, self.bits)):
            return []
        first = max(0, bisect_left([b[0] for b in self.blocks], key) - 1)
        out = []
        for block in self.blocks[first:]:
            if block[0] > key:
                break
            out += [ids for k, _, ids in self._entries(block) if k == key]
        return out


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_tables(docs: DataFrame, tokenizer: str, end: int, folder: str) -> DataFrame:
    """Encode documents (doc_id, text), append the end id to each, and write shards in ascending doc_id order.

    Returns the manifest (part, file, path, first_id, docs, ids), itself written to the shared folder. Texts, not ids,
    are range-partitioned: one shuffle. A null text is empty; documents without doc_id come first; repeated rows
    are all kept, ordered by text. A task writes under a name of its own attempt and renames, so a repeated task leaves one file.
    """

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        part, enc, tail, done = TaskContext.get().partitionId(), tokens.encoder(tokenizer), end.to_bytes(4, "little"), []
        writer = stream = None

        def finish():
            writer.close()
            stream.close()
            name = f"{base}/shard-{part:06}-{len(done):04}.sst"
            files.move(temp, name)
            done.append((part, len(done), f"{folder}/{name.rsplit('/', 1)[1]}", first, writer.docs, writer.ids))

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, ids in tokens.by_bytes(batch.column(1).to_pylist(), enc):
                if writer is None:
                    temp, first = f"{base}/.writing-{uuid.uuid4().hex}", names[i]
                    stream = files.open_output_stream(temp)
                    writer = Writer(stream)
                writer.add(names[i], ids + tail)
                if writer.at >= SHARD:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["part", "file", "path", "first_id", "docs", "ids"],
        )

    ordered = common.documents(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return common.written(ordered.mapInArrow(write, "part int, file int, path string, first_id long, docs long, ids long"), "manifest")


def read_tables(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read shards back: a row (doc_id, start, n_tokens, ids_crc32, ids) for each document, start counting over all shards; without ids on demand.

    The driver takes the manifest's one row for each shard file (SHARD bytes of stored ids, so few) to place the shards.
    """
    shards, start = [], 0
    for row in manifest.orderBy("part", "file").collect():
        shards.append((row["path"], start))
        start += row["ids"]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, before = shards[k]
                files, name = _files(path)
                with files.open_input_file(name) as source:
                    held, size = [], 0
                    for doc_id, at, ids in Reader(source, source.size()):
                        held.append((doc_id, before + at, len(ids) >> 2, tokens.crc(ids), *([ids] if with_ids else [])))
                        size += len(ids) if with_ids else 64
                        if size >= 1 << 22:
                            yield _rows(held, pa, with_ids)
                            held, size = [], 0
                    yield _rows(held, pa, with_ids)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _rows(held, pa, with_ids):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])
