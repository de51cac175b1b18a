"""Best-fit packing by hierarchical residual packing.

Every scan partition encodes its documents and packs the pieces best-fit; nearly full bins are final. The underfull
bins go up a tree: each round deals them to fewer tasks, which pack bins as items best-fit again. A task never gets
more than ITEMS bins; where more stay underfull, the tree ends with several tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
END = 0
#: A bin with at most this many free places is final before the last round.
NEARLY = 8
FAN_IN = 8
#: Underfull bins that one task may hold.
ITEMS = 250_000
SCHEMA = "size int, pieces binary"
#: One piece in a bin's binary: known says whether doc_id is there.
PIECE = [("known", "i1"), ("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<i8")]


def best_fit(items, capacity: int = CAPACITY):
    """Pack (size, bytes) best-fit, largest first; yields (size, bytes) of each bin."""
    bins: list[list] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit k: some bin has k places left
    for size, data in sorted(items, key=lambda x: -x[0]):
        fits = free >> size
        if size and fits:
            room = size + (fits & -fits).bit_length() - 1
            k = at[room].pop()
            if not at[room]:
                free &= ~(1 << room)
            bins[k][1].append(data)
            room -= size
        else:
            k, room = len(bins), capacity - size
            bins.append([0, [data]])
        bins[k][0] = capacity - room
        at[room].append(k)
        free |= 1 << room
    return ((size, b"".join(x)) for size, x in bins)


def cut(ids: bytes, capacity: int = CAPACITY):
    """(start, bytes) of the pieces of one document; only longer ones are cut, and the first takes the remainder."""
    n, at = len(ids) >> 2, 0
    while at < n:
        to = at + ((n - at) % capacity or capacity)
        yield at, ids[4 * at : 4 * to]
        at = to


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, items: int = ITEMS) -> DataFrame:
    """Pack all documents (doc_id, text), each followed by the end id, into sequences of at most `capacity` tokens.

    Returns a row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece. A null text is
    empty and packs its end id alone. Repeated rows are packed once each, rows without doc_id too. An empty table
    gives no rows. The result is read from tables written to the shared folder, so sequence_id and offset stay
    the same whichever executors are lost.
    """
    spark = docs.sparkSession

    def encode(batches):
        import pyarrow as pa

        import numpy as np

        enc, found, tail = tokens.encoder(path), [], end.to_bytes(4, "little")
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, ids in tokens.by_bytes(batch.column(1).to_pylist(), enc):
                for k, (start, data) in enumerate(cut(ids + tail, capacity)):
                    found.append((len(data) >> 2, np.array([(names[i] is not None, names[i] or 0, k, start, len(data) >> 2, tokens.crc(data))], PIECE).tobytes()))
        yield from _batches(best_fit(found, capacity), pa)

    def merge(batches):
        import pyarrow as pa

        yield from _batches(best_fit([x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], capacity), pa)

    def open_out(batches):
        import pyarrow as pa

        import numpy as np

        for b in batches:
            if not b.num_rows:
                continue
            blobs = b.column(1).to_pylist()
            rows = np.frombuffer(b"".join(blobs), PIECE)
            n = np.array([len(x) // np.dtype(PIECE).itemsize for x in blobs])
            first = np.repeat(np.cumsum(n) - n, n)
            places = np.cumsum(rows["length"]) - rows["length"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"], mask=rows["known"] == 0),
                    pa.array(rows["piece"]),
                    pa.array(rows["start"]),
                    pa.array(rows["length"].astype("i8")),
                    pa.array(rows["crc"]),
                    pa.array(np.repeat(np.asarray(b.column(2)), n)),
                    pa.array((places - places[first]).astype("i8")),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    bins = common.written(common.documents(docs).mapInArrow(common.giving_back(encode, "tokens"), SCHEMA), "bins")
    tasks, full, spent = max(1, bins.rdd.getNumPartitions()), [], []
    while True:
        under = bins.where(F.col("size") < capacity - NEARLY)
        n = under.count()
        full.append(bins.where(F.col("size") >= capacity - NEARLY))
        least = -(-n // items)
        to = max(1, least, -(-tasks // FAN_IN))
        if n == 0 or tasks == 1 or to == tasks:
            full.append(under)
            break
        spent.append(bins)
        bins = common.written(under.repartition(to).mapInArrow(common.giving_back(merge), SCHEMA), "bins")
        tasks = to
    last = full[0]
    for x in full[1:]:
        last = last.unionAll(x)
    numbered = common.written(last.withColumn("sequence_id", F.monotonically_increasing_id()), "sequences")
    common.drop(bins, *spent)
    return numbered.mapInArrow(common.giving_back(open_out), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _batches(found, pa, rows: int = 20_000):
    sizes, data = [], []
    for size, x in found:
        sizes.append(size)
        data.append(x)
        if len(sizes) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["size", "pieces"])
            sizes, data = [], []
    yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["size", "pieces"])
