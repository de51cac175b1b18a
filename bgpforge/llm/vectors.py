"""What the operators on embeddings share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(batch, column: int = 0):
    """The rows' positions and vectors (lists of doubles) that are not null, not zero, and wholly finite."""
    import numpy as np

    for i, x in enumerate(batch.column(column).to_pylist()):
        if x and None not in x:
            v = np.array(x, "f8")
            if np.isfinite(v).all() and v.any():
                yield i, v


def matrices(column):
    """(length, positions, matrix) for every length of the usable vectors of an Arrow column of lists of floats."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0))
    starts, values = np.array(column.offsets)[:-1], np.array(pc.fill_null(column.values, float("nan")))
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.nonzero(lengths == dim)[0]
        matrix = values[starts[at][:, None] + np.arange(dim)]
        ok = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
        yield dim, at[ok], matrix[ok]


def blobs(column):
    """The vectors of an Arrow column of lists of floats as binaries, null elements as NaN."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pa.concat_arrays([column])
    values = np.ascontiguousarray(np.array(pc.fill_null(column.values, float("nan"))))
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((np.array(column.offsets, "i8") * values.itemsize).astype("i4")), pa.py_buffer(values)])


def stack(blobs, kind: str = "<f8"):
    """Binary vectors of one length as a matrix."""
    import numpy as np

    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def unit(matrix):
    """Rows scaled to length 1; scaled by their largest component first, so that nothing over- or underflows."""
    import numpy as np

    x = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepare(table: DataFrame, keep: list[str]) -> DataFrame:
    """vec_id, the columns in keep, and the usable vectors as binary doubles (`vector`), with their length (`dim`)."""
    source = table.select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"), *[F.col(c).cast("long").alias(c) for c in keep])

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(usable(batch))
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in range(1, batch.num_columns)], pa.array([v.tobytes() for _, v in found], pa.binary()), pa.array([len(v) for _, v in found], pa.int32())],
                names=["vec_id", *keep, "vector", "dim"],
            )

    return source.mapInArrow(pack, ", ".join(["vec_id long", *[f"{c} long" for c in keep], "vector binary", "dim int"]))
