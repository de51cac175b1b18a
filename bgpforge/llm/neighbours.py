"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

K = 5
#: Dimensions of the projection (even), confidence of the stopping test, seed of the projection.
PROJECTED, CONFIDENCE, SEED = 8, 0.995, 7
#: Vectors the top of the tree is fitted on; vectors of a block; queries of a block; rows of a leaf within a block.
SAMPLE, ROWS, QUERIES, LEAF = 8192, 8192, 4096, 128


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_point(p: float, m: int) -> float:
    """Where the distribution function reaches p."""
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def split_tree(points, rows: int):
    """kd-tree over points: a list of (dimension, value, left, right) or None for leaves, each with its box."""
    import numpy as np

    nodes = []

    def grow(at):
        me = len(nodes)
        nodes.append(None)
        some = points[at]
        if len(at) > rows:
            spread = some.max(axis=0) - some.min(axis=0)
            dim = int(spread.argmax())
            value = float(np.median(some[:, dim]))
            left = some[:, dim] < value
            if left.any() and not left.all():
                nodes[me] = (dim, value, grow(at[left]), grow(at[~left]))
        return me

    grow(np.arange(len(points)))
    return nodes


def leaf_of(nodes, points):
    """The leaf of each point."""
    import numpy as np

    out, todo = np.zeros(len(points), "i4"), [(0, np.arange(len(points)))]
    while todo:
        me, at = todo.pop()
        if nodes[me] is None:
            out[at] = me
        elif len(at):
            dim, value, left, right = nodes[me]
            low = points[at, dim] < value
            todo += [(left, at[low]), (right, at[~low])]
    return out


def near_leaves(nodes, points, reach):
    """(point, leaf) for every leaf whose cell is less than reach (squared) from a point."""
    import numpy as np

    whose, which, todo = [], [], [(0, np.arange(len(points)), np.zeros(points.shape))]
    while todo:
        me, at, off = todo.pop()
        if not len(at):
            continue
        if nodes[me] is None:
            whose.append(at)
            which.append(np.full(len(at), me))
            continue
        dim, value, left, right = nodes[me]
        for child, gap in ((left, np.maximum(0, points[at, dim] - value)), (right, np.maximum(0, value - points[at, dim]))):
            more = off.copy()
            more[:, dim] = np.maximum(more[:, dim], gap)
            ok = (more * more).sum(axis=1) <= reach[at]
            todo.append((child, at[ok], more[ok]))
    return (np.concatenate(whose), np.concatenate(which)) if whose else (np.zeros(0, int), np.zeros(0, int))


def best(scores, names, k: int):
    """Positions of the k largest scores, ties to the smaller name."""
    import numpy as np

    if len(scores) > k:
        some = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((names[some], -scores[some]))[:k]]


def cosine(matrix, sizes, vector, size):
    """Cosines in doubles; each row is summed in the same order wherever it stands, so equal vectors tie."""
    return (matrix * vector).sum(axis=1) / (sizes * size)


def search(table: DataFrame, is_query: Column, k: int = K, confidence: float = CONFIDENCE, projected: int = PROJECTED, sample: int = SAMPLE, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """The k nearest other rows, by cosine, of every query row of table (vec_id, embedding).

    Unit vectors are projected to a few dimensions by a Gaussian (2-stable) matrix; the squared projected distance of two
    vectors is their squared distance times a chi-square variable. A kd-tree over the projections, its top fitted on a
    bounded sample, deals every vector to a cell, and cells to blocks of bounded size. A query goes to the cells, and in
    a block to the leaves, that its stopping test leaves: it stops at projected distance r once a vector as near as its k-th best so far
    would have been seen with the given confidence, chi2(r^2 / d_k^2) >= confidence. Each true neighbour is so found with
    that probability at least. Found candidates are scored on the original vectors.

    Returns (query_id, rank, vec_id, score), all candidates where there are fewer than k; equal scores go to the smaller vec_id. Null, zero and non-finite vectors and rows without vec_id
    take no part; vectors of different lengths are no candidates of each other. Rows that repeat a vec_id are candidates each, but not of a query with that
    vec_id. Empty tables give no rows.
    """
    import numpy as np

    spark = table.sparkSession
    limit = chi_square_point(confidence, projected)

    def matrix_of(dim):
        return np.random.default_rng(SEED * 1_000_003 + dim).standard_normal((dim, projected))

    flagged = table.withColumn("__query", F.coalesce(is_query, F.lit(False)).cast("long")).select("embedding", "vec_id", F.col("__query").alias("asks"))
    ready = common.written(vectors.prepare(flagged.where("vec_id is not null"), ["asks"]), "vectors")
    counts = {x["dim"]: (x["n"], x["q"]) for x in ready.groupBy("dim").agg(F.count("*").alias("n"), F.sum("asks").alias("q")).collect()}
    tops, samples = {}, {}
    for dim, (n, _) in counts.items():
        got = ready.where(F.col("dim") == dim).select("vec_id", "vector").orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample).collect()
        points = vectors.stack([bytes(x[1]) for x in got])
        samples[dim] = (np.array([x[0] for x in got]), vectors.unit(points))
        tops[dim] = split_tree(samples[dim][1] @ matrix_of(dim), max(1, int(len(got) * rows / n)))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            dims, out = np.array(batch.column(3)), []
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                points = vectors.unit(vectors.stack(batch.column(2).take(pa.array(at)).to_pylist()))
                low = points @ matrix_of(int(dim))
                out.append((at, leaf_of(tops[int(dim)], low), np.zeros(len(at), bool), np.zeros(len(at))))
                asks = np.nonzero(np.array(batch.column(1))[at] != 0)[0]
                if len(asks):
                    names, known = samples[int(dim)]
                    bound = np.empty(len(asks))
                    for part in range(0, len(asks), 256):
                        some = asks[part : part + 256]
                        near = points[some] @ known.T
                        near[np.array(batch.column(0))[at[some]][:, None] == names[None, :]] = -np.inf
                        kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] >= k else np.full(len(some), -np.inf)
                        bound[part : part + 256] = np.where(np.isfinite(kth), np.maximum(0, 2 - 2 * kth), np.inf) + 1e-12
                    whose, leaf = near_leaves(tops[int(dim)], low[asks], limit * bound)
                    out.append((at[asks[whose]], leaf, np.ones(len(whose), bool), bound[whose]))
            take = pa.array(np.concatenate([x[0] for x in out]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), *[pa.array(np.concatenate([x[i] for x in out]), t) for i, t in ((1, pa.int32()), (2, pa.bool_()), (3, pa.float64()))]],
                names=["vec_id", "vector", "dim", "cell", "asks", "bound"],
            )

    placed = common.written(ready.mapInArrow(place, "vec_id long, vector binary, dim int, cell int, asks boolean, bound double"), "placed")
    blocks = placed.groupBy("dim", "cell").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(~F.col("asks"), 1).otherwise(0)) / rows)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("asks"), 1).otherwise(0)) / queries)).cast("int").alias("sheets"))
    sized = placed.join(blocks, ["dim", "cell"])
    spot = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shared = ["dim", "cell", "block", "sheet", "asks", "vec_id", "vector", "bound"]
    grid = sized.where("not asks").withColumn("block", spot("blocks")).withColumn("sheet", every("sheets")).select(*shared).unionAll(sized.where("asks").withColumn("sheet", spot("sheets")).withColumn("block", every("blocks")).select(*shared))

    def visit(group):
        import pyarrow as pa

        asks, names = np.array(group.column("asks")), np.array(group.column("vec_id"))
        all_vectors = vectors.stack(group.column("vector").to_pylist())
        out = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        here = np.nonzero(~asks)[0]
        if len(here):
            originals, known = all_vectors[here], names[here]
            sizes = np.sqrt((originals * originals).sum(axis=1))
            way = matrix_of(originals.shape[1])
            low = vectors.unit(originals) @ way
            leaf = leaf_of(split_tree(low, LEAF), low)
            order = np.argsort(leaf, kind="stable")
            starts = np.concatenate(([0], np.nonzero(np.diff(leaf[order]))[0] + 1, [len(order)]))
            boxes = [(low[order[a:b]].min(axis=0), low[order[a:b]].max(axis=0)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            floor, ceiling = np.array([x[0] for x in boxes]), np.array([x[1] for x in boxes])
            bounds = np.array(group.column("bound"))
            for q in np.nonzero(asks)[0]:
                vector, size, reach = all_vectors[q], np.sqrt((all_vectors[q] ** 2).sum()), bounds[q]
                at = vectors.unit(vector[None, :])[0] @ way
                gap = np.maximum(0, np.maximum(floor - at, at - ceiling))
                gap = (gap * gap).sum(axis=1)
                found, scores = np.zeros(0, "i8"), np.zeros(0)
                turn = np.argsort(gap, kind="stable")
                for first in range(0, len(turn), 16):
                    leaves = turn[first : first + 16]
                    leaves = leaves[gap[leaves] <= limit * reach]
                    if not len(leaves):
                        break
                    rows_ = np.concatenate([order[starts[x] : starts[x + 1]] for x in leaves])
                    off = low[rows_] - at
                    rows_ = rows_[((off * off).sum(axis=1) <= limit * reach) & (known[rows_] != names[q])]
                    if len(rows_):
                        found = np.concatenate((found, rows_))
                        scores = np.concatenate((scores, cosine(originals[rows_], sizes[rows_], vector, size)))
                        top = best(scores, known[found], k)
                        found, scores = found[top], scores[top]
                        if len(found) == k:
                            reach = min(reach, max(0.0, 2 - 2 * scores[-1]) + 1e-12)
                out.append((np.full(len(found), names[q]), known[found], scores))
        return pa.table({"query_id": np.concatenate([x[0] for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    found = grid.groupBy("dim", "cell", "block", "sheet").applyInArrow(visit, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
