"""What both classifiers share: which labelled rows they may learn from, and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int):
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo modulus, is the remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(doc_id, text, y) of the labelled rows to learn from, at most `most` of each kind.

    The rows are chosen by a hash of doc_id from labels alone, so that 2 x most of them, a proven bound, meet the texts by broadcast and no
    text is shuffled. Rows without label, doc_id or text teach nothing.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    marks = marks.where(~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))
    some = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return docs.where("doc_id is not null and text is not null").join(F.broadcast(some[0].unionAll(some[1])), "doc_id").select("doc_id", "text", "y")


def drawn(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, characters: int) -> DataFrame:
    """(y, draw, text) of the texts of each label to learn from: those with the smallest `draw`, a hash of doc_id, a bounded, repeatable sample.

    At most `most` of each label, and as many as begin within the first `characters` of their characters together.
    """
    rows = training(docs, labels, label, modulus, remainder, most).select("y", "text", F.xxhash64("doc_id").alias("draw"), F.length("text").alias("size"))
    # A window over 2 x most rows at most.
    before = F.sum("size").over(Window.partitionBy("y").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < characters).select("y", "draw", "text")


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, characters: int) -> dict[int, list[str]]:
    """The texts of each label to learn from, in the order of their draw (see `drawn`, whose bounds are those of what the driver gets)."""
    found = drawn(docs, labels, label, modulus, remainder, most, characters).orderBy("draw", "text").select("y", "text").collect()
    return {y: [r["text"] for r in found if r["y"] == y] for y in (0, 1)}


def logistic_fit(values, labels, width: int, weight: float = 1e-2, even: bool = False):
    """(slopes, shift) of a logistic curve through rows of `width` values and labels, with smoothed targets.

    With `even`, both labels weigh alike as a whole, however rare one is.
    """
    import numpy as np

    y = np.asarray(labels, "f8")
    x = np.asarray(values, "f8").reshape(len(y), width)
    up, down = y.sum(), len(y) - y.sum()
    if not up or not down:
        return [0.0] * x.shape[1], float(np.log((up + 1) / (down + 1)))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    design = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    count = np.where(y > 0, len(y) / (2 * up), len(y) / (2 * down)) if even else np.ones(len(y))
    w = np.zeros(design.shape[1])

    def loss(w):
        s = design @ w
        return (count * (np.logaddexp(0, s) - t * s)).sum() + weight * (w @ w) / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (count * p * (1 - p))[:, None]) + weight * np.eye(len(w)), design.T @ (count * (p - t)) + weight * w)
        scale, now = 1.0, loss(w)
        while scale > 1e-6 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        if np.abs(step).max() * scale < 1e-9:
            break
    return (w[:-1] / spread).tolist(), float(w[-1] - (w[:-1] * mean / spread).sum())


def logistic(slopes, shift: float, values):
    import numpy as np

    x = np.asarray(values, "f8").reshape(-1, len(slopes))
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(slopes) + shift, -500, 500)))
