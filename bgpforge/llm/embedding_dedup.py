"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one vector kept of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

THRESHOLD = 0.93
#: Vectors that k-means is fitted on; vectors of one label in a cell at which it aims; most cells.
SAMPLE, CELL, CELLS = 20_000, 4096, 1024
#: Vectors of a block at most, and the bytes of a block as doubles; two blocks meet in a task.
BLOCK, BYTES = 65_536, 32 << 20
#: Products of a step, and pairs that are confirmed at once.
STEP, PAIRS = 8 << 20, 65_536


def fit_centroids(points, k: int, rounds: int = 8):
    """Spherical k-means: unit centroids (k x d), seeded by spread positions in the sample."""
    import numpy as np

    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (points @ centroids.T).argmax(axis=1)
        for c in range(k):
            total = points[near == c].sum(axis=0)
            size = np.sqrt((total * total).sum())
            if size > 0:
                centroids[c] = total / size
    return centroids


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Group vectors (vec_id, embedding, label) whose cosine is at least the threshold and whose labels are equal.

    Returns a row (vec_id, n_links, component_id, kept) for each row of the table. Vectors that are null, zero or hold null or non-finite
    components, and those without a label, link with nothing; vectors of different lengths never link. Equal vectors of one label are
    compared once and counted (equal: of one length, with two equal hashes of 64 bits). Rows that repeat a vec_id are linked like others (a
    component is named by its smallest vec_id); a row without vec_id keeps a null component. Empty tables give no rows.

    Labels of more than `cell` vectors are cut into cells. No link is lost at cell borders: y in the cell of c2 is nearer to c2 than to c1, so x in
    the cell of c1 that links with y is at most sin(arccos(threshold)) from the plane between c1 and c2, and visits the later of both cells.
    Neighbouring cells share a part of about a block, to which a vector goes once, so that copies of vectors grow with parts, not with cells. Parts are
    cut into blocks of those at home and of visitors, visitors never meet each other, and a task holds two blocks at most; it returns each vector's
    number of links and a star for each group, never pairs. Products in single precision, with a margin for their rounding, leave out pairs; the rest is confirmed in double precision.
    """
    import numpy as np

    element = table.schema["embedding"].dataType.elementType.typeName()
    flat = F.col("embedding") if element == "float" else F.col("embedding").cast("array<double>")
    source = table.select(flat.alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label")).withColumn("dim", F.size("embedding"))
    source = source.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    usable = source.where("label is not null and vec_id is not null and dim > 0")

    def room(dim: int) -> int:
        return max(1, min(block, BYTES // (8 * dim)))

    sizes = usable.groupBy("dim", "label").agg(F.count("*").alias("n"))
    large = {(r["dim"], r["label"]): r["n"] for r in sizes.where(F.col("n") > F.least(F.lit(cell), F.greatest(F.lit(1), F.floor(F.lit(BYTES) / (8 * F.col("dim")))))).collect()}
    # Cells of a label of a length, by powers of two, so that few models serve many labels.
    wanted = {key: min(CELLS, 2 ** max(1, round(np.log2(n / min(cell, room(key[0])))))) for key, n in large.items()}
    models = {}
    for dim in {d for d, _ in wanted}:
        of = vectors.prepare(table.where(F.size("embedding") == dim), ["label"]).where("label is not null and vec_id is not null").select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        if of:
            points = vectors.unit(vectors.stack([bytes(x[0]) for x in of]))
            for k in {k for (d, _), k in wanted.items() if d == dim}:
                models[dim, k] = fit_centroids(points, min(k, len(points)))
    wanted = {key: k for key, k in wanted.items() if (key[0], k) in models}

    def placed(batch):
        """(positions, dim, label, own cell, visited cells: positions within the first and cells) of the usable vectors of a batch, by dim and label."""
        labels = np.array(batch.column("label"))
        for dim, at, points in vectors.matrices(batch.column("embedding")):
            for label in np.unique(labels[at]):
                some = np.nonzero(labels[at] == label)[0]
                k = wanted.get((dim, int(label)))
                if k is None:
                    yield at[some], dim, int(label), np.zeros(len(some), int), (np.zeros(0, int), np.zeros(0, int))
                    continue
                centroids = models[dim, k]
                near = vectors.unit(points[some].astype("f8")) @ centroids.T
                own = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T)))[own]
                visit = (near[np.arange(len(some)), own][:, None] - near <= reach * apart) & (np.arange(len(centroids)) > own[:, None])
                yield at[some], dim, int(label), own, np.nonzero(visit)

    def visited(part_of, own, where):
        """Each visitor once for each part that is not its own: positions and parts."""
        pairs = np.unique(np.stack([where[0], part_of[where[1]]]), axis=1)
        return pairs[:, pairs[1] != part_of[own[pairs[0]]]]

    def tally(part_of):
        def run(batches):
            import pyarrow as pa

            n = {}
            for batch in batches:
                for _, dim, label, own, where in placed(batch):
                    at = own if part_of is None else visited(part_of[dim, label], own, where)[1]
                    for c, m in zip(*np.unique(at, return_counts=True), strict=True):
                        n[dim, label, int(c)] = n.get((dim, label, int(c)), 0) + int(m)
            if n:
                keys = list(zip(*n, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["dim", "label", "at", "n"])

        return run

    reach = float(np.sqrt(max(0.0, 1 - threshold * threshold))) + 1e-9
    part_of, blocks = {}, {}
    if wanted:
        chosen = usable.join(F.broadcast(table.sparkSession.createDataFrame(list(wanted), "dim int, label long")), ["dim", "label"]).select("embedding", "label")
        counted = lambda parts: {(r["dim"], r["label"], r["at"]): r["n"] for r in chosen.mapInArrow(tally(parts), "dim int, label long, at int, n long").groupBy("dim", "label", "at").agg(F.sum("n").alias("n")).collect()}
        home = counted(None)
        for (dim, label), k in wanted.items():
            parts, held, filled = [], 0, 0
            for c in range(len(models[dim, k])):
                n = home.get((dim, label, c), 0)
                if held and held + n > room(dim):
                    filled, held = filled + 1, 0
                parts.append(filled)
                held += n
                blocks[dim, label, filled] = (-(-held // room(dim)), 0)
            part_of[dim, label] = np.array(parts)
        if any(x[-1] for x in part_of.values()):
            for key, n in counted(part_of).items():
                blocks[key] = (blocks[key][0], -(-n // room(key[0])))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            taken, out = [], []
            h1, rep = np.array(batch.column("h1")), np.array(batch.column("vec_id"))
            order = np.lexsort((rep, np.array(batch.column("h2")), h1))
            # Copies within a batch become one row.
            named = np.stack([np.array(batch.column(c)) for c in ("h1", "h2", "label", "dim")])[:, order]
            first = np.r_[True, (named[:, 1:] != named[:, :-1]).any(axis=0)] if len(order) else np.zeros(0, bool)
            firsts = np.nonzero(first)[0]
            copies, least = np.zeros(len(order), "i8"), np.zeros(len(order), "i8")
            if len(order):
                copies[order[firsts]] = np.diff(np.r_[firsts, len(order)])
                least[order[firsts]] = np.minimum.reduceat(rep[order], firsts)
            one = pa.array(np.sort(order[firsts]), pa.int64())
            batch = batch.take(one)
            copies, least, spread = copies[one], least[one], h1[one].view("u8") >> np.uint64(1)
            for at, dim, label, own, where in placed(batch):
                part = part_of.get((dim, label), np.zeros(1, int))[own]
                coming = [(at, part, True)]
                if (dim, label) in part_of:
                    who, to = visited(part_of[dim, label], own, where)
                    coming.append((at[who], to, False))
                for who, to, is_home in coming:
                    for g in np.unique(to):
                        some = who[to == g]
                        homes, visitors = blocks.get((dim, label, int(g)), (1, 0))
                        visitors = max(1, visitors)
                        mine = (spread[some] % np.uint64(homes if is_home else visitors)).astype(int)
                        for b in np.unique(mine):
                            those, b = some[mine == b], int(b)
                            if is_home:  # with every block of visitors, the first of which also meets its own kind, and with other blocks at home
                                tasks = [(b, v, True) for v in range(visitors)] + [(b, visitors + j, True) for j in range(b)] + [(i, visitors + b, False) for i in range(b + 1, homes)]
                            else:
                                tasks = [(i, b, False) for i in range(homes)]
                            for i, j, left in tasks:
                                taken.append(those)
                                out.append((dim, int(g), i, j, left))
            if taken:
                rows, lengths = np.concatenate(taken), [len(x) for x in taken]
                dims, parts, i, j, left = (np.repeat(np.array(x), lengths) for x in zip(*out, strict=True))
                width = max(1, min(len(rows), BYTES // (8 * int(dims.max()))))
                for low in range(0, len(rows), width):
                    some = slice(low, low + width)
                    picked = pa.array(rows[some], pa.int64())
                    blobs = vectors.blobs(batch.column("embedding").take(picked))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(picked), pa.array(dims[some], pa.int32()), pa.array(parts[some], pa.int32()), pa.array(i[some], pa.int32()), pa.array(j[some], pa.int32()), pa.array(left[some], pa.bool_()), batch.column("h1").take(picked), batch.column("h2").take(picked), pa.array(least[rows[some]]), pa.array(copies[rows[some]]), blobs],
                        names=["label", "dim", "part", "i", "j", "home", "h1", "h2", "rep", "copies", "vector"],
                    )

    dealt = usable.select("embedding", "vec_id", "label", "dim", "h1", "h2").mapInArrow(deal, "label long, dim int, part int, i int, j int, home boolean, h1 long, h2 long, rep long, copies long, vector binary")
    kind = "<f4" if element == "float" else "<f8"

    def compare(rows):
        import pyarrow as pa

        h1, h2, home, rep, copies = (np.array(rows.column(c)) for c in ("h1", "h2", "home", "rep", "copies"))
        order = np.lexsort((h2, h1))
        first = np.nonzero(np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])[0]
        copies, rep, at = np.add.reduceat(copies[order], first), np.minimum.reduceat(rep[order], first), order[first]
        points = vectors.unit(vectors.stack(rows.column("vector").take(pa.array(at)).to_pylist(), kind).astype("f8"))
        h1, h2, home = h1[at], h2[at], home[at]
        within = rows.column("j")[0].as_py() == 0
        count, root = np.zeros(len(at), "i8"), np.arange(len(at))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        # Those at home first: a block of visitors stands behind them.
        turn = np.argsort(~home, kind="stable")
        points, h1, h2, rep, copies, n = points[turn], h1[turn], h2[turn], rep[turn], copies[turn], int(home.sum())
        single, least = points.astype("f4"), threshold - 1e-6 - 2.4e-7 * points.shape[1]
        step = max(1, STEP // max(1, len(points)))
        made = np.empty(step * len(points), "f4")
        for low in range(0, n, step):
            high = min(n, low + step)
            start = low if within else n
            width = len(points) - start
            if not width:
                continue
            close = np.matmul(single[low:high], single[start:].T, out=made[: (high - low) * width].reshape(high - low, width))
            if within:  # a vector with itself
                close[np.arange(high - low), np.arange(high - low)] = -1
            near = np.nonzero(close.max(axis=1) >= least)[0]
            hits = np.flatnonzero(close[near] >= least)
            for k in range(0, len(hits), PAIRS):
                a, b = np.divmod(hits[k : k + PAIRS], width)
                a, b = near[a] + low, b + start
                ok = a < b
                a, b = a[ok], b[ok]
                ok = (points[a] * points[b]).sum(axis=1) >= threshold
                a, b = a[ok], b[ok]
                np.add.at(count, a, copies[b])
                np.add.at(count, b, copies[a])
                while (root[root] != root).any():
                    root[:] = root[root]
                ok = root[a] != root[b]
                for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        if rep[x] <= rep[y]:
                            root[y] = x
                        else:
                            root[x] = y
        mine = (np.arange(len(at)) < n) & (copies > 1) & within
        some = np.nonzero((count > 0) | mine)[0]
        size = len(some)
        return pa.table({"label": np.full(size, rows.column("label")[0].as_py(), "i8"), "dim": np.full(size, rows.column("dim")[0].as_py(), "i4"), "h1": h1[some], "h2": h2[some], "rep": rep[some], "copies": copies[some], "links": count[some], "star": rep[[find(x) for x in some]] if size else np.zeros(0, "i8")})

    found = common.written(dealt.groupBy("label", "dim", "part", "i", "j").applyInArrow(compare, "label long, dim int, h1 long, h2 long, rep long, copies long, links long, star long"), "found")
    group_of = common.components(found.select(F.col("rep").alias("a"), F.col("star").alias("b")))
    key = ["label", "dim", "h1", "h2"]
    classes = found.groupBy(*key).agg(F.min("rep").alias("rep"), (F.sum("links") + F.max("copies") - 1).alias("class_links"))
    classes = common.written(classes.join(group_of, F.col("rep") == F.col("node"), "left").select(*key, "class_links", F.coalesce("component", "rep").alias("class_component")), "classes")
    common.drop(found, group_of)
    named = F.col("vec_id").isNotNull()
    out = source.select("vec_id", *key).join(classes, key, "left")
    out = out.select("vec_id", F.when(named, F.coalesce("class_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, F.coalesce("class_component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
