"""MinHash near-dedup by a signature-coordinate inverted join.

A set's signature has COORDINATES coordinates, each of ROWS minima: two sets of similarity s agree in a coordinate with
probability s^4. Documents are posted under each coordinate-value pair. Pairs that agree in fewer than AGREE coordinates are left out: at
similarity 0.85 a pair misses that with probability 6e-7, at 0.8 with 6e-5, more similar ones hardly ever. A pair with AGREE = 2 agreeing
coordinates has its first one among all but the last: that prefix is posted. Candidates of a list must also collide in LANES single minima as often as the
threshold makes likely, less 4.7 standard deviations (`matches`), and are then confirmed on their full sets.

A list whose documents are all of one group already is merged and gone: one round compares a document of each list of the first coordinates
with the others of it, which settles most lists of copies. Lists of other groups are compared whole: with a join up to SMALL documents, else in blocks of documents of like size,
inside a task, without a row for a pair. Lists with more than WHOLE different documents to compare for each of theirs, those of very common
passages, are skipped, and their documents are posted again under the second coordinate that they share with anyone. The full sets of a candidate component
are again compared in blocks, which give links that join groups.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COORDINATES, ROWS, AGREE = 24, 4, 2
#: Single minima that are compared, seven to a long.
LANES = 91
#: A list in which a document has at most this many others of another group, on average, is compared whole.
WHOLE = 4000
#: Documents of one side of a block of candidates.
SIDE = 400
#: Lists of at most so many documents are compared by a join; documents of one side of a block of a longer list.
SMALL, WIDE = 16, 2000
#: Coordinates (first ones) whose lists are compared with one of their documents ahead of all else, to group copies early.
EARLY = 3
#: Classes of equal sets that are sent to every executor, at most: those with so large a share of all rows that no more can exist.
HOT = 4096
_SEVEN = 0x007F7F7F7F7F7F7F
_HIGH = 0x0080808080808080


def shingles(text: str | None, width: int):
    """The set as sorted distinct 64-bit hashes: shingles of `width` words, or the whole sequence if it is shorter."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=len(words))], "u8")
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = len(words) - width + 1
    out = hashed[:n].copy()
    for k in range(1, width):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashed[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _salts():
    import numpy as np

    draw = np.random.default_rng(20)
    n = COORDINATES * ROWS
    return draw.integers(1, 2**63, n, dtype="u8") | np.uint64(1), draw.integers(0, 2**63, n, dtype="u8")


def signature(hashes, salts):
    """COORDINATES x ROWS minima of 32-bit hashes of the set."""
    import numpy as np

    odd, add = salts
    low = None
    for at in range(0, len(hashes), 2048):
        x = hashes[None, at : at + 2048] ^ add[:, None]
        x = ((x * odd[:, None]) >> np.uint64(32)).min(axis=1)
        low = x if low is None else np.minimum(low, x)
    return low


def features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2: digest of the set, coordinates: hashed, lanes: single minima's low bytes, seven in a long) of every row."""

    def make(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        salts = _salts()
        places = np.uint64(8) * np.arange(7, dtype="u8")
        for batch in batches:
            sizes, digests, minima = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                sizes.append(len(found))
                data = xxhash.xxh3_128_digest(found.tobytes())
                digests.append((int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)))
                minima.append(signature(found, salts) if len(found) else np.zeros(COORDINATES * ROWS, "u8"))
            n = len(minima)
            low = np.array(minima, "u8").reshape(n, COORDINATES * ROWS)
            mixed = np.broadcast_to(np.arange(COORDINATES, dtype="u8"), (n, COORDINATES)).copy()
            for k in range(ROWS):
                mixed = (mixed ^ low[:, k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            packed = ((low[:, :LANES].reshape(n, LANES // 7, 7) & np.uint64(255)) << places).sum(axis=2, dtype="u8")
            listed = lambda x, size: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * size), pa.array(np.ascontiguousarray(x).ravel().view("i8")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([x for x, _ in digests], pa.int64()), pa.array([x for _, x in digests], pa.int64()), listed(mixed, COORDINATES), listed(packed, LANES // 7)],
                names=["doc_id", "n_shingles", "h1", "h2", "coordinates", "lanes"],
            )

    return common.documents(docs).mapInArrow(common.giving_back(make), "doc_id long, n_shingles long, h1 long, h2 long, coordinates array<long>, lanes array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h1, h2, hashes) of every row: the full sets."""

    def make(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = shingles(text, width)
                data = xxhash.xxh3_128_digest(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i : i + 1], pa.array([int.from_bytes(data[:8], "little", signed=True)], pa.int64()), pa.array([int.from_bytes(data[8:], "little", signed=True)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found.view("i8")))],
                    names=["doc_id", "h1", "h2", "hashes"],
                )

    return docs.mapInArrow(common.giving_back(make), "doc_id long, h1 long, h2 long, hashes array<long>")


def matches(percent: int) -> int:
    """Collisions that a pair of this similarity reaches but for a probability of about 2e-6."""
    s = percent / 100
    return int(LANES * s - 4.7 * (LANES * s * (1 - s)) ** 0.5)


def _agree(a: str, b: str):
    """At least this many lanes agree, by bytes that are equal in p0..p3 of both sides (never fewer than really do)."""
    out = F.lit(LANES)
    for i in range(LANES // 7):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        odd = (x.bitwiseAND(F.lit(_SEVEN)) + F.lit(_SEVEN)).bitwiseOR(x).bitwiseAND(F.lit(_HIGH))
        out = out - F.bit_count(odd)
    return out


def _blocks(batches):
    """A table for each run of equal values in the first column."""
    import numpy as np
    import pyarrow as pa

    held, name = [], None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1), len(keys)] if len(keys) else []
        for first, to in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[first] != name:
                yield pa.Table.from_batches(held)
                held = []
            name = keys[first]
            held.append(batch.slice(first, to - first))
    if held:
        yield pa.Table.from_batches(held)


def _columns(block):
    """side, id, n, group of a block's rows, and their lanes as bytes (the eighth of each long is 0)."""
    import numpy as np

    lanes = np.stack([block.column(f"p{i}").to_numpy() for i in range(LANES // 7)], axis=1)
    return *(block.column(c).to_numpy() for c in ("side", "id", "n", "in_group")), np.ascontiguousarray(lanes).view("u1")


def _near(i, among, n, group, lanes, percent: int):
    """Of the places `among` those of another group that may be similar enough to place i."""
    import numpy as np

    among = among[group[among] != group[i]]
    among = among[100 * np.minimum(n[among], n[i]) >= percent * np.maximum(n[among], n[i])]
    return among[(lanes[among] == lanes[i]).sum(axis=1) - LANES // 7 >= matches(percent)]


def _list_blocks(percent: int):
    """For mapInArrow over blocks of lists: candidates of side 0 with side 1, contracted to stars."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs():
            for block in _blocks(batches):
                side, ids, n, group, lanes = _columns(block)
                every = np.nonzero(side == 1)[0]
                a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
                for i in np.nonzero(side == 0)[0]:
                    near = _near(i, every, n, group, lanes, percent)
                    a.append(np.full(len(near), ids[i]))
                    b.append(ids[near])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        yield from common._contract(pairs())

    return run


def _component_blocks(percent: int):
    """For mapInArrow over blocks of candidate components, with full sets: links that join groups, no more than join them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for block in _blocks(batches):
            side, ids, n, group, lanes = _columns(block)
            sets = block.column("hashes").combine_chunks()
            _, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            n = sets.value_lengths().to_numpy()
            ends = np.cumsum(n)
            group, a, b = group.copy(), [], []
            left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            member = np.zeros(int(codes.max()) + 1, bool)
            for k, i in enumerate(left):
                mine = codes[ends[i] - n[i] : ends[i]]
                member[mine] = True
                for j in _near(i, right if len(right) else left[k + 1 :], n, group, lanes, percent):
                    if group[i] != group[j]:
                        shared = np.count_nonzero(member[codes[ends[j] - n[j] : ends[j]]])
                        if 100 * shared >= percent * (n[i] + n[j] - shared):
                            a.append(ids[i])
                            b.append(ids[j])
                            group[group == group[j]] = group[i]
                member[mine] = False
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Group documents (doc_id, text) whose word-shingle sets have a Jaccard similarity of at least percent / 100.

    Returns a row (doc_id, n_shingles, component_id, kept) for each row of docs; component_id is the smallest doc_id reachable by
    links. A null, empty or blank text has no shingles and links with nothing. A text of fewer than `width` words is one
    shingle. Rows that share a doc_id are one document: the links of any count. A row without doc_id links with nothing, has a null component and is kept. Empty
    tables give no rows. Other columns of docs, of any name, are not looked at.

    Equal sets are one node. Links are confirmed on full sets.
    """
    packs = [f"p{i}" for i in range(LANES // 7)]
    texts = common.documents(docs)
    rows = common.written(features(docs, width), "features")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # All rows of a class have equal features, so any will do; equal rows meet as partial aggregates.
    nodes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("coordinates").alias("coordinates"), F.first("lanes").alias("lanes"))
    nodes = common.written(nodes.select("id", "h1", "h2", "n", "copies", "coordinates", *[F.element_at("lanes", i + 1).alias(c) for i, c in enumerate(packs)]), "nodes")
    told = nodes.select("id", "n", *packs)

    def settled(links: DataFrame, groups: DataFrame) -> DataFrame:
        """Links that join the groups of similar documents within each component of candidate links (a, b)."""
        links = common.written(links.distinct(), "candidates")
        if links.isEmpty():
            return links
        parts = common.components(links)
        sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / SIDE).alias("slices"))
        members = parts.join(sizes, "component").join(groups.withColumnRenamed("component", "in_group"), "node", "left")
        members = members.select(F.col("node").alias("id"), "component", "slices", F.coalesce("in_group", "node").alias("in_group"))
        members = common.written(members.join(nodes.select("id", "h1", "h2", "n", *packs), "id"), "members")
        # Texts of the members only are split into shingles again: full sets are too large to be kept for all.
        # Their ids stand in a table of their own: while its size allows, it is broadcast and no text is shuffled.
        wanted = common.written(members.select(F.col("id").alias("doc_id")), "wanted")
        again = _sets(texts.join(wanted, "doc_id", "left_semi"), width)
        sets = common.written(again.join(members.select(F.col("id").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"]).select(F.col("doc_id").alias("id"), "hashes"), "sets")
        spread = members.join(sets, "id").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        spread = spread.select(F.xxhash64("component", F.least("slice", "other"), F.greatest("slice", "other")).alias("block"), (F.col("slice") > F.col("other")).cast("int").alias("side"), "id", "n", "in_group", *packs, "hashes")
        out = common.written(spread.repartition("block").sortWithinPartitions("block").mapInArrow(common.giving_back(_component_blocks(percent)), "a long, b long"), "confirmed")
        common.drop(links, parts, members, wanted, sets)
        return out

    def alike(a, b):
        low, high = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
        return (100 * low >= percent * high) & (_agree(f"{a}p", f"{b}p") >= matches(percent))

    def grown(groups: DataFrame, new: DataFrame) -> DataFrame:
        """The groups after more links."""
        if new.isEmpty():
            return groups
        out = common.components(groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(new))
        common.drop(groups, new)
        return out

    # Rows that share a doc_id but not their set join the groups of both sets.
    twice = full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    twice = common.written(twice, "twice")
    groups = common.components(full.join(twice, "doc_id", "left_semi").join(nodes.select("h1", "h2", "id"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")))

    # One document of each list of the first coordinates is compared with all others of it.
    early = nodes.select("id", "n", *packs, F.explode(F.slice("coordinates", 1, EARLY)).alias("key"))
    hubs = early.withColumn("draw", F.xxhash64("key", "id")).groupBy("key").agg(F.count("*").alias("many"), *[F.min_by(c, "draw").alias(f"h{c}") for c in ("id", "n", *packs)]).where("many > 1")
    star = early.join(hubs, "key").where(F.col("id") != F.col("hid")).where(alike("", "h"))
    groups = grown(groups, settled(star.select(F.least("id", "hid").alias("a"), F.greatest("id", "hid").alias("b")), groups))

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.join(groups.withColumnRenamed("node", "id").withColumnRenamed("component", "in_group"), "id", "left").withColumn("in_group", F.coalesce("in_group", "id"))

    def mixed(posts: DataFrame) -> DataFrame:
        """The posts (key, last, id, in_group) in lists of different groups."""
        keys = posts.groupBy("key").agg(F.min("in_group").alias("low"), F.max("in_group").alias("high")).where("low != high").select("key")
        return common.written(posts.join(keys, "key", "left_semi"), "posts")

    posts = mixed(grouped(nodes.select("id", "coordinates")).select("id", "in_group", F.posexplode(F.slice("coordinates", 1, COORDINATES - AGREE + 1)).alias("last", "key")).select("key", "last", "id", "in_group"))
    for depth in range(1, AGREE + 1):
        # Pairs of different groups are left; the largest group of a list needs no comparison with itself.
        sizes = posts.groupBy("key", "in_group").agg(F.count("*").alias("rows"))
        lists = sizes.groupBy("key").agg(F.sum("rows").alias("many"), F.sum(F.col("rows") * F.col("rows")).alias("squares"), F.max_by("in_group", F.struct("rows", "in_group")).alias("main"), F.max("rows").alias("most"))
        slices = lambda n: F.ceil(n / WIDE)
        lists = common.written(lists.select("key", "main", (F.col("many") <= SMALL).alias("small"), slices(F.col("many") - F.col("most")).alias("lefts"), slices(F.col("many")).alias("rights"), (F.col("many") * F.col("many") - F.col("squares") <= WHOLE * F.col("many")).alias("whole")), "lists")
        now = lists.where("whole") if depth < AGREE else lists
        tried = common.written(posts.join(now, "key").join(told, "id"), "tried")
        less = tried.where("small and in_group != main").select("key", "main", *[F.col(c).alias(f"l{c}") for c in ("id", "n", *packs, "in_group")])
        every = tried.where("small").select("key", *[F.col(c).alias(f"r{c}") for c in ("id", "n", *packs, "in_group")])
        pairs = less.join(every, "key").where("lin_group != rin_group and (rin_group = main or lid < rid)").where(alike("l", "r")).select(F.col("lid").alias("a"), F.col("rid").alias("b"))
        # Longer lists go in blocks: documents outside the main group against all of like size. Sizes lie in bands as wide as the threshold allows, so like ones
        # are in the same band or in neighbouring ones.
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100) + 1e-9))
        slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        longer = tried.where("not small").withColumn("band", band)
        left = longer.where("in_group != main").withColumn("x", slot("lefts")).withColumn("y", each("rights")).withColumn("side", F.lit(0))
        left = left.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        right = longer.withColumn("y", slot("rights")).withColumn("x", each("lefts")).withColumn("side", F.lit(1))
        sides = [x.select(F.xxhash64("key", "band", "x", "y").alias("block"), "side", "id", "n", "in_group", *packs) for x in (left, right)]
        stars = sides[0].unionAll(sides[1]).repartition("block").sortWithinPartitions("block").mapInArrow(common.giving_back(_list_blocks(percent)), "a long, b long")
        groups = grown(groups, settled(pairs.unionAll(stars), groups))
        common.drop(tried)
        long = lists.where("not whole").select("key")
        if depth == AGREE or long.isEmpty():
            common.drop(posts, lists)
            break
        # A pair that agrees twice meets in both lists, so the second coordinate is sought among the node's posts in lists of different groups.
        first = posts.join(long, "key", "left_semi").select("key", "last", "id")
        second = posts.select("id", F.col("last").alias("next"), F.col("key").alias("value")).unionAll(nodes.select("id", F.lit(COORDINATES - 1).alias("next"), F.element_at("coordinates", COORDINATES).alias("value")))
        pairs_of = first.join(second, "id").where("next > last").select("id", F.xxhash64("key", "value").alias("key"), F.col("next").alias("last"))
        after = mixed(grouped(pairs_of).select("key", "last", "id", "in_group"))
        common.drop(posts, lists)
        posts = after
    by_set = nodes.select("h1", "h2", "copies", F.col("id").alias("node")).join(groups, "node", "left").select("h1", "h2", "copies", F.coalesce("component", "node").alias("component"))
    by_set = common.written(by_set, "by_set")
    # At most HOT classes hold more than a HOT-th of the rows each; they go to every executor, so that no class meets in one task.
    least = full.count() / HOT
    hot, cold = by_set.where(F.col("copies") > least).drop("copies"), by_set.where(F.col("copies") <= least).drop("copies")
    plain = rows.select("doc_id", "n_shingles", "h1", "h2")
    linked, alone = plain.where("n_shingles > 0 and doc_id is not null"), plain.where("n_shingles = 0 or doc_id is null")
    rest = linked.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])
    out = [x.select("doc_id", "n_shingles", F.col(c).alias("component_id")) for x, c in ((linked.join(F.broadcast(hot), ["h1", "h2"]), "component"), (rest, "component"), (alone, "doc_id"))]
    common.drop(nodes, twice)
    return out[0].unionAll(out[1]).unionAll(out[2]).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one document of each group (see `near_duplicates`): that of the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows without doc_id all stay.
    """
    groups = common.written(near_duplicates(docs.select("doc_id", "text"), width, percent), "groups")
    ids = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    out = docs.join(groups.where("not kept").select(ids).distinct(), "doc_id", "left_anti").select(*docs.columns)
    twice = groups.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(ids)
    if twice.isEmpty():
        return out
    return out.join(twice, "doc_id", "left_anti").select(*docs.columns).unionAll(out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
