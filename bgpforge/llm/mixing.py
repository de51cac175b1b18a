"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix"
#: Mean documents of a bucket of the shuffled order, over all sources.
BUCKET = 2000
#: Words of a packet of the one document that ends beyond its source's target.
PACKET = 16
#: Mean documents of a partition of the sorted queue.
RANGE = 5000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(key, source_size) to (key, source_size, weight, target): water-filling of share x all words.

    Sources in order of key take the weights in turn. A target stops at epochs x the source's size and the excess is
    shared again by weight: with level L, target = min(L x weight, epochs x size), and L is what makes them add up.
    """
    one = Window.orderBy("key")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(one) - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "key")
    every = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("all_words"),
        F.coalesce(F.sum("source_size").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.row_number().over(up).alias("place"),
    ).withColumn("level", (F.lit(float(share)) * F.col("all_words") - F.lit(float(epochs)) * F.col("capped")) / F.col("rest"))
    filled = filled.withColumn("water", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(every))
    return filled.select("key", "source_size", "weight", F.coalesce(F.least(F.col("water") * F.col("weight"), F.col("cap")), F.lit(0.0)).alias("target"))


def packets(size: Column, start: Column, source_size: Column, target: Column, epochs: int = EPOCHS) -> Column:
    """What a document puts into the queue: an array of (finish, words), in order of finish, once for each epoch that begins below its source's target.

    A document that ends beyond the target, at most one of a source, is queued in packets of PACKET words, so that the budget ends near every target.
    """
    def queued(begin: Column) -> Column:
        whole = F.array(F.struct(((begin + size) / target).alias("finish"), size.alias("words")))

        def packet(k: Column) -> Column:
            end = F.least((k + 1) * PACKET, size)
            return F.struct(((begin + end) / target).alias("finish"), (end - k * PACKET).alias("words"))

        many = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / PACKET)), packet)
        return F.when((size > 0) & (begin < target), F.when(begin + size <= target, whole).otherwise(many)).otherwise(F.slice(whole, 1, 0))

    return F.concat(*[queued(start + F.lit(epoch) * source_size) for epoch in range(epochs)])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Every source is a queue of its documents in shuffled order (md5 of seed and doc_id), repeated up to `epochs` times. A
    document's virtual finish time is its source's words up to its end, divided by the source's target. All queued
    documents are range-sorted by it; prefix sums over the sorted partitions tell where the budget, share x all words,
    rounded down, is served, and the rest is cut off. So the mix takes the budget to the word (all that is queued, if that is less), and each source its target but
    for the packets of one document (see `packets`).

    Returns a row (doc_id, source, size, source_size, target, taken, ticket, virtual_finish: that of the first time) for each row of docs (doc_id,
    text, source). A null text has size 0 and takes 0 words;
    a null source is a source of its own, last; rows without doc_id, repeated rows and ties of the shuffle are
    ordered by size, and rows equal in both are alike. Empty tables give no rows. Prefix sums within a source go through buckets of the shuffled order, so
    that no source meets in one task.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = sized.select("*", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("key"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("ticket"))
    sized = common.written(sized, "sized")
    n, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = 2
    while 16**digits * BUCKET < n:
        digits += 1
    sized_in = sized.withColumn("bucket", F.substring("ticket", 1, digits))
    buckets = common.written(sized_in.groupBy("key", "bucket").agg(F.sum("size").alias("words")), "buckets")
    plan = targets(buckets.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")).join(plan, "key")
    here = Window.partitionBy("key", "bucket").orderBy("ticket", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized_in.join(placed, ["key", "bucket"]).withColumn("start", F.col("base") + F.sum("size").over(here) - F.col("size"))
    rows = common.written(rows.select("doc_id", "source", "size", "source_size", "target", "ticket", "key", "start"), "placed")
    common.drop(sized, buckets)
    queued = packets(F.col("size"), F.col("start"), F.col("source_size"), F.col("target"), epochs)
    place = ["finish", "key", "start"]  # a document with words is told by its source and start
    queue = rows.select("key", "start", F.explode(queued).alias("packet")).select("packet.finish", "key", "start", "packet.words")
    cut = _cut(queue, place, int(share * words), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE)))
    if cut is None:

        def served(x: Column) -> Column:
            return x["words"]

    else:
        at, key, start = F.lit(cut["finish"]), F.lit(cut["key"]), F.lit(cut["start"]).cast("long")
        earlier = (F.col("key") < key) | ((F.col("key") == key) & (F.col("start") < start))
        last = (F.col("key") == key) & (F.col("start") == start)

        def served(x: Column) -> Column:
            tie = x["finish"] == at
            return F.when((x["finish"] < at) | (tie & earlier), x["words"]).when(tie & last, x["words"] - F.lit(cut["over"])).otherwise(F.lit(0).cast("long"))

    taken = F.aggregate(F.transform(queued, served), F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        "ticket",
        F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0)).alias("virtual_finish"),
    )


def _cut(queue: DataFrame, place: list[str], budget: int, partitions: int):
    """Where the budget ends in the queue sorted by place: the last packet's place, and `over`, its words beyond the budget; None if all is served.

    The driver sees one sum for each sorted partition as a table, and this one row.
    """
    ranged = queue.repartitionByRange(partitions, *place).sortWithinPartitions(*place).withColumn("part", F.spark_partition_id())
    ranged = common.written(ranged, "queue")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("part").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(upto))
    part = parts.where(F.col("upto") >= budget).orderBy("part").first()
    found = None
    if part is not None:
        inside = Window.partitionBy("part").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = ranged.where(F.col("part") == part["part"]).withColumn("over", F.sum("words").over(inside) + F.lit(part["upto"] - part["words"] - budget))
        found = ends.where("over >= 0").orderBy(*place).select(*place, "over").first()
    common.drop(ranged)
    return found


def repeat(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix of whole documents: the rows of docs, all columns, each as often as the mix takes it, 0 to `epochs` times.

    A document that `mix` cuts is taken whole if at least half of it is in. As a source is served in shuffled order, a
    ticket for each source and epoch tells where it ends, and docs meet only these; rows that repeat a doc_id share its ticket and are
    taken alike. Documents of size 0 weigh nothing and stay once.
    """
    served = mix(docs.select("doc_id", "text", "source"), weights, share, epochs, seed).where("size > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    cuts = common.written(served.groupBy("source").agg(*[F.max(F.when(times > e, F.col("ticket"))).alias(f"cut{e}") for e in range(epochs)]).withColumnRenamed("source", "of"), "cuts")
    text, source = F.coalesce(F.col("d.text").cast("string"), F.lit("")), F.col("d.source").cast("string")
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("d.doc_id").cast("long").cast("string"), F.lit(""))))
    copies = sum((F.when(own <= F.col(f"c.cut{e}"), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    copies = F.when(text.rlike(common.WORD), copies).otherwise(1)
    joined = docs.alias("d").join(cuts.alias("c"), source.eqNullSafe(F.col("c.of")), "left")
    rows = joined.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
    return rows.select("row.*")
