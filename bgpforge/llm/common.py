"""What the operators of this subpackage share: written tables, connected components, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space class for every operator: blank and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where it names none, a temporary one in local mode; an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="forge-")
    return _fallback[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    The frame carries its path as `written_path`, for `drop`.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "written_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _contract(batches):
    """Replace the links of one partition by stars around each component's smallest node."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, find(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    if pairs:
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([r for _, r in pairs], pa.int64())})


#: Links that one task contracts at most.
LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) for each linked node.

    component is the smallest node reachable. Partitions first contract their own links to stars. Where these are few
    enough for one task, a second contraction ends it; else large-star and small-star steps alternate until nothing changes, every step a shuffle of
    links, and a hub's rows meet only in joins, whose partitions may be split.
    """
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").mapInArrow(_contract, "a long, b long"), "links")
    tasks = -(-edges.count() // LINKS)
    if tasks:
        after = written(edges.coalesce(tasks).mapInArrow(_contract, "a long, b long"), "links")
        drop(edges)
        edges = after
    if tasks > 1:
        edges = _settled(edges)
    roots = edges.select(F.col("b").alias("node")).distinct()
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
    out.written_path = edges.written_path
    return out


def _settled(edges: DataFrame) -> DataFrame:
    """Stars (a, b) around the smallest node of each component."""
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        after = written(small, "links")
        state = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        drop(edges)
        edges = after
        if state == seen or state[0] == 0:
            break
        seen = state
    return edges


def give_back() -> None:
    """Return what this Python worker has freed to the system, where its C library can: idle workers live on beside later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def collect(spark: SparkSession) -> None:
    """Let the JVM of every executor collect its garbage and give freed heap back to the system, and let the driver give back what it has freed.

    A JVM keeps the heap that its largest stage took, beside the Python workers of later stages. The collections run in tasks, two for each slot;
    Spark deals them to free slots, so an executor may be left out where others are faster, which costs memory only.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc"), "id").write.format("noop").mode("overwrite").save()
    collect_driver(spark)


def collect_driver(spark: SparkSession) -> bool:
    """Let the driver's Python and JVM give freed memory back to the system; whether the JVM could trim what it holds beside its heap.

    Compilers take hundreds of MB beside the heap, which the C library keeps once they are freed. JVMs that cannot trim it keep it, which costs memory only.
    """
    import gc

    from py4j.protocol import Py4JError

    gc.collect()
    give_back()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.gc()

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    try:
        # The server's own class is closed to reflection, the interface is not.
        kind, found = jvm.java.lang.Class, jvm.java.lang.Class.forName
        types = array(kind, *map(found, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = found("javax.management.MBeanServerConnection").getMethod("invoke", types)
        command = array(jvm.java.lang.Object, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    except Py4JError:
        return False
    return True


#: What this Python worker remembers from task to task, by operator.
_remembered: dict[str, dict] = {}


def remembered(operator: str | None = None) -> dict:
    """What this Python worker remembers for an operator; what it remembers for others is dropped, as later stages use the worker again."""
    for other in [x for x in _remembered if x != operator]:
        del _remembered[other]
    return _remembered.setdefault(operator, {}) if operator else {}


def giving_back(make, operator: str | None = None):
    """The function of batches `make`, followed by `give_back`; it begins without what the worker remembers for other operators."""

    def run(batches):
        remembered(operator)
        yield from make(batches)
        give_back()

    return run


def documents(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
