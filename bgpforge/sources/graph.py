"""Graph sources: relational tables as triples, N-Triples, delimited text, query records; and sinks for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bgpforge.operators.workload import numbered

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: (predicate, table, subject: kind and column, object: kind and column or None for a literal, whether rows repeat).
MAPPING = (
    ("placedBy", "orders", ("order", "o_orderkey"), ("customer", "o_custkey"), False),
    ("priority", "orders", ("order", "o_orderkey"), (None, "o_orderpriority"), False),
    ("status", "orders", ("order", "o_orderkey"), (None, "o_orderstatus"), False),
    ("inNation", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), False),
    ("inNation", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), False),
    ("segment", "customer", ("customer", "c_custkey"), (None, "c_mktsegment"), False),
    ("inRegion", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), False),
    ("name", "region", ("region", "r_regionkey"), (None, "r_name"), False),
    ("hasPart", "lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), True),
    ("suppliedBy", "lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey"), True),
    ("brand", "part", ("part", "p_partkey"), (None, "p_brand"), False),
    ("type", "part", ("part", "p_partkey"), (None, "p_type"), False),
)


def _branch(predicate, table, subject, value, repeats) -> str:
    iri = lambda kind, column: f"'<urn:{kind}/' || CAST({column} AS STRING) || '>'"
    o = iri(*value) if value[0] else f"'\"' || {value[1]} || '\"'"
    # What repeats is made distinct as keys, before any text is made of them.
    rows = f"(SELECT DISTINCT {subject[1]}, {value[1]} FROM {table})" if repeats else table
    return f"SELECT {iri(*subject)} AS s, '<urn:p/{predicate}>' AS p, {o} AS o FROM {rows}"


#: The triples in SQL that Spark and DuckDB share. A graph is a set: only tables whose rows can repeat a triple need DISTINCT.
TRIPLES_SQL = " UNION ALL ".join(_branch(*x) for x in MAPPING)


def register(spark: SparkSession, sf_dir: str, tables=TABLES) -> None:
    """Temporary views of the tables, those behind `triples` at least, and of `triples`. A constant predicate prunes the view to the tables behind it."""
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    spark.sql(TRIPLES_SQL).createOrReplaceTempView("triples")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, dict.fromkeys(x[1] for x in MAPPING))
    return spark.table("triples")


def read_ntriples(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """N-Triples lines (or tab-delimited ones) as a set of (s, p, o); the final dot goes, comments and blank lines too."""
    line = F.regexp_replace(F.trim("value"), r"\s*\.\s*$", "")
    parts = F.split(line, separator if separator == "\t" else r"\s+", 3)
    rows = spark.read.text(path).where("length(trim(value)) > 0 and not startswith(trim(value), '#')")
    return rows.select(*[F.element_at(parts, i + 1).alias(c) for i, c in enumerate("spo")]).distinct()


def write_ntriples(graph: DataFrame, path: str) -> None:
    graph.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def read_delimited(spark: SparkSession, path: str, separator: str = ",", base: str = "http://example.org/") -> DataFrame:
    """Three-column CSV or TSV as triples of IRIs below a base."""
    rows = spark.read.csv(path, sep=separator).toDF("s", "p", "o")
    return rows.select(*[F.format_string(f"<{base}%s>", c).alias(c) for c in "spo"]).distinct()


def entity_ids(graph: DataFrame) -> DataFrame:
    """(term, id): ids from 0 in order of term."""
    terms = graph.select(F.col("s").alias("term")).union(graph.select("o")).distinct()
    return numbered(terms, ["term"])


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Query records {x, y, query, triples, type}; type defaults to the file's name, limit is per file."""
    rows = spark.read.option("multiLine", True).schema("x array<string>, y long, query string, triples array<array<string>>, type string").json(path)
    rows = rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).withColumn("type", F.coalesce("type", "file"))
    if limit is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("query"))).where(F.col("n") <= limit).drop("n")
    return rows.drop("file")


def read_query_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.text(path).where("length(trim(value)) > 0").withColumnRenamed("value", "query")
    return rows if limit is None else rows.limit(limit)


def read_query_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, query): queries apart by blank lines."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return rows.select("file", F.posexplode(F.split("value", r"\n\s*\n")).alias("position", "query")).where("length(trim(query)) > 0")


def with_cardinalities(queries: DataFrame, cardinalities: DataFrame) -> DataFrame:
    """Zip two line files by position: (position, query) with (position, y)."""
    return queries.join(cardinalities, "position")


def write_append(rows: DataFrame, path: str, key: str = "query") -> int:
    """Resumable sink: append the rows whose key the table does not hold yet; returns how many."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def embedding_text(vectors: DataFrame, predicates: DataFrame, size: int = 128, separator: str = " ") -> DataFrame:
    """Lines `term v1 v2 ...`, predicates first; a predicate without vector is zeros."""
    heads = predicates.select("term").distinct().join(vectors, "term", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), size))).withColumn("first", F.lit(0))
    rest = vectors.join(predicates.select("term").distinct(), "term", "left_anti").withColumn("first", F.lit(1))
    lines = heads.select("first", "term", "vec").unionByName(rest.select("first", "term", "vec"))
    return lines.orderBy("first", "term").select(F.concat_ws(separator, "term", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))


def text_graph(graph: DataFrame, type_predicate: str) -> DataFrame:
    """Lines `t`, `v id labels`, `e src dst label` of a labelled graph; label 0 where a vertex has no type."""
    ids = entity_ids(graph)
    types = graph.where(F.col("p") == type_predicate)
    labels = numbered(types.select("o").distinct(), ["o"]).select("o", (F.col("id") + 1).alias("label"))
    of = types.join(labels, "o").groupBy("s").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    vertices = ids.join(of, ids.term == of.s, "left").select(F.lit(1).alias("k"), "id", F.concat_ws(" ", F.lit("v"), F.col("id"), F.coalesce(F.array_join("labels", " "), F.lit("0"))).alias("value"))
    predicates = numbered(graph.select("p").distinct(), ["p"], "label")
    edges = graph.join(predicates, "p").join(ids.select(F.col("term").alias("s"), F.col("id").alias("a")), "s").join(ids.select(F.col("term").alias("o"), F.col("id").alias("b")), "o")
    edges = edges.select(F.lit(2).alias("k"), F.col("a").alias("id"), F.concat_ws(" ", F.lit("e"), "a", "b", "label").alias("value"))
    head = graph.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("id"), F.lit("t").alias("value"))
    return head.union(vertices).union(edges).orderBy("k", "id", "value").select("value")
