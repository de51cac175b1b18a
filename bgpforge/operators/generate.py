"""Seeded workloads and walks as iterated joins, renaming-free deduplication, and query features.

Choices are the smallest of a seeded hash, so a run repeats; each is made for all seeds at once, not one request at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bgpforge.plans.bgp import Bgp, BgpError, canonical, parse


def uniform(seed: int, *columns):
    """A number in (0, 1) for each row, from a seeded hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_003)) + 1) / 1_000_005.0


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int, *keys) -> DataFrame:
    """n rows without replacement, each as likely as its weight: the smallest of -ln(u) / weight."""
    return rows.withColumn("__k", -F.log(uniform(seed, *keys)) / F.col(weight)).orderBy("__k", *keys).limit(n).drop("__k")


def sample_terms(graph: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """n terms of a column, the rarer the likelier: weight 1 / (count + 1)."""
    counts = graph.groupBy(F.col(column).alias("term")).agg((1 / (F.count("*") + 1)).alias("w"))
    return weighted_sample(counts, "w", n, seed, "term").select("term")


def stars(graph: DataFrame, size: int, n: int, seed: int = 0, bound: float = 0.2) -> DataFrame:
    """(query, y): stars of `size` predicates around sampled subjects, some objects bound, with their true number of solutions over the graph."""
    picked = sample_terms(graph, "s", n, seed)
    of = graph.join(picked, F.col("s") == F.col("term")).groupBy("s", "p").agg(F.min("o").alias("o"))
    arms = of.groupBy("s").agg(F.sort_array(F.collect_list(F.struct(uniform(seed, "s", "p").alias("u"), "p", "o"))).alias("arms")).where(F.size("arms") >= size)
    arms = arms.select("s", F.transform(F.slice("arms", 1, size), lambda x: F.struct(x["p"].alias("p"), F.when(x["u"] < bound, x["o"]).alias("o"))).alias("arms"))
    text = lambda x, i: F.concat(F.lit("?s "), x["p"], F.coalesce(F.concat(F.lit(" "), x["o"]), F.concat(F.lit(" ?o"), i.cast("string"))), F.lit(" ."))
    counts = star_counts(graph, arms.select(F.col("s").alias("star"), "arms"))
    query = F.concat(F.lit("SELECT * WHERE { "), F.array_join(F.transform("arms", text), " "), F.lit(" }")).alias("query")
    return arms.join(counts, F.col("s") == F.col("star")).select(query, "y")


def empty_stars(graph: DataFrame, size: int, n: int, seed: int = 0) -> DataFrame:
    """(query, y): stars around sampled subjects with one predicate replaced by another of the graph, as far as they then have no solution; y is 0."""
    picked = sample_terms(graph, "s", n, seed)
    predicates = graph.select("p").distinct()
    of = graph.join(picked, F.col("s") == F.col("term")).select("s", "p").distinct()
    arms = of.groupBy("s").agg(F.sort_array(F.collect_list(F.struct(uniform(seed, "s", "p").alias("u"), "p"))).alias("a")).where(F.size("a") >= size).select("s", F.slice("a.p", 1, size).alias("ps"))
    other = arms.join(F.broadcast(predicates), ~F.array_contains("ps", F.col("p"))).groupBy("s", "ps").agg(F.min_by("p", uniform(seed + 1, "s", "p")).alias("p"))
    made = other.select(F.col("s").alias("star"), F.concat(F.array("p"), F.slice("ps", 2, size)).alias("ps"))
    counts = star_counts(graph, made.select("star", F.transform("ps", lambda p: F.struct(p.alias("p"), F.lit(None).cast("string").alias("o"))).alias("arms")))
    text = F.array_join(F.transform("ps", lambda p, i: F.concat(F.lit("?s "), p, F.lit(" ?o"), i.cast("string"), F.lit(" ."))), " ")
    return made.join(counts, "star", "left_anti").select(F.concat(F.lit("SELECT * WHERE { "), text, F.lit(" }")).alias("query"), F.lit(0).cast("long").alias("y"))


def star_counts(graph: DataFrame, workload: DataFrame) -> DataFrame:
    """(star, y): solutions over all subjects of stars (star, arms) with arms (p, o), predicates distinct and o null where the object is free.

    One pass over the graph for the whole workload: solutions of each distinct arm at each subject, then for each star the sum over subjects
    of their product. Stars without solutions give no row.
    """
    wanted = workload.select("star", F.size("arms").alias("size"), F.explode("arms").alias("arm")).select("star", "size", F.col("arm.p").alias("wp"), F.col("arm.o").alias("wo"))
    distinct = wanted.select("wp", "wo").distinct()
    at = graph.join(F.broadcast(distinct), (F.col("p") == F.col("wp")) & (F.col("wo").isNull() | (F.col("o") == F.col("wo")))).groupBy("s", "wp", "wo").agg(F.count("*").alias("c"))
    met = at.withColumnsRenamed({"wp": "ap", "wo": "ao"}).join(F.broadcast(wanted), (F.col("ap") == F.col("wp")) & F.col("ao").eqNullSafe(F.col("wo")))
    each = met.groupBy("star", "s", "size").agg(F.count("*").alias("arms"), F.collect_list("c").alias("c")).where("arms = size")
    return each.groupBy("star").agg(F.sum(F.aggregate("c", F.lit(1).cast("long"), lambda a, x: a * x)).alias("y"))


def paths(graph: DataFrame, size: int, n: int, seed: int = 0) -> DataFrame:
    """(query): chains of `size` patterns from sampled subjects, no predicate twice."""
    at = sample_terms(graph.where(~F.col("o").startswith('"')), "s", n, seed).select(F.col("term").alias("start"), F.col("term").alias("end"), F.array().cast("array<string>").alias("ps"))
    for k in range(size):
        step = at.join(graph, F.col("end") == F.col("s")).where(~F.array_contains("ps", F.col("p")))
        step = step.groupBy("start", "ps").agg(F.min_by(F.struct("p", "o"), uniform(seed + k, "s", "p", "o")).alias("t"))
        at = step.select("start", F.col("t.o").alias("end"), F.concat("ps", F.array("t.p")).alias("ps"))
    text = F.transform("ps", lambda p, i: F.concat(F.lit("?v"), i.cast("string"), F.lit(" "), p, F.lit(" ?v"), (i + 1).cast("string"), F.lit(" .")))
    return at.select(F.concat(F.lit("SELECT * WHERE { "), F.array_join(text, " "), F.lit(" }")).alias("query"))


def walks(graph: DataFrame, depth: int, each: int, seed: int = 0) -> DataFrame:
    """(walk): `each` random walks of up to `depth` steps from every subject, as terms s p o p o ..."""
    at = graph.select("s").distinct().select(F.array("s").alias("walk"), F.col("s").alias("end"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("n"))
    for k in range(depth):
        step = at.join(graph, F.col("end") == F.col("s"), "left")
        step = step.groupBy("walk", "end", "n").agg(F.min_by(F.struct("p", "o"), uniform(seed + k, "n", "s", "p", "o")).alias("t"))
        at = step.select(F.when(F.col("t.p").isNull(), F.col("walk")).otherwise(F.concat("walk", F.array("t.p", "t.o"))).alias("walk"), F.coalesce("t.o", "end").alias("end"), "n")
    return at.select("walk")


def embed(walked: DataFrame, size: int = 128, window: int = 5, least: int = 1, seed: int = 0) -> DataFrame:
    """(term, vec): skip-gram vectors of the terms of walks."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, seed=seed, inputCol="walk", outputCol="v").fit(walked)
    return model.getVectors().withColumnRenamed("word", "term").withColumnRenamed("vector", "vec")


def dedupe(queries: DataFrame) -> DataFrame:
    """(seq, query): the first of all queries equal but for names of variables and order of triples; what does not parse stays as it is."""

    def form(batches):
        for rows in batches:
            yield rows.assign(form=[_form(q) for q in rows["query"]])

    formed = queries.select("seq", "query").mapInPandas(form, "seq long, query string, form string")
    return formed.groupBy("form").agg(F.min(F.struct("seq", "query")).alias("x")).select("x.seq", "x.query")


def _form(text: str) -> str:
    try:
        return canonical(parse(text))
    except BgpError:
        return text


def split(queries: DataFrame, share: int = 10) -> tuple[DataFrame, DataFrame]:
    """(training, validation): one in `share`, by a hash of the query."""
    held = F.pmod(F.xxhash64("query"), F.lit(share)) == 0
    return queries.where(~held), queries.where(held)


def line_graph(spark: SparkSession, bgps: list[Bgp]) -> DataFrame:
    """(query_id, i, j, same): pairs of patterns that share a term, and which of their 3 x 3 positions are equal."""
    rows = [(q, i, *tp.terms) for q, b in enumerate(bgps) for i, tp in enumerate(b.patterns)]
    tps = spark.createDataFrame(rows, "query_id int, i int, s string, p string, o string")
    other = tps.select("query_id", F.col("i").alias("j"), *[F.col(c).alias(f"{c}2") for c in "spo"])
    same = F.array(*[(F.col(a) == F.col(f"{b}2")).cast("int") for a in "spo" for b in "spo"])
    return tps.join(other, "query_id").where("i != j").select("query_id", "i", "j", same.alias("same")).where(F.array_contains("same", 1))
