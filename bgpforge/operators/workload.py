"""Workloads as tables: patterns (query_id, tp_idx, s, p, o), records (query_id, y, query), plans (query, order, cost)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bgpforge.operators import statistics

#: What a pattern workload may not contain.
KEYWORDS = ("FILTER", "UNION", "OPTIONAL", "MINUS", "GROUP BY", "ORDER BY", "SERVICE", "VALUES", "BIND")


def succeeded(records: DataFrame) -> DataFrame:
    """Records whose cardinality was counted: y is not -1. Null is kept, as nothing failed."""
    return records.where("y is null or y != -1")


def without_repeated_predicates(patterns: DataFrame) -> DataFrame:
    """Patterns of queries in which no (s, p) stands twice."""
    twice = patterns.groupBy("query_id", "s", "p").agg(F.count("*").alias("rows")).where("rows > 1").select("query_id").distinct()
    return patterns.join(twice, "query_id", "left_anti")


def at_most(records: DataFrame, most: int) -> DataFrame:
    """Records with a cardinality of at most `most`; a missing one counts as 0."""
    return records.where(F.coalesce("y", F.lit(0)) <= most)


def plain_patterns(records: DataFrame, keywords=KEYWORDS) -> DataFrame:
    """Records whose query text holds none of the keywords, in any case, as a word."""
    words = "|".join(k.replace(" ", r"\s+") for k in keywords)
    return records.where(~F.col("query").rlike(rf"(?i)\b(?:{words})\b"))


def known_terms_only(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Patterns of queries whose constants all stand in vocabulary (term)."""
    terms = patterns.select("query_id", F.explode(F.array("s", "p", "o")).alias("term")).where(~F.col("term").rlike(r"^[?$]"))
    unknown = terms.join(vocabulary.select("term"), "term", "left_anti").select("query_id").distinct()
    return patterns.join(unknown, "query_id", "left_anti")


def with_repeated_triples(patterns: DataFrame) -> DataFrame:
    """(query_id, repeats): queries that hold a triple more than once, and how many are too many."""
    size = patterns.groupBy("query_id").agg((F.count("*") - F.countDistinct("s", "p", "o")).alias("repeats"))
    return size.where("repeats > 0")


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order: later duplicates go."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def workload_multiplicities(graph: DataFrame, patterns: DataFrame) -> DataFrame:
    """Predicate statistics of the predicates that a workload uses."""
    used = patterns.select("p").where(~F.col("p").rlike(r"^[?$]")).distinct()
    return statistics.predicate_statistics(graph.join(F.broadcast(used), "p", "left_semi"))


def predicate_usage(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("p").agg(F.count("*").alias("uses"), F.countDistinct("query_id").alias("queries"))


def dataset_statistics(records: DataFrame) -> DataFrame:
    """Size, empty results, cardinalities of the others, and bound terms of (query_id, y, bound)."""
    some = lambda f: f(F.when(F.col("y") > 0, F.col("y")))
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("y") == 0).alias("zeros"),
        F.round(F.count_if(F.col("y") == 0) * 100.0 / F.count("*"), 6).cast("double").alias("zero_pct"),
        some(F.min).alias("low"),
        some(F.max).alias("high"),
        F.round(some(F.avg), 6).alias("mean"),
        F.round(some(lambda c: F.percentile(c, F.lit(0.5))), 6).alias("median"),
        F.round(F.avg("bound"), 6).alias("mean_bound"),
        F.min("bound").alias("min_bound"),
        F.max("bound").alias("max_bound"),
    )


def worst(rows: DataFrame, actual: str, predicted: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest q-error; ties to the smaller key."""
    return rows.select(key, F.round(statistics.q_error(F.col(actual), F.col(predicted)), 6).alias("q")).orderBy(F.desc("q"), key).limit(k)


def extremes(coverage: DataFrame, n: int) -> DataFrame:
    """(kind, term): the n terms of highest and lowest coverage, and the n most and least frequent ones, of (term, db_freq, pct)."""
    kinds = (("highest", F.desc("pct")), ("lowest", F.asc("pct")), ("most", F.desc("db_freq")), ("least", F.asc("db_freq")))
    out = [coverage.orderBy(by, "term").limit(n).select(F.lit(kind).alias("kind"), "term") for kind, by in kinds]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def most_uncertain(rows: DataFrame, share: float, key: str = "query_id", value: str = "variance") -> DataFrame:
    """The int(n * share) rows with the largest value; ties to the smaller key."""
    return rows.orderBy(F.desc(value), key).limit(int(rows.count() * share))


def numbered(rows: DataFrame, order: list[str], name: str = "id", parts: int = 16) -> DataFrame:
    """A number from 0 for each row in a total order. Ranges of the order are counted apart, so that no task holds all rows.

    The ranges' bounds are picked from 64 rows a part with the smallest hash, so both passes over rows, and reruns, split them alike.
    """
    sample = rows.select(F.struct(*order).alias("_b")).orderBy(F.xxhash64(*order)).limit(64 * parts)
    bounds = sample.agg(F.sort_array(F.collect_list("_b")).alias("_s")).select(F.filter("_s", lambda x, i: i % 64 == 63).alias("_bounds"))
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("_part", F.size(F.filter("_bounds", lambda b: b < F.struct(*order)))).drop("_bounds")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    # At most `parts` rows and one.
    starts = sizes.withColumn("_start", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).select("_part", "_start")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + place - 1).cast("long")).drop("_part", "_start")


def slow_down_order(usage: DataFrame) -> DataFrame:
    """Predicates by how often they occur, rarest first, with their place: (p, triples, place)."""
    return numbered(usage.select("p", "triples"), ["triples", "p"], "place", 4)


def standardised(plans: DataFrame, mean: float | None = None, std: float | None = None) -> DataFrame:
    """Costs less their mean, by their population deviation, and scaled to 0..1; statistics that are None are taken from the plans."""
    stats = plans.agg(F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("std"), F.min("cost").alias("low"), F.max("cost").alias("high"))
    given = stats.select(F.lit(mean).cast("double").alias("m") if mean is not None else F.col("mean").alias("m"), F.lit(std).cast("double").alias("d") if std is not None else F.col("std").alias("d"), "low", "high")
    out = plans.crossJoin(F.broadcast(given))
    z = F.when(F.col("d") > 0, (F.col("cost") - F.col("m")) / F.col("d")).otherwise(F.lit(0.0))
    unit = F.when(F.col("high") > F.col("low"), (F.col("cost") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    return out.select(*plans.columns, F.round(z, 6).alias("z"), F.round(unit, 6).alias("unit"))


def best_of_prefixes(plans: DataFrame) -> DataFrame:
    """(query, prefix, cost, order): the cheapest full order of (query, order array<int>, cost) that begins with each prefix of two patterns or more; ties to the smaller order."""
    sizes = F.when(F.size("order") > 2, F.sequence(F.lit(2), F.size("order") - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = plans.select("query", "order", "cost", F.explode(sizes).alias("k")).select("query", F.expr("slice(order, 1, k)").alias("prefix"), F.struct("cost", "order").alias("best"))
    return prefixes.groupBy("query", "prefix").agg(F.min("best").alias("best")).select("query", "prefix", "best.cost", "best.order")


def plan_dataset(plans: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Training rows (id, query, prefix, log_cost, z) of simulated plans (query, order, cost): every order once, its prefixes at their best plan's cost.

    Queries of done (query) are left out, so that a run can be resumed. The logarithm is of 1 + cost, and z is standardised over all rows.
    """
    rows = first_of_each(plans.where("cost is not null"), ["query", "order"], ["cost"])
    if done is not None:
        rows = rows.join(done.select("query"), "query", "left_anti")
    every = best_of_prefixes(rows).select("query", "prefix", "cost").unionAll(rows.select("query", F.col("order").alias("prefix"), "cost"))
    logs = every.select("query", "prefix", F.log1p("cost").alias("cost"))
    out = standardised(logs).select("query", "prefix", F.round("cost", 6).alias("log_cost"), "z")
    return numbered(out, ["query", "prefix"])


def with_targets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Records with the plans of their query text; those without any go."""
    return records.join(targets, "query")


def numbered_variables(query: Column) -> Column:
    """A query text whose variables are named ?z0, ?z1, ... in order of first appearance."""
    names = F.array_distinct(F.regexp_extract_all(query, F.lit(r"[?$]\w+"), F.lit(0)))
    pieces = F.split(query, r"[?$]\w+", -1)
    found = F.regexp_extract_all(query, F.lit(r"[?$]\w+"), F.lit(0))
    named = F.transform(found, lambda v: F.concat(F.lit("?z"), (F.array_position(names, v) - 1).cast("string")))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("a"), named.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit(""))))), "")


def looked_up(table: Column, key: Column, default) -> Column:
    """A map's value for a key, or a default."""
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def plan_key(order: Column, query: Column) -> Column:
    """An order and its query as one text key."""
    return F.concat(F.lit("("), F.array_join(order.cast("array<string>"), ", "), F.lit("),"), query)


def run_status(error: Column, seconds: Column, timeout: float) -> Column:
    """OK, TIMEOUT (the limit was reached), TIME_OUT (the engine says so) or FAIL."""
    says = F.lower(F.coalesce(error, F.lit("")))
    return F.when(error.isNull() & (seconds < timeout), "OK").when(error.isNull(), "TIMEOUT").when(says.contains("timed out") | says.contains("timeout"), "TIME_OUT").otherwise("FAIL")


def walk_coverage(walks: DataFrame, terms: DataFrame, least: int = 1) -> DataFrame:
    """(missing, rare): how many terms (term) no walk holds, and how many walks (walk array<string>) hold fewer than `least` times."""
    counts = walks.select(F.explode("walk").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    joined = terms.select("term").distinct().join(counts, "term", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return joined.agg(F.count_if(F.col("n") == 0).alias("missing"), F.count_if((F.col("n") > 0) & (F.col("n") < least)).alias("rare"))


def walk_difference(walks: DataFrame, graph: DataFrame) -> DataFrame:
    """(term, in_walks, in_graph) where the counts differ."""
    counts = walks.select(F.explode("walk").alias("term")).groupBy("term").agg(F.count("*").alias("in_walks"))
    joined = counts.join(statistics.term_occurrences(graph).withColumnRenamed("cnt", "in_graph"), "term", "full")
    return joined.select("term", F.coalesce("in_walks", F.lit(0)).alias("in_walks"), F.coalesce("in_graph", F.lit(0)).alias("in_graph")).where("in_walks != in_graph")
