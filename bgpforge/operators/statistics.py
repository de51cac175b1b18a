"""Statistics of a graph and of workloads, each as one aggregation over the triples instead of a request for every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bgpforge.plans.bgp import Bgp


def is_literal(c: str) -> Column:
    return F.col(c).startswith('"')


def term_occurrences(graph: DataFrame) -> DataFrame:
    """(term, cnt): a triple that holds a term twice counts twice."""
    return graph.select(F.explode(F.array("s", "p", "o")).alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))


def vocabulary(graph: DataFrame) -> DataFrame:
    return term_occurrences(graph).withColumn("is_literal", is_literal("term"))


def predicate_statistics(graph: DataFrame) -> DataFrame:
    """(p, triples, subjects, objects, m_so, m_os): multiplicities are triples by distinct subjects, and by distinct objects."""
    counts = graph.groupBy("p").agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("triples") / F.col(d)).otherwise(F.lit(0.0))
    return counts.withColumn("m_so", ratio("subjects")).withColumn("m_os", ratio("objects"))


def sketches(graph: DataFrame, precision: int = 12) -> DataFrame:
    """(p, domain, range): HyperLogLog sketches."""
    return graph.groupBy("p").agg(F.hll_sketch_agg("s", precision).alias("domain"), F.hll_sketch_agg("o", precision).alias("range"))


def sketch_overlap(sketched: DataFrame, left: str, right: str) -> DataFrame:
    """Estimated common subjects of two predicates, by inclusion and exclusion, at least 0, as log(1 + x)."""
    a, b = (sketched.where(F.col("p") == p).select(F.col("domain").alias(n)) for p, n in ((left, "a"), (right, "b")))
    size = F.hll_sketch_estimate("a") + F.hll_sketch_estimate("b") - F.hll_sketch_estimate(F.hll_union("a", "b"))
    return a.crossJoin(b).select(F.log1p(F.greatest(F.lit(0.0), size.cast("double"))).alias("log_overlap"))


def degrees(graph: DataFrame, column: str = "s") -> DataFrame:
    return graph.groupBy(F.col(column).alias("term")).agg(F.count("*").alias("degree"))


def pattern_cardinalities(graph: DataFrame, bgps: list[Bgp]) -> DataFrame:
    """(tp_key, cnt) of the distinct patterns of a workload: one pass over the graph."""
    found = {tp.key: tp for bgp in bgps for tp in bgp.patterns}

    def matches(tp) -> Column:
        out, seen = F.lit(True), {}
        for c, t in zip("spo", tp.terms, strict=True):
            if t[0] not in "?$":
                out = out & (F.col(c) == t)
            elif t[1:] in seen:
                out = out & (F.col(c) == F.col(seen[t[1:]]))
            else:
                seen[t[1:]] = c
        return out

    row = graph.agg(*[F.count_if(matches(tp)).alias(f"c{i}") for i, tp in enumerate(found.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("tp_key"), F.col(f"c{i}").alias("cnt")) for i, k in enumerate(found)])).alias("x")).select("x.*")


def workload_occurrences(graph: DataFrame, bgps: list[Bgp]) -> DataFrame:
    """(term, cnt) of each distinct constant of a workload, 0 where the graph lacks it."""
    terms = sorted({t for b in bgps for tp in b.patterns for t in tp.terms if t[0] not in "?$"})
    wanted = graph.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return wanted.join(term_occurrences(graph), "term", "left").select("term", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def characteristic_sets(graph: DataFrame) -> DataFrame:
    """(predicates, subjects): how many subjects have exactly these predicates."""
    return graph.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("p")), " ").alias("predicates")).groupBy("predicates").agg(F.count("*").alias("subjects"))


def two_hops(graph: DataFrame, term: str, most: int | None = None) -> DataFrame:
    """Distinct triples within two steps of a term, in both directions."""
    near = graph.where((F.col("s") == term) | (F.col("o") == term))
    ends = near.select(F.explode(F.array("s", "o")).alias("x")).where(~F.col("x").startswith('"')).distinct()
    far = graph.join(ends, F.col("s") == F.col("x"), "left_semi").union(graph.join(ends, F.col("o") == F.col("x"), "left_semi"))
    out = near.union(far).distinct()
    return out if most is None else out.limit(most)


def q_error(actual: Column, predicted: Column) -> Column:
    """Both at least 1; the larger ratio."""
    t, p = F.greatest(actual.cast("double"), F.lit(1.0)), F.greatest(predicted.cast("double"), F.lit(1.0))
    return F.greatest(t / (p + 1e-7), p / (t + 1e-7))


def error_summary(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = rows.select(q_error(F.col(actual), F.col(predicted)).alias("q"), F.abs(F.col(actual) - F.col(predicted)).cast("double").alias("d"))
    at = lambda p: F.round(F.percentile("q", F.lit(p)), 6)
    return e.agg(F.round(F.avg("q"), 6).alias("mean_q"), *[at(x / 100).alias(f"p{x}") for x in (50, 90, 95, 99)], F.round(F.avg("d"), 6).alias("mae"))


def coverage(graph: DataFrame, bgps: list[Bgp]) -> DataFrame:
    """(term, q_freq, db_freq, pct): share of a term's occurrences that a workload uses, in percent; 0 where it has none."""
    uses: dict[str, int] = {}
    for b in bgps:
        for tp in b.patterns:
            for t in tp.terms:
                if t[0] not in "?$":
                    uses[t] = uses.get(t, 0) + 1
    used = graph.sparkSession.createDataFrame(sorted(uses.items()), "term string, q_freq long")
    joined = used.join(term_occurrences(graph), "term", "left").select("term", "q_freq", F.coalesce("cnt", F.lit(0)).alias("db_freq"))
    return joined.withColumn("pct", F.when(F.col("db_freq") > 0, F.col("q_freq") / F.col("db_freq") * 100).otherwise(F.lit(0.0)))
