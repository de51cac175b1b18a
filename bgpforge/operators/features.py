"""Query graphs as features: nodes are subjects and objects, edges are patterns in both directions. One plan for a whole workload.

A workload is a table of patterns (query_id, tp_idx, s, p, o). Groups and windows are by query, so they hold one query's terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_variable(term: str | Column) -> Column:
    return (F.col(term) if isinstance(term, str) else term).rlike(r"^[?$]")


def places(patterns: DataFrame, columns: str = "spo") -> DataFrame:
    """(query_id, term, first): every term of a query with its first place, counted over `columns` of the patterns in order."""
    at = lambda k: (F.col("tp_idx") * len(columns) + k).cast("long")
    each = patterns.select("query_id", F.explode(F.array(*[F.struct(F.col(c).alias("term"), at(k).alias("at")) for k, c in enumerate(columns)])).alias("x"))
    return each.groupBy("query_id", "x.term").agg(F.min("x.at").alias("first"))


def term_numbers(patterns: DataFrame, columns: str = "spo", variables_only: bool = False) -> DataFrame:
    """(query_id, term, id): terms numbered from 0 by first appearance in their query."""
    rows = places(patterns, columns)
    rows = rows.where(is_variable("term")) if variables_only else rows
    return rows.select("query_id", "term", (F.row_number().over(Window.partitionBy("query_id").orderBy("first")) - 1).cast("long").alias("id"))


def common_values(patterns: DataFrame, sketched: DataFrame) -> DataFrame:
    """(query_id, term, shared): log(1 + x) of the least estimated overlap of any two value sets that a variable is drawn from; 0 below two sets."""
    known = patterns.join(F.broadcast(sketched.withColumnRenamed("p", "sp")), F.col("p") == F.col("sp"))
    ends = known.select("query_id", F.explode(F.array(F.struct(F.col("s").alias("term"), (F.col("tp_idx") * 2).alias("at"), F.col("domain").alias("sketch")), F.struct(F.col("o").alias("term"), (F.col("tp_idx") * 2 + 1).alias("at"), F.col("range").alias("sketch")))).alias("x"))
    ends = ends.select("query_id", "x.term", "x.at", "x.sketch").where(is_variable("term"))
    other = ends.select("query_id", "term", F.col("at").alias("at2"), F.col("sketch").alias("sketch2"))
    size = lambda c: F.hll_sketch_estimate(c)
    overlap = F.greatest(F.lit(0), size("sketch") + size("sketch2") - F.hll_sketch_estimate(F.hll_union("sketch", "sketch2")))
    pairs = ends.join(other, ["query_id", "term"]).where("at < at2").groupBy("query_id", "term").agg(F.log1p(F.min(overlap).cast("double")).alias("shared"))
    return ends.select("query_id", "term").distinct().join(pairs, ["query_id", "term"], "left").select("query_id", "term", F.coalesce("shared", F.lit(0.0)).alias("shared"))


def _vectors(patterns, occurrences, embeddings, size, multiplicities, sketched, rich) -> DataFrame:
    """(query_id, term, is_predicate, vector) of every term in each of its two roles."""
    roles = patterns.select("query_id", F.explode(F.array(*[F.struct(F.col(c).alias("term"), F.lit(c == "p").alias("is_predicate")) for c in "spo"])).alias("x")).select("query_id", "x.*").distinct()
    numbers = term_numbers(patterns, "spo", variables_only=True)
    rows = roles.join(numbers, ["query_id", "term"], "left").join(occurrences.select("term", "cnt"), "term", "left").join(embeddings.select("term", "vec"), "term", "left")
    zeros, ones = (F.array_repeat(F.lit(x), size) for x in (0.0, 1.0))
    count = F.log1p(F.coalesce("cnt", F.lit(0)).cast("double"))
    variable, vec = is_variable("term"), F.col("vec").cast("array<double>")
    number = F.col("id").cast("double")
    if not rich:
        return rows.select("query_id", "term", "is_predicate", F.when(variable, F.concat(F.array(number), ones)).otherwise(F.concat(F.array(count), F.coalesce(vec, zeros))).alias("vector"))
    if sketched is not None:
        rows = rows.join(common_values(patterns, sketched), ["query_id", "term"], "left")
    shared = F.when(~F.col("is_predicate"), F.coalesce("shared", F.lit(0.0))).otherwise(F.lit(0.0)) if sketched is not None else F.lit(0.0)
    none = F.array().cast("array<double>")
    of_variable = of_constant = none
    if multiplicities is not None:
        rows = rows.join(F.broadcast(multiplicities.select(F.col("p").alias("term"), "m_so", "m_os")), "term", "left")
        missing = F.raise_error(F.concat(F.lit("no multiplicity of predicate "), F.col("term"))).cast("array<double>")
        of_variable = F.array(*[F.lit(0.0)] * 3)
        of_constant = F.when(~F.col("is_predicate"), of_variable).when(F.col("m_so").isNull(), missing).otherwise(F.array(F.log1p("m_so"), F.log1p("m_os"), F.lit(1.0)))
    kind = lambda k: F.array(*[F.lit(float(i == k)) for i in range(3)])
    a = F.concat(F.array(number, shared), of_variable, kind(0), ones)
    b = F.concat(F.array(count, F.lit(1.0)), of_constant, F.when(vec.isNotNull(), F.concat(kind(2), vec)).otherwise(F.concat(kind(1), zeros)))
    return rows.select("query_id", "term", "is_predicate", F.when(variable, a).otherwise(b).alias("vector"))


def query_graphs(patterns: DataFrame, occurrences: DataFrame, embeddings: DataFrame, size: int, rich: bool = False, cardinalities: DataFrame | None = None, multiplicities: DataFrame | None = None, sketched: DataFrame | None = None) -> DataFrame:
    """(query_id, nodes, edge_src, edge_dst, edge_attr, id_to_term).

    Nodes are subjects and objects by first appearance. Plain vectors: a variable is its number and ones, a constant log(1 + count) and its
    embedding, or zeros. Rich ones (`rich`) have a second number (common values of a variable, from `sketched`; 1 for constants), the logged
    multiplicities of predicates with a flag (where `multiplicities` is given), one of three marks (variable, without, with embedding), and on edges the
    logged cardinality of the pattern from `cardinalities` (query_id, tp_idx, cnt; missing: 0). Every pattern is an edge forth and one back,
    the last feature of which is 1 and -1. A term that occurs nowhere counts 0. Queries without patterns give no row.
    """
    vectors = _vectors(patterns, occurrences, embeddings, size, multiplicities, sketched, rich)
    numbers = term_numbers(patterns, "so")
    nodes = numbers.join(vectors.where("NOT is_predicate"), ["query_id", "term"])
    nodes = nodes.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "term", "vector"))).alias("n"))
    end = lambda c, name: numbers.select("query_id", F.col("term").alias(c), F.col("id").alias(name))
    edges = patterns.join(end("s", "src"), ["query_id", "s"]).join(end("o", "dst"), ["query_id", "o"]).join(vectors.where("is_predicate").select("query_id", F.col("term").alias("p"), "vector"), ["query_id", "p"])
    more = F.array().cast("array<double>")
    if rich:
        counts = patterns.select("query_id", "tp_idx", F.lit(0).alias("cnt")).limit(0) if cardinalities is None else cardinalities.select("query_id", "tp_idx", "cnt")
        edges = edges.join(counts, ["query_id", "tp_idx"], "left")
        more = F.array(F.log1p(F.coalesce("cnt", F.lit(0)).cast("double")))
    one = lambda a, b, way: F.struct("tp_idx", F.lit(-way).alias("turn"), F.col(a).alias("a"), F.col(b).alias("b"), F.concat("vector", more, F.array(F.lit(way))).alias("attr"))
    both = edges.select("query_id", F.explode(F.array(one("src", "dst", 1.0), one("dst", "src", -1.0))).alias("e"))
    both = both.groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return nodes.join(both, "query_id").select("query_id", F.col("n.vector").alias("nodes"), F.col("e.a").alias("edge_src"), F.col("e.b").alias("edge_dst"), F.col("e.attr").alias("edge_attr"), F.col("n.term").alias("id_to_term"))


def flattened(graphs: DataFrame) -> DataFrame:
    """(query_id, part, i, j, value): every number of `query_graphs`, to 6 decimals."""
    one = lambda part, c: graphs.select("query_id", F.lit(part).alias("part"), F.posexplode(c).alias("i", "v")).select("query_id", "part", "i", F.posexplode("v").alias("j", "value"))
    ends = graphs.select("query_id", F.lit("ends").alias("part"), F.posexplode(F.arrays_zip("edge_src", "edge_dst")).alias("i", "v")).select("query_id", "part", "i", F.posexplode(F.array("v.edge_src", "v.edge_dst").cast("array<double>")).alias("j", "value"))
    rows = one("node", "nodes").unionAll(one("edge", "edge_attr")).unionAll(ends)
    return rows.select("query_id", "part", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("value", 6).alias("value"))


FEATURIZERS = {"predicate_edge": lambda *a, **k: query_graphs(*a, **k, rich=False), "predicate_edge_hll": lambda *a, **k: query_graphs(*a, **k, rich=True)}
