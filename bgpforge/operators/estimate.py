"""Estimates of a pattern's solutions: characteristic sets and wander join; and the text form that estimators outside read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bgpforge.operators.evaluate import scan
from bgpforge.operators.generate import uniform
from bgpforge.plans.bgp import Bgp, BgpError, adjacency, connected_subgraphs, parse


def characteristic_multiplicities(graph: DataFrame) -> DataFrame:
    """(id, subjects, p, triples): for each set of predicates that subjects have, its subjects, and the triples of each of its predicates."""
    per = graph.groupBy("s", "p").agg(F.count("*").alias("n"))
    of = per.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("ps"))
    sets = of.select(F.array_join("ps.p", " ").alias("id"), F.explode("ps").alias("x"))
    return sets.groupBy("id", F.col("x.p").alias("p")).agg(F.count("*").alias("subjects"), F.sum("x.n").alias("triples"))


def star_estimate(graph: DataFrame, predicates: list[str]) -> DataFrame:
    """(estimate): solutions of the star of `predicates` with free objects; in every set that has them all, subjects times the mean triples of each."""
    wanted = list(dict.fromkeys(predicates))
    power = F.create_map(*[x for p in wanted for x in (F.lit(p), F.lit(predicates.count(p)))])
    held = characteristic_multiplicities(graph).where(F.col("p").isin(wanted))
    mean = F.pow(F.col("triples") / F.col("subjects"), power[F.col("p")])
    sets = held.groupBy("id").agg(F.first("subjects").alias("subjects"), F.count("*").alias("n"), F.collect_list(mean).alias("means")).where(F.col("n") == len(wanted))
    return sets.agg(F.coalesce(F.sum(F.col("subjects") * F.aggregate("means", F.lit(1.0), lambda a, x: a * x)), F.lit(0.0)).alias("estimate"))


def wander_join(graph: DataFrame, bgp: Bgp, walks: int, seed: int = 0) -> DataFrame:
    """(estimate, walks, ended): solutions estimated from seeded random walks over the patterns in order, all walks advanced by one join.

    A walk starts at a triple of the first pattern, and goes on to one of the triples that match what is bound, each as likely; it counts as the
    product of the numbers it chose from, or 0 where nothing matches. Every pattern must share a variable with those before it. Starts
    are triples with a small seeded hash, about `walks` of them (the count is returned), so nothing is sorted; with no fewer walks than triples,
    every triple starts one, and only choices after the second pattern are left to chance. Rows of the graph are distinct.
    """
    first, bound = scan(graph, bgp.patterns[0]), list(bgp.patterns[0].variables)
    if not bound:
        raise BgpError("the first pattern has no variable")
    total = chosen = first.count()
    at = first
    if walks < total:
        at = first.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *bound), 11) / float(1 << 53) < walks / total)
        chosen = at.count()
    at = at.withColumn("__w", F.lit(1.0)).withColumn("__id", F.monotonically_increasing_id())
    for k, tp in enumerate(bgp.patterns[1:], 1):
        shared = [v for v in tp.variables if v in bound]
        if not shared:
            raise BgpError(f"pattern {k} shares no variable with those before it")
        new = [v for v in tp.variables if v not in bound]
        met = at.join(scan(graph, tp), shared)
        pick = F.min_by(F.struct(*new), uniform(seed + k, *bound, *new)).alias("__t") if new else F.lit(None).alias("__t")
        at = met.groupBy("__id", "__w", *bound).agg(F.count("*").alias("__n"), pick)
        at = at.select("__id", (F.col("__w") * F.col("__n")).alias("__w"), *bound, *[F.col(f"__t.`{v}`").alias(v) for v in new])
        bound += new
    scale = float(total) / max(1, chosen)
    return at.agg((F.coalesce(F.sum("__w"), F.lit(0.0)) * scale).alias("estimate"), F.lit(chosen).cast("long").alias("walks"), F.count("*").alias("ended"))


def estimator_text(bgp: Bgp, ids: dict[str, int], predicate_ids: dict[str, int], type_predicate: str, number: int = 0) -> str:
    """A pattern as lines `t # s number`, `v vertex labels id` and `e subject object predicate`.

    Vertices are numbered by first appearance; labels are the ids of constant types, -1 without; variables have id -1. A term without id is an error.
    """

    def known(table: dict[str, int], term: str) -> int:
        if term[0] in "?$":
            return -1
        if term not in table:
            raise BgpError(f"no id of {term}")
        return table[term]

    vertices = {t: i for i, t in enumerate(dict.fromkeys(t for tp in bgp.patterns for t in (tp.s, tp.o)))}
    labels: dict[str, list[int]] = {}
    for tp in bgp.patterns:
        if tp.p == type_predicate and tp.o[0] not in "?$":
            labels.setdefault(tp.s, []).append(known(ids, tp.o))
    lines = [f"t # s {number}"]
    lines += [f"v {i} {' '.join(map(str, labels.get(t, [-1])))} {known(ids, t)}" for t, i in vertices.items()]
    lines += [f"e {vertices[tp.s]} {vertices[tp.o]} {known(predicate_ids, tp.p)}" for tp in bgp.patterns]
    return "\n".join(lines) + "\n"


def estimator_queries(queries: DataFrame, ids: DataFrame, type_predicate: str) -> DataFrame:
    """(query_id, part, file): the text of every connected part of every query, one row each; `part` lists its patterns from 0.

    queries: (query_id, query); ids: (term, id, predicate_id). Only ids of terms in use meet the queries, so the graph's vocabulary stays a table.
    """
    terms = queries.select("query_id", "query", F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit(r'(<[^<>\s]*>|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z-]+|\^\^<[^<>\s]*>)?)'), F.lit(1)))).alias("term"))
    found = terms.join(ids, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "id", "predicate_id")).alias("known"))

    def write(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for q, text, known in zip(rows["query_id"], rows["query"], rows["known"], strict=True):
                known = [] if known is None else list(known)
                names = {x["term"]: int(x["id"]) for x in known if x["id"] is not None}
                predicates = {x["term"]: int(x["predicate_id"]) for x in known if x["predicate_id"] is not None}
                bgp = parse(text)
                parts = sorted((tuple(sorted(c)) for c in connected_subgraphs(adjacency(bgp))), key=lambda c: (len(c), c))
                out += [(q, ",".join(map(str, c)), estimator_text(bgp.sub(c), names, predicates, type_predicate, j)) for j, c in enumerate(parts)]
            yield pd.DataFrame(out, columns=["query_id", "part", "file"])

    return queries.join(found, "query_id", "left").select("query_id", "query", "known").mapInPandas(write, "query_id long, part string, file string")


def estimator_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, estimate, seconds) of lines `path estimate seconds`; other lines are left out."""
    part = lambda k: F.regexp_extract(column, r"^\s*(\S+)\s+([0-9.eE+-]+)\s+([0-9.eE+-]+)\s*$", k)
    return lines.select(part(1).alias("path"), F.expr(f"try_cast(regexp_extract({column}, '^\\\\s*\\\\S+\\\\s+(\\\\S+)', 1) as double)").alias("estimate"), F.expr(f"try_cast(regexp_extract({column}, '(\\\\S+)\\\\s*$', 1) as double)").alias("seconds")).where("path != '' AND estimate IS NOT NULL AND seconds IS NOT NULL")
