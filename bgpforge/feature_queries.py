"""Registered queries of query features, estimates and exports; operators and SQL are written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from bgpforge.operators import estimate as C
from bgpforge.operators import features as X
from bgpforge.operators import statistics as S
from bgpforge.plans import bgp as P
from bgpforge.queries import _STATS, _TERMS, bgp, bgp_sql, on_graph, with_triples
from bgpforge.sources import graph as sources

_BGPS = [bgp(t) for t in ("?o p:placedBy ?c . ?c p:inNation ?n . ?n p:inRegion <urn:region/0> .", '?o p:hasPart ?x . ?o p:status "F" . ?o p:placedBy ?c .', "?a ?q ?b . ?b p:inNation ?a .", '?o p:status "nowhere" .')]
_ROWS = [(q, k, *tp.terms) for q, b in enumerate(_BGPS) for k, tp in enumerate(b.patterns)]
_TPS = "tps(query_id, tp_idx, s, p, o) AS (VALUES " + ", ".join(f"({q}, {k}, '{s}', '{p}', '{o}')" for q, k, s, p, o in _ROWS) + ")"
_CARDS = "cards AS (" + " UNION ALL ".join(f"SELECT {q} AS query_id, {k} AS tp_idx, n FROM ({bgp_sql(P.Bgp((tp,)), 'COUNT(*) AS n')})" for q, b in enumerate(_BGPS) for k, tp in enumerate(b.patterns)) + ")"
_EMBEDDED = "SELECT p AS term, CAST(subjects AS DOUBLE) AS a, CAST(objects AS DOUBLE) AS b FROM stats WHERE subjects > objects UNION ALL SELECT DISTINCT o, 0.5, 0.25 FROM triples WHERE p = '<urn:p/inRegion>'"
_TABLES = f"""stats AS ({_STATS}), occ AS ({_TERMS}), emb AS ({_EMBEDDED}), {_TPS}, {_CARDS},
spots AS (SELECT query_id, tp_idx * 3 + k AS spot, CASE k WHEN 0 THEN s WHEN 1 THEN p ELSE o END AS term, k FROM tps, (VALUES (0), (1), (2)) ks(k)),
vars AS (SELECT query_id, term, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MIN(spot)) - 1 AS id FROM spots WHERE term[1] IN ('?', '$') GROUP BY query_id, term),
ends AS (SELECT query_id, term, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MIN(spot)) - 1 AS id FROM spots WHERE k <> 1 GROUP BY query_id, term)"""


def _features_sql(variable: str, constant: str, on_edge: str) -> str:
    return with_triples(
        f"""SELECT query_id, part, i, UNNEST(RANGE(LEN(v))) AS j, ROUND(UNNEST(v), 6) AS value FROM (
        SELECT e.query_id, 'node' AS part, e.id AS i, v FROM ends e JOIN vec USING (query_id, term) WHERE NOT edge
        UNION ALL SELECT t.query_id, 'edge', t.tp_idx * 2 + w, list_concat(v, CAST({on_edge} AS DOUBLE[])) FROM tps t JOIN vec ON vec.query_id = t.query_id AND vec.term = t.p AND edge JOIN cards c ON c.query_id = t.query_id AND c.tp_idx = t.tp_idx, (VALUES (0), (1)) ws(w)
        UNION ALL SELECT t.query_id, 'ends', t.tp_idx * 2 + w, CAST(CASE w WHEN 0 THEN [a.id, b.id] ELSE [b.id, a.id] END AS DOUBLE[]) FROM tps t JOIN ends a ON a.query_id = t.query_id AND a.term = t.s JOIN ends b ON b.query_id = t.query_id AND b.term = t.o, (VALUES (0), (1)) ws(w))""",
        f"""{_TABLES}, vec AS (SELECT r.query_id, r.term, r.edge, CAST(CASE WHEN vars.id IS NOT NULL THEN {variable} ELSE {constant} END AS DOUBLE[]) AS v
        FROM (SELECT DISTINCT query_id, term, k = 1 AS edge FROM spots) r LEFT JOIN vars USING (query_id, term) LEFT JOIN occ ON occ.term = r.term LEFT JOIN emb ON emb.term = r.term LEFT JOIN stats ON stats.p = r.term)""",
    )


_COUNT = "LN(1 + COALESCE(occ.cnt, 0))"
_PLAIN = _features_sql("[vars.id, 1, 1]", f"[{_COUNT}, COALESCE(emb.a, 0), COALESCE(emb.b, 0)]", "[1 - 2 * w]")
_RICH = _features_sql(
    "[vars.id, 0, 0, 0, 0, 1, 0, 0, 1, 1]",
    f"list_concat(list_concat(CAST([{_COUNT}, 1] AS DOUBLE[]), CAST(CASE WHEN r.edge THEN [LN(1 + m_so), LN(1 + m_os), 1] ELSE [0, 0, 0] END AS DOUBLE[])), CAST(CASE WHEN emb.term IS NULL THEN [0, 1, 0, 0, 0] ELSE [0, 0, 1, emb.a, emb.b] END AS DOUBLE[]))",
    "[LN(1 + c.n), 1 - 2 * w]",
)


def _features(rich: bool):
    def run(g):
        spark = g.sparkSession
        patterns = spark.createDataFrame(_ROWS, "query_id long, tp_idx long, s string, p string, o string")
        stats = S.predicate_statistics(g)
        pair = lambda a, b: F.array(a.cast("double"), b.cast("double")).alias("vec")
        embedded = stats.where("subjects > objects").select(F.col("p").alias("term"), pair(F.col("subjects"), F.col("objects")))
        embedded = embedded.unionAll(g.where(F.col("p") == "<urn:p/inRegion>").select(F.col("o").alias("term"), pair(F.lit(0.5), F.lit(0.25))).distinct())
        if not rich:
            return X.flattened(X.query_graphs(patterns, S.term_occurrences(g), embedded, 2))
        keyed = patterns.withColumn("tp_key", F.concat_ws(" ", "s", "p", "o", F.lit(".")))
        cards = keyed.join(S.pattern_cardinalities(g, _BGPS), "tp_key").select("query_id", "tp_idx", "cnt")
        return X.flattened(X.query_graphs(patterns, S.term_occurrences(g), embedded, 2, rich=True, cardinalities=cards, multiplicities=stats))

    return run


on_graph("predicate_edge_features", _PLAIN, _features(False))
on_graph("predicate_edge_statistics_features", _RICH, _features(True))
on_graph("variable_numbers", f"WITH {_TPS} SELECT query_id, term, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MIN(tp_idx * 3 + k)) - 1 AS id FROM (SELECT query_id, tp_idx, k, CASE k WHEN 0 THEN s WHEN 1 THEN p ELSE o END AS term FROM tps, (VALUES (0), (1), (2)) ks(k)) WHERE term[1] IN ('?', '$') GROUP BY query_id, term", lambda g: X.term_numbers(g.sparkSession.createDataFrame(_ROWS, "query_id long, tp_idx long, s string, p string, o string"), variables_only=True))

_STAR = ["<urn:p/placedBy>", "<urn:p/hasPart>", "<urn:p/status>"]
_SETS = "per AS (SELECT s, p, COUNT(*) AS n FROM triples GROUP BY s, p), sets AS (SELECT s, string_agg(p, ' ' ORDER BY p) AS id FROM per GROUP BY s), means AS (SELECT id, p, COUNT(*) AS subjects, CAST(SUM(n) AS BIGINT) AS triples FROM per JOIN sets USING (s) GROUP BY id, p)"
on_graph("charset_multiplicities", with_triples("SELECT id, p, subjects, triples FROM means", _SETS), C.characteristic_multiplicities)
_IN = ", ".join(f"'{p}'" for p in _STAR)
on_graph("charset_estimate", with_triples(f"SELECT ROUND(COALESCE(SUM(x), 0), 6) AS estimate FROM (SELECT id, ANY_VALUE(subjects) * PRODUCT(CAST(triples AS DOUBLE) / subjects) AS x FROM means WHERE p IN ({_IN}) GROUP BY id HAVING COUNT(*) = 3)", _SETS), lambda g: C.star_estimate(g, _STAR).select(F.round("estimate", 6).alias("estimate")))

#: As many walks as the first pattern has triples, and one choice: the estimate is exact.
_TWO = bgp("?o p:placedBy ?c . ?o p:hasPart ?x .")
on_graph("wander_join_exhaustive", with_triples(bgp_sql(_TWO, "CAST(COUNT(*) AS DOUBLE) AS estimate")), lambda g: C.wander_join(g, _TWO, 2_000_000_000).select("estimate"))
#: Sampled walks over three patterns, of which the last two branch: within a fifth of the truth.
_THREE = bgp("?c p:inNation ?n . ?o p:placedBy ?c . ?o p:hasPart ?x .")
on_graph("wander_join_sampled", with_triples(f"SELECT COUNT(*) > 0 AS close FROM ({bgp_sql(_THREE)})"), lambda g: C.wander_join(g, _THREE, 1000, 7).crossJoin(_true(g)).select((F.abs(F.col("estimate") - F.col("n")) <= 0.2 * F.col("n")).alias("close")))


def _true(g):
    from bgpforge.operators.evaluate import evaluate

    return evaluate(g, _THREE).agg(F.count("*").alias("n"))


def _exported(g):
    queries = g.sparkSession.createDataFrame([(q, b.text) for q, b in enumerate(_BGPS[:2])], "query_id long, query string")
    used = g.select(F.explode(F.array("s", "o")).alias("term")).where(F.col("term").isin("<urn:region/0>", '"F"')).distinct()
    ids = used.select("term", F.length("term").cast("long").alias("id"), F.lit(None).cast("long").alias("predicate_id"))
    predicates = g.groupBy(F.col("p").alias("term")).agg(F.lit(None).cast("long").alias("id"), F.length(F.first("p")).cast("long").alias("predicate_id"))
    return C.estimator_queries(queries, ids.unionAll(predicates), "<urn:p/inRegion>")


on_graph("estimator_queries", None, _exported)
on_graph("entity_ids", with_triples("SELECT term, ROW_NUMBER() OVER (ORDER BY term) - 1 AS id FROM (SELECT s AS term FROM triples UNION SELECT o FROM triples)"), sources.entity_ids)
