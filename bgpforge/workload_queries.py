"""Registered queries of workload, plan and feedback operators. The tables stand in for workloads (BASE); operators and SQL are written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from bgpforge.operators import feedback as B
from bgpforge.operators import statistics as S
from bgpforge.operators import workload as W
from bgpforge.plans import bgp as P
from bgpforge.queries import QUERIES as REGISTERED
from bgpforge.queries import _LOG, _ORDERS, _PATH, _STATS, _searched, on_graph, on_log, query, with_triples
from bgpforge.sources import graph

#: Workload tables by name: patterns, records, plans, samples.
BASE = {
    "patterns": "SELECT l_orderkey AS query_id, l_linenumber AS tp_idx, '?o' AS s, '<urn:p/' || l_returnflag || '>' AS p, CASE WHEN l_linestatus = 'O' THEN '?x' ELSE '<urn:part/' || CAST(l_partkey % 50 AS STRING) || '>' END AS o FROM lineitem",
    "records": "SELECT o_orderkey AS query_id, CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 100 END AS BIGINT) AS y, CAST(o_custkey % 4 AS BIGINT) AS bound, 'SELECT * WHERE { ?a <urn:p/' || o_orderpriority || '> ?b . ?b <urn:p/x> $c . ?c <urn:p/y> ?a } ' || CASE WHEN o_orderkey % 5 = 0 THEN 'filter (?b)' WHEN o_orderkey % 5 = 1 THEN 'Group  by ?a' WHEN o_orderkey % 5 = 2 THEN '# unionized' ELSE '' END AS query FROM orders",
    "plans": "SELECT 'q' || CAST(user_id % 40 AS STRING) AS query, CASE event_id % 6 WHEN 0 THEN '0,1,2' WHEN 1 THEN '0,2,1' WHEN 2 THEN '1,0,2' WHEN 3 THEN '1,2,0' WHEN 4 THEN '2,0,1' ELSE '2,1,0' END AS steps, value AS cost, event_id AS seq FROM events",
    "usage": "SELECT user_id AS query_id, AVG(value) AS variance FROM events GROUP BY user_id",
    "history": "SELECT event_type AS metric, user_id AS epoch, ROUND(AVG(value), 0) AS value FROM events GROUP BY event_type, user_id",
    "pairs": "SELECT event_id AS seq, user_id % 3 AS z, value AS actual, CAST(user_id AS DOUBLE) AS predicted, event_type != 'error' AS valid FROM events",
}


def base(spark, sf_dir, name):
    graph.register(spark, sf_dir)
    return spark.sql(BASE[name])


def on_base(name: str, table: str, sql: str, f) -> None:
    """A query over one workload table; sql reads it under its name."""
    query(name, f"WITH {table} AS ({BASE[table]}) {sql}")(lambda spark, d: f(base(spark, d, table)))


# Workload filters and statistics.
on_base("queries_succeeded", "records", "SELECT query_id, y FROM records WHERE y IS DISTINCT FROM -1", lambda r: W.succeeded(r).select("query_id", "y"))
on_base("queries_without_repeated_predicates", "patterns", "SELECT query_id, tp_idx FROM patterns WHERE query_id NOT IN (SELECT query_id FROM patterns GROUP BY query_id, s, p HAVING COUNT(*) > 1)", lambda r: W.without_repeated_predicates(r).select("query_id", "tp_idx"))
on_base("queries_at_most", "records", "SELECT query_id, y FROM records WHERE y IS NULL OR y <= 40", lambda r: W.at_most(r, 40).select("query_id", "y"))
on_base("queries_plain", "records", "SELECT query_id FROM records WHERE query_id % 5 NOT IN (0, 1)", lambda r: W.plain_patterns(r).select("query_id"))
on_base("queries_with_repeated_triples", "patterns", "SELECT query_id, CAST(SUM(n - 1) AS BIGINT) AS repeats FROM (SELECT query_id, COUNT(*) AS n FROM patterns GROUP BY query_id, s, p, o) GROUP BY query_id HAVING SUM(n - 1) > 0", W.with_repeated_triples)
on_base("queries_first_of_each", "records", "SELECT query, MIN(query_id) AS query_id FROM records GROUP BY query", lambda r: W.first_of_each(r.select("query", "query_id"), ["query"], ["query_id"]))
on_base("predicate_usage", "patterns", "SELECT p, COUNT(*) AS uses, COUNT(DISTINCT query_id) AS queries FROM patterns GROUP BY p", W.predicate_usage)
on_base("workload_statistics", "records", "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE y = 0) AS zeros, CAST(ROUND(COUNT(*) FILTER (WHERE y = 0) * 100.0 / COUNT(*), 6) AS DOUBLE) AS zero_pct, MIN(y) FILTER (WHERE y > 0) AS low, MAX(y) AS high, ROUND(AVG(y) FILTER (WHERE y > 0), 6) AS mean, ROUND(quantile_cont(CASE WHEN y > 0 THEN y END, 0.5), 6) AS median, ROUND(AVG(bound), 6) AS mean_bound, MIN(bound) AS min_bound, MAX(bound) AS max_bound FROM records", W.dataset_statistics)
on_graph("workload_multiplicities", with_triples(f"SELECT * FROM ({_STATS}) WHERE p IN ('<urn:p/placedBy>', '<urn:p/inNation>')"), lambda g: W.workload_multiplicities(g, g.sparkSession.createDataFrame([("<urn:p/placedBy>",), ("<urn:p/inNation>",), ("?v",), ("<urn:p/none>",)], "p string")))


@query("queries_of_known_terms", f"WITH patterns AS ({BASE['patterns']}) SELECT query_id, tp_idx FROM patterns WHERE query_id NOT IN (SELECT query_id FROM patterns WHERE p = '<urn:p/R>' OR (o LIKE '<%' AND CAST(regexp_extract(o, '[0-9]+') AS INTEGER) >= 45))")
def _known(spark, d):
    words = [(f"<urn:part/{i}>",) for i in range(45)] + [("<urn:p/A>",), ("<urn:p/N>",)]
    return W.known_terms_only(base(spark, d, "patterns"), spark.createDataFrame(words, "term string")).select("query_id", "tp_idx")


# Ranking.
_Q = "GREATEST(GREATEST(CAST(y AS DOUBLE), 1.0) / (GREATEST(CAST(bound AS DOUBLE), 1.0) + 1e-7), GREATEST(CAST(bound AS DOUBLE), 1.0) / (GREATEST(CAST(y AS DOUBLE), 1.0) + 1e-7))"
on_base("worst_estimates", "records", f"SELECT query_id, ROUND({_Q}, 6) AS q FROM records WHERE y IS NOT NULL ORDER BY q DESC, query_id LIMIT 20", lambda r: W.worst(r.where("y is not null"), "y", "bound", "query_id", 20))
on_base("most_uncertain", "usage", "SELECT query_id FROM (SELECT query_id, ROW_NUMBER() OVER (ORDER BY variance DESC, query_id) AS r, COUNT(*) OVER () AS n FROM usage) WHERE r <= FLOOR(n * 0.1)", lambda r: W.most_uncertain(r, 0.1).select("query_id"))
on_base("numbered_queries", "plans", "SELECT seq, ROW_NUMBER() OVER (ORDER BY query, seq) - 1 AS id FROM plans", lambda r: W.numbered(r.select("query", "seq"), ["query", "seq"]).select("seq", "id"))
on_graph("slow_down_order", with_triples(f"SELECT p, triples, ROW_NUMBER() OVER (ORDER BY triples, p) - 1 AS place FROM ({_STATS})"), lambda g: W.slow_down_order(S.predicate_statistics(g)))
_COVER = "cover AS (SELECT o AS term, COUNT(*) AS db_freq, COUNT(DISTINCT p) * 100.0 / COUNT(*) AS pct FROM triples GROUP BY o)"
_KIND = "SELECT '{k}' AS kind, term FROM (SELECT term FROM cover ORDER BY {by}, term LIMIT 5)"
on_graph(
    "coverage_extremes",
    with_triples(" UNION ALL ".join(_KIND.format(k=k, by=by) for k, by in (("highest", "pct DESC"), ("lowest", "pct"), ("most", "db_freq DESC"), ("least", "db_freq"))), _COVER),
    lambda g: W.extremes(g.groupBy(F.col("o").alias("term")).agg(F.count("*").alias("db_freq"), (F.countDistinct("p") * 100.0 / F.count("*")).alias("pct")), 5),
)


# Plan data.
def _plans(rows):
    return rows.select("query", F.split("steps", ",").cast("array<int>").alias("order"), "cost")


_BEST = "SELECT query, prefix, cost, steps FROM (SELECT query, substr(steps, 1, 3) AS prefix, cost, steps, ROW_NUMBER() OVER (PARTITION BY query, substr(steps, 1, 3) ORDER BY cost, steps) AS r FROM plans) WHERE r = 1"
_joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
on_base("best_of_prefixes", "plans", _BEST, lambda r: W.best_of_prefixes(_plans(r)).select("query", _joined("prefix").alias("prefix"), "cost", _joined("order").alias("steps")))
on_base("standardised_costs", "plans", "SELECT seq, ROUND((cost - AVG(cost) OVER ()) / STDDEV_POP(cost) OVER (), 6) AS z, ROUND((cost - MIN(cost) OVER ()) / (MAX(cost) OVER () - MIN(cost) OVER ()), 6) AS unit FROM plans", lambda r: W.standardised(r.select("seq", "cost")).select("seq", "z", "unit"))
_DATA = f"one AS (SELECT query, steps, MIN(cost) AS cost FROM plans GROUP BY query, steps), every AS (SELECT query, prefix, LN(1 + cost) AS c FROM ({_BEST}) UNION ALL SELECT query, steps, LN(1 + cost) FROM one)"
query("plan_dataset", f"WITH plans AS ({BASE['plans']}), {_DATA} SELECT ROW_NUMBER() OVER (ORDER BY query, prefix) - 1 AS id, query, prefix, ROUND(c, 6) AS log_cost, ROUND((c - AVG(c) OVER ()) / STDDEV_POP(c) OVER (), 6) AS z FROM every")(
    lambda spark, d: W.plan_dataset(_plans(base(spark, d, "plans"))).select("id", "query", _joined("prefix").alias("prefix"), "log_cost", "z")
)
on_base("plan_targets", "plans", "SELECT a.query, COUNT(*) AS n FROM plans a JOIN (SELECT DISTINCT query FROM plans WHERE cost > 100) b ON a.query = b.query GROUP BY a.query", lambda r: W.with_targets(r, r.where("cost > 100").select("query").distinct()).groupBy("query").agg(F.count("*").alias("n")))
query("leftdeep_best_order", with_triples("SELECT CAST(arg_min(steps, (cost, steps)) AS VARCHAR) AS steps, MIN(cost) AS cost FROM plans WHERE size = 4", _ORDERS, True))(
    _searched(lambda spark, c: spark.createDataFrame([(",".join(str(1 << i) for i in p.leaves), int(v)) for v, p in [P.dp_search(_PATH, c)[1]]], "steps string, cost long"))
)

# Texts.
on_base("numbered_variables", "records", "SELECT query_id, 'SELECT * WHERE { ?z0 ' || regexp_extract(query, '<urn:p/[^>]*>') || ' ?z1 . ?z1 <urn:p/x> ?z2 . ?z3 <urn:p/y> ?z0 } ' || CASE query_id % 5 WHEN 0 THEN 'filter (?z1)' WHEN 1 THEN 'Group  by ?z0' WHEN 2 THEN '# unionized' ELSE '' END AS query FROM records", lambda r: r.select("query_id", W.numbered_variables(F.col("query")).alias("query")))
on_base("plan_keys", "plans", "SELECT seq, '(' || replace(steps, ',', ', ') || '),' || query AS plan_key FROM plans", lambda r: r.select("seq", W.plan_key(F.split("steps", ","), F.col("query")).alias("plan_key")))
on_base("map_lookup", "plans", "SELECT query, CASE query WHEN 'q1' THEN 5 WHEN 'q2' THEN 7 ELSE 1 END AS v FROM (SELECT DISTINCT query FROM plans)", lambda r: r.select("query").distinct().select("query", W.looked_up(F.create_map(F.lit("q1"), F.lit(5), F.lit("q2"), F.lit(7)), F.col("query"), 1).alias("v")))
on_log("run_status", f"WITH {_LOG} SELECT seq, CASE WHEN is_error AND seq % 2 = 0 THEN 'TIME_OUT' WHEN is_error THEN 'FAIL' WHEN latency < 60 THEN 'OK' ELSE 'TIMEOUT' END AS status FROM log WHERE latency IS NOT NULL", lambda log: log.where("latency is not null").select("seq", W.run_status(F.when(F.col("is_error"), F.when(F.col("seq") % 2 == 0, "Query Timed out").otherwise("broken")), F.col("latency"), 60.0).alias("status")))

# Feedback state.
_DAILY = "FROM log WHERE NOT is_error AND latency IS NOT NULL GROUP BY day"
on_log("ingested_runs", f"WITH {_LOG} SELECT seq, ROUND(LN(1 + CASE WHEN is_error THEN 60.0 ELSE latency END), 6) AS log_latency, CASE WHEN NOT is_error THEN ROUND(LN(1 + latency), 6) END AS masked_cost, NOT is_error AS valid FROM log", B.ingested)
on_log("timeouts_by_best", f"WITH {_LOG} SELECT query_id, LEAST(COALESCE(2 * MIN(latency) FILTER (WHERE NOT is_error), 60.0), 60.0) AS timeout FROM log GROUP BY query_id", B.timeouts_by_best)
on_log("timeout_rewards", f"WITH {_LOG} SELECT query_id, ROUND(COALESCE(-LN(1 + MIN(latency) FILTER (WHERE NOT is_error)) - 5, -20.0), 6) AS reward FROM log GROUP BY query_id", B.timeout_rewards)
on_log("reward_memo", f"WITH {_LOG} SELECT query_id, plan_id, arg_min(latency, seq) AS cost FROM log WHERE NOT is_error AND latency > 0 GROUP BY query_id, plan_id", B.reward_memo)
on_log("moving_statistics", f"WITH RECURSIVE {_LOG}, daily AS (SELECT AVG(latency) AS m, GREATEST(COALESCE(STDDEV_SAMP(latency), 0), 1e-8) AS d, ROW_NUMBER() OVER (ORDER BY day) AS r {_DAILY}), fold(r, m, d) AS (SELECT r, m, d FROM daily WHERE r = 1 UNION ALL SELECT x.r, 0.9 * f.m + 0.1 * x.m, 0.9 * f.d + 0.1 * x.d FROM fold f JOIN daily x ON x.r = f.r + 1) SELECT ROUND(arg_max(m, r), 6) AS mean, ROUND(arg_max(d, r), 6) AS std FROM fold", B.moving_statistics)
on_log("blend_weight", f"WITH RECURSIVE {_LOG}, daily AS (SELECT VAR_POP(LN(1 + latency)) AS c, VAR_POP(latency) AS l, ROW_NUMBER() OVER (ORDER BY day) AS r {_DAILY}), fold(r, c, l) AS (SELECT r, c, l FROM daily WHERE r = 1 UNION ALL SELECT x.r, 0.9 * f.c + 0.1 * x.c, 0.9 * f.l + 0.1 * x.l FROM fold f JOIN daily x ON x.r = f.r + 1) SELECT ROUND(arg_max(c, r), 6) AS cost_var, ROUND(arg_max(l, r), 6) AS latency_var, ROUND(arg_max(c, r) / GREATEST(arg_max(l, r), 1e-6), 9) AS weight FROM fold", B.blend_weight)
on_log("rescaled_head", f"WITH RECURSIVE {_LOG}, daily AS (SELECT AVG(latency) AS m, VAR_POP(latency) AS v, ROW_NUMBER() OVER (ORDER BY day) AS r {_DAILY}), fold(r, m, v) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT x.r, 0.9 * f.m + 0.1 * x.m, 0.9 * f.v + 0.1 * x.v FROM fold f JOIN daily x ON x.r = f.r + 1), last AS (SELECT arg_max(m, r) AS m, arg_max(v, r) AS v FROM fold) SELECT ROUND(m, 6) AS mean, ROUND(v, 6) AS variance, ROUND(1 / GREATEST(SQRT(v), 1e-4), 6) AS weight, ROUND(-m / GREATEST(SQRT(v), 1e-4), 6) AS bias FROM last", B.rescaled_head)
on_base("best_epochs", "history", "SELECT metric, epoch, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY value, epoch DESC) AS r FROM history WHERE value IS NOT NULL) WHERE r = 1", lambda r: B.best_epochs(r.where("value is not null")))
on_base("relative_errors", "pairs", "SELECT ROUND(AVG(CASE WHEN actual != 0 THEN ABS((actual - predicted) / actual) END) * 100, 6) AS mape, ROUND(AVG((actual - predicted) * (actual - predicted)), 6) AS mse, ROUND(AVG((actual - predicted) * (actual - predicted)) FILTER (WHERE valid), 6) AS masked_mse FROM pairs", lambda r: B.relative_errors(r, "actual", "predicted"))
_LL = "SELECT seq // 10 AS chunk, z, SUM(-0.5 * POWER((actual - predicted) / 50.0, 2) - LN(50.0) - 0.5 * LN(2 * 3.141592653589793)) AS s FROM pairs GROUP BY 1, 2"
on_base("joint_likelihood", "pairs", f"SELECT ROUND(AVG(nll), 6) AS nll FROM (SELECT chunk, -(MAX(top) + LN(AVG(EXP(s - top)))) AS nll FROM (SELECT *, MAX(s) OVER (PARTITION BY chunk) AS top FROM ({_LL})) GROUP BY chunk)", lambda r: B.joint_likelihood(r, 10, 50.0))
_DRAWS = lambda r: r.select("actual", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("predicted") * i / 4).alias("draws"))
on_base("calibration", "pairs", "SELECT l / 10.0 AS level, ROUND(AVG(CASE WHEN p <= l / 10.0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT seq, CAST(COUNT(*) FILTER (WHERE predicted * i / 4 <= actual) AS DOUBLE) / 8 AS p FROM pairs, range(1, 9) x(i) GROUP BY seq), range(1, 11) y(l) GROUP BY l".replace("l / 10.0", "CAST(l AS DOUBLE) / 10"), lambda r: B.calibration(_DRAWS(r)))
on_base("sharpness", "pairs", "SELECT ROUND(AVG(v), 6) AS sharpness FROM (SELECT seq, VAR_SAMP(predicted * i / 4) AS v FROM pairs, range(1, 9) x(i) GROUP BY seq)", lambda r: B.sharpness(_DRAWS(r)))
on_log("latency_rewards", f"WITH {_LOG} SELECT seq, CASE WHEN seq % 3 = 0 THEN -latency ELSE 0.0 END AS reward FROM log", lambda log: log.select("seq", B.latency_reward(F.col("latency"), F.col("seq") % 3 == 0).alias("reward")))
on_log("executed_cost", f"WITH {_LOG} SELECT seq, ROUND(-LN(1 + query_id) - LN(1 + seq), 6) AS reward FROM log", lambda log: log.select("seq", F.round(B.executed_cost(F.array("query_id", "seq", F.lit(9))), 6).alias("reward")))


# Walks against the graph.
def _chains(g):
    hop = lambda p, a, b: g.where(F.col("p") == f"<urn:p/{p}>").select(F.col("s").alias(a), F.col("o").alias(b))
    return hop("placedBy", "a", "b").join(hop("inNation", "b", "c"), "b").select(F.array("a", F.lit("<urn:p/placedBy>"), "b", F.lit("<urn:p/inNation>"), "c").alias("walk"))


_CHAINS = "hops AS (SELECT x.s AS a, x.o AS b, y.o AS c FROM triples x JOIN triples y ON x.o = y.s WHERE x.p = '<urn:p/placedBy>' AND y.p = '<urn:p/inNation>'), held AS (SELECT term, COUNT(*) AS n FROM (SELECT a AS term FROM hops UNION ALL SELECT b FROM hops UNION ALL SELECT c FROM hops UNION ALL SELECT '<urn:p/placedBy>' FROM hops UNION ALL SELECT '<urn:p/inNation>' FROM hops) GROUP BY term)"
_OCC = "occ AS (SELECT term, COUNT(*) AS n FROM (SELECT s AS term FROM triples UNION ALL SELECT p FROM triples UNION ALL SELECT o FROM triples) GROUP BY term)"
on_graph("walk_coverage", with_triples("SELECT COUNT(*) FILTER (WHERE h.n IS NULL) AS missing, COUNT(*) FILTER (WHERE h.n < 5) AS rare FROM occ LEFT JOIN held h ON h.term = occ.term", f"{_CHAINS}, {_OCC}"), lambda g: W.walk_coverage(_chains(g), S.term_occurrences(g), 5))
on_graph("walk_difference", with_triples("SELECT COALESCE(h.term, occ.term) AS term, COALESCE(h.n, 0) AS in_walks, COALESCE(occ.n, 0) AS in_graph FROM held h FULL JOIN occ ON h.term = occ.term WHERE COALESCE(h.n, 0) != COALESCE(occ.n, 0)", f"{_CHAINS}, {_OCC}"), lambda g: W.walk_difference(_chains(g), g))
