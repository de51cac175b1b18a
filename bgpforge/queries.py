"""The registered queries over the graph view of the tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bgpforge.functions import text as T
from bgpforge.operators import evaluate as E
from bgpforge.operators import feedback as B
from bgpforge.operators import generate as G
from bgpforge.operators import statistics as S
from bgpforge.plans import bgp as P
from bgpforge.sources import graph

PREFIX = {"p": "urn:p/", "r": "urn:region/", "n": "urn:nation/"}
FLAGSHIP = '?ord p:placedBy ?cust . ?cust p:inNation ?nat . ?nat p:inRegion ?reg . ?ord p:suppliedBy ?sup . ?sup p:inNation ?nat . ?ord p:priority "5-LOW" .'
PATTERNS = {
    "bgp_star_2": '?o p:placedBy ?c . ?o p:status "F" .',
    "bgp_star_3": '?o p:placedBy ?c . ?o p:hasPart ?x . ?o p:status "F" .',
    "bgp_star_5": '?o p:placedBy ?c . ?o p:hasPart ?x . ?o p:suppliedBy ?s . ?o p:status "F" . ?o p:priority "1-URGENT" .',
    "bgp_path_3": "?o p:placedBy ?c . ?c p:inNation ?n . ?n p:inRegion ?r .",
    "bgp_cyclic": FLAGSHIP,
    "bgp_bound_literal": '?o p:priority "2-HIGH" . ?o p:status ?s .',
    "bgp_object_star": "?a p:inNation ?n . ?b p:inNation ?n . ?n p:inRegion r:0> .".replace("r:0>", "<urn:region/0>"),
    "bgp_variable_predicate": "<urn:order/1> ?p ?o .",
    "bgp_repeated_variable": "?x p:inNation ?x .",
    "bgp_cartesian_small": "?r p:name ?n . ?a p:inRegion <urn:region/1> .",
}
SEARCH = "?v0 p:placedBy ?v1 . ?v1 p:inNation ?v2 . ?v2 p:inRegion <urn:region/0> . ?v0 p:hasPart ?v4 ."


def bgp(text: str) -> P.Bgp:
    return P.parse(text, PREFIX)


def bgp_sql(pattern: P.Bgp, select: str | None = None) -> str:
    """A pattern as one SQL join over triples."""
    where, at = [], {}
    for i, tp in enumerate(pattern.patterns):
        for c, t in zip("spo", tp.terms, strict=True):
            if t[0] not in "?$":
                where.append(f"t{i}.{c} = '{t}'")
            elif t[1:] in at:
                where.append(f"t{i}.{c} = {at[t[1:]]}")
            else:
                at[t[1:]] = f"t{i}.{c}"
    columns = select or ", ".join(f'{c} AS "{v}"' for v, c in at.items())
    return f"SELECT {columns} FROM {', '.join(f'triples t{i}' for i in range(len(pattern.patterns)))} WHERE {' AND '.join(where) or 'true'}"


def with_triples(sql: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}triples AS MATERIALIZED ({graph.TRIPLES_SQL}){', ' + more if more else ''} {sql}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def on_graph(name: str, sql: str | None, f) -> None:
    query(name, sql)(lambda spark, d: f(graph.triples(spark, d)))


def on_log(name: str, sql: str | None, f) -> None:
    query(name, sql)(lambda spark, d: f(B.execution_log(spark.read.parquet(f"{d}/events.parquet"))))


def shared(name: str, body: str) -> None:
    """SQL that both engines run as it stands."""

    def run(spark, d):
        graph.register(spark, d)
        return spark.sql(body)

    query(name, with_triples(body))(run)


# Patterns and joins. The region comes first where pairs of subjects in every nation would be made before it.
ORDERS = {"bgp_object_star": (2, 0, 1)}
for _name, _text in PATTERNS.items():
    on_graph(_name, with_triples(bgp_sql(bgp(_text))), lambda g, b=bgp(_text), order=ORDERS.get(_name, ()): E.evaluate_order(g, b, order))
on_graph("flagship_count", with_triples(bgp_sql(bgp(FLAGSHIP), "COUNT(*) AS n")), lambda g: E.evaluate(g, bgp(FLAGSHIP)).agg(F.count("*").alias("n")))
_PATH = bgp(SEARCH)


def _same_bag(g: DataFrame) -> DataFrame:
    """The solutions in every left-deep order, and in a bushy shape: rows and how many orders gave them."""
    orders = list(P.left_deep_orders(_PATH))
    plans = [P.left_deep(o) for o in orders] + [E.bushy_from_pairs(4, [(3, 0), (1, 2), (4, 5)])]
    frames = [E.evaluate(g, _PATH, p).groupBy("v2").agg(F.count("*").alias("n")).withColumn("plan", F.lit(i)) for i, p in enumerate(plans)]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out.groupBy("v2", "n").agg(F.count("*").alias("plans"))


on_graph("forced_order_same_bag", with_triples(f"SELECT v2, n, CAST(9 AS BIGINT) AS plans FROM (SELECT v2, COUNT(*) AS n FROM ({bgp_sql(_PATH)}) GROUP BY v2)"), _same_bag)
on_graph("values_lookup", with_triples("SELECT s, p, o FROM triples WHERE s IN ('<urn:order/1>', '<urn:order/2>', '<urn:customer/3>')"), lambda g: g.where(F.col("s").isin("<urn:order/1>", "<urn:order/2>", "<urn:customer/3>")))
_NEAR = "near AS (SELECT * FROM triples WHERE s = '<urn:nation/3>' OR o = '<urn:nation/3>'), ends AS (SELECT s AS x FROM near UNION SELECT o FROM near WHERE NOT starts_with(o, '\"'))"
on_graph("two_hop_neighbourhood", with_triples("SELECT DISTINCT s, p, o FROM triples WHERE s IN (SELECT x FROM ends) OR o IN (SELECT x FROM ends)", _NEAR), lambda g: S.two_hops(g, "<urn:nation/3>"))
shared("bind_constant", "SELECT '<urn:order/1>' AS s, p, o FROM triples WHERE s = '<urn:order/1>'")
shared("filter_literal_objects", "SELECT p, COUNT(*) AS n FROM triples WHERE o LIKE '\"%' GROUP BY p")
shared("filter_iri_subjects", "SELECT p, COUNT(*) AS n FROM triples WHERE s LIKE '<%' GROUP BY p")
shared("resume_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")

# Statistics.
on_graph("triples_count", with_triples("SELECT COUNT(*) AS n FROM triples"), lambda g: g.agg(F.count("*").alias("n")))
_STATS = "SELECT p, COUNT(*) AS triples, COUNT(DISTINCT s) AS subjects, COUNT(DISTINCT o) AS objects, CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT s) AS m_so, CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT o) AS m_os FROM triples GROUP BY p"
on_graph("pred_stats", with_triples(_STATS), S.predicate_statistics)
_TERMS = "SELECT term, COUNT(*) AS cnt FROM (SELECT s AS term FROM triples UNION ALL SELECT p FROM triples UNION ALL SELECT o FROM triples) GROUP BY term"
on_graph("term_occurrence", with_triples(_TERMS), S.term_occurrences)
on_graph("vocab_uri_literal", with_triples(f"SELECT is_literal, COUNT(*) AS terms, CAST(SUM(cnt) AS BIGINT) AS cnt FROM (SELECT *, starts_with(term, '\"') AS is_literal FROM ({_TERMS})) GROUP BY is_literal"), lambda g: S.vocabulary(g).groupBy("is_literal").agg(F.count("*").alias("terms"), F.sum("cnt").alias("cnt")))
on_graph("subject_count", with_triples("SELECT COUNT(DISTINCT s) AS n FROM triples"), lambda g: g.agg(F.countDistinct("s").alias("n")))
on_graph("degree_out", with_triples("SELECT s AS term, COUNT(*) AS degree FROM triples GROUP BY s"), lambda g: S.degrees(g, "s"))
on_graph("degree_in", with_triples("SELECT o AS term, COUNT(*) AS degree FROM triples GROUP BY o"), lambda g: S.degrees(g, "o"))
_WORKLOAD = [bgp(x) for x in PATTERNS.values()]
_TPS = {tp.key: tp for b in _WORKLOAD for tp in b.patterns}
on_graph("tp_cards_batch", with_triples(" UNION ALL ".join(f"SELECT '{k}' AS tp_key, n AS cnt FROM ({bgp_sql(P.Bgp((tp,)), 'COUNT(*) AS n')})" for k, tp in _TPS.items())), lambda g: S.pattern_cardinalities(g, _WORKLOAD))
_CONSTANTS = sorted({t for tp in _TPS.values() for t in tp.terms if t[0] not in "?$"})
_VALUES = ", ".join(f"('{t}')" for t in _CONSTANTS)
on_graph("workload_occurrence", with_triples(f"SELECT w.term, COALESCE(cnt, 0) AS cnt FROM (VALUES {_VALUES}) w(term) LEFT JOIN ({_TERMS}) x ON x.term = w.term"), lambda g: S.workload_occurrences(g, _WORKLOAD))
on_graph("charset_counts", with_triples("SELECT predicates, COUNT(*) AS subjects FROM (SELECT s, string_agg(DISTINCT p, ' ' ORDER BY p) AS predicates FROM triples GROUP BY s) GROUP BY predicates"), S.characteristic_sets)
_INDEP = "SELECT a.p AS p1, b.p AS p2, ROUND(CAST(a.triples AS DOUBLE) * b.triples / GREATEST(a.subjects, b.subjects), 6) AS estimate FROM stats a JOIN stats b ON a.p < b.p"


def _independence(g: DataFrame) -> DataFrame:
    s = S.predicate_statistics(g)
    a, b = (s.select(*[F.col(c).alias(f"{c}{k}") for c in ("p", "triples", "subjects")]) for k in "12")
    return a.join(b, F.col("p1") < F.col("p2")).select("p1", "p2", F.round(F.col("triples1").cast("double") * F.col("triples2") / F.greatest("subjects1", "subjects2"), 6).alias("estimate"))


on_graph("indep_estimate", with_triples(_INDEP, f"stats AS ({_STATS})"), _independence)
on_graph("coverage", None, lambda g: S.coverage(g, _WORKLOAD))
on_graph("hll_domain_range", None, lambda g: S.sketches(g).select("p", F.hll_sketch_estimate("domain").alias("subjects"), F.hll_sketch_estimate("range").alias("objects")))
on_graph("hll_intersection", None, lambda g: S.sketch_overlap(S.sketches(g), "<urn:p/hasPart>", "<urn:p/placedBy>"))
shared("ecdf", "SELECT degree, CAST(MAX(c) AS DOUBLE) AS ecdf FROM (SELECT degree, CUME_DIST() OVER (ORDER BY degree) AS c FROM (SELECT o, COUNT(*) AS degree FROM triples WHERE p = '<urn:p/placedBy>' GROUP BY o)) GROUP BY degree")
shared("coverage_topn", "SELECT o, cnt, r FROM (SELECT o, cnt, ROW_NUMBER() OVER (ORDER BY cnt DESC, o) AS r FROM (SELECT o, COUNT(*) AS cnt FROM triples GROUP BY o)) WHERE r <= 20")
shared("degree_histogram", "SELECT CAST(FLOOR(degree / 2) AS BIGINT) AS bin, COUNT(*) AS n FROM (SELECT s, COUNT(*) AS degree FROM triples GROUP BY s) GROUP BY 1")
shared("page_of_subjects", "SELECT s FROM (SELECT DISTINCT s FROM triples WHERE p = '<urn:p/placedBy>') ORDER BY s LIMIT 50 OFFSET 100")
shared("distinct_predicates", "SELECT DISTINCT p FROM triples")
shared("distinct_literals", "SELECT DISTINCT o FROM triples WHERE o LIKE '\"%'")
shared("set_difference_terms", "SELECT DISTINCT o AS term FROM triples WHERE o LIKE '<%' EXCEPT SELECT s FROM triples")
shared("set_intersection_terms", "SELECT s AS term FROM triples INTERSECT SELECT o FROM triples")
shared("dataset_stats", "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE n_chars = 0) AS zeros, MIN(n_chars) AS low, MAX(n_chars) AS high, ROUND(AVG(n_chars), 6) AS mean FROM documents")
_QE = "SELECT GREATEST(GREATEST(o_totalprice, 1.0) / (GREATEST(o_custkey * 200.0, 1.0) + 1e-7), GREATEST(o_custkey * 200.0, 1.0) / (GREATEST(o_totalprice, 1.0) + 1e-7)) AS q, ABS(o_totalprice - o_custkey * 200.0) AS d FROM orders"
query("q_error_summary", f"SELECT ROUND(AVG(q), 6) AS mean_q, ROUND(quantile_cont(q, 0.5), 6) AS p50, ROUND(quantile_cont(q, 0.9), 6) AS p90, ROUND(quantile_cont(q, 0.95), 6) AS p95, ROUND(quantile_cont(q, 0.99), 6) AS p99, ROUND(AVG(d), 6) AS mae FROM ({_QE})")(
    lambda spark, d: S.error_summary(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").alias("y"), (F.col("o_custkey").cast("double") * F.lit(200.0)).alias("e")), "y", "e")
)
shared("regression_r2", "SELECT ROUND(REGR_SLOPE(value, event_id), 9) AS slope, ROUND(REGR_INTERCEPT(value, event_id), 6) AS intercept, ROUND(REGR_R2(value, event_id), 9) AS r2 FROM events")
shared("run_mean_std", "SELECT event_type, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_POP(value), 6) AS std, ROUND(MIN(value), 6) AS low, ROUND(MAX(value), 6) AS high, ROUND(1.96 * STDDEV_SAMP(value) / SQRT(COUNT(*)), 6) AS ci FROM events GROUP BY event_type")
shared("hinge_mse", "SELECT ROUND(AVG(CASE WHEN event_type = 'error' THEN POWER(GREATEST(60.0 - value, 0.0), 2) ELSE POWER(value - 50.0, 2) END), 6) AS loss FROM events")

# Plan search over true cardinalities of connected parts.
query("join_graph_edges", "SELECT * FROM (VALUES (0, 1), (0, 3), (1, 2)) e(i, j)")(lambda spark, d: spark.createDataFrame([(i, j) for i, near in enumerate(P.adjacency(_PATH)) for j in near if i < j], "i int, j int"))
query("csg_count", "SELECT n, CAST(n * (n + 1) / 2 AS BIGINT) AS csg, CAST((n * n * n - n) / 6 AS BIGINT) AS pairs FROM (VALUES (3), (4), (5), (6)) x(n)")(
    lambda spark, d: spark.createDataFrame([(n, len(list(P.connected_subgraphs(a))), len(list(P.csg_cmp_pairs(a)))) for n in (3, 4, 5, 6) for a in [[{j for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)]]], "n int, csg long, pairs long")
)


def true_cards(g: DataFrame, pattern: P.Bgp) -> dict[frozenset[int], int]:
    """Rows of every connected part of a pattern, in one job: a union of counts."""
    parts = list(P.connected_subgraphs(P.adjacency(pattern)))
    frames = [E.evaluate(g, pattern.sub(sorted(x))).agg(F.count("*").alias("n")).withColumn("k", F.lit(i)) for i, x in enumerate(parts)]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return {parts[r["k"]]: r["n"] for r in out.collect()}


_PARTS = sorted(P.connected_subgraphs(P.adjacency(_PATH)), key=lambda x: (len(x), sorted(x)))
_CARDS = "cards AS (" + " UNION ALL ".join(f"SELECT {sum(1 << i for i in x)} AS mask, {len(x)} AS size, n FROM ({bgp_sql(_PATH.sub(sorted(x)), 'COUNT(*) AS n')})" for x in _PARTS) + ")"
_ORDERS = _CARDS + ", bits AS (SELECT mask AS bit FROM cards WHERE size = 1), plans(mask, size, cost, steps) AS (SELECT mask, 1, CAST(n AS BIGINT), CAST(mask AS VARCHAR) FROM cards WHERE size = 1 UNION ALL SELECT c.mask, p.size + 1, CAST(p.cost + c.n AS BIGINT), p.steps || ',' || b.bit FROM plans p JOIN bits b ON (p.mask & b.bit) = 0 JOIN cards c ON c.mask = (p.mask | b.bit))"


def _searched(f):
    def run(spark, d):
        cards = true_cards(graph.triples(spark, d), _PATH)
        return f(spark, lambda x: cards[frozenset(x)])

    return run


query("sub_query_cards", with_triples("SELECT mask, CAST(n AS BIGINT) AS n FROM cards", _CARDS))(lambda spark, d: spark.createDataFrame([(sum(1 << i for i in k), v) for k, v in true_cards(graph.triples(spark, d), _PATH).items()], "mask int, n long"))
query("leftdeep_plans", with_triples("SELECT steps, cost FROM plans WHERE size = 4", _ORDERS, True))(_searched(lambda spark, c: spark.createDataFrame([(",".join(str(1 << i) for i in o), int(P.left_deep_cost(o, c))) for o in P.left_deep_orders(_PATH)], "steps string, cost long")))
query("leftdeep_best_cost", with_triples("SELECT MIN(cost) AS cost FROM plans WHERE size = 4", _ORDERS, True))(_searched(lambda spark, c: spark.createDataFrame([(int(P.dp_search(_PATH, c)[1][0]),)], "cost long")))
query("dpccp_best_cost")(_searched(lambda spark, c: spark.createDataFrame([(int(P.dp_search(_PATH, c)[0][0]), P.dp_search(_PATH, c)[0][1].pretty())], "cost long, plan string")))
query("beam_topk")(_searched(lambda spark, c: spark.createDataFrame([(str(list(o)), float(v)) for v, o in P.beam_left_deep(_PATH, c, 4)], "plan string, cost double")))
query("beam_bushy")(_searched(lambda spark, c: spark.createDataFrame([(f[0].pretty(), float(v)) for v, f in P.beam_bushy(_PATH, c, 4)], "plan string, cost double")))


@query("execution_signal")
def _signal(spark: SparkSession, d: str) -> DataFrame:
    """The chosen plan, run: rows of each join as measured."""
    g = graph.triples(spark, d)
    cards = true_cards(g, _PATH)
    _, (_, plan) = P.dp_search(_PATH, lambda x: cards[frozenset(x)])
    x = E.execute(g, _PATH, plan)
    return spark.createDataFrame([(list(plan.leaves), x["rows"], x["per_join_rows"], x["total_cost"], x["is_error"], x["is_valid_join_row"])], "plan array<int>, rows long, per_join_rows array<long>, total_cost long, is_error boolean, is_valid_join_row array<boolean>")


# Execution feedback.
_LOG = "log AS (SELECT user_id AS query_id, event_type AS plan_id, event_id AS seq, value AS latency, event_type = 'error' AS is_error, CAST(ts AS DATE) AS day FROM events)"
on_log("best_plan_cache", f"WITH {_LOG} SELECT query_id, plan_id, latency, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, plan_id ORDER BY latency, seq) AS r FROM log WHERE NOT is_error AND latency IS NOT NULL) WHERE r = 1", B.best_plans)
on_log("adaptive_timeout", f"WITH {_LOG} SELECT query_id, GREATEST(1.0, LEAST(2 * arg_max(latency, seq), 60.0)) AS timeout FROM log WHERE NOT is_error GROUP BY query_id", B.adaptive_timeouts)
on_log("ring_buffer", f"WITH {_LOG} SELECT seq % 512 AS slot, MAX(seq) AS seq, arg_max(latency, seq) AS latency FROM log GROUP BY 1", B.ring_buffer)
on_log("ema_normaliser", f"WITH RECURSIVE {_LOG}, daily AS (SELECT day, AVG(latency) AS m, ROW_NUMBER() OVER (ORDER BY day) AS r FROM log WHERE NOT is_error GROUP BY day), fold(r, e) AS (SELECT r, m FROM daily WHERE r = 1 UNION ALL SELECT d.r, 0.9 * f.e + 0.1 * d.m FROM fold f JOIN daily d ON d.r = f.r + 1) SELECT ROUND(arg_max(e, r), 6) AS ema FROM fold", B.moving_average)
on_log("timeout_metrics", f"WITH {_LOG}, t AS (SELECT CASE WHEN is_error THEN 60.0 ELSE latency END AS t, is_error FROM log) SELECT COUNT(*) AS n, ROUND(AVG(t), 6) AS mean_t, ROUND(quantile_cont(t, 0.5), 6) AS p50, ROUND(quantile_cont(t, 0.9), 6) AS p90, ROUND(quantile_cont(t, 0.99), 6) AS p99, ROUND(MAX(t), 6) AS max_t, ROUND(AVG(CAST(is_error AS DOUBLE)), 6) AS error_rate FROM t", B.latency_metrics)
on_log("z_score", f"WITH {_LOG} SELECT seq, ROUND((latency - m) / s, 6) AS z FROM log, (SELECT AVG(latency) AS m, STDDEV_POP(latency) AS s FROM log)", B.z_scores)
on_log("per_weights", f"WITH {_LOG}, a AS (SELECT seq, POWER(latency, 0.6) AS a FROM log WHERE latency > 0) SELECT seq, ROUND(a / SUM(a) OVER (), 9) AS prob, ROUND(POWER(a / MIN(a) OVER (), -0.4), 6) AS weight FROM a", B.replay_priorities)
on_log("cvar", f"WITH {_LOG}, r AS (SELECT query_id, latency, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY latency DESC, seq) AS n, COUNT(*) OVER (PARTITION BY query_id) AS k FROM log WHERE latency IS NOT NULL) SELECT query_id, ROUND(AVG(latency), 6) AS cvar FROM r WHERE n <= GREATEST(1, FLOOR(0.09999999999999998 * k)) GROUP BY query_id", B.tail_risk)

# Scalar functions.
query("duration_decode", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id / 1000.0 WHEN 1 THEN CAST(event_id AS DOUBLE) ELSE event_id * 60.0 END AS seconds FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", T.seconds(F.concat(F.col("event_id").cast("string"), F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit("m")), (F.col("event_id") % 3 + 1).cast("int")))).alias("seconds"))
)
on_graph("term_render", with_triples("SELECT p, MIN(s || ' ' || p || ' ' || o || ' .') AS first_key, COUNT(*) AS n FROM triples GROUP BY p"), lambda g: g.groupBy("p").agg(F.min(T.pattern_key()).alias("first_key"), F.count("*").alias("n")))

# Generated workloads and walks: seeded, so rows only.
query("generated_stars")(lambda spark, d: G.stars(graph.triples(spark, d), 3, 50, seed=1))
query("generated_paths")(lambda spark, d: G.paths(graph.triples(spark, d), 3, 50, seed=1))
query("random_walks")(lambda spark, d: G.walks(graph.triples(spark, d).where(~S.is_literal("o")), 3, 2, seed=1))
query("isomorphism_dedupe")(lambda spark, d: G.dedupe(spark.createDataFrame([(i, b.text) for i, b in enumerate([*_WORKLOAD, bgp('?x p:status "F" . ?x p:placedBy ?y .')])], "seq long, query string")))
query("line_graph_features")(lambda spark, d: G.line_graph(spark, [bgp(FLAGSHIP)]))
