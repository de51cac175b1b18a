import duckdb
import pytest
from pyspark.sql import functions as F

from bgpforge import feature_queries  # noqa: F401  (registers its queries)
from bgpforge import queries as Q
from bgpforge import workload_queries  # noqa: F401  (registers its queries)
from bgpforge.operators import evaluate as E
from bgpforge.sources import graph

DATA = "/root/testdata/sf0.001"
CHECKED = ["bgp_star_3", "bgp_cyclic", "bgp_path_3", "pred_stats", "tp_cards_batch", "leftdeep_plans", "forced_order_same_bag", "best_plan_cache", "cvar", "ema_normaliser", "plan_dataset", "numbered_variables", "moving_statistics", "walk_difference", "leftdeep_best_order", "charset_estimate", "predicate_edge_features", "predicate_edge_statistics_features", "wander_join_exhaustive", "variable_numbers"]


def rows(frame):
    return sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in graph.TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(Q.QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(Q.SQL[name]).df())


def test_golden(spark):
    assert Q.QUERIES["flagship_count"](spark, DATA).first()[0] == 40
    assert Q.QUERIES["triples_count"](spark, DATA).first()[0] == 16133
    assert Q.QUERIES["dpccp_best_cost"](spark, DATA).first()["cost"] == 1538
    assert Q.QUERIES["execution_signal"](spark, DATA).first()["per_join_rows"][-1] == 1194


def test_stars_count_over_the_graph(spark):
    """y is the number of solutions of the query itself, at every subject."""
    from bgpforge.operators import generate as G
    from bgpforge.plans import bgp as P

    rows = [(f"<s{i}>", f"<p{k}>", f"<o{(i * k + j) % 5}>") for i in range(12) for k in range(1, 5) for j in range(1 + (i + k) % 3) if (i + k) % 4]
    g = spark.createDataFrame(rows, "s string, p string, o string").cache()
    got = [r for seed in (1, 2) for r in G.stars(g, 2, 4, seed, bound=0.4).collect()]
    assert got and any("<o" in r["query"] for r in got)
    for r in got:
        assert r["y"] == E.evaluate(g, P.parse(r["query"], {})).count()


def test_object_star_makes_no_pairs_outside_its_region(spark):
    """The pairs of subjects are made after the region is known, in many tasks, and are those of SQL."""
    db = duckdb.connect()
    for t in graph.TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = Q.QUERIES["bgp_object_star"](spark, DATA)
    assert rows(got.toPandas()) == rows(db.sql(Q.SQL["bgp_object_star"]).df())
    once = Q.QUERIES["bgp_object_star"](spark, DATA)
    n = once._jdf.queryExecution().executedPlan().execute().count()
    assert n == got.count() and max(E.join_rows(once)) == n
    tasks = got.select(F.spark_partition_id().alias("k")).groupBy("k").count()
    assert tasks.count() > 5 and tasks.agg(F.max("count")).first()[0] < n / 4


def test_object_star_makes_small_files(spark, tmp_path):
    """Where no side is broadcast, pairs are all there once, and lie so that a file holds their values as short references."""
    left, right = (spark.range(9000).select((F.col("id") % 2).alias("n"), F.format_string("<urn:customer/%d>", F.col("id")).alias(c)) for c in "ab")
    total = [F.count("*"), F.sum(F.xxhash64("n", "a", "b").cast("decimal(38,0)"))]
    expected = left.join(right, "n").agg(*total).first()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        E.spread_join(left, right).write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.columns == ["n", "a", "b"] and got.agg(*total).first() == expected
    assert sum(x.stat().st_size for x in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * expected[0]


def test_ntriples_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("<a>", "<p>", '"x y"'), ("<a>", "<p>", "<b>")], "s string, p string, o string")
    graph.write_ntriples(g, str(tmp_path / "g"))
    assert sorted(graph.read_ntriples(spark, str(tmp_path / "g")).collect()) == sorted(g.collect())
