import math
import random

import pytest

from bgpforge.operators import estimate as C
from bgpforge.operators import evaluate as E
from bgpforge.operators import features as X
from bgpforge.operators import statistics as S
from bgpforge.plans import bgp as P

ROWS = [(f"<s{i}>", f"<p{k}>", f"<o{(i * k + j) % 7}>") for i in range(30) for k in range(1, 4) for j in range(1 + (i * k) % 4)]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string").distinct().cache()


def test_query_graph(spark):
    patterns = spark.createDataFrame([(1, 0, "?a", "<p>", "<c>"), (1, 1, "?b", "<q>", "?a"), (2, 0, "?x", "?y", '"l"')], "query_id long, tp_idx long, s string, p string, o string")
    counts = spark.createDataFrame([("<p>", 3), ("<c>", 1)], "term string, cnt long")
    vectors = spark.createDataFrame([("<c>", [0.5, 2.0])], "term string, vec array<double>")
    one, two = X.query_graphs(patterns, counts, vectors, 2).orderBy("query_id").collect()
    assert one.id_to_term == ["?a", "<c>", "?b"] and one.edge_src == [0, 1, 2, 0] and one.edge_dst == [1, 0, 0, 2]
    assert one.nodes == [[0.0, 1.0, 1.0], [math.log1p(1), 0.5, 2.0], [1.0, 1.0, 1.0]]
    assert one.edge_attr[0] == [math.log1p(3), 0.0, 0.0, 1.0] and one.edge_attr[3] == [0.0, 0.0, 0.0, -1.0]
    assert two.edge_attr[0] == [1.0, 1.0, 1.0, 1.0] and two.nodes[1] == [0.0, 0.0, 0.0]
    none = spark.createDataFrame([("<p>", 1.0, 1.0)], "p string, m_so double, m_os double")
    with pytest.raises(Exception, match="no multiplicity"):
        X.query_graphs(patterns, counts, vectors, 2, rich=True, multiplicities=none).collect()
    assert X.query_graphs(patterns.limit(0), counts, vectors, 2).count() == 0


def test_common_values(spark, g):
    patterns = spark.createDataFrame([(1, 0, "?a", "<p1>", "?b"), (1, 1, "?a", "<p2>", "?c"), (1, 2, "?c", "<p9>", "?a")], "query_id long, tp_idx long, s string, p string, o string")
    got = {r.term: r.shared for r in X.common_values(patterns, S.sketches(g)).collect()}
    assert got.keys() == {"?a", "?b", "?c"} and got["?b"] == got["?c"] == 0.0
    assert abs(got["?a"] - math.log1p(30)) < 0.05


def test_estimates(g):
    star = P.parse("{ ?s <p1> ?a . ?s <p2> ?b . ?s <p3> ?c . }")
    true = E.evaluate(g, star).count()
    full = C.wander_join(g, star, 10**9).first()
    assert full.walks == g.where("p = '<p1>'").count() and abs(full.estimate - true) < 1e-6
    pair = P.parse("{ ?s <p1> ?a . ?t <p2> ?a . ?t <p3> ?c . }")
    pair_true = E.evaluate(g, pair).count()
    got = [C.wander_join(g, pair, 40, seed).first().estimate for seed in range(8)]
    assert len(set(got)) > 1 and abs(sum(got) / len(got) - pair_true) < 0.25 * pair_true
    per = {(s, p): len({o for a, b, o in ROWS if (a, b) == (s, p)}) for s, p, _ in ROWS}
    mean = [sum(per[f"<s{i}>", f"<p{k}>"] for i in range(30)) / 30 for k in (1, 2)]
    assert abs(C.star_estimate(g, ["<p1>", "<p2>"]).first()[0] - 30 * mean[0] * mean[1]) < 1e-6
    assert C.star_estimate(g, ["<p1>", "<none>"]).first()[0] == 0
    with pytest.raises(P.BgpError):
        C.wander_join(g, P.parse("{ ?s <p1> ?a . ?t <p2> ?b . }"), 5)


def test_estimator_text(spark):
    bgp = P.parse("{ ?x <type> <T> . ?x <p> <v> . }")
    assert C.estimator_text(bgp, {"<T>": 4, "<v>": 9}, {"<type>": 0, "<p>": 1}, "<type>", 3) == "t # s 3\nv 0 4 -1\nv 1 -1 4\nv 2 -1 9\ne 0 1 0\ne 0 2 1\n"
    with pytest.raises(P.BgpError, match="no id of <v>"):
        C.estimator_text(bgp, {"<T>": 4}, {"<type>": 0, "<p>": 1}, "<type>")
    lines = spark.createDataFrame([("a/q1.txt 12.5 0.25",), ("warming up",), ("a/q2.txt x 1",)], "value string")
    assert [tuple(r) for r in C.estimator_results(lines).collect()] == [("a/q1.txt", 12.5, 0.25)]


def test_canonical():
    wide = [f"?s <p> ?o{i} ." for i in range(30)]
    assert P.canonical(P.parse("{ " + " ".join(wide) + " }")) == P.canonical(P.parse("{ " + " ".join(reversed(wide)).replace("?s", "?z") + " }"))
    ring = lambda *sizes: P.Bgp(tuple(P.TriplePattern(f"?v{k}_{i}", "<p>", f"?v{k}_{(i + 1) % n}") for k, n in enumerate(sizes) for i in range(n)))
    assert P.canonical(ring(6)) != P.canonical(ring(3, 3))
    rng = random.Random(3)
    for _ in range(60):
        names = [f"v{i}" for i in range(4)]
        tps = [(f"?{rng.choice(names)}", rng.choice(["<p>", "<q>"]), rng.choice(["<c>", *(f"?{v}" for v in names)])) for _ in range(5)]
        other = dict(zip(names, rng.sample(["a", "b", "c", "d"], 4), strict=True))
        renamed = [tuple(f"?{other[t[1:]]}" if t[0] == "?" else t for t in x) for x in rng.sample(tps, 5)]
        one, two = (P.canonical(P.Bgp(tuple(P.TriplePattern(*t) for t in x))) for x in (tps, renamed))
        assert one == two


def test_numbered_terms(spark, g, monkeypatch):
    from bgpforge.operators import workload as W
    from bgpforge.sources import graph as sources

    terms = sorted({t for s, _, o in ROWS for t in (s, o)})
    assert [(r.term, r.id) for r in sources.entity_ids(g).orderBy("id").collect()] == [(t, i) for i, t in enumerate(terms)]
    rows = spark.range(5000).selectExpr("id % 700 AS a", "id AS b")
    got = W.numbered(rows, ["a", "b"], "n", 8).orderBy("n").collect()
    assert [r.n for r in got] == list(range(5000)) and [(r.a, r.b) for r in got] == sorted((i % 700, i) for i in range(5000))
    assert W.numbered(rows.limit(0), ["a"]).count() == 0
    lines = [r.value for r in sources.text_graph(g, "<p1>").collect()]
    assert lines[0] == "t" and len(lines) == 1 + len(terms) + len(set(ROWS))


def test_empty_stars(spark):
    from bgpforge.operators import generate as G

    graph = spark.createDataFrame([(f"<s{i}>", f"<p{k}>", "<o>") for i in range(20) for k in ((0, 1, 2) if i % 2 else (3, 4, 5))], "s string, p string, o string").cache()
    got = G.empty_stars(graph, 2, 4).collect()
    assert len(got) >= 1
    for r in got:
        assert r.y == 0 and E.evaluate(graph, P.parse(r.query)).count() == 0


def test_epochs(spark, tmp_path):
    from bgpforge.sources import experiments as R

    for epoch, loss in enumerate([3.0, 1.0, 1.0, 2.0]):
        R.write_epoch(spark.createDataFrame([(loss,)], "loss double"), str(tmp_path / "run"), epoch)
    R.write_epoch(spark.createDataFrame([(2.5,)], "loss double"), str(tmp_path / "run"), 3)
    run = R.read_epochs(spark, str(tmp_path / "run"))
    assert R.last_epoch(run) == 3 and R.best_epoch(run, "loss") == 2 and R.best_epoch(run, "loss", False) == 0
    assert run.where("epoch = 3").first().loss == 2.5 and R.best_epoch(run.limit(0), "loss") is None


def test_triple_convolution(spark):
    import numpy as np

    from bgpforge.operators import models as M

    rng = np.random.default_rng(0)
    x, attr = rng.normal(size=(3, 2)), np.array([[0.3, 1.0], [0.3, -1.0], [0.7, 1.0], [0.7, -1.0]])
    src, dst = [0, 1, 2, 1], [1, 0, 1, 2]
    w, v = (rng.normal(size=(5, 2)), rng.normal(size=2)), (rng.normal(size=(2, 4)), rng.normal(size=4))
    want = 1.5 * x
    for a, b, e in zip(src, dst, attr, strict=True):
        first, last = (x[b], x[a]) if e[1] == 1 else (x[a], x[b])
        want[b] += np.maximum(np.concatenate([first, e[:1], last]) @ w[0] + w[1], 0)
    assert np.allclose(M.triple_convolution(x, src, dst, attr, w, v, 0.5), want @ v[0] + v[1])
    graphs = spark.createDataFrame([(1, x.tolist(), src, dst, attr.tolist())], "query_id long, nodes array<array<double>>, edge_src array<long>, edge_dst array<long>, edge_attr array<array<double>>")
    head = (np.ones(4), np.zeros(1))
    assert abs(M.scores(graphs, [{"message": w, "out": v, "eps": 0.5}], head).first().score - np.maximum(want @ v[0] + v[1], 0).sum()) < 1e-9
