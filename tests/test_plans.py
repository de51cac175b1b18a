import itertools

import pytest

from bgpforge.plans import bgp as P

CHAIN = {frozenset({0}): 10, frozenset({1}): 20, frozenset({2}): 30, frozenset({0, 1}): 5, frozenset({1, 2}): 50, frozenset({0, 1, 2}): 7}


def chain(n):
    return P.parse(" ".join(f"?v{i} <urn:p{i}> ?v{i + 1} ." for i in range(n)))


def star(n):
    return P.parse(" ".join(f"?s <urn:p{i}> ?v{i} ." for i in range(n)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_counts(n):
    a, b = P.adjacency(chain(n)), P.adjacency(star(n))
    assert len(set(P.connected_subgraphs(a))) == len(list(P.connected_subgraphs(a))) == n * (n + 1) // 2
    assert len(list(P.csg_cmp_pairs(a))) == (n**3 - n) // 6
    assert len(list(P.csg_cmp_pairs(b))) == (3**n - 2 ** (n + 1) + 1) // 2
    assert len(list(P.left_deep_orders(star(n)))) == len(list(itertools.permutations(range(n))))


def test_golden_costs():
    cards = lambda x: CHAIN[frozenset(x)]
    (bushy, _), (deep, plan) = P.dp_search(chain(3), cards)
    assert (bushy, deep, plan.leaves[-1]) == (22, 22, 2)
    assert P.left_deep_cost((0, 1, 2), cards) == 22
    assert min(P.left_deep_cost(o, cards) for o in P.left_deep_orders(chain(3))) == deep


def test_errors():
    with pytest.raises(P.Disconnected):
        P.dp_search(P.parse("?a <urn:x> ?b . ?c <urn:y> ?d ."), lambda x: 1)
    for text in ("_:b <urn:x> ?y .", "?a <urn:x> .", "{ ?a <urn:x> ?b . FILTER(?b) }", '"l" <urn:x> ?b .', "?a zz:x ?b ."):
        with pytest.raises(P.BgpError):
            P.parse(text)


def test_isomorphism():
    a, b, c = P.parse("?x <urn:p> ?y . ?y <urn:q> ?z ."), P.parse("?m <urn:q> ?n . ?k <urn:p> ?m ."), P.parse("?x <urn:p> ?y . ?x <urn:q> ?z .")
    assert P.canonical(a) == P.canonical(b) != P.canonical(c)


def test_beams_agree_with_search():
    cards = lambda x: CHAIN[frozenset(x)]
    assert P.beam_bushy(chain(3), cards, 10)[0][0] == min(5 + 7, 50 + 7)
    assert P.beam_left_deep(chain(1), cards, 3) == []
    assert P.tree_triples(P.left_deep([0, 1, 2])) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 2), (5, 4, 3)]


def test_left_deep_plan_costs_what_is_reported():
    """The golden of a chain, and random chains: the order returned has the cost that is returned, and no order is cheaper."""
    import random

    cards = {(0,): 10, (1,): 20, (2,): 30, (0, 1): 5, (1, 2): 50, (0, 1, 2): 7}
    chain = P.parse("?a <p> ?b . ?b <q> ?c . ?c <r> ?d .", {})
    cost, plan = P.dp_search(chain, lambda x: cards[tuple(sorted(x))])[1]
    assert (cost, list(plan.leaves)) == (22, [0, 1, 2])
    draw = random.Random(4)
    for _ in range(40):
        n = draw.randint(2, 6)
        bgp = P.parse(" . ".join(f"?v{i} <p{i}> ?v{i + 1}" for i in range(n)) + " .", {})
        known: dict = {}
        size = lambda x, known=known: known.setdefault(frozenset(x), draw.randint(1, 1000))
        cost, plan = P.dp_search(bgp, size)[1]
        assert plan.left_deep and P.left_deep_cost(plan.leaves, size) == cost == min(P.left_deep_cost(o, size) for o in P.left_deep_orders(bgp))
