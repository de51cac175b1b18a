"""Basic graph patterns: terms, parsing, join graph, connected subgraphs, and plan search on the driver."""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

TERM = re.compile(r"""<[^<>\s]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^<>\s]*>)?|[?$]\w+|_:\w+|[A-Za-z][\w-]*:[\w./-]*|\ba\b""")


class BgpError(ValueError):
    """A pattern or plan that has no meaning here."""


class Disconnected(BgpError):
    """A search without Cartesian products on a pattern whose parts share no term."""


@dataclass(frozen=True)
class TriplePattern:
    s: str
    p: str
    o: str

    @property
    def terms(self) -> tuple[str, str, str]:
        return self.s, self.p, self.o

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t[1:] for t in self.terms if t[0] in "?$"))

    @property
    def key(self) -> str:
        return f"{self.s} {self.p} {self.o} ."


@dataclass(frozen=True)
class Bgp:
    patterns: tuple[TriplePattern, ...]

    @cached_property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(v for tp in self.patterns for v in tp.variables))

    @property
    def text(self) -> str:
        return "SELECT * WHERE { " + " ".join(tp.key for tp in self.patterns) + " }"

    def sub(self, indexes) -> Bgp:
        return Bgp(tuple(self.patterns[i] for i in indexes))


def parse(text: str, prefixes: dict[str, str] | None = None) -> Bgp:
    """`SELECT ... WHERE { tp . tp . }`; blank nodes and other operators raise BgpError."""
    found = re.search(r"\{(.*)\}", text, re.S)
    body = found[1] if found else text
    prefixes = dict(prefixes or {}) | {k: v for k, v in re.findall(r"PREFIX\s+([A-Za-z][\w-]*):\s*<([^>]*)>", text, re.I)}
    bare = re.sub(r"<[^>]*>|\"(?:[^\"\\]|\\.)*\"", " ", body)
    if word := re.search(r"\b(FILTER|OPTIONAL|UNION|MINUS|GRAPH|BIND|VALUES|SERVICE)\b|[{}]", bare, re.I):
        raise BgpError(f"{word[0]} is no part of a basic graph pattern")
    terms = TERM.findall(body)
    if len(terms) < 3 or len(terms) % 3:
        raise BgpError(f"{len(terms)} terms do not make triples")
    out = []
    for t in terms:
        if t.startswith("_:"):
            raise BgpError("blank nodes are not supported")
        if t[0] not in "<\"?$":
            name, _, local = t.partition(":")
            if name not in prefixes:
                raise BgpError(f"unknown prefix {name}")
            t = f"<{prefixes[name]}{local}>"
        out.append(t)
    if any(t[0] == '"' for i, t in enumerate(out) if i % 3 < 2):
        raise BgpError("a literal is no subject or predicate")
    return Bgp(tuple(TriplePattern(*out[i : i + 3]) for i in range(0, len(out), 3)))


def adjacency(bgp: Bgp, variables_only: bool = False) -> list[set[int]]:
    """Patterns are adjacent if they share any term (constants and predicates too), or any variable."""
    of = [set(tp.variables) if variables_only else set(tp.terms) for tp in bgp.patterns]
    return [{j for j in range(len(of)) if j != i and of[i] & of[j]} for i in range(len(of))]


def _near(adj, some: frozenset[int]) -> set[int]:
    return set().union(*(adj[i] for i in some)) - some


def connected_subgraphs(adj: list[set[int]]) -> Iterator[frozenset[int]]:
    """Each once: grown from every start over neighbours that no earlier start owns."""
    for start in reversed(range(len(adj))):
        yield frozenset({start})
        yield from _grow(adj, frozenset({start}), set(range(start + 1)))


def _grow(adj, some, banned) -> Iterator[frozenset[int]]:
    near = sorted(_near(adj, some) - banned)
    parts = [frozenset(x) for n in range(1, len(near) + 1) for x in itertools.combinations(near, n)]
    for part in parts:
        yield some | part
    for part in parts:
        yield from _grow(adj, some | part, banned | set(near))


def csg_cmp_pairs(adj) -> Iterator[tuple[frozenset[int], frozenset[int]]]:
    """Unordered pairs of connected, disjoint, adjacent subgraphs, each once."""
    for left in connected_subgraphs(adj):
        banned = set(range(min(left) + 1)) | left
        near = sorted(_near(adj, left) - banned, reverse=True)
        for start in near:
            yield left, frozenset({start})
            for right in _grow(adj, frozenset({start}), banned | {x for x in near if x <= start}):
                yield left, right


Cardinality = Callable[[frozenset[int]], float]


@dataclass(frozen=True)
class Plan:
    """A leaf (index) or a join of two plans."""

    index: int | None = None
    left: Plan | None = None
    right: Plan | None = None

    @property
    def leaves(self) -> tuple[int, ...]:
        return (self.index,) if self.index is not None else self.left.leaves + self.right.leaves

    @property
    def left_deep(self) -> bool:
        return self.index is not None or (self.right.index is not None and self.left.left_deep)

    def pretty(self, depth: int = 0) -> str:
        if self.index is not None:
            return "  " * depth + f"scan {self.index}"
        return "\n".join(["  " * depth + "join", self.left.pretty(depth + 1), self.right.pretty(depth + 1)])


def left_deep(order) -> Plan:
    first, *rest = order
    plan = Plan(first)
    for i in rest:
        plan = Plan(None, plan, Plan(i))
    return plan


def left_deep_cost(order, cards: Cardinality) -> float:
    """First scan and all join outputs."""
    return cards(frozenset(order[:1])) + sum(cards(frozenset(order[: k + 1])) for k in range(1, len(order)))


def plan_cost(plan: Plan, cards: Cardinality) -> float:
    """A scan costs its size; a join its output, and the cost of its sides, of which a leaf beside another plan is free."""
    if plan.index is not None:
        return cards(frozenset({plan.index}))
    out = cards(frozenset(plan.leaves))
    if plan.left.index is not None:
        return plan_cost(plan.right, cards) + out
    if plan.right.index is not None:
        return plan_cost(plan.left, cards) + out
    return plan_cost(plan.left, cards) + plan_cost(plan.right, cards) + out


def dp_search(bgp: Bgp, cards: Cardinality) -> tuple[tuple[float, Plan], tuple[float, Plan]]:
    """Best bushy and best left-deep plan over connected subgraph pairs, each by its own cost rule; ties keep the first found."""
    adj, n = adjacency(bgp), len(bgp.patterns)
    leaf = {frozenset({i}): (cards(frozenset({i})), Plan(i)) for i in range(n)}
    bushy, deep = dict(leaf), dict(leaf)
    for a, b in sorted(csg_cmp_pairs(adj), key=lambda x: (len(x[0] | x[1]), sorted(x[0]), sorted(x[1]))):
        for left, right in ((a, b), (b, a)):
            for best, ok in ((bushy, True), (deep, len(right) == 1)):
                if ok and left in best and right in best:
                    plan = Plan(None, best[left][1], best[right][1])
                    cost = plan_cost(plan, cards) if best is bushy else best[left][0] + cards(left | right)
                    if left | right not in best or cost < best[left | right][0]:
                        best[left | right] = cost, plan
    every = frozenset(range(n))
    if every not in bushy:
        raise Disconnected("the pattern is not connected")
    return bushy[every], deep[every]


def left_deep_orders(bgp: Bgp) -> Iterator[tuple[int, ...]]:
    """All orders whose every prefix is connected."""
    adj = adjacency(bgp)

    def extend(order):
        if len(order) == len(adj):
            yield order
        for i in sorted(_near(adj, frozenset(order))):
            yield from extend((*order, i))

    for i in range(len(adj)):
        yield from extend((i,))


def sampled_orders(bgp: Bgp, most: int, seed: int = 0) -> list[tuple[int, ...]]:
    """From each start random connected orders, with replacement, at most `most` and (n-1)!; dead ends are dropped."""
    adj, draw, out = adjacency(bgp), random.Random(seed), []
    limit = 1
    for k in range(2, len(adj)):
        limit *= k
    for start in range(len(adj)):
        for _ in range(min(limit, most)):
            order = [start]
            while near := sorted(_near(adj, frozenset(order))):
                order.append(draw.choice(near))
            if len(order) == len(adj):
                out.append(tuple(order))
    return out


def beam_left_deep(bgp: Bgp, cost: Callable[[tuple[int, ...]], float], width: int) -> list[tuple[float, tuple[int, ...]]]:
    """Keep the `width` best prefixes of each size, no Cartesian products; ranked by the model's cost of the prefix itself."""
    adj, beam = adjacency(bgp, variables_only=True), [(i,) for i in range(len(bgp.patterns))]
    scored: list[tuple[float, tuple[int, ...]]] = []
    for depth in range(1, len(bgp.patterns)):
        found = [(*order, i) for order in beam for i in sorted(_near(adj, frozenset(order))) if depth > 1 or i > order[0]]
        scored = sorted(((cost(x), x) for x in found), key=lambda x: x[0])[:width]
        beam = [x for _, x in scored]
    return scored


def beam_bushy(bgp: Bgp, cards: Cardinality, width: int) -> list[tuple[float, tuple[Plan, ...]]]:
    """Beam over forests by accumulated output sizes; equal forests go on once."""
    adj = adjacency(bgp, variables_only=True)
    beam: list[tuple[float, tuple[Plan, ...]]] = [(0.0, tuple(Plan(i) for i in range(len(bgp.patterns))))]
    for _ in range(len(bgp.patterns) - 1):
        found: dict[frozenset, tuple[float, tuple[Plan, ...]]] = {}
        for total, forest in beam:
            for u, v in itertools.permutations(forest, 2):
                if u.index is not None and v.index is not None and u.index > v.index:
                    continue
                if not _near(adj, frozenset(u.leaves)) & set(v.leaves):
                    continue
                after = tuple(x for x in forest if x not in (u, v)) + (Plan(None, u, v),)
                price = total + cards(frozenset(u.leaves + v.leaves))
                sign = frozenset(after)
                if sign not in found or price < found[sign][0]:
                    found[sign] = price, after
        if not found:
            break
        beam = sorted(found.values(), key=lambda x: x[0])[:width]
    return beam


def _refined(bgp: Bgp, colour: dict[str, int]) -> dict[str, int]:
    """Colours split by the patterns that a variable stands in, until none splits further; numbers keep the order of the colours before."""
    show = lambda t: ("?", colour[t[1:]]) if t[0] in "?$" else (t, -1)
    while True:
        seen = {v: (c, sorted((tuple(i for i, t in enumerate(tp.terms) if t[0] in "?$" and t[1:] == v), tuple(map(show, tp.terms))) for tp in bgp.patterns if v in tp.variables)) for v, c in colour.items()}
        rank: list = []
        for x in sorted(seen.values()):
            if not rank or rank[-1] != x:
                rank.append(x)
        after = {v: rank.index(x) for v, x in seen.items()}
        if len(set(after.values())) == len(set(colour.values())):
            return after
        colour = after


def _swapped(bgp: Bgp, v: str, w: str) -> bool:
    """Whether the pattern is the same with two variables exchanged."""
    other = {v: w, w: v}
    swap = lambda t: "?" + other.get(t[1:], t[1:]) if t[0] in "?$" else t
    plain = lambda t: "?" + t[1:] if t[0] in "?$" else t
    return sorted(tuple(map(swap, tp.terms)) for tp in bgp.patterns) == sorted(tuple(map(plain, tp.terms)) for tp in bgp.patterns)


def canonical(bgp: Bgp) -> str:
    """A text equal for patterns that differ in names of variables and order of triples only.

    Variables are coloured by where they stand and refined by their neighbours' colours. Of the first colour that is left with several
    variables, each is set apart in turn, except those that may be exchanged with one tried before, and the smallest text wins.
    """

    def least(colour: dict[str, int]) -> str:
        colour = _refined(bgp, colour)
        cells: dict[int, list[str]] = {}
        for v, c in colour.items():
            cells.setdefault(c, []).append(v)
        tied = next((cells[c] for c in sorted(cells) if len(cells[c]) > 1), None)
        if tied is None:
            order = {v: i for i, v in enumerate(sorted(colour, key=colour.get))}
            return "\n".join(sorted(" ".join(f"?{order[t[1:]]}" if t[0] in "?$" else t for t in tp.terms) for tp in bgp.patterns))
        tried: list[str] = []
        for v in tied:
            if not any(_swapped(bgp, v, w) for w in tried):
                tried.append(v)
        return min(least({x: 2 * c + (c == colour[v] and x != v) for x, c in colour.items()}) for v in tried)

    return least(dict.fromkeys(bgp.variables, 0))


def tree_triples(plan: Plan) -> list[tuple[int, int, int]]:
    """(node, left, right) from 1 in post-order of joins after leaves; leaves have children 0."""
    leaves = {i: k + 1 for k, i in enumerate(plan.leaves)}
    out: list[tuple[int, int, int]] = []
    count = itertools.count(len(leaves) + 1)

    def walk(x: Plan) -> int:
        if x.index is not None:
            return leaves[x.index]
        a, b = walk(x.left), walk(x.right)
        me = next(count)
        out.append((me, a, b))
        return me

    walk(plan)
    return [(k, 0, 0) for k in leaves.values()] + out
