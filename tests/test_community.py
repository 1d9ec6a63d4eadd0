"""Communities against a plain local search, label propagation and their own invariants."""

import random
from collections import Counter

import pytest

from weftspark.operators import community


def _graph(seed, groups=2, size=5, inside=0.7, outside=0.04):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(groups * size)]
    edges = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and rng.random() < (inside if i // size == j // size else outside)]
    return names, edges


def _modularity(member, edges):
    m, inside, degree = len(edges), Counter(), Counter()
    for a, b in edges:
        degree[member[a]] += 1
        degree[member[b]] += 1
        inside[member[a]] += member[a] == member[b]
    return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def _propagated(names, edges, seed=1):
    rng, label, near = random.Random(seed), {n: n for n in names}, {n: [] for n in names}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    for _ in range(20):
        for n in rng.sample(names, len(names)):
            if near[n]:
                count = Counter(label[x] for x in near[n])
                label[n] = min(count, key=lambda c: (-count[c], c))
    return label


def _pieces(members, edges):
    left, pieces = set(members), 0
    while left:
        pieces, stack = pieces + 1, [left.pop()]
        while stack:
            at = stack.pop()
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == at and y in left:
                        left.discard(y)
                        stack.append(y)
    return pieces


@pytest.fixture(scope="module")
def found(spark):
    names, edges = _graph(3)
    odd = edges + [(b, a) for a, b in edges[:20]] + [(names[0], names[0]), (names[1], "ghost")]
    nodes = spark.createDataFrame([(n,) for n in names + ["lone"]], "id string")
    frame = spark.createDataFrame(odd, "src string, dst string")
    return names, edges, nodes, frame, {r.id: r.community for r in community.louvain(nodes, frame).collect()}


def test_communities_are_whole_connected_and_at_least_as_good_as_labels(spark, found):
    names, edges, nodes, frame, member = found
    assert member.keys() == {*names, "lone"} and member["lone"] == "lone" and list(member.values()).count("lone") == 1
    q = _modularity(member, edges)
    assert q >= _modularity(_propagated(names, edges), edges) - 1e-9
    assert q >= 0.95 * _modularity({n: i // 5 for i, n in enumerate(names)}, edges)
    for c in set(member.values()):
        assert _pieces([n for n in member if member[n] == c], edges) == 1
    told = community.modularity(spark.createDataFrame(list(member.items()), "id string, community string"), frame)
    assert abs(told - q) < 1e-9


def test_no_single_move_gains(found):
    names, edges, _, _, member = found
    q = _modularity(member, edges)
    for n in names:
        for c in {member[b if a == n else a] for a, b in edges if n in (a, b)}:
            assert _modularity(member | {n: c}, edges) <= q + 1e-6


def test_the_result_depends_on_no_order(spark):
    pairs = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3"), ("a1", "b1")]
    nodes = spark.createDataFrame([(x,) for p in pairs for x in p], "id string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = community.louvain(nodes, spark.createDataFrame(pairs, "src string, dst string").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.id: r.community[0] for r in rows} == {x: x[0] for p in pairs for x in p} and len({r.community for r in rows}) == 2


def test_parts_of_a_community_that_fell_apart(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "e"), ("b", "c")], "a string, b string")
    member = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "x"), ("e", "x"), ("c", "y"), ("z", "x")], "id string, community string")
    assert {r.id: r.community for r in community._connected(links, member).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "z": "z"}
