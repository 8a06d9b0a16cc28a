"""Communities found in parallel against the sequential form."""

import random

import pytest

from lodewell.operators import graph as G

KARATE = "2-1 3-1 3-2 4-1 4-2 4-3 5-1 6-1 7-1 7-5 7-6 8-1 8-2 8-3 8-4 9-1 9-3 10-3 11-1 11-5 11-6 12-1 13-1 13-4 14-1 14-2 14-3 14-4 17-6 17-7 18-1 18-2 20-1 20-2 22-1 22-2 26-24 26-25 28-3 28-24 28-25 29-3 30-24 30-27 31-2 31-9 32-1 32-25 32-26 32-29 33-3 33-9 33-15 33-16 33-19 33-21 33-23 33-24 33-30 33-31 33-32 34-9 34-10 34-14 34-15 34-16 34-19 34-20 34-21 34-23 34-24 34-27 34-28 34-29 34-30 34-31 34-32 34-33"


def planted(n, groups, inside, outside, seed):
    rnd = random.Random(seed)
    return [(i, j, float(rnd.randint(1, 3))) for i in range(n) for j in range(i + 1, n) if rnd.random() < (inside if i % groups == j % groups else outside)]


GRAPHS = {
    "club": [(*map(int, e.split("-")), 1.0) for e in KARATE.split()],
    "planted": planted(60, 4, 0.5, 0.03, 1),
    "stars": [(0, i, 1.0) for i in range(1, 9)] + [(10, i, 1.0) for i in range(11, 15)],
    "complete": [(i, j, 1.0) for i in range(12) for j in range(i)],
}


def modularity(home, edges):
    double, inside, total = sum(2 * w for *_, w in edges), 0.0, {}
    for a, b, w in edges:
        inside += 2 * w * (home[a] == home[b])
        for x in (a, b):
            total[home[x]] = total.get(home[x], 0.0) + w
    return inside / double - sum((t / double) ** 2 for t in total.values())


@pytest.mark.parametrize("name", GRAPHS)
def test_communities_are_no_worse_than_sequential_ones(spark, name):
    edges = GRAPHS[name]
    rows = G.communities(spark.createDataFrame(edges, "src long, dst long, w double")).collect()
    home = {r["node"]: r["community"] for r in rows}
    assert len(rows) == len(home) and set(home) == {x for a, b, _ in edges for x in (a, b)}
    assert all(min(n for n, c in home.items() if c == community) == community for community in home.values())
    got, (_, sequential) = modularity(home, edges), G.louvain(sorted(home), edges)
    assert abs(got - rows[0]["modularity"]) < 1e-6 and got >= sequential - 0.01


def test_odd_edges_have_communities(spark):
    rows = [("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 2.0), ("c", "d", 0.0), ("e", "f", None), ("g", "g", 3.0), ("h", "i", 2.0)]
    found = {r["node"]: r["community"] for r in G.communities(spark.createDataFrame(rows, "src string, dst string, w double"), "string").collect()}
    assert found == {"a": "a", "b": "a", "g": "g", "h": "h", "i": "h"}
    assert G.communities(spark.createDataFrame([], "src long, dst long, w double")).collect() == []


def test_nodes_sent_or_joined_give_the_same_communities(spark, monkeypatch):
    edges = spark.createDataFrame(GRAPHS["planted"], "src long, dst long, w double")
    sent = {r["node"]: r["community"] for r in G.communities(edges).collect()}
    monkeypatch.setattr(G, "NODES_SENT", 0)
    assert {r["node"]: r["community"] for r in G.communities(edges).collect()} == sent


def test_half_of_a_dense_graph_moves_at_once(spark, monkeypatch):
    rnd, freedoms, made = random.Random(5), [], G._moves

    def seen(*args):
        freedoms.append(args[-2])
        return made(*args)

    monkeypatch.setattr(G, "_moves", seen)
    monkeypatch.setattr(G, "LEVELS", 1)
    monkeypatch.setattr(G, "MOVE_ROUNDS", 3)
    edges = [(i, j, 1.0) for i in range(40) for j in range(i) if rnd.random() < 0.5]
    found = G.communities(spark.createDataFrame(edges, "src long, dst long, w double")).collect()
    assert G.HALF in freedoms and len({r["community"] for r in found}) < 30
