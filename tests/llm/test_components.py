import random

from edgeloom.llm.components import components


def test_random_graphs_paths_and_stars(spark, stage):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(300, 300), (7, 7)] + [(101, 100)]
    parent = {}

    def root(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), stage).collect()}
    assert got == {k: root(k) for k in parent}


def test_no_edges(spark, stage):
    assert components(spark.createDataFrame([], "a long, b long"), stage).count() == 0
