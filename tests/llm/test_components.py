import random

from panelmetrics.llm.components import connected_components


def test_components_of_random_graphs_paths_and_stars(spark):
    chance = random.Random(12)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(160)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a path in order
    edges += [(2000, 2001 + i) for i in range(50)] + [(2500, 2600), (2600, 2500), (7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: root(x) for x in ends}


def test_no_edges_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
