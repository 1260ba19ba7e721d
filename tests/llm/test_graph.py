import random

from folioflow.llm.graph import components


def test_random_graphs(spark):
    rnd = random.Random(2)
    edges = [
        (rnd.randrange(300), rnd.randrange(300)) for _ in range(200)
    ] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7), (-5, -9)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    d = spark.createDataFrame([*edges, edges[0], (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(d).collect()} == {x: root(x) for x in up}
    assert components(d.limit(0)).count() == 0
