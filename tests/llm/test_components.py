"""Connected components against a search."""

import random

from askgrid.llm.components import components


def test_random_graphs_chains_and_stars(spark):
    chosen = random.Random(1)
    edges = [(chosen.randrange(300), chosen.randrange(300)) for _ in range(170)]
    chain = [1000 + x for x in chosen.sample(range(200), 200)]
    edges += list(zip(chain, chain[1:], strict=False)) + [(2000, 2000 + i) for i in range(1, 50)] + [(5000 - i, 5000) for i in range(1, 9)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [(9999, 9999)]
    group = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == {x: group[x] for x in linked}
    assert components(df.limit(0)).count() == 0
