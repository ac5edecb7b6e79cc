import random

from accordant.llm.components import components


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_chains_stars_and_random(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    links += [(-5, 7_000_000_000), (300, 300), (None, 4), (1, 0), (1, 0)]
    rng.shuffle(links)
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute(links)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
