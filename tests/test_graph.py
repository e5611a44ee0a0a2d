import random

from quillon.operators import graph


def test_cycles_match_brute_force(spark):
    r = random.Random(5)
    for n, m in ((12, 18), (30, 34), (8, 0)):
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        reach = {a: {b for x, b in pairs if x == a} for a in range(n)}
        for _ in range(n):
            reach = {a: to | {c for b in to for c in reach[b]} for a, to in reach.items()}
        want = {}
        for a in range(n):
            others = [b for b in range(n) if b != a and b in reach[a] and a in reach[b]]
            if others:
                want[a] = min([a, *others])
        edges = spark.createDataFrame([(a, b) for a, b in pairs], "source int, target int")
        assert {x.node: x.cycle for x in graph.cycles(edges).collect()} == want
