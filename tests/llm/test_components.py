import random

from riskbook.llm.components import connected
from tests.llm.helpers import find_components


def test_equals_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(80)] + [(3000 - k, 3000) for k in range(30)] + [(5, 5), (None, 4)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == find_components({n for e in real for n in e}, real)


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
