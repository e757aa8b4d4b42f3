import random

from fieldscan.llm.components import components


def test_chains_stars_and_random_links(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    links += [(1, 0), (7, 7), (None, 3), (-5, 150)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            label[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in list(label)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
