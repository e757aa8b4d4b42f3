import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Anchors: ids divisible by 5. Rows of a repeated id must be alike."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows if i is not None and l is not None and fine(v)]
    out = set()
    for a, v, l in whole:
        if a % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, k) for i, w, k in whole if i != a and len(w) == len(v))
        for p, pos, _ in [s for s in scored if s[2] == l][:5]:
            hits = [(i, -s) for s, i, k in scored if k != l and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out |= {(a, pos, r, i, -p, s) for r, (i, s) in enumerate(hits, 1)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "v": F.lit(1), "leaf": F.lit(2.5)})
    label = gnat.changed_label(F.col("vec_id"), F.col("label"))
    got = gnat.hard_negatives(df, F.col("vec_id") % 5 == 0, label, **options)
    return {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()}


def clustered(rng, n):
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("options", [{"leaf_rows": 12, "sample_rows": 150, "tile_rows": 7, "block_rows": 9}, {}])
def test_equals_brute_force(spark, options):
    rows = clustered(random.Random(4), 300) + [(1000 + i, [0.5, 0.5, 0.25, 0.0, 0.0, 0.125], i % 3) for i in range(30)]
    expected = brute(rows)
    assert len(expected) > 500 and found(spark, rows, **options) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 1.0], 1), (4, [inf, 0.0], 2), (None, [1.0, 1.0], 1), (6, [1.0, 1.0], None)]
    rows += [(8, [1.0, 1.5], 1), (9, [1.0, 1.0], 2), (9, [1.0, 1.0], 2), (11, [0.5, 1.0], 3), (5, [3e6, 3e6], 4), (12, [2e6, 2e6], 4), (13, [1.2e6, 1.2e6], 5)]
    rows += [(10, [1.0], 2), (15, [], 2), (16, [], 3), (20, [-1.0, 0.0], 6), (17, [1.0, 0.0], 6), (30, [0.0, 0.0], 9), (18, [0.0, 0.0], 9)]
    # Of a table this small every leaf is met; the repeated row is a candidate twice.
    expected = brute(rows)
    assert found(spark, rows) == expected and {r[0] for r in expected} >= {0, 5, 30}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_ranges_leave_out_children_and_lose_none():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 300, (20, 8))
    vectors = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 30, (4000, 8)))
    norm = float((vectors**2).sum(1).max())
    tree = gnat.fit(vectors[:800], norm, 20)
    shape = (len(tree.nodes), gnat.FAN_OUT, gnat.FAN_OUT)
    tree.low, tree.high = np.full(shape, np.inf), np.full(shape, -np.inf)
    leaf = gnat.descend(tree, vectors, norm, tree.low, tree.high)
    scores = (vectors[:100] @ vectors.T).astype(np.int64)
    highs = np.sort(scores, axis=1)[:, -2][:, None]
    lows = highs * 8 // 10
    met = gnat.surviving(tree, vectors[:100], *gnat.ring(vectors[:100], lows, highs, norm), norm)
    reach = {(int(a), k) for k, own in met for a in own}
    rows, at = np.nonzero((scores >= lows) & (scores <= highs))
    assert {(int(r), int(leaf[x])) for r, x in zip(rows, at)} <= reach
    assert len(reach) < 0.5 * 100 * tree.leaves
