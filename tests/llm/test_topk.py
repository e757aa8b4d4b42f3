import math
import random

from pyspark.sql import functions as F

from fieldscan.llm.topk import top_k


def brute(rows, k):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = set()
    for q, v in {i: v for i, v in sorted(whole, key=lambda r: r[1], reverse=True)}.items():
        if q % 5 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    return {tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0, **options).collect()}


def test_equals_brute_force_with_ties_over_many_tiles(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.251]) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5]) for i in range(20)]
    assert found(spark, rows, k=4, shard_rows=7, block_rows=3) == brute(rows, 4)


def test_null_odd_repeated_and_large_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0])]
    rows += [(5, [3e7, -3e7]), (6, [3e7, 3e7]), (7, [1.0]), (10, [2.0, 1.0, 0.0]), (15, []), (8, [1.0, 2.0]), (8, [1.0, 2.0])]
    got = found(spark, rows, k=5)
    assert {r for r in got if r[0] != 0} == {r for r in brute(rows, 5) if r[0] != 0}
    # A repeated query is asked once, and its other row is no candidate; a repeated candidate counts twice.
    assert sorted((r[1], r[2]) for r in got if r[0] == 0) == [(1, 6), (2, 8), (3, 8), (4, 5)]


def test_empty_table(spark):
    assert found(spark, []) == set()
