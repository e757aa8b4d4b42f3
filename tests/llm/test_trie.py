import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.llm import trie
from fieldscan.llm.running import running

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def told(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((-(2**63) if turn is None else turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(own, key=lambda t: t[0])] for c, own in convs.items()}


def rebuilt(convs):
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    base = lambda c: c - (abs(c) % 100) * (1 if c > 0 else -1)
    return {c: convs.get(base(c), [])[: h(c)] + own[h(c) :] for c, own in convs.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    under = lambda pre: [p for p in members if p[: len(pre)] == pre]
    children = lambda pre: [p for p in members if len(p) == len(pre) + 1 and p[:-1] == pre]
    out = []
    for pre, own in members.items():
        last = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(pre))
        out.append((
            min(own), len(pre), min(members[pre[:-1]]) if pre else None, len(own), len(children(pre)),
            sum(not children(p) for p in under(pre)), sum((len(members[p]) - 1) * len(p[-1][1]) for p in under(pre) if p),
            hashlib.sha256(last.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"conv": F.lit("x"), "depth": F.lit(1.5), "digest": F.lit(None), "n": F.lit(3)})


def nodes(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def random_rows(rng):
    rows = []
    for c in [*range(0, 60), *range(95, 130), -3, -100, -105, 200, 299]:
        if rng.random() < 0.8:
            for t in rng.sample(range(12), rng.randrange(1, 9)):
                rows.append((c, None if t == 11 else t, rng.choice(["user", "assistant", None]), rng.choice(["hé", "yes", "no", "", None, "𝒳 long text"])))
    rows += [(400 + k, t, "user", f"same {t}") for k in range(30) for t in range(9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [trie.MOST_CELLS, 512])
def test_equals_brute_force(spark, cells):
    """With few cells, few prefixes are proved to be single."""
    rows = random_rows(random.Random(7))
    assert nodes(trie.rebuilt_trie(frame(spark, rows), cells)) == brute(rebuilt(told(rows)))
    assert nodes(trie.prefix_trie(frame(spark, rows), cells)) == brute(told(rows))


def test_repeated_turns_and_no_ids(spark):
    rows = [(None, 1, "user", "lost")] + [(7, 1, "user", "again")] * 5 + [(8, 1, "user", "again")] * 3
    assert nodes(trie.prefix_trie(frame(spark, rows))) == brute(told(rows))


def test_empty_table(spark):
    assert trie.rebuilt_trie(frame(spark, [])).collect() == []


def test_running_folds_of_a_hot_key_over_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(5, k, int(rng.integers(0, 99))) for k in range(3000)] + [(k, 0, k) for k in (1, 2, 9)]
    df = spark.createDataFrame(rows, "key long, place long, v long").withColumn("x", F.xxhash64("place", "v"))
    sums = {(r.key, r.place): r.run_v for r in running(df, "key", ["place"], ["v"]).collect()}
    assert sums[5, 2999] == sum(v for k, _, v in rows if k == 5) and sums[5, 0] == rows[0][2] and sums[9, 0] == 9
    table = df.collect()
    xors = {(r.key, r.place): r.run_x for r in running(df, "key", ["place"], ["x"], "xor").collect()}
    assert xors[5, 1700] == np.bitwise_xor.reduce([r.x for r in table if r.key == 5 and r.place <= 1700])


def test_an_estimate_of_one_is_a_proof(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, (500, 2))
    keys[100:200] = keys[:100]
    bits = trie.sketch(spark.createDataFrame([tuple(map(int, k)) for k in keys], "k1 long, k2 long"), 500)
    whole = np.unpackbits(bits, axis=1)
    several = np.all([whole[i][c.astype(int)] == 1 for i, c in enumerate(trie.cells(keys[:, 0].copy(), keys[:, 1].copy(), whole.shape[1]))], axis=0)
    assert several[:200].all() and several[200:].mean() < 0.2
