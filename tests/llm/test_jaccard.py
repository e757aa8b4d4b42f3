import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldscan.llm import jaccard
from fieldscan.llm.common import packed, unpacked
from tests.llm.conftest import EDGES


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Component by set: equal texts count once, so repeated ids do no harm."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    out = []
    for i, (id_, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((id_, len(sets[i]), (min(ids) if ids else None) if sets[i] else id_))
    return sorted(out, key=str)


def near_copies(rng, groups, size, words):
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(words)] = str(rng.random())
            rows.append(" ".join(copy + ["and now the same old end of it all"] * rng.randrange(2)))
    return rows


def test_equals_brute_force(docs):
    rng = random.Random(11)
    texts = near_copies(rng, 12, 6, 60) + near_copies(rng, 3, 12, 25) + ["a b c d", "A  b C d", "a b c e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + EDGES
    got = sorted((tuple(r) for r in jaccard.similar(docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_a_chain_is_one_component(docs):
    words = [f"w{i}" for i in range(140)]
    rows = [(10 + k, " ".join(words[4 * k : 4 * k + 60])) for k in range(20)]
    got = sorted(tuple(r) for r in jaccard.similar(docs(rows)).collect())
    assert got == brute(rows) and {r[2] for r in got} == {10}


def test_empty_table_and_single_row(docs):
    assert jaccard.similar(docs([])).collect() == []
    assert [tuple(r) for r in jaccard.similar(docs([(9, "a b")])).collect()] == [(9, 1, 9)]


def test_one_of_each_group_stays(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (2, text), (2, text), (5, text + " more"), (8, "alone"), (1, None), (1, None), (4, " "), (None, text), (None, "no id")]
    kept = jaccard.one_of_each(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, text), (8, "alone"), (1, None), (1, None), (4, " "), (None, "no id")], key=str)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40)), st.integers(0, 2**20))
def test_gaps_come_back(values, base):
    ascending = np.array(sorted(v + base for v in values), np.uint64)
    assert unpacked(packed(ascending, base), base).tolist() == ascending.tolist()
    dense = np.array(sorted(base + v % 500_000 for v in values), np.uint64)
    assert unpacked(packed(dense, base), base).tolist() == dense.tolist()


def test_a_chain_through_a_row_without_an_id(docs):
    words = [f"w{i}" for i in range(140)]
    texts = [" ".join(words[4 * k : 4 * k + 60]) for k in range(3)]
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2])]
    got = sorted((tuple(r) for r in jaccard.similar(docs(rows)).collect()), key=str)
    assert got == brute(rows) and {r[2] for r in got} == {1}
    df = docs(rows).selectExpr("*", "1 AS _id", "2 AS _key", "3 AS id2")
    assert [r["doc_id"] for r in jaccard.one_of_each(df).collect()] == [1]


def test_hot_ngrams_in_tiles(docs, monkeypatch):
    """Hundreds of texts around the threshold, whose n-grams make tiles in place of pairs."""
    rng = random.Random(3)
    texts = []
    for words in (90, 130):
        base = [f"b{words}w{i}" for i in range(words)]
        for k in range(130):
            own = list(base)
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(words)] = f"x{rng.random()}"
            texts.append(" ".join(own[: words - rng.randrange(30)]))
    rows = list(enumerate(texts + near_copies(rng, 6, 5, 60)))
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "TILE_SETS", 23)
    expected = brute(rows)
    assert 20 < len({r[2] for r in expected}) < 200
    for list_pairs in (8, jaccard.LIST_PAIRS):
        assert sorted((tuple(r) for r in jaccard.similar(docs(rows), list_pairs=list_pairs).collect()), key=str) == expected


def test_overlaps_by_fragment():
    rng = random.Random(1)
    sets = [[sorted(rng.sample(range(10 * f, 10 * f + 9), rng.randrange(6))) for f in range(4)] for _ in range(30)]
    whole = [set(sum(s, [])) for s in sets]
    assert jaccard.overlaps(sets[:12], sets[12:]).tolist() == [[len(a & b) for b in whole[12:]] for a in whole[:12]]
