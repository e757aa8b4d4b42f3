import random

import numpy as np
import pytest
import xxhash

from fieldscan.llm import simhash
from tests.llm.conftest import EDGES


def fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    marks = [fingerprint(t) for _, t in rows]
    near = [[j for j, b in enumerate(marks) if j != i and (a ^ b).bit_count() <= radius] for i, a in enumerate(marks)]
    label = list(range(len(rows)))
    for i, others in enumerate(near):
        for j in others:
            x, y = label[i], label[j]
            label = [y if v == x else v for v in label]
    out = []
    for i, (id_, _) in enumerate(rows):
        ids = [r for (r, _), v in zip(rows, label) if v == label[i] and r is not None]
        out.append((id_, f"{marks[i]:016x}", min(ids) if ids else None, len(near[i])))
    return sorted(out, key=str)


def copies(rng, groups, size, words, changes):
    texts = []
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(changes)):
                own[rng.randrange(words)] = str(rng.random())
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("tile_rows", [3, 4096])
def test_equals_brute_force(docs, tile_rows):
    rng = random.Random(5)
    texts = copies(rng, 8, 8, 150, 4) + copies(rng, 1, 60, 300, 6) + ["Same  text here"] * 9 + [None, "", "same TEXT here"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + EDGES
    got = simhash.near_duplicates(docs(rows), tile_rows=tile_rows)
    expected = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert len({r[2] for r in expected}) < len(rows) - 40


def test_a_class_without_any_id_has_no_component(docs):
    assert [tuple(r) for r in simhash.near_duplicates(docs([(None, "a b c"), (None, "a b c")])).collect()] == [
        (None, f"{fingerprint('a b c'):016x}", None, 1)
    ] * 2


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []


def test_a_long_text_is_counted_in_parts(monkeypatch):
    texts = ["a b c d e f g h i j k", "", "x", "p q r s t u v w " * 9]
    monkeypatch.setattr(simhash, "HASHES", 7)
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


def test_cells_within_the_radius_are_met_once():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400, np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64))
    lanes = lambda v: np.bitwise_count(v.view(np.uint16).reshape(-1, 4)).astype(int)
    cell = lambda v: ((lanes(v) + 3) * 23 ** np.arange(4)).sum(1)
    assert set(np.abs(cell(a) - cell(b)).tolist()) <= set(simhash.steps(3))
    assert len(simhash.steps(3)) == 65
