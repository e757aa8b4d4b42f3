import hashlib
import random
import re

from fieldscan.llm import decontaminate
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(window, len(b))
            for a in range(len(b) - n + 1) if b and item is not None else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[a : a + n]:
                        hit |= set(range(at, at + n))
                        names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(12)
    vocabulary = ["red", "a", "Über", "the", "x1", "stone", "of", "漢字"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 9, 10, 11, 30])))) for i in range(14)]
    items += [(20, "only once"), (20, "only once"), (21, None), (22, " .,"), (None, "red stone"), (100, items[3][1])]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(200 + i, f"before {t}, AND {t.upper() if t else ''} after") for i, (_, t) in enumerate(items)] + EDGES + [(300, None)]
    return rows, items


def test_equals_brute_force_in_one_pass_and_in_many(spark, docs):
    rows, items = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    assert sorted((tuple(r) for r in decontaminate.contamination(docs(rows), benchmark).collect()), key=str) == expected
    assert sorted((tuple(r) for r in decontaminate.contamination(docs(rows), benchmark, per_pass=20).collect()), key=str) == expected


def test_clean_rows_stay_as_they_are(spark, docs):
    rows, items = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = {r[0] for r in brute(rows, items) if not r[5]}
    kept = decontaminate.without_contaminated(docs(rows), benchmark)
    assert kept.columns == docs([]).columns and {r["doc_id"] for r in kept.collect()} == clean


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontaminate.contamination(docs(EDGES), none).collect()} == {False}
    assert decontaminate.contamination(docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
