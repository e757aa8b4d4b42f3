import random
import zlib

from pyspark.sql import functions as F

from fieldscan.llm import toxicity
from tests.llm.conftest import EDGES

CLEAN = [f"word{i}" for i in range(80)]
BAD = ["rotten", "vileness", "vilest"]


def text(rng, bad):
    lines = [" ".join(rng.choice(CLEAN) for _ in range(8)) for _ in range(rng.randrange(2, 12))]
    if bad:
        at = rng.randrange(len(lines))
        lines[at] += " " + rng.choice(BAD)
    return ". ".join(lines)


def corpus(n=600):
    rng = random.Random(4)
    return [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]


def test_held_out_texts_are_told_apart(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs([(i, t) for i, t, _ in rows]), labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) >= 0.97 * len(right)
    kept = toxicity.without_toxic(docs([(i, t) for i, t, _ in rows]), labels)
    assert kept.columns == docs([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_the_offending_sentence_is_found(spark, docs):
    model = toxicity.fit([(t.encode(), y) for _, t, y in corpus()])
    rows = [(1, "word1 word2. So rotten, word3! word4"), (2, "word1. word2")]
    got = {r["row"]["doc_id"]: r["sentences"] for r in toxicity.score(docs(rows), model, ["doc_id"], spans=True).collect()}
    assert [(s["number"], s["words"]) for s in got[1]] == [(1, "so rotten word3")] and got[2] == []


def test_a_long_text_is_not_toxic_for_its_length(spark, docs):
    rng = random.Random(1)
    model = toxicity.fit([(t.encode(), y) for _, t, y in corpus()])
    long = ". ".join(text(rng, False) for _ in range(3000))
    rows = toxicity.score(docs([(1, long), (2, long + ". rotten")]), model, ["doc_id"]).collect()
    scores = {r["row"]["doc_id"]: r["score"] for r in rows}
    assert scores[1] < 0.1 and scores[2] > 0.5


def test_edges_and_missing_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(EDGES), labels).collect()
    assert len(got) == len(EDGES) and {r["predicted"] for r in got} == {0} and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    one = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs(EDGES), one).collect()) == len(EDGES)
    assert toxicity.toxicity(docs([]), one).collect() == []
    assert toxicity.train(docs(EDGES), labels, F.lit(True)).known.size == 0


def test_training_takes_one_text_of_an_id_and_so_many_bytes(spark, docs):
    rows = [(i, ("vile slur " if i % 2 else "kind word ") * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    learn = toxicity.not_held_out()
    whole = toxicity.train(docs(rows), labels, learn)
    again = toxicity.train(docs(rows + [(3, rows[3][1])] * 40 + [(5, "z")] * 5), labels, learn)
    assert len(whole.known) and set(whole.known.tolist()) == set(again.known.tolist())
    assert len(toxicity.train(docs(rows), labels, learn, most_bytes=100).known) == 0
    got = toxicity.toxicity(docs(rows + [(99, "A vile slur here. Kind word there.")]), labels).filter("doc_id = 99").first()
    assert got["predicted"] == 1 and got["n_sentences"] >= 1
