import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldscan.llm import nbest
from tests.llm.conftest import EDGES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return nbest.Encoder(MODEL)


def brute(pieces, text):
    """All segmentations, the best first."""
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
        for end in range(at + 1, min(len(text), at + pieces.longest) + 1):
            found = pieces.scores.get(text[at:end])
            if found:
                go(end, score + found[0], ids + [found[1]])
            elif end == at + 1:
                go(end, score + pieces.unknown_score, ids + pieces.unknown(text[at]))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_equals_all_segmentations(encoder):
    parts = ["a", "the", "er", " ", " ", "\n", "é", "漢", "ing", "x", ".", "  ", "▁", "\x00", "😀"]

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from(parts), max_size=7).map("".join), st.integers(1, 5))
    def same(text, n):
        every = brute(encoder.pieces, encoder.pieces.marked(text))
        scores = pytest.approx([s for s, _ in every[:n]])
        ((ids, found),) = encoder.encode([text], n)
        assert found == scores
        listed = encoder.n_best(text, n)
        assert [s for s, _ in listed] == scores and len({tuple(i) for _, i in listed}) == len(listed)
        assert all((i in [x for _, x in every]) for _, i in listed) and ids.tolist() in [x for _, x in every]
        assert encoder.decode(ids.tolist()) == text.replace("▁", " ")

    same()


def test_batches_and_search_agree(encoder):
    units = ["▁internationally", "▁" + "ab" * 40, "xyz" * 9, "▁▁▁", "é"]
    for (score, ids, loss), unit in zip(nbest.best_of(encoder.pieces, units), units):
        first, *rest = nbest.search(encoder.pieces, unit, 2)
        assert score == pytest.approx(first[0]) and (loss == pytest.approx(first[0] - rest[0][0]) if rest else loss == float("inf"))


def test_rows_and_decoding(docs):
    found = nbest.encode(docs(EDGES), MODEL, ["doc_id", "row"])
    got = found.collect()
    assert sorted((str(r["row"]["doc_id"]), r["decodes"]) for r in got) == sorted((str(i), True) for i, _ in EDGES)
    assert all(r["n_pieces"] == len(r["ids"]) and (r["n_pieces"] > 0 or r["scores"] == [0.0]) for r in got)
    back = nbest.decode(found.select("row.doc_id", "ids", F.lit(3).alias("text")), MODEL)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in EDGES), key=str)
    assert nbest.encode(docs([]), MODEL, ["doc_id"]).collect() == []


def test_all_of_the_n_best_come_out(spark, docs, encoder, monkeypatch):
    from fieldscan.llm import queries

    texts = ["", "a", "the er", "x  ing é", "ererer the", "漢 a", "xx\nthe"]
    got = nbest.encode(docs(list(enumerate(texts))), MODEL, ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["row"]["doc_id"]]
        every = brute(encoder.pieces, encoder.pieces.marked(text))
        listed = [(x["score"], x["ids"]) for x in r["n_best"]]
        assert [s for s, _ in listed] == pytest.approx([s for s, _ in every[:3]]) == r["scores"] and listed[0][1] == r["ids"]
        assert len({tuple(ids) for _, ids in listed}) == len(listed) == min(3, len(every))
        for score, ids in listed:
            assert any(ids == x and score == pytest.approx(s) for s, x in every) and encoder.decode(ids) == text
    assert nbest.encode(docs([(1, "a")]), MODEL, ["doc_id"], with_ids=False).first()["n_best"] is None
    monkeypatch.setattr(queries, "table", lambda *_: docs([(1, "the er")]))
    row = queries.op10_nbest_pieces(spark, "").first()
    assert len({row["ids_crc32"], row["second_ids_crc32"], row["third_ids_crc32"], 0}) == 4


def test_listed_segmentations_with_ties(encoder):
    texts = ["aaaa aaaa", "ababab abab xyxyxy", "▁▁▁ ▁▁", "the the the the", "      x"]
    for n in (1, 2, 3, 5, 9):
        for text, found in zip(texts, encoder.encode_all(texts, n)):
            assert len({tuple(ids.tolist()) for _, ids in found}) == len(found)
            assert [s for s, _ in found] == pytest.approx([s for s, _ in encoder.n_best(text, n)])
            for _, ids in found:
                assert encoder.decode(ids.tolist()) == text.replace("▁", " ")
