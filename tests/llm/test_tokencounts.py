import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldscan.llm.common import new_folder
from fieldscan.llm.tokencounts import CACHE_SCHEMA, count_tokens, file_digest, sentencepiece_counter
from tests.llm.conftest import EDGES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab e\n\t▁é漢<s>0 ", max_size=30), max_size=5))
def test_words_have_as_many_ids_as_whole_texts(texts):
    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sentencepiece_counter(MODEL)([t.encode() for t in texts]).tolist() == [len(whole.encode(t)) for t in texts]


def test_counts_rows_and_cache(spark, docs):
    rows = EDGES + [(7, "one"), (8, " lead  and  double "), (9, "<s> </s> <unk>")]
    cache = new_folder(spark, "test-cache")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows), key=str)
    for _ in range(2):
        assert sorted((tuple(r) for r in count_tokens(docs(rows), MODEL, cache).collect()), key=str) == expected
        # The second run appends nothing: every content was stored once.
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    other = Tokenizer.from_file(JSON)
    got = count_tokens(docs(rows), JSON, cache).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == sorted((i, len(other.encode(t or "").ids)) for i, t in rows if i is not None)
    assert spark.read.schema(CACHE_SCHEMA).parquet(cache).select("tokenizer").distinct().count() == 2


def test_stored_counts_are_used(spark, docs):
    cache = new_folder(spark, "test-cache")
    count_tokens(docs([(1, "known")]), MODEL, cache).collect()
    row = spark.read.schema(CACHE_SCHEMA).parquet(cache).first()
    spark.createDataFrame([(row["digest"], file_digest(MODEL), 99)], CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert [r["n_tokens"] for r in count_tokens(docs([(1, "known"), (2, "known")]), MODEL, cache).collect()] == [99, 99]
    assert count_tokens(docs([]), MODEL, cache).collect() == []
