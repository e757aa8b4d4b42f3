import pytest

import corpus_pipeline
from fieldscan.llm.common import saved
from tests.llm import test_decontaminate, test_jaccard, test_linedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "sentencepiece"]
    for name, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns and df.schema == stages[0][1].schema, name


def test_each_stage_against_brute_force(spark, stages):
    read, clean, lines, once, apart = (texts(df) for _, df in stages[:5])
    assert clean.items() <= read.items() and len(clean) > 0.7 * len(read)
    assert sorted(lines.items(), key=str) == test_linedup.brute(list(clean.items()))
    groups = test_jaccard.brute(list(lines.items()))
    assert set(once) == {i for i, n, c in groups if i == c or not n} and once.items() <= lines.items()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = test_decontaminate.brute(list(once.items()), items)
    assert set(apart) == {r[0] for r in found if not r[5]} and apart.items() <= once.items()
    last = {r["doc_id"]: r for r in stages[5][1].collect()}
    assert set(last) == set(apart) and all(r["decodes"] and r["n_pieces"] == len(r["ids"]) for r in last.values())


def test_run_gives_the_last_stage(spark, stages):
    rows = lambda df: sorted((r["doc_id"], r["n_pieces"], r["best_score"]) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1][1])
