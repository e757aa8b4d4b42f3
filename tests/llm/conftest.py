import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as documents with columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id long, text string, row string, content int, id long, block int, n int, score double, hits string"
        return spark.createDataFrame([(i, t, "r", 1, 7, 2, 3, 0.5, "h") for i, t in rows], schema)

    return make


EDGES = [(None, "no id here at all now"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x " * 30_000), (6, "Ünïcode ß 　 \x85 漢字 '\"")]
