import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldscan.functions.shape import entropy, field_shapes, merge_counts, shape, shape_counts


@pytest.mark.parametrize(
    "value, expected",
    [
        ("AB-1234", "A2-94"), ("aB c", "a1A1 1a1"), ("", ""), ("Größe 5€", "A1a1u2a1 191?1"), ("a\t\n b", "a1 3a1"), ("((x))", "((a1))"),
        ("a1" * 13, "text4"), ("x" * 5000, "a5000"),
    ],
)
def test_shapes(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(shape(F.col("v"))).first()[0] == expected


def test_entropy_of_classes(spark):
    def told(v):
        kinds = Counter("A" if c.isascii() and c.isupper() else "a" if c.isascii() and c.islower() else "9" if c.isascii() and c.isdigit() else "u" if c.isalnum() else " " if c == " " else "?" if not c.isascii() else "other" for c in v)
        return -sum(n / len(v) * math.log2(n / len(v)) for n in kinds.values())

    values = ["", "aaaa", "aA1 ", "x-.;y", "é€ b", "ABCabc123"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(entropy(F.col("v"))).collect()
    assert [r[0] for r in got] == pytest.approx([told(v) if v else 0.0 for v in values])


def test_sketches_add_up(spark, texts):
    first, second = ["AB-1", "CD-2", "x"], ["EF-3", None, "y z", ""]
    whole = field_shapes(shape_counts(texts(first + second))).collect()
    parts = field_shapes(merge_counts(shape_counts(texts(first)), shape_counts(texts(second)))).collect()
    assert whole == parts and [(r["n_values"], r["n_shapes"], r["top_shape"], r["top_share"]) for r in parts] == [(6, 4, "A2-91", 0.5)]
