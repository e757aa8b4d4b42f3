"""The structural fingerprint of a value: its runs of character classes and their entropy."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes: capitals, small letters, digits, letters and digits beyond ASCII, other signs beyond ASCII.
CLASSES = [("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "9"), (r"[^\x00-\x7F]", "?")]
_FROM = string.ascii_uppercase + string.ascii_lowercase + string.digits + "\x00"
_TO = "A" * 26 + "a" * 26 + "9" * 10 + "u"
# Runs of letters, digits and blanks are counted; every other sign stands for itself.
RUN = r"A+|a+|9+|u+|\?+|[ \t\r\n]+|[^Aa9u? \t\r\n]"
# Values of more runs are texts: they are told apart by their size only.
MOST_RUNS = 24


def classes(value: Column) -> Column:
    """The value with each character replaced by its class; ASCII signs stay."""
    # Letters beyond ASCII first become a control sign, so that the classes do not meet.
    marked = F.regexp_replace(F.regexp_replace(value, r"(?![\x00-\x7F])[\p{L}\p{N}]", "\x00"), r"[^\x00-\x7F]", "?")
    plain = F.when(F.octet_length(value) == F.length(value), value).otherwise(marked)
    # The other classes in one pass.
    return F.translate(plain, _FROM, _TO)


def shape(value: Column, kinds: Column | None = None) -> Column:
    """Runs as class and length, say ``A2-94``; of a text, ``text`` and its length as a power of two.

    ``kinds`` are the value's ``classes``, where those are at hand.
    """
    runs = F.regexp_extract_all(classes(value) if kinds is None else kinds, F.lit(RUN), F.lit(0))
    told = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[^Aa9u? \t\r\n]"), r).otherwise(F.concat(F.translate(F.left(r, F.lit(1)), "\t\r\n", "   "), F.length(r).cast("string")))), "")
    size = F.floor(F.log2(F.length(value))).cast("string")
    return F.when(F.size(runs) > MOST_RUNS, F.concat(F.lit("text"), size)).otherwise(told)


def entropy(value: Column, kinds: Column | None = None) -> Column:
    """Bits per character of the value's classes; 0 for an empty value."""
    kinds = classes(value) if kinds is None else kinds
    own = [F.length(kinds) - F.length(F.replace(kinds, F.lit(c), F.lit(""))) for c in ("A", "a", "9", "u", "?", " ")]

    def bits(n: Column, size: Column) -> Column:
        return F.when(n > 0, -(n / size) * F.log2(n / size)).otherwise(0.0)

    def added(counts: Column) -> Column:
        """Counts of the classes and, last, the length; what is in no class is the rest."""
        size, names = counts[len(own)], [counts[i] for i in range(len(own))]
        every = [*names, size - sum(names, F.lit(0))]
        return sum((bits(n, size) for n in every), F.lit(0.0))

    # The counts are a list of their own, so that each is worked out once.
    counted = F.get(F.transform(F.array(F.array(*own, F.length(kinds))), added), F.lit(0))
    return F.when(F.length(value) > 0, counted).otherwise(0.0)


def shape_counts(flat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sketch of each field's values: ``n``, ``chars`` and ``bits`` summed per shape.

    Sketches are added up by ``merge_counts``, so new days need not read old ones again.
    """
    by = [*(keys or []), "field_path"]
    # Classes are a column of their own, so that they are worked out once.
    rows = flat.where(F.col("value").isNotNull()).select(*by, "value", classes(F.col("value")).alias("kinds"))
    value, kinds = F.col("value"), F.col("kinds")
    rows = rows.select(*by, shape(value, kinds).alias("shape"), F.length("value").cast("long").alias("chars"), entropy(value, kinds).alias("bits"))
    return rows.groupBy(*by, "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("bits").alias("bits"))


def merge_counts(*sketches: DataFrame) -> DataFrame:
    first, *rest = sketches
    for s in rest:
        first = first.unionByName(s)
    by = [c for c in first.columns if c not in ("n", "chars", "bits")]
    return first.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "chars", "bits")))


def field_shapes(counts: DataFrame) -> DataFrame:
    """Per field: its values and shapes, the commonest shape and its share, mean length and entropy."""
    by = [c for c in counts.columns if c not in ("shape", "n", "chars", "bits")]
    best = F.max(F.struct("n", "shape"))
    rows = counts.groupBy(*by).agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_shapes"), best.alias("best"), F.sum("chars").alias("chars"), F.sum("bits").alias("bits"))
    return rows.select(
        *by, "n_values", "n_shapes", F.col("best.shape").alias("top_shape"), F.round(F.col("best.n") / F.col("n_values"), 4).alias("top_share"),
        F.round(F.col("chars") / F.col("n_values"), 2).alias("mean_chars"), F.round(F.col("bits") / F.col("n_values"), 2).alias("mean_bits"),
    )
