"""Bloom filters over 64-bit hashes, made and merged by Spark, and exact joins behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits a key, probes of a key, and the most bits that a filter may have (32 MB).
KEY_BITS = 12
PROBES = 4
MOST_BITS = 1 << 28


def bloom_bits(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """The filter's words over a column of 64-bit hashes (nulls left out).

    Bits are combined by an aggregate that Spark merges task by task. The size follows the
    keys up to ``most_bits``; beyond that more strangers pass, and none is lost.
    """
    n = keys.where(F.col(column).isNotNull()).count()
    bits = min(most_bits, 1 << max(10, (KEY_BITS * max(1, n) - 1).bit_length()))
    places = _places(F.col(column), bits)
    probes = keys.where(F.col(column).isNotNull()).select(F.explode(places).alias("place"))
    words = probes.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")
    )
    found, out = words.toArrow(), np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _places(hashed: Column, bits: int) -> Column:
    """A key's probes: the upper half of its hash, moved on by the lower half."""
    low, high = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)
    return F.transform(F.array(*map(F.lit, range(PROBES))), lambda k: (high + k * low).bitwiseAND(F.lit(bits - 1)))


def maybe_in(spark, words: np.ndarray) -> Callable[[Column], Column]:
    """A test for arrays of hashes: of each, whether it may be one of the filter's keys."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<boolean>")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for lists in batches:
            sizes = lists.map(len, na_action="ignore").fillna(0).to_numpy(np.int64)
            given = [x for x in lists if x is not None and len(x)]
            flat = np.concatenate(given).astype(np.int64).view(np.uint64) if given else np.zeros(0, np.uint64)
            low, high, fits = flat & np.uint64(0xFFFFFFFF), flat >> np.uint64(32), np.ones(len(flat), bool)
            for k in range(PROBES):
                at = (high + np.uint64(k) * low) & np.uint64(len(own) * 64 - 1)
                fits &= (own[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield pd.Series(np.split(fits, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return test


def value_digest(value: Column) -> Column:
    """What values are compared by: the SHA-256 of the trimmed lower-case text, so that a
    reference set need not hold the values themselves."""
    return F.sha2(F.lower(F.trim(value)), 256)


def reference_hits(flat: DataFrame, references: DataFrame, ids: list[str], most_bits: int = MOST_BITS) -> DataFrame:
    """Fields whose value is in a reference set: ``ids + (field_path, set_name)``.

    ``references(set_name, digest)`` holds digests of ``value_digest``. Values that the Bloom
    filter rules out are not shuffled; those that pass are joined by digest, so no hit is
    false. A value may be in several sets; nulls are in none.
    """
    known = references.where(F.col("digest").isNotNull()).select("set_name", "digest").distinct()
    passes = maybe_in(flat.sparkSession, bloom_bits(known.select(F.xxhash64("digest").alias("key")), "key", most_bits))
    rows = flat.select(*ids, "field_path", value_digest(F.col("value")).alias("digest"))
    # The digest of a null is null; the filter is asked in lists of one.
    rows = rows.withColumn("passes", passes(F.when(F.col("digest").isNotNull(), F.array(F.xxhash64("digest")))))
    return rows.where(F.get("passes", F.lit(0))).drop("passes").join(known, "digest").select(*ids, "field_path", "set_name")
