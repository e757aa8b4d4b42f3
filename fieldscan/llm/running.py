"""Running folds over the rows of a key, however many rows a key has.

Rows are dealt by ranges of key and order, so a hot key lies in several partitions. Each
partition folds its rows in one pass over Arrow batches; what a key's earlier partitions
hold is one row per partition and is added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_parts

# Folds that a slice's value can be taken out of again.
_FOLDS = {"sum": (np.add, np.subtract), "xor": (np.bitwise_xor, np.bitwise_xor)}


def _relative(key: str, values: list[str], fold: str):
    """The fold from the key's first row in the partition; ``tail`` marks the partition's last row."""
    add, take = _FOLDS[fold]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, held = TaskContext.get().partitionId(), None, np.zeros(len(values), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            new = np.r_[True, keys[1:] != keys[:-1]]
            starts = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            goes_on = last is not None and keys[0] == last
            folds = []
            for k, name in enumerate(values):
                run_ = add.accumulate(batch.column(name).to_numpy())
                before = np.r_[np.int64(0), run_[starts[1:] - 1]]
                own = take(run_, before[of])
                if goes_on:
                    own[of == 0] = add(own[of == 0], carry[k])
                folds.append(own)
            last, carry = keys[-1], np.array([f[-1] for f in folds], np.int64)
            if held is not None:
                yield held
            names = [*batch.schema.names, *(f"run_{v}" for v in values), "part", "tail"]
            columns = [*batch.columns, *map(pa.array, folds), pa.array(np.full(len(keys), part, np.int32)), pa.array(np.zeros(len(keys), bool))]
            held = pa.RecordBatch.from_arrays(columns, names)
        if held is not None:
            yield held.set_column(held.num_columns - 1, "tail", pa.array(np.arange(held.num_rows) == held.num_rows - 1))

    return run


def running(df: DataFrame, key: str, order: list[str], values: list[str], fold: str = "sum") -> DataFrame:
    """``df`` with ``run_<value>`` for each of ``values``: its fold over the key's rows up to this one.

    Key and values are longs without nulls; ``order`` puts the rows of a key in order, nulls
    first. A sum must stay within a long; ``xor`` is free of that. The table comes back
    sorted by key and order within each of its files.
    """
    spark = df.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    kinds += "".join(f", run_{v} long" for v in values) + ", part int, tail boolean"
    dealt = df.repartitionByRange(shuffle_parts(spark), key, *order).sortWithinPartitions(key, *order)
    rows = saved(dealt.mapInArrow(_relative(key, values, fold), kinds), "running")
    # One row per partition: what the next partition has to add if it starts with the same key.
    tails = sorted(tuple(r) for r in rows.filter("tail").select("part", key, *(f"run_{v}" for v in values)).collect())
    add, offsets, held = _FOLDS[fold][0], [], {}
    for at, (part, own, *folds) in enumerate(tails):
        folds = np.array(folds, np.int64)
        held = {own: add(held[own], folds) if own in held else folds}
        if at + 1 < len(tails):
            offsets.append((tails[at + 1][0], own, *map(int, held[own])))
    schema = f"part int, `{key}` long" + "".join(f", add_{v} long" for v in values)
    found = rows.drop("tail").join(F.broadcast(spark.createDataFrame(offsets, schema)), ["part", key], "left")
    whole = {f"run_{v}": _added(f"run_{v}", f"add_{v}", fold) for v in values}
    return found.withColumns(whole).select(*df.columns, *whole)


def _added(value: str, offset: str, fold: str):
    rest = F.coalesce(F.col(offset), F.lit(0).cast("long"))
    return F.col(value).bitwiseXOR(rest) if fold == "xor" else F.col(value) + rest
