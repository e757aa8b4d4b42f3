"""Nested records to (field_path, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscan.functions.tree import leaves_sql

# Levels that generators take apart; what lies deeper is folded in the row.
NATIVE_LEVELS = 6
FIELD = "struct<field_path:string,value:string>"


def flatten_variant(
    records: DataFrame,
    ids: list[str],
    payload: str = "payload",
    keep_nulls: bool = False,
    levels: int = NATIVE_LEVELS,
) -> DataFrame:
    """Leaves of a VARIANT record as rows ``ids + (field_path, value)``, at any depth.

    Each level is one generator over the records' own bytes: no shuffle, works on
    streams. Only ``ids`` travel with a leaf, never the record. Null leaves are
    dropped (``keep_nulls`` keeps them as ``""``) and empty containers vanish. A
    container below ``levels`` levels is taken apart by a fold over its text, which is
    worked out for such a leaf only. Everything is built-in expressions.
    """
    children = records.sparkSession.tvf.variant_explode_outer(F.col("node").outer()).alias("c")
    rows = records.select(*ids, F.lit("").alias("field_path"), F.col(payload).alias("node"))
    path = """CASE WHEN c.key IS NOT NULL THEN if(r.field_path = '', c.key, concat(r.field_path, '.', c.key))
        WHEN c.value IS NOT NULL THEN concat(r.field_path, '[', c.pos, ']') ELSE r.field_path END AS field_path"""
    keep = [f"r.`{c}`" for c in ids]
    for _ in range(levels):
        rows = rows.alias("r").lateralJoin(children).selectExpr(*keep, path, "coalesce(c.value, r.node) AS node")
    leaves = rows.select(*ids, "field_path", "node", F.try_variant_get("node", "$", "string").alias("value"))
    kind = F.when(F.substring("value", 1, 1).isin("{", "["), F.schema_of_variant("node"))
    empty = kind.isin("OBJECT<>", "ARRAY<VOID>") & F.col("value").isin("{}", "[]")
    container = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
    value = F.coalesce("value", F.when(F.col("node").isNotNull(), F.lit(""))) if keep_nulls else F.col("value")
    # A generator, not a filter: a filter would be pushed down and render every value twice.
    here = F.when(value.isNull() | empty, F.array().cast(f"array<{FIELD}>")).otherwise(
        F.array(F.struct(F.col("field_path").alias("field_path"), value.alias("value")))
    )
    leaves = leaves.withColumn("deep", F.when(container & ~empty, F.expr(leaves_sql("value"))))
    missing = F.lit("") if keep_nulls else F.lit(None).cast("string")
    below = F.filter(
        F.transform(
            "deep",
            lambda d: F.struct(
                F.when((F.col("field_path") == "") & d["under"].startswith("."), F.substring(d["under"], 2, F.length(d["under"])))
                .otherwise(F.concat("field_path", d["under"])).alias("field_path"),
                F.coalesce(F.try_variant_get(F.try_parse_json(d["json"]), "$", "string"), missing).alias("value"),
            ),
        ),
        lambda f: f["value"].isNotNull(),
    )
    return leaves.select(*ids, F.explode(F.coalesce(below, here)).alias("f")).select(*ids, "f.field_path", "f.value")


def schema_leaves(schema: T.StructType) -> list[str]:
    """Dotted paths of every field of a Spark schema, containers included."""

    def walk(dtype: T.DataType, path: str) -> list[str]:
        if isinstance(dtype, T.StructType):
            found = []
            for f in dtype.fields:
                child = f"{path}.{f.name}" if path else f.name
                found += [child, *walk(f.dataType, child)]
            return found
        if isinstance(dtype, T.ArrayType):
            return walk(dtype.elementType, path)
        if isinstance(dtype, T.MapType):
            return walk(dtype.valueType, path)
        return []

    return walk(schema, "")


def _leaf_array(value: Column, dtype: T.DataType, path: Column) -> Column:
    def under(name: Column) -> Column:
        return F.when(path != "", F.concat(path, F.lit("."), name)).otherwise(name)

    if isinstance(dtype, T.StructType):
        parts = [_leaf_array(value[f.name], f.dataType, under(F.lit(f.name))) for f in dtype.fields]
        return F.concat(*parts) if parts else F.array().cast(f"array<{FIELD}>")
    if isinstance(dtype, T.ArrayType):
        items = F.transform(
            value,
            lambda x, i: _leaf_array(x, dtype.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
        )
        return F.coalesce(F.flatten(items), F.array().cast(f"array<{FIELD}>"))
    if isinstance(dtype, T.MapType):
        items = F.transform(
            F.map_entries(value),
            lambda kv: _leaf_array(kv["value"], dtype.valueType, under(kv["key"].cast("string"))),
        )
        return F.coalesce(F.flatten(items), F.array().cast(f"array<{FIELD}>"))
    return F.array(F.struct(path.alias("field_path"), value.cast("string").alias("value")))


def flatten_columns(table: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """Leaves of a table whose schema is known: one generator, no JSON in between."""
    columns = columns or [c for c in table.columns if c not in ids]
    parts = [_leaf_array(F.col(c), table.schema[c].dataType, F.lit(c)) for c in columns]
    return (
        table.select(*ids, F.explode(F.concat(*parts)).alias("leaf"))
        .select(*ids, "leaf.field_path", "leaf.value")
        .where(F.col("value").isNotNull())
    )
