"""Writers that a replay does not double."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """Write one micro-batch under its own id; a replayed batch replaces itself."""
    target = f"{path}/batch={batch_id}"
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(target)


def write_topics(rows: DataFrame, servers: str, **options) -> None:
    """Rows (topic, key, value) to Kafka; needs the Kafka connector."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).options(**options).save()


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new snapshot folder; earlier ones stay, so readers and retries are safe."""
    target = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}")
