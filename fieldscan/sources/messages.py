"""Messages in: topics, wire headers, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "msg_id string, topic string, key string, value string, event_time timestamp"


def read_topic_stream(
    spark: SparkSession, servers: str, topics: str, starting: str = "latest", per_trigger: int | None = None, **options
) -> DataFrame:
    """Kafka topics as a message stream. Needs the Kafka connector on the classpath;
    the checkpoint of the query keeps the offsets, so delivery is at least once."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", starting)
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.options(**options).load().select(
        F.concat_ws("/", "topic", "partition", "offset").alias("msg_id"),
        "topic",
        F.col("key").cast("string").alias("key"),
        "value",
        F.col("timestamp").alias("event_time"),
    )


def read_file_stream(
    spark: SparkSession, path: str, schema: str = MESSAGE_SCHEMA, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Message files landing in a folder, through the same code path as topics."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def schema_id(value: Column) -> Column:
    """Schema id of a wire-format value: 0x00, four bytes big-endian, body; else null."""
    framed = (F.octet_length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(framed, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long").cast("int"))


def wire_body(value: Column) -> Column:
    return F.when(schema_id(value).isNotNull(), F.substring(value, 6, 2**31 - 1)).otherwise(value)


def drop_tombstones(messages: DataFrame) -> DataFrame:
    """Messages without a value, or with a blank one, have nothing to classify."""
    text = F.col("value").cast("string")
    return messages.where(F.col("value").isNotNull() & (F.length(F.trim(text)) > 0))


def avro_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.AvroDataToCatalyst")
    except Exception:
        return False
    return True


def decode(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Add ``payload`` (VARIANT object, null if unreadable) and ``schema_id``.

    A message is a record, so only text that begins with a brace (after blanks) is read;
    a list or a bare value counts as unreadable.

    A wire-format value is read with the schema registered under its id when
    ``schemas`` is given and the Avro functions are on the classpath; every other
    value, and every wire value that fails, is tried as JSON. ``schemas`` is the
    registry's table (ids and texts), not data: one branch per id of it.
    """
    binary = dict(messages.dtypes)["value"] == "binary"
    value = F.col("value")
    text = F.when(value.cast("string").rlike(r"^[ \t\r\n]*\{"), value.cast("string"))
    payload = F.try_parse_json(text)
    df = messages.withColumn("schema_id", schema_id(value) if binary else F.lit(None).cast("int"))
    if binary and schemas is not None and avro_available(messages.sparkSession):
        from pyspark.sql.avro.functions import from_avro

        known = schemas.where(F.upper(F.coalesce("schema_type", F.lit("AVRO"))) == "AVRO")
        for row in known.select("id", "schema").distinct().toLocalIterator():
            record = from_avro(F.substring(value, 6, 2**31 - 1), row["schema"], {"mode": "PERMISSIVE"})
            payload = F.when(F.col("schema_id") == row["id"], F.coalesce(F.to_variant_object(record), payload)).otherwise(payload)
    return df.withColumn("payload", payload)


def split_malformed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, malformed): unreadable messages are set aside, never fatal."""
    return decoded.where(F.col("payload").isNotNull()), decoded.where(F.col("payload").isNull())


def record_json(columns: list[str]) -> Column:
    """A row's columns as one JSON object; null columns are left out."""
    return F.to_json(F.struct(*columns))


def sample_first(messages: DataFrame, n: int) -> DataFrame:
    """A bounded scan: the first ``n`` messages by arrival time."""
    return messages.orderBy("event_time", "msg_id").limit(n)
