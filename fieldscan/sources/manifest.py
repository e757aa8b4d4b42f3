"""Versioned tables in plain folders: data files, and a manifest per version that lists them.

A writer puts its files where no manifest names them yet and then publishes the next
manifest by a rename that never overwrites. Of two writers from one version the second one
fails with ``Conflict`` and loses nothing; readers follow the newest manifest, so they see
all of a commit or none of it. Files are reached through Spark's file systems only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published the version in between."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def text_of(spark: SparkSession, path: str) -> str:
    fs, target = _files(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with what is in it."""
    fs, target = _files(spark, path)
    fs.delete(target, True)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet: whole or not at all."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, source = _files(spark, draft)
    fs.mkdirs(source.getParent())
    out = fs.create(source, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), keep)
    except Exception as e:
        fs.delete(source, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(path) from None
        raise


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, target = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in listed(spark, f"{root}/manifests") if n.endswith(".json"))


def entries(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, list[dict]]:
    """(version, what it lists); the newest one if none is named, and (0, []) where nothing is."""
    if version is None:
        version = max(versions(spark, root), default=0)
    return (version, json.loads(text_of(spark, f"{root}/manifests/{version:010d}.json"))) if version else (0, [])


def commit(spark: SparkSession, root: str, base: int, parts: list[dict]) -> int:
    """Publish the version after ``base``; ``Conflict`` if there is one already."""
    publish(spark, f"{root}/manifests/{base + 1:010d}.json", json.dumps(parts))
    return base + 1


def put(df: DataFrame, root: str, by: dict[str, str]) -> list[dict]:
    """Write rows to a folder of their own, split by columns (``name: column``), and list its parts."""
    spark, folder = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    split = df.withColumns({f"_{name}": df[column].cast("string") for name, column in by.items()})
    split.write.partitionBy(*(f"_{name}" for name in by)).parquet(folder)
    found: list[dict] = [{"path": folder}]
    for name in by:
        below = []
        for entry in found:
            fs, target = _files(spark, entry["path"])
            for status in fs.listStatus(target):
                part = status.getPath().getName()
                if part.startswith(f"_{name}="):
                    value = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part[len(name) + 2 :])
                    below.append({**entry, name: value, "path": f"{entry['path']}/{part}"})
        found = below
    return found


def read(spark: SparkSession, schema: str, parts: list[dict]) -> DataFrame:
    """The rows of listed parts; none if nothing is listed."""
    return spark.read.schema(schema).parquet(*(e["path"] for e in parts)) if parts else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the manifests but the last ``keep`` and the folders that none of those names; how many folders went."""
    known = versions(spark, root)
    held = {e["path"] for v in known[-keep:] for e in entries(spark, root, v)[1]}
    for v in known[:-keep]:
        fs, target = _files(spark, f"{root}/manifests/{v:010d}.json")
        fs.delete(target, False)
    fs, data = _files(spark, f"{root}/data")
    gone = 0
    for status in fs.listStatus(data) if fs.exists(data) else []:
        folder = f"{root}/data/{status.getPath().getName()}"
        if not any(p.startswith(folder + "/") for p in held):
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
