"""Near-duplicate texts by SimHash, compared exactly in tiles.

A text's fingerprint takes the majority of the bits of its shingle hashes. Texts of one
fingerprint are one class. Distinct fingerprints are put into cells by the population
counts of their four 16-bit lanes: two fingerprints differ in at least as many bits as
their lane counts differ by in total, so a cell meets only cells within the radius (129
of up to 83,521). A cell is cut into tiles of bounded size; each pair of tiles is one
numpy comparison (exclusive-or and bit counts) of all its rows. Of a pair of tiles only
sums of links and a spanning forest leave the task, however many links it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lengths_to_starts, merged, require, saved, shuffle_parts, utf8, words_of
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
LANES = 4
TILE_ROWS = 4_096
# Tiles of one cell that meet a tile in one group, and rows that a group is to hold.
SLOT_TILES = 16
GROUP_ROWS = 1_000_000
# Hashes turned into bits at a time, and pairs compared at a time.
HASHES = 1 << 17
PAIRS = 1 << 21


def shingle_hashes(text: bytes, width: int = SHINGLE) -> Iterator[int]:
    """The XXH64 of each shingle, repeats included; of a shorter text, of all its words."""
    words = words_of(text)
    if len(words) >= width:
        runs = map(b" ".join, zip(*(words[k:] for k in range(width))))
    else:
        runs = [b" ".join(words)] if words else []
    return (xxhash.xxh64_intdigest(run, SEED) for run in runs)


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if it is in over half of the hashes."""
    sizes = np.zeros(len(texts), np.int64)

    parts = [np.zeros(0, np.uint64)]
    for k, text in enumerate(texts):
        parts.append(np.fromiter(shingle_hashes(text, width), np.uint64))
        sizes[k] = len(parts[-1])
    hashes = np.concatenate(parts)
    filled = np.flatnonzero(sizes)
    starts = lengths_to_starts(sizes[filled])
    counts = np.zeros((len(filled), 64), np.int64)
    for a in range(0, len(hashes), HASHES):
        part = hashes[a : a + HASHES]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(starts, [a, a + len(part) - 1], "right") - 1
        counts[first : last + 1] += np.add.reduceat(bits, np.maximum(starts[first : last + 1] - a, 0), axis=0, dtype=np.int64)
    over = (2 * counts > sizes[filled][:, None]).astype(np.uint8)
    out = np.zeros(len(texts), np.uint64)
    out[filled] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged(batches, "content"):
            found = fingerprints(table.column("content").to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(found)], ["id", "fp"])

    return run


def _cell(fp: Column, radius: int) -> Column:
    """The population counts of the lanes as one number, in which a step to another count is a fixed summand."""
    lane = lambda k: F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))
    return sum(((lane(k) + radius) * (17 + 2 * radius) ** k for k in range(LANES)), F.lit(0)).cast("int")


def steps(radius: int) -> list[int]:
    """Of each two opposite steps to a cell within the radius, one; and no step."""
    moves = [m for m in product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, m)) <= radius]
    return sorted({max(n, -n) for n in (sum(x * (17 + 2 * radius) ** k for k, x in enumerate(m)) for m in moves)})


def join_labels(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (a node that each node is linked with, at last the smallest) after the links x-y."""
    while len(x):
        a, b = labels[x], labels[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def compare(host: np.ndarray, host_copies: np.ndarray, guest: np.ndarray, guest_copies: np.ndarray, radius: int, same: bool):
    """Links of two tiles: copies linked with each row of either, and a spanning forest as labels.

    Rows are numbered host first, then guest; with ``same`` the guest is the host itself.
    """
    n = len(host)
    links = np.zeros(n + (0 if same else len(guest)), np.int64)
    labels = np.arange(len(links))
    copies = host_copies if same else np.concatenate([host_copies, guest_copies])
    step = max(1, PAIRS // max(1, len(guest)))
    for a in range(0, n, step):
        near = np.bitwise_count(host[a : a + step, None] ^ guest[None, :]) <= radius
        if same:
            near &= np.arange(a, min(a + step, n))[:, None] < np.arange(len(guest))[None, :]
        x, y = np.nonzero(near)
        if not len(x):
            continue
        x, y = x + a, y + (0 if same else n)
        links += np.bincount(x, copies[y], len(links)).astype(np.int64)
        links += np.bincount(y, copies[x], len(links)).astype(np.int64)
        labels = join_labels(labels, x, y)
    return links, labels


def _tile_links(radius: int):
    """Of one group of host tiles and the tiles that they meet: rows ``x, y, links``.

    ``y`` is a link of the spanning forest; ``links`` the copies linked with ``x``.
    """

    def run(hosts: pa.Table, guests: pa.Table) -> pa.Table:
        met: dict[tuple[int, int], list[int]] = {}
        for at, key in enumerate(zip(guests.column("to_cell").to_pylist(), guests.column("to_sub").to_pylist())):
            met.setdefault(key, []).append(at)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def values(tiles: pa.ChunkedArray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
            held = pa.concat_arrays(tiles.take(pa.array(at)).chunks).flatten()
            return held.field("fp").to_numpy().view(np.uint64), held.field("copies").to_numpy()

        keys = zip(hosts.column("cell").to_pylist(), hosts.column("sub").to_pylist())
        for at, key in enumerate(keys):
            if key not in met:
                continue
            host, host_copies = values(hosts.column("held"), [at])
            own = [g for g in met[key] if guests.column("own")[g].as_py()]
            others = [g for g in met[key] if not guests.column("own")[g].as_py()]
            for part, same in ((own, True), (others, False)):
                if not part:
                    continue
                guest, guest_copies = values(guests.column("met"), part)
                links, labels = compare(host, host_copies, guest, guest_copies, radius, same)
                nodes = (host if same else np.concatenate([host, guest])).view(np.int64)
                some = np.flatnonzero(links)
                found.append((nodes[some], nodes[labels[some]], links[some]))
        x, y, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"x": x, "y": y, "links": n})

    return run


def _links(distinct: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """``x, y, links`` of all pairs of tiles, for a table ``fp, copies`` of distinct fingerprints."""
    spark = distinct.sparkSession
    rows = distinct.withColumn("cell", _cell(F.col("fp"), radius))
    # At most 17 ** 4 cells, whatever the input: a bounded table that every task may hold.
    cells = saved(rows.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("subs"), F.count("*").alias("n")), "cells")
    most, total = cells.agg(F.max("subs"), F.sum("n")).first()
    if not total:
        return spark.createDataFrame([], "x long, y long, links long")
    tiles = (
        rows.join(F.broadcast(cells.drop("n")), "cell")
        .withColumn("sub", F.pmod(F.xxhash64("fp"), "subs").cast("int"))
        .groupBy("cell", "sub").agg(F.collect_list(F.struct("fp", "copies")).alias("held"))
    )
    tiles = saved(tiles, "tiles")
    moves = steps(radius)
    groups = max(shuffle_parts(spark), -(-total * len(moves) // GROUP_ROWS))
    group = lambda *key: F.pmod(F.xxhash64(*key), F.lit(groups))
    hosts = tiles.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit((most - 1) // SLOT_TILES))))
    hosts = hosts.select(group("cell", "sub", "slot").alias("g"), "cell", "sub", "held")
    guests = (
        tiles.withColumn("move", F.explode(F.array(*map(F.lit, moves))))
        .withColumn("to_cell", F.col("cell") - F.col("move"))
        .join(F.broadcast(cells.select(F.col("cell").alias("to_cell"), F.col("subs").alias("to_subs"))), "to_cell")
        .withColumn("to_sub", F.explode(F.sequence(F.lit(0), F.col("to_subs") - 1)))
        .filter((F.col("move") != 0) | (F.col("to_sub") <= F.col("sub")))
        .withColumn("slot", F.floor(F.col("sub") / SLOT_TILES).cast("int"))
    )
    own = (F.col("move") == 0) & (F.col("to_sub") == F.col("sub"))
    guests = guests.select(group("to_cell", "to_sub", "slot").alias("g"), "to_cell", "to_sub", own.alias("own"), F.col("held").alias("met"))
    guests = guests.withColumnRenamed("g", "guest_g")
    return hosts.groupBy("g").cogroup(guests.groupBy("guest_g")).applyInArrow(_tile_links(radius), "x long, y long, links long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """``id, fingerprint, component_id, n_links`` per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; shingles are ``width`` words
    joined by a space, repeats included, or all words of a shorter text. The fingerprint
    (16 hex digits) of a null text or one without words is zero, linked like any other.
    Rows link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is
    the smallest id reachable by links, the row's own included, and null if no row of the
    component has an id. ``n_links`` counts the other rows that a row links with. Rows that
    repeat an id are rows of their own. Tables may be empty; other columns are not read.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("content"))
    rows = saved(rows.mapInArrow(_fingerprint_rows(width), "id long, fp long"), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "distinct")
    links = saved(_links(distinct.select("fp", "copies"), radius, tile_rows), "links")
    labels = components(links, "x", "y").toDF("fp", "component")
    sums = links.groupBy(F.col("x").alias("fp")).agg(F.sum("links").alias("links"))
    found = distinct.join(labels, "fp", "left").join(sums, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    found = saved(found, "labelled")
    firsts = saved(found.groupBy("component").agg(F.min("first").alias("component_id")), "firsts")
    # The join by component has the hot keys (one label for thousands of fingerprints), the one by
    # fingerprint too (thousands of copies): both are left joins of tables, which Spark can split.
    found = saved(
        found.join(firsts.hint("merge"), "component", "left")
        .select("fp", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "components",
    )
    return rows.join(found.hint("merge"), "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )
