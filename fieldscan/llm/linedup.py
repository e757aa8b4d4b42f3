"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where a text is cut, so the
same lines are cut the same way wherever they stand, and lines added before them do not
shift the cuts. A line as long as a paragraph is a chunk of its own. Chunks that occur
more than once are grouped by their hash and their bytes; one occurrence stays.

Chunks miss what is repeated in part of a chunk only. Therefore all runs of lines that
hold ``long_words`` words are looked at, too: the shortest such runs from each line on and
up to each line, which together cover every longer run, are joined by their digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, require, saved

# One cut after four lines on average; the rolling hash sees two lines.
DIVISOR = 4
LONG_WORDS = 50
_MASK = (1 << 64) - 1


def cut_lines(lines: list[bytes], divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """The chunks of a text, as [first, end) ranges of its lines."""
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    is_long = [len(x) > 2 * long_words - 2 and len(x.split()) >= long_words for x in lines]
    out, first, before = [], 0, 0
    for i, h in enumerate(hashes):
        rolled = (before * 0x9E3779B97F4A7C15 + h) & _MASK
        rolled ^= rolled >> 29
        before = h
        last = i + 1 == len(lines)
        if last or is_long[i] or is_long[i + 1] or rolled % divisor == 0:
            out.append((first, i + 1))
            first = i + 1
    return out


def counted_chunks(text: bytes, divisor: int, long_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``first, end, hash, bytes`` of the chunks that dedup looks at: several lines, not
    all of them blank, or one line of ``long_words`` words."""
    lines = text.split(b"\n")
    for first, end in cut_lines(lines, divisor, long_words):
        if end - first > 1 or len(lines[first].split()) >= long_words:
            chunk = b"\n".join(lines[first:end])
            if chunk.strip():
                yield first, end, xxhash.xxh64_intdigest(chunk) - (1 << 63), chunk


def windows(lines: list[bytes], long_words: int) -> list[tuple[int, int, bytes]]:
    """``first, end, digest`` of the shortest runs of several lines that hold ``long_words`` words,
    from each line with words on and up to each such line; in ascending order.

    A longer run that begins and ends with words is covered by those inside it and by its
    lines of ``long_words`` words. A line is in at most about twice ``long_words`` of them.
    """
    words = [len(x.split()) for x in lines]
    if sum(words) < long_words:
        return []
    full = [i for i, n in enumerate(words) if n]
    spans, total, k = set(), 0, 0
    for i in full:
        while k < len(full) and total < long_words:
            total += words[full[k]]
            k += 1
        if total < long_words:
            break
        spans.add((i, full[k - 1] + 1))
        total -= words[i]
    total, k = 0, 0
    for i in full:
        total += words[i]
        while total - words[full[k]] >= long_words:
            total -= words[full[k]]
            k += 1
        if total >= long_words:
            spans.add((full[k], i + 1))
    marks = b"".join([blake2b(x, digest_size=16).digest() for x in lines])
    return [(a, b, blake2b(marks[16 * a : 16 * b], digest_size=16).digest()) for a, b in sorted(spans) if b - a > 1]


def _window_rows(long_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "content"):
            ids, digests = [], []
            for id_, text in zip(piece.column("id").to_pylist(), piece.column("content").to_pylist()):
                found = [d for *_, d in windows(text.split(b"\n"), long_words)]
                ids += [id_] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["id", "digest"])

    return run


def _repeated_lines(lines: list[bytes], others: list[bytes] | None, own: list[bytes] | None, long_words: int) -> bytearray:
    """Marks the lines of windows that an earlier text has, or this text at an earlier place that ends before."""
    marked = bytearray(len(lines))
    if others or own:
        others, own, ends = set(others or ()), set(own or ()), {}
        for first, end, digest in windows(lines, long_words):
            if digest in others or digest in own and ends.setdefault(digest, end) <= first:
                marked[first:end] = b"\1" * (end - first)
    return marked


def _chunk_rows(divisor: int, long_words: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "content"):
            ids, hashes, chunks = [], [], []
            for id_, text in zip(piece.column("id").to_pylist(), piece.column("content").to_pylist()):
                for _, _, h, chunk in counted_chunks(text, divisor, long_words):
                    ids.append(id_)
                    hashes.append(h)
                    chunks.append(chunk)
            columns = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())] + [pa.array(chunks, pa.binary())] * with_bytes
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "chunk"][: len(columns)])

    return run


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str, divisor: int, long_words: int) -> DataFrame:
    """``hash, keeper``: chunks that occur more than once, and the smallest id that has them.

    Occurrences are grouped by their bytes, put together in the tasks that read them.
    Two chunks of one hash but of other bytes are not told apart later on, so both stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_col, "UTF-8").alias("content")).dropna()
    chunks = rows.mapInArrow(_chunk_rows(divisor, long_words, True), "id long, hash long, chunk binary")
    same = chunks.groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("keeper"))
    by_hash = same.groupBy("hash").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min("keeper").alias("keeper"))
    return by_hash.filter("kinds = 1 AND n > 1").select("hash", "keeper")


def _uncovered(marked: bytearray, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges of marked lines that are not gone yet."""
    for a, b in gone:
        marked[a:b] = bytes(b - a)
    out, at = [], marked.find(1)
    while at >= 0:
        end = marked.find(0, at)
        end = len(marked) if end < 0 else end
        out.append((at, end))
        at = marked.find(1, end)
    return out


def _removed(divisor: int, long_words: int, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "content"):
            texts, n_lines, removed = [], [], []
            columns = (piece.column(c).to_pylist() for c in ("content", "others", "own", "other_windows", "own_windows"))
            for text, others, own, other_windows, own_windows in zip(*columns):
                if text is None:
                    texts.append(None)
                    n_lines.append(0)
                    removed.append([])
                    continue
                lines, gone = text.split(b"\n"), []
                marked = _repeated_lines(lines, other_windows, own_windows, long_words)
                if others or own:
                    others, own = set(others or ()), set(own or ())
                    for first, end, h, _ in counted_chunks(text, divisor, long_words):
                        if h in others:
                            gone.append((first, end))
                        elif h in own:
                            own.discard(h)
                            others.add(h)
                gone = sorted(gone + _uncovered(marked, gone))
                n_lines.append(len(lines))
                removed.append([{"first": a, "end": b} for a, b in gone])
                for a, b in reversed(gone):
                    del lines[a:b]
                texts.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), *(pa.array(v, t) for v, t in zip((texts, n_lines, removed), types))], names
            )

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS
) -> DataFrame:
    """``docs`` with ``text_col`` freed of repeated chunks, and ``n_lines`` and ``removed`` besides.

    ``removed`` holds the [first, end) line ranges taken out; lines count from 0. Of equal
    chunks the first one in the row of the smallest id stays. A null text stays null and
    has no lines, an empty text has one, empty, line; a row without id is left as it is;
    rows that repeat an id all keep what that id keeps. Columns of ``docs`` that are
    called like the new ones are replaced by them; all others are kept as they are.

    Every run of lines goes, too, that begins and ends with words, has ``long_words`` of
    them, and occurs in a text of a smaller id, or earlier in the same text without
    overlap. Runs are compared by 128-bit digests.
    """
    require(docs, id_col, text_col)
    repeated = repeated_chunks(docs, id_col, text_col, divisor, long_words)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_col, "UTF-8").alias("content")).dropna()
    chunks = rows.mapInArrow(_chunk_rows(divisor, long_words, False), "id long, hash long").distinct()
    found = chunks.join(repeated, "hash").select("id", "keeper", "hash", F.lit(None).cast("binary").alias("digest"))
    runs = rows.mapInArrow(_window_rows(long_words), "id long, digest binary")
    same = runs.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("keeper")).filter("n > 1").select("digest", "keeper")
    found = found.union(runs.join(same, "digest").select("id", "keeper", F.lit(None).cast("long"), "digest").distinct())
    is_own = F.col("id") == F.col("keeper")
    lists = [
        F.collect_list(F.when(is_own == mine, F.col(c))).alias(name)
        for name, mine, c in (("others", False, "hash"), ("own", True, "hash"), ("other_windows", False, "digest"), ("own_windows", True, "digest"))
    ]
    # An id has at most as many hashes as its texts have chunks, and two windows per line.
    found = saved(found.groupBy("id").agg(*lists), "chunks")

    kept = [c for c in docs.columns if c not in (text_col, "n_lines", "removed")]
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.encode(text_col, "UTF-8").alias("content"), F.col(id_col).cast("long").alias("id")
    )
    joined = left.join(found, "id", "left").select("row", "content", "others", "own", "other_windows", "own_windows")
    ranges = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    run = _removed(divisor, long_words, ["row", "content", "n_lines", "removed"], [pa.binary(), pa.int64(), ranges])
    row_type = joined.schema["row"].dataType.simpleString()
    cleaned = joined.mapInArrow(run, f"row {row_type}, content binary, n_lines long, removed array<struct<first:int,end:int>>")
    columns = [F.col("content").cast("string").alias(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c in kept or c == text_col]
    return cleaned.select(*columns, "n_lines", "removed")
