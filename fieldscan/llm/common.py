"""What the operators share: the shared folder, tables cut out of the lineage, batches of
texts, and numpy views of word sequences.

Text columns travel as Arrow batches; a task works on pieces of at most ``PIECE_BYTES``
of text at a time, so its memory does not follow the size of its partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 3 << 20
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="fieldscan-llm-"))
    return f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there and lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def utf8(column: Column | str) -> Column:
    """The text's bytes, empty for null."""
    return F.coalesce(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8"), F.lit(b""))


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds ``most`` bytes, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start, total = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, "right")))
            yield batch.slice(start, stop - start)
            total, start = int(ends[stop - 1]), stop


def merged(batches: Iterable[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """Batches put together up to about ``most`` bytes of text."""
    held, size = [], 0
    for piece in pieces(batches, text, most):
        n = piece.column(text).nbytes
        if held and size + n > 2 * most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Gives memory that this worker no longer uses back to the system: workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps what it keeps


def lengths_to_starts(lengths: np.ndarray) -> np.ndarray:
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return starts


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class Words:
    """The words of several texts, end to end, as codes into a list of distinct words."""

    def __init__(self, lists: list[list[bytes]]):
        codes: defaultdict[bytes, int] = defaultdict()
        codes.default_factory = codes.__len__
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.starts = lengths_to_starts(self.lengths)
        self.codes = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int64, self.starts[-1])
        self.distinct = list(codes)

    @classmethod
    def split(cls, texts: pa.Array) -> Words:
        """Of texts in UTF-8, parted at white space like ``bytes.split``; no list of all words is made."""
        lists = pc.ascii_split_whitespace(texts.view(pa.string()))
        coded = lists.values.dictionary_encode()
        self = cls.__new__(cls)
        self.distinct = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.starts = lists.offsets.to_numpy().astype(np.int64)
        if b"" in self.distinct:
            # Before white space at the start of a text, after that at its end.
            none = self.distinct.index(b"")
            del self.distinct[none]
            kept = self.codes != none
            self.starts = lengths_to_starts(kept)[self.starts]
            self.codes = self.codes[kept]
            self.codes -= self.codes > none
        self.lengths = np.diff(self.starts)
        return self

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of each distinct word."""
        return np.array([word_hash(w) for w in self.distinct], np.uint64)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive items."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of several slices, end to end."""
    offsets = lengths_to_starts(lengths)
    kind = np.int32 if max(offsets[-1], starts.max(initial=0)) < 2**31 else np.int64
    out = np.repeat((starts - offsets[:-1]).astype(kind), lengths)
    out += np.arange(offsets[-1], dtype=kind)
    return out


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return text.lower().split()


_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and everything beyond ASCII, with A-Z in lower case."""
    return text.translate(_ALNUM).split()


def packed(sorted_values: np.ndarray, base: int) -> bytes:
    """Ascending values from ``base`` on as gaps of two, four or eight bytes.

    In two bytes, 65535 means: go on by 65535 without a value.
    """
    gaps = np.diff(sorted_values, prepend=np.uint64(base)).astype(np.uint64)
    if not len(gaps):
        return b""
    steps = gaps // np.uint64(65535)
    if int(steps.sum()) <= len(gaps):
        out = np.full(len(gaps) + int(steps.sum()), 65535, np.uint16)
        out[np.cumsum(steps.astype(np.int64) + 1) - 1] = gaps % np.uint64(65535)
        return b"\x02" + out.astype("<u2").tobytes()
    kind = "<u4" if int(gaps.max()) < 2**32 else "<u8"
    return bytes([int(kind[2])]) + gaps.astype(kind).tobytes()


def unpacked(data: bytes, base: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(data, f"<u{data[0]}", offset=1)
    values = np.cumsum(gaps.astype(np.uint64)) + np.uint64(base)
    return values[gaps != 65535] if data[0] == 2 else values
