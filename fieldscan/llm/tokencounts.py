"""Token counts with a cache of digests.

Contents are joined by their digest, and by the digest of the tokenizer's file, to the
counts already stored. Only distinct misses are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, require, utf8

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
COUNT_LIMIT = 4096
MEMO_WORDS = 400_000


def file_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def word_wise(pieces_: list[str]) -> bool:
    """No piece joins two words: the mark of a word's start stands first, or alone in runs."""
    return all("▁" not in p[1:] or not p.strip("▁") for p in pieces_)


def sentencepiece_counter(path: str) -> Callable[[list[bytes]], np.ndarray]:
    """Counts ids as the library's ``encode`` gives them.

    No piece of such a model spans two words, so a text of words between single blanks
    has as many ids as its words have; each distinct word is encoded once per task. Any
    other text (runs of blanks, blanks at its ends, the mark itself) is encoded whole.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    split = word_wise([model.id_to_piece(i) for i in range(model.get_piece_size())])
    # The rule above also needs a normaliser that leaves texts as they are, but for the blanks.
    probe = "AÄßﬁ½​\t\n\x01z"
    split = split and model.decode(model.encode(probe)) == probe
    whole = re.compile("  |^ | $|▁")
    memo: dict[str, int] = {}

    def count(texts: list[bytes]) -> np.ndarray:
        texts = [t.decode("utf-8", "replace") for t in texts]
        by_word = [split and bool(t) and not whole.search(t) for t in texts]
        words = [t.split(" ") if w else () for t, w in zip(texts, by_word)]
        new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in memo]
        memo.update(zip(new, map(len, model.encode(new, num_threads=1))))
        of = memo.__getitem__
        out = np.array([sum(map(of, ws)) if w else len(model.encode(t)) for t, ws, w in zip(texts, words, by_word)], np.int64)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return out

    return count


def json_counter(path: str) -> Callable[[list[bytes]], np.ndarray]:
    """Counts ids as the tokenizers library's ``encode`` gives them, without special tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def count(texts: list[bytes]) -> np.ndarray:
        found = model.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return np.array([len(x.ids) for x in found], np.int64)

    return count


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version; empty if nothing was stored yet.

    Two runs may have stored the same digest; it comes once.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = COUNT_LIMIT,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row, from the cache at ``cache``.

    ``tokenizer`` is a ``.model`` file (sentencepiece) or a ``.json`` file (tokenizers); begin,
    end and special tokens are not added. The content is normalised so far as null is the
    empty text; nothing else may change without changing counts. Rows that repeat a text
    are counted once and each get the count; a row without id keeps its null; an empty
    table gives an empty result and leaves the cache as it is. Only ``id_col`` and
    ``text_col`` are read, so other columns cannot clash. Misses travel once per digest,
    copies having been put together before the shuffle.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    make = sentencepiece_counter if tokenizer.endswith(".model") else json_counter
    text = utf8(text_col)
    digest = F.unhex(F.sha2(text, 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make(tokenizer)
        for piece in pieces(batches, "content"):
            n = counter(piece.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [piece.column("digest"), pa.array([version] * piece.num_rows), pa.array(n, pa.int64())],
                ["digest", "tokenizer", "n_tokens"],
            )

    contents = docs.select(digest.alias("digest"), text.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    misses = contents.join(read_cache(spark, cache, version), "digest", "left_anti").select("digest", "content")
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)

    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    counted = rows.join(read_cache(spark, cache, version), "digest")
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
