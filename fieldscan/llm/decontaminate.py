"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words. The shingles of a window are
ordered by how rare they are in the corpus; a text that contains the window contains its
rarest shingle, so that one is the necessary prefix. A text's shingles are joined with
these prefixes, length and position bound where the window could lie, and the words
there are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, alnum_words, gather, merged, require, rolling, utf8

WINDOW = 10
SHINGLE = 3
WINDOWS_PER_PASS = 100_000


class Windows:
    """Distinct windows of some items: their words, the shingle that stands for each, and their items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = alnum_words(text)
            wide = min(window, len(words))
            for at in range(len(words) - wide + 1) if words else ():
                owners.setdefault(tuple(words[at : at + wide]), set()).add(item)
        self.words = sorted(owners)
        self.owners = [sorted(owners[w], key=str) for w in self.words]

    def shingles(self) -> list[np.ndarray]:
        """The shingle hashes of each window, in order."""
        out = []
        for window in self.words:
            view = Words([list(window)])
            out.append(rolling(view.hashes()[view.codes], min(SHINGLE, len(window))))
        return out


def _shingle_hits(view: Words, hashes: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Positions in the end-to-end words where a wanted shingle of ``width`` words starts."""
    at = np.flatnonzero(np.isin(rolling(hashes, width), wanted))
    if not len(at):
        return at
    doc = np.searchsorted(view.starts, at, "right") - 1
    return at[at + width <= view.starts[doc + 1]]


def shingle_counts(docs: DataFrame, text_col: str, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each wanted shingle (by width) occurs in all texts. Partial counts are made in tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {w: np.zeros(len(h), np.int64) for w, h in wanted.items()}
        for table in merged(batches, "content"):
            view = Words([alnum_words(t) for t in table.column("content").to_pylist()])
            hashes = view.hashes()[view.codes] if len(view.codes) else np.zeros(0, np.uint64)
            for width, sought in wanted.items():
                at = _shingle_hits(view, hashes, sought, width)
                found = rolling(hashes, width)[at]
                totals[width] += np.bincount(np.searchsorted(sought, found), minlength=len(sought))
        for width, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["width", "at", "n"]
            )

    rows = docs.select(utf8(text_col).alias("content")).mapInArrow(count, "width int, at long, n long").groupBy("width", "at").agg(F.sum("n").alias("n"))
    return {(r["width"], int(wanted[r["width"]][r["at"]])): r["n"] for r in rows.collect()}


class Index:
    """The prefix shingle of every window, sorted, with its place in the window."""

    def __init__(self, windows: Windows, counts: dict[tuple[int, int], int]):
        rows = []
        for number, hashes in enumerate(windows.shingles()):
            width = min(SHINGLE, len(windows.words[number]))
            place = min(range(len(hashes)), key=lambda i: (counts.get((width, int(hashes[i])), 0), int(hashes[i]), i))
            rows.append((width, int(hashes[place]), place, number))
        self.by_width = {}
        for width in sorted({r[0] for r in rows}):
            own = sorted(r for r in rows if r[0] == width)
            self.by_width[width] = tuple(np.array([r[i] for r in own], np.uint64 if i == 1 else np.int64) for i in (1, 2, 3))
        self.words, self.owners = windows.words, windows.owners

    def hits(self, texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, set]]:
        """For each text, which of its words are hit, and the items whose windows occur."""
        view = Words(texts)
        marks = np.zeros(len(view.codes) + 1, np.int64)
        items: dict[int, set] = {}
        if len(view.codes):
            hashes = view.hashes()[view.codes]
            for width, (prefix, place, number) in self.by_width.items():
                at = _shingle_hits(view, hashes, prefix, width)
                found = rolling(hashes, width)[at]
                low, high = np.searchsorted(prefix, found, "left"), np.searchsorted(prefix, found, "right")
                pick = gather(low, high - low)
                at = np.repeat(at, high - low)
                doc = np.searchsorted(view.starts, at, "right") - 1
                start = at - place[pick]
                size = np.array([len(self.words[n]) for n in number[pick]], np.int64)
                # Length and position: the whole window must lie in the text.
                fits = (start >= view.starts[doc]) & (start + size <= view.starts[doc + 1])
                for s, w, d, n in zip(start[fits], size[fits], doc[fits], number[pick][fits]):
                    inside = s - view.starts[d]
                    if tuple(texts[d][inside : inside + w]) == self.words[n]:
                        marks[s] += 1
                        marks[s + w] -= 1
                        items.setdefault(int(d), set()).update(self.owners[n])
        hit = np.cumsum(marks[:-1]) > 0
        for d in range(len(texts)):
            yield hit[view.starts[d] : view.starts[d + 1]], items.get(d, set())


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    per_pass: int = WINDOWS_PER_PASS,
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` as the struct ``row``, and what was found in each row's text.

    ``n_words``, ``hits`` (array of [first, end) word ranges hit), ``n_hit`` and ``items`` (sorted
    as strings). A null text has no words; a null or wordless item has no window; items of
    fewer than ``window`` words are one window; items without id are left out. Repeated rows
    and items, empty tables and clashing column names change nothing.

    The items of one pass are broadcast: at most about ``per_pass`` windows. A larger
    benchmark takes several passes over the texts, each adding to the row's findings.
    """
    require(docs, text_col)
    require(benchmark, item_id, item_text)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])
    out = docs.select(
        kept.alias("row"), utf8(text_col).alias("content"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:long,end:long>>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    for items in _passes(benchmark.filter(F.col(item_id).isNotNull()), item_id, item_text, per_pass):
        out = _one_pass(out, docs, text_col, items, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return out.select("row", "n_words", "hits", n_hit.alias("n_hit"), F.array_sort("items").alias("items"))


def _passes(benchmark: DataFrame, item_id: str, item_text: str, per_pass: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in groups of about ``8 * per_pass`` bytes; a word with its blank rarely has fewer than eight.

    Groups are dealt by hash, so each is fetched alone and nothing else is held. At least
    one group comes, empty if there is no item, since texts are counted in any case.
    """
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), utf8(item_text).alias("content")).distinct()
    total = rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    groups = max(1, -(-total // (8 * per_pass)))
    for group in range(groups):
        yield [(r["item"], bytes(r["content"])) for r in rows.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).collect()]


def _one_pass(rows: DataFrame, docs: DataFrame, text_col: str, items: list, window: int) -> DataFrame:
    windows = Windows(items, window)
    wanted: dict[int, set] = {}
    for words, hashes in zip(windows.words, windows.shingles()):
        wanted.setdefault(min(SHINGLE, len(words)), set()).update(int(h) for h in hashes)
    sought = {w: np.array(sorted(h), np.uint64) for w, h in wanted.items()}
    index = docs.sparkSession.sparkContext.broadcast(Index(windows, shingle_counts(docs, text_col, sought)))
    schema = rows.schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for table in merged(batches, "content"):
            texts = [alnum_words(t) for t in table.column("content").to_pylist()]
            ranges, found = [], []
            before = zip(table.column("hits").to_pylist(), table.column("items").to_pylist())
            for (hit, names), (old, had) in zip(known.hits(texts), before):
                for r in old:
                    hit[r["first"] : r["end"]] = True
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                ranges.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                found.append(sorted(names | set(had)))
            new = {"n_words": [len(t) for t in texts], "hits": ranges, "items": found}
            for name, values in new.items():
                at = table.schema.get_field_index(name)
                table = table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))
            yield from table.to_batches()

    return rows.mapInArrow(search, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` per row; see ``find_items``."""
    require(docs, id_col)
    found = find_items(docs, benchmark, text_col, keep=[id_col], **options)
    return found.select(
        F.col("row").getField(id_col).alias(id_col), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, in which no window of an item occurs."""
    return find_items(docs, benchmark, text_col, **options).filter("n_hit = 0").select("row.*")
