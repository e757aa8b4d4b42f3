"""Self-join of texts by the Jaccard similarity of their word n-grams.

The global order of n-grams (by hash, which is even) is cut into fragments. Every
fragment is counted on its own and what it knows about a text or a pair is summed over
the fragments:

1. In each fragment, n-grams that only one text has are counted per text. A text with
   more of them than a linked text could have leaves the join; no n-gram travels with
   its text yet, only sorted hashes whose gaps take about two bytes.
2. Texts left are reduced to one per distinct set. Each fragment returns how many of
   them have an n-gram; that gives each text its prefix of rare n-grams.
3. Pairs that share a prefix n-gram are candidates. Each fragment counts the overlap of
   its part of the two sets; the parts are summed and the sum decides.

Texts of one class are not paired with each other. A first round tries one partner per
text, the one it shares most prefix n-grams with; after it, only pairs of different
components are left to try, all of them, so nothing is lost. Prefix n-grams that would still
make many pairs (thousands of texts near the threshold) make none: the texts that
they hang together are dealt to blocks by size, and each two blocks are one task that counts
overlaps as a matrix, fragment by fragment, and puts out a spanning forest of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, gather, lengths_to_starts, merged, packed, require, rolling, saved, shuffle_parts, unpacked, utf8, words_of
from .components import components
from .simhash import join_labels

NGRAM = 5
# A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
FRAGMENT_NGRAMS = 3_000_000
BLOCK_NGRAMS = 1_000_000
PAIR_FRAGMENTS = 4
# Long words of a set's bitmap.
BITMAP = 64
# An n-gram that would make more pairs than this is counted in tiles; n-grams and sets of a
# block of a tile, and n-grams that are counted at a time.
LIST_PAIRS = 4_096
TILE_NGRAMS = 500_000
TILE_SETS = 1_024
TILE_COLUMNS = 2_048


def ngram_sets(texts: list[bytes], width: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, end to end, and the size of each set.

    A text of fewer words has one n-gram, all its words; one without words has none.
    """
    view = Words([words_of(t) for t in texts])
    if not len(view.codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes = view.hashes()[view.codes]
    runs = rolling(hashes, width)
    sets = []
    for a, b in zip(view.starts[:-1], view.starts[1:]):
        n = int(b - a)
        sets.append(np.unique(runs[a : b - width + 1]) if n >= width else rolling(hashes[a:b], n) if n else runs[:0])
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def least_overlap(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The smallest overlap that a set of ``n`` can have with a linked one."""
    return -(-percent * n // 100)


class Fragments:
    """Hashes cut to their upper ``bits``, and the ranges of them that make the fragments."""

    def __init__(self, ngrams: int, least: int):
        self.bits = max(16, min(64, int(ngrams).bit_length() + 6))
        self.count = max(least, -(-ngrams // FRAGMENT_NGRAMS))
        self.width = -(-(1 << self.bits) // self.count)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def bounds(self, ascending: np.ndarray) -> np.ndarray:
        """Where each fragment starts in ascending cut hashes; one more at the end."""
        inner = [min(k * self.width, 2**64 - 1) for k in range(1, self.count)]
        return np.r_[0, np.searchsorted(ascending, np.array(inner, np.uint64)), len(ascending)]


FIRST = "fragment int, block long, singles binary, texts binary, several binary, ids array<long>, keys array<long>, sizes binary, digests binary"
COUNTED = "block long, ids array<long>, keys array<long>, sizes binary, digests binary, alone binary"


def _sketch(fragments: Fragments, width: int):
    """Of each piece of texts, a row per fragment with its sorted n-grams, and one with its texts.

    An n-gram that several texts of the piece have is sent once, without texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        names = [c.split()[0] for c in FIRST.split(", ")]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for table in merged(batches, "content"):
            for start in range(0, table.num_rows, 65_000):
                part = table.slice(start, 65_000)
                block = (partition << 24) + number
                number += 1
                hashes, sizes = ngram_sets(part.column("content").to_pylist(), width)
                ends = lengths_to_starts(sizes)
                digests = b"".join(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest() for a, b in zip(ends[:-1], ends[1:]))
                rows = [(fragments.count + block % fragments.count, block, None, None, None, part.column("id").to_pylist(), part.column("key").to_pylist(), sizes.astype("<u4").tobytes(), digests)]
                keys = fragments.cut(hashes)
                order = np.argsort(keys)
                keys, texts = keys[order], np.repeat(np.arange(len(sizes)), sizes)[order].astype("<u2")
                new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
                single = new & np.r_[new[1:], True][: len(keys)]
                one, of, many = keys[single], texts[single], keys[new & ~single]
                one_at, many_at = fragments.bounds(one), fragments.bounds(many)
                for f in range(fragments.count):
                    p, q = slice(one_at[f], one_at[f + 1]), slice(many_at[f], many_at[f + 1])
                    if len(one[p]) or len(many[q]):
                        base = f * fragments.width
                        rows.append((f, block, packed(one[p], base), of[p].tobytes(), packed(many[q], base), None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _alone(fragments: Fragments):
    """In one fragment: for each piece, how many n-grams of each text no other text has."""

    def run(table: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in COUNTED.split(", ")]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        fragment = table.column("fragment")[0].as_py()
        blocks = table.column("block").to_pylist()
        if fragment >= fragments.count:
            rows = list(zip(blocks, *(table.column(c).to_pylist() for c in names[1:-1]), [None] * len(blocks)))
        else:
            base = fragment * fragments.width
            singles = [unpacked(x, base) for x in table.column("singles").to_pylist()]
            texts = [np.frombuffer(x, "<u2") for x in table.column("texts").to_pylist()]
            several = [unpacked(x, base) for x in table.column("several").to_pylist()]
            values = np.concatenate(singles + several)
            order = np.argsort(values)
            ranked = values[order]
            new = np.r_[True, ranked[1:] != ranked[:-1]]
            alone = np.zeros(len(values), bool)
            alone[order] = new & np.r_[new[1:], True]
            rows, at = [], 0
            for block, own, of in zip(blocks, singles, texts):
                mine = of[alone[at : at + len(own)]]
                at += len(own)
                kind = 2 if len(mine) < 65536 else 4
                counts = bytes([kind]) + np.bincount(mine).astype(f"<u{kind}").tobytes() if len(mine) else None
                rows.append((block, None, None, None, None, counts))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _sum_alone(table: pa.Table) -> pa.Table:
    """Of one piece: its texts, with the counts of all fragments summed."""
    own = next(r for r in table.select(["ids", "keys", "sizes", "digests"]).to_pylist() if r["sizes"] is not None)
    ids, keys, sizes, digests = own.values()
    sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
    total = np.zeros(len(sizes), np.int64)
    for data in table.column("alone").to_pylist():
        if data:
            counts = np.frombuffer(data, f"<u{data[0]}", offset=1)
            total[: len(counts)] += counts
    nodes = np.frombuffer(digests, "<i8")
    return pa.table({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "node": nodes, "n": sizes, "alone": total})


def text_key(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(utf8(text_col))


def classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, key, node, n, alone`` per row: the text's hash, the set's digest, its size, and its
    n-grams in no other row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("content"), text_key(text_col).alias("key"))
    size = rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    fragments = Fragments(size // 6 + 1, shuffle_parts(docs.sparkSession))
    counted = rows.mapInArrow(_sketch(fragments, width), FIRST).groupBy("fragment").applyInArrow(_alone(fragments), COUNTED)
    return counted.groupBy("block").applyInArrow(_sum_alone, "id long, key long, node long, n long, alone long")


def _block_counts(fragments: Fragments, width: int):
    """The distinct n-grams of a block of texts and how many of its texts have each."""

    def run(table: pa.Table) -> pa.Table:
        _, hashes, _ = _sets(table, width)
        distinct, counts = np.unique(hashes, return_counts=True)
        at = fragments.bounds(distinct)
        block = table.column("block")[0].as_py()
        rows = [(f, block, distinct[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for f, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], ["fragment", "block", "ngrams", "counts"])

    return run


def _sets(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, n-grams and sizes of a block, a row per node and in the order of the nodes.

    The text under an id may have become another one (repeated ids); only texts whose set
    is the node's are kept, once.
    """
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    texts = table.column("content").to_pylist()
    hashes, sizes = ngram_sets([texts[i] for i in order], width)
    ends, kept, last = lengths_to_starts(sizes), [], None
    for i, node in enumerate(nodes[order]):
        if node != last and node == np.frombuffer(hashlib.blake2b(hashes[ends[i] : ends[i + 1]].tobytes(), digest_size=8).digest(), "<i8")[0]:
            kept.append(i)
            last = node
    kept = np.array(kept, np.int64)
    return nodes[order][kept], hashes[gather(ends[kept], sizes[kept])], sizes[kept]


def _sum_counts(table: pa.Table) -> pa.Table:
    """In one fragment: for each block, in how many texts of all blocks each of its n-grams is."""
    ngrams = [np.frombuffer(x, "<u8") for x in table.column("ngrams").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
    distinct, at = np.unique(np.concatenate(ngrams), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype("<u4")[at]
    ends = lengths_to_starts(np.array([len(x) for x in ngrams]))
    parts = [total[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.table({"fragment": table.column("fragment"), "block": table.column("block"), "totals": pa.array(parts, pa.binary())})


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit per n-gram, at its hash. A bit that another set does not have is an n-gram it does not have."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(hashes % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8")


def _prefixes(width: int, percent: int):
    """For each text of a block: its rare prefix n-grams that other texts have too, their
    positions, and all its n-grams that other texts have, cut into fragments for pairs."""

    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        names = ["node", "n", "prefix", "parts", "bits"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("ngram", pa.int64()), ("place", pa.int32())])), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        nodes, hashes, sizes = _sets(texts, width)
        frequency = np.zeros(0, np.int64)
        if totals.num_rows:
            ranked = sorted(zip(totals.column("fragment").to_pylist(), totals.column("totals").to_pylist()))
            frequency = np.concatenate([np.frombuffer(t, "<u4") for _, t in ranked]).astype(np.int64)
        distinct, at = np.unique(hashes, return_inverse=True)
        of = frequency[at] if len(distinct) else frequency
        ends = lengths_to_starts(sizes)
        prefixes, parts, bits = [], [], []
        for a, b in zip(ends[:-1], ends[1:]):
            own, often = hashes[a:b], of[a:b]
            most = len(own) - int(least_overlap(len(own), percent)) + 1
            rare = np.lexsort((own, often))[:most]
            places = np.flatnonzero(often[rare] > 1)
            prefixes.append([{"ngram": int(h), "place": int(p)} for h, p in zip(own[rare[places]].view(np.int64), places)])
            bits.append(bitmap(own))
            shared = own[often > 1]
            cuts = np.searchsorted(shared, np.arange(1, PAIR_FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // PAIR_FRAGMENTS))
            parts.append([p.view(np.int64) for p in np.split(shared, cuts)])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((nodes, sizes, prefixes, parts, bits), types)], names)

    return run


def _fits(percent: int):
    """Length and position bounds of two rows that share the n-gram at ``place`` (from 0)."""
    least = F.least("n", "other_n")
    length = 100 * least >= percent * F.greatest("n", "other_n")
    possible = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    return length & ((100 + percent) * possible >= percent * (F.col("n") + F.col("other_n")))


def _bitmaps_allow(percent: int):
    """At most so many n-grams in common as each set has less those whose bit the other lacks."""
    missing = lambda a, b: sum((F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.bitwise_not(f"{b}{i}"))) for i in range(BITMAP)), F.lit(0))
    possible = F.least(F.col("n") - missing("b", "o"), F.col("other_n") - missing("o", "b"))
    return (100 + percent) * possible >= percent * (F.col("n") + F.col("other_n"))


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that are linked: overlaps counted per fragment, then summed per pair."""
    parts = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.posexplode("parts").alias("fragment", f"part_{side}"))
    # The same plan at every size: pairs and parts meet by shuffle.
    left = pairs.hint("merge").join(parts("x"), "x")
    both = left.hint("merge").join(parts("y"), ["y", "fragment"])
    partial = both.select("x", "y", "n_x", "n_y", F.size(F.array_intersect("part_x", "part_y")).alias("overlap"))
    total = partial.groupBy("x", "y", "n_x", "n_y").agg(F.sum("overlap").alias("overlap"))
    return total.filter(100 * F.col("overlap") >= percent * (F.col("n_x") + F.col("n_y") - F.col("overlap"))).select("x", "y")


def _first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """For each text at most one pair: with the text that leads most of its prefix n-grams."""
    leaders = members.groupBy("ngram").agg(F.min(F.struct("node", "n", "place")).alias("lead"))
    found = members.join(leaders, "ngram").select(
        "node", "n", "place", F.col("lead.node").alias("other"), F.col("lead.n").alias("other_n"), F.col("lead.place").alias("other_place")
    )
    counted = found.filter((F.col("node") != F.col("other")) & _fits(percent)).groupBy("node", "other").count()
    best = counted.groupBy("node").agg(F.max(F.struct("count", "other")).alias("best"))
    return best.select(F.least("node", "best.other").alias("x"), F.greatest("node", "best.other").alias("y")).distinct()


def _hot_ngrams(members: DataFrame, groups: DataFrame, list_pairs: int) -> DataFrame:
    """``ngram``: those whose list would make more than ``list_pairs`` pairs of different components."""
    rows = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("ngram", "component").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("ngram").agg(F.sum("n").alias("total"), F.max("n").alias("main"))
    return lists.filter(F.col("total") * (F.col("total") - F.col("main")) > list_pairs).select("ngram")


def _tiled_links(members: DataFrame, hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y``: links between texts that hot n-grams hang together, as a forest per tile.

    Sizes of linked texts differ by at most a class (a step of just over 100 / ``percent``), so a block
    of one class meets blocks of its own and of the next class only.
    """
    own = saved(members.join(hot, "ngram").select("ngram", "node"), "hot")
    leads = own.groupBy("ngram").agg(F.min("node").alias("lead"))
    clusters = components(own.join(leads.hint("merge"), "ngram"), "node", "lead").toDF("node", "cluster")
    held = sets.join(clusters.hint("merge"), "node").select(
        "node", "n", "cluster", "parts", F.floor(F.log(F.col("n")) / F.log(F.lit(100.1 / percent))).cast("int").alias("size_class")
    )
    held = saved(held, "held")
    kind = ["cluster", "size_class"]
    blocks = held.groupBy(*kind).agg(F.greatest(F.ceil(F.sum("n") / TILE_NGRAMS), F.ceil(F.count("*") / TILE_SETS)).cast("int").alias("blocks"))
    held = saved(held.join(blocks.hint("merge"), kind).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "blocks")
    # Every block is the left one of tiles with itself, later blocks of its class, and all of the next class.
    to = blocks.select("cluster", F.explode(F.array(F.col("size_class"), F.col("size_class") - 1)).alias("size_class"), F.col("size_class").alias("to_class"), F.col("blocks").alias("to_blocks"))
    tiles = blocks.join(to, kind).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("to_blocks") - 1)))
    tiles = tiles.filter((F.col("to_class") > F.col("size_class")) | (F.col("to_block") >= F.col("block")))
    tiles = saved(tiles.select(*kind, "block", "to_class", "to_block", F.monotonically_increasing_id().alias("tile")), "tiles")
    side = held.select(*kind, "block", "node", "n", "parts")
    left = side.join(tiles.select(*kind, "block", "tile").hint("merge"), [*kind, "block"]).select("tile", "node", "n", "parts")
    right = side.join(
        tiles.select("cluster", F.col("to_class").alias("size_class"), F.col("to_block").alias("block"), F.col("tile").alias("to_tile")).hint("merge"), [*kind, "block"]
    ).select("to_tile", F.col("node").alias("to_node"), F.col("n").alias("to_n"), F.col("parts").alias("to_parts"))
    found = left.groupBy("tile").cogroup(right.groupBy("to_tile")).applyInArrow(_tile_links(percent), "x long, y long")
    return saved(found, "links")


def _incidence(hashes: np.ndarray, sizes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Which set has which of the ascending n-grams, as ones and zeros."""
    out = np.zeros((len(sizes), len(columns)), np.float32)
    at = np.searchsorted(columns, hashes)
    at[at == len(columns)] = 0
    known = columns[at] == hashes if len(columns) else np.zeros(len(hashes), bool)
    out[np.repeat(np.arange(len(sizes)), sizes)[known], at[known]] = 1
    return out


def _fragment_sets(parts: list, fragment: int) -> tuple[np.ndarray, np.ndarray]:
    own = [np.array(p[fragment], np.int64) for p in parts]
    return np.concatenate([np.zeros(0, np.int64), *own]), np.array([len(p) for p in own], np.int64)


def overlaps(left: list, right: list) -> np.ndarray:
    """How many n-grams each two sets share, counted per fragment and summed."""
    total = np.zeros((len(left), len(right)), np.float32)
    for fragment in range(len(left[0]) if left else 0):
        (a, sizes), (b, other) = _fragment_sets(left, fragment), _fragment_sets(right, fragment)
        both = np.intersect1d(a, b)
        for k in range(0, len(both), TILE_COLUMNS):
            columns = both[k : k + TILE_COLUMNS]
            total += _incidence(a, sizes, columns) @ _incidence(b, other, columns).T
    return total.astype(np.int64)


def _tile_links(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not left.num_rows or not right.num_rows:
            return pa.table({"x": none, "y": none})
        a, b = left.column("node").to_numpy(), right.column("to_node").to_numpy()
        total = left.column("n").to_numpy()[:, None] + right.column("to_n").to_numpy()[None, :]
        shared = overlaps(left.column("parts").to_pylist(), right.column("to_parts").to_pylist())
        x, y = np.nonzero((100 * shared >= percent * (total - shared)) & (a[:, None] != b[None, :]))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = join_labels(np.arange(len(nodes)), at[x], at[len(a) + y])
        some = np.flatnonzero(labels != np.arange(len(nodes)))
        return pa.table({"x": nodes[labels[some]], "y": nodes[some]})

    return run


def _rest_pairs(members: DataFrame, sets: DataFrame, groups: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components that were not tried yet.

    In each n-gram's list the largest component is only met by the others, so a list of
    near copies that are linked already makes no pair. Pairs whose bitmaps rule a link
    out do not leave the join.
    """
    rows = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("ngram", "component").count()
    main = sizes.groupBy("ngram").agg(F.count("*").alias("several"), F.max(F.struct("count", "component")).alias("main"))
    main = main.filter("several > 1").select("ngram", F.col("main.component").alias("main"))
    rows = rows.join(main, "ngram").join(sets.select("node", "bits"), "node")
    rows = saved(rows.select("*", *[F.col("bits")[i].alias(f"b{i}") for i in range(BITMAP)]).drop("bits"), "members")
    few = rows.filter("component <> main")
    other = rows.select(
        "ngram", *[F.col(c).alias(f"other_{c}") for c in ("n", "place", "component")], F.col("node").alias("other"),
        *[F.col(f"b{i}").alias(f"o{i}") for i in range(BITMAP)],
    )
    meets = (F.col("component") != F.col("other_component")) & ((F.col("other_component") == F.col("main")) | (F.col("node") < F.col("other")))
    pairs = few.join(other, "ngram").filter(meets & _fits(percent) & _bitmaps_allow(percent))
    pairs = pairs.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct()
    return pairs.join(tried, ["x", "y"], "left_anti")


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NGRAM, percent: int = PERCENT, list_pairs: int = LIST_PAIRS
) -> DataFrame:
    """``id, n_shingles, component_id`` per row of ``docs``.

    Two rows link when 100 * intersection >= percent * union of their n-gram sets (n-grams of
    ``width`` words, A-Z in lower case); ``component_id`` is the smallest id reachable by
    links, the row's own included. Rows with equal sets are one class and are not paired.
    A null text or one without words has no n-gram and links with nothing. A row without
    id gets the component of its class, or null if that has no id at all. Rows that
    repeat an id are rows of their own. Tables may be empty; other columns are not read.

    N-grams are compared by their 64-bit hash. ``docs`` should be read from a table: the
    first step numbers its texts as they are read.
    """
    rows = saved(_labelled(docs, id_col, text_col, width, percent, list_pairs), "labelled")
    firsts = saved(rows.groupBy("component").agg(F.min("id").alias("component_id")), "firsts")
    # Sets without n-grams share one digest but are linked with nothing.
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    # Both sides are tables: Spark can split the rows of a large component.
    return rows.join(firsts.hint("merge"), "component", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, unchanged, but of each component only the one of the smallest id.

    Of rows that repeat that id, one stays; rows without id stay only in a component that
    has no id, one for all. Rows without n-grams all stay. See ``similar`` for links.
    """
    rows = _labelled(docs, id_col, text_col, width, percent, LIST_PAIRS).filter("n > 0")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("first.id", "first.key")
    first = first.toDF("first_id", "first_key").distinct()
    has_words = F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    packed_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), has_words.alias("has_words"))
    kept = packed_rows.filter("has_words").join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    return kept.dropDuplicates(["id", "key"]).select("row.*").union(packed_rows.filter("not has_words").select("row.*"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, list_pairs: int) -> DataFrame:
    """``id, key, n, component`` per row; the component is named by the smallest of its sets' digests."""
    require(docs, id_col, text_col)
    rows = saved(classes(docs, id_col, text_col, width), "classes")
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    open_rows = rows.filter((F.col("n") > 0) & (F.col("alone") < most))
    # A set is fetched by one of its rows, with an id if there is one.
    row = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("row")
    nodes = open_rows.groupBy("node").agg(row, F.first("n").alias("n")).select("node", "n", "row.id", "row.key")
    nodes = saved(nodes, "nodes")
    total, rest = nodes.agg(F.sum("n"), F.count("*")).first()
    if rest < 2:
        return rows.select("id", "key", "n", F.col("node").alias("component"))
    groups = components(_links(docs, id_col, text_col, nodes, total, width, percent, list_pairs), "x", "y")
    found = rows.join(groups, "node", "left")
    return found.select("id", "key", "n", F.coalesce("component", "node").alias("component"))


def _links(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, total: int, width: int, percent: int, list_pairs: int) -> DataFrame:
    spark = docs.sparkSession
    blocks = max(shuffle_parts(spark), -(-total // BLOCK_NGRAMS))
    fragments = Fragments(total, shuffle_parts(spark))
    fragments.bits, fragments.width = 64, -(-(1 << 64) // fragments.count)
    found = nodes.select(F.col("id").alias("of_id"), F.col("key").alias("of_key"), "node").hint("merge")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("content"), text_key(text_col).alias("key"))
    texts = texts.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
    texts = saved(texts.select("node", "content", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block")), "texts")
    counts = texts.groupBy("block").applyInArrow(_block_counts(fragments, width), "fragment int, block long, ngrams binary, counts binary")
    totals = counts.groupBy("fragment").applyInArrow(_sum_counts, "fragment int, block long, totals binary")
    sets = (
        texts.groupBy("block").cogroup(totals.groupBy("block"))
        .applyInArrow(_prefixes(width, percent), "node long, n long, prefix array<struct<ngram:long,place:int>>, parts array<array<long>>, bits array<long>")
    )
    sets = saved(sets.filter(F.size("prefix") > 0), "sets")
    members = saved(sets.select("node", "n", F.explode("prefix").alias("p")).select("node", "n", "p.ngram", "p.place"), "prefixes")
    tried = saved(_first_pairs(members, percent), "pairs")
    links = saved(_overlaps(tried, sets, percent), "links")
    groups = saved(components(links, "x", "y"), "groups")
    hot = saved(_hot_ngrams(members, groups, list_pairs), "hot")
    if not hot.isEmpty():
        # Hot n-grams first: what they link is not paired any more.
        links = links.union(_tiled_links(members, hot, sets, percent))
        members = members.join(hot.hint("merge"), "ngram", "left_anti")
        groups = saved(components(links, "x", "y"), "groups")
    rest = saved(_rest_pairs(members, sets, groups, tried, percent), "pairs")
    return saved(links.union(_overlaps(rest, sets, percent)), "links")
