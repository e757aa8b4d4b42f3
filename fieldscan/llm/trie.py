"""The prefix trie of conversations, with count-min screening of prefix digests.

A turn is reduced to a 128-bit digest and its length, and a prefix to the exclusive-or of
its turns' digests, each mixed with its place: 128 bits, worked out by running folds that
split long conversations. A count-min sketch of all prefixes is made in tasks. Counts stop
at two, so it is one bit a cell, and its size is bounded. Where the estimate is one, the
prefix is proved to have one member and its node is written from the row itself; only
prefixes that may be shared are shuffled and grouped exactly.

No step walks the tree. A node is represented by its smallest member, and a conversation
represents all nodes of its path from some depth on. So what a subtree adds up to is a sum
over a node's members of what each represents, less what the representative itself holds
above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, require, saved, shuffle_parts, unpacked
from .running import running

SKETCH_ROWS = 3
# Cells of a sketch row follow the prefixes up to this many (a bit each).
MOST_CELLS = 1 << 27
LEAST_CELLS = 1 << 9
# Parents of more than a thousandth of all children: fewer than a thousand, whatever the input.
HOT_SHARE = 1_000
SHARED_FIRST = 5
BLOCK = 100

NODE = ["k1", "k2", "depth"]
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def numbered(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv, place, digest, points``: the turns of each conversation, numbered from 1.

    They are ordered by turn, null first; turns of one number by digest. Null roles and
    texts are empty. Rows without a conversation take no part; repeated rows are turns of
    their own. ``points`` counts the text's code points.
    """
    require(conversations, conv_col, turn_col, role_col, text_col)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.length(text).cast("long").alias("points"), F.lit(1).cast("long").alias("place"), F.monotonically_increasing_id().alias("nth"),
    )
    found = running(rows, "conv", ["turn", "digest", "nth"], ["place"])
    return saved(found.select("conv", F.col("run_place").alias("place"), "digest", "points"), "turns")


def lengths(turns: DataFrame) -> DataFrame:
    """``conv, n``: the turns of each conversation."""
    return turns.groupBy("conv").agg(F.max("place").alias("n"))


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its block: crc32 of its id, modulo 6."""
    return F.crc32(conv.cast("string").cast("binary")) % (SHARED_FIRST + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the rebuilt conversations.

    Conversation c has the first h turns of conversation c - c % 100 (all if that has
    fewer, none if it is absent), then its own after its first h; h as in ``shared_turns``.
    """
    opening = F.sort_array(F.collect_list(F.struct("place", "digest", "points")))
    firsts = turns.filter((F.col("conv") % BLOCK == 0) & (F.col("place") <= SHARED_FIRST)).groupBy("conv").agg(opening.alias("opening"))
    convs = lengths(turns).withColumn("h", shared_turns(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    convs = convs.join(firsts.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.withColumn("b", F.least("h", F.when(F.col("opening").isNull(), 0).otherwise(F.size("opening"))).cast("long"))
    convs = saved(convs.withColumn("n", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    first = convs.filter("b > 0").select("conv", "n", F.explode(F.slice("opening", F.lit(1), F.col("b").cast("int"))).alias("t"))
    own = turns.filter(F.col("place") > shared_turns(F.col("conv"))).join(convs.select("conv", "n", "h", "b").hint("merge"), "conv")
    rows = first.select("conv", "n", "t.place", "t.digest", "t.points").union(
        own.select("conv", "n", F.col("place") - F.col("h") + F.col("b"), "digest", "points")
    )
    return rows.drop("n"), convs.select("conv", "n")


def cells(k1: np.ndarray, k2: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch."""
    a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    return [(a + np.uint64(i) * b) & np.uint64(width - 1) for i in range(SKETCH_ROWS)]


def piece_cells(width: int) -> int:
    """Cells of a piece of a sketch row, of which there are 16 to 1,024."""
    return width // max(16, min(1024, width >> 17))


def _partial(width: int):
    """Of each batch, for each piece of the sketch: its cells, and those met more than once."""
    size = piece_cells(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, found in enumerate(cells(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), width)):
                met, counts = np.unique(found, return_counts=True)
                cuts = np.r_[0, np.flatnonzero(np.diff(met // np.uint64(size))) + 1, len(met)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if b > a:
                        piece = int(met[a]) // size
                        base, again = piece * size, counts[a:b] > 1
                        rows.append((i, piece, packed(met[a:b], base), packed(met[a:b][again], base)))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "piece", "once", "again"])

    return run


def _several(width: int):
    """Of one piece of the sketch: a bit per cell whose count is two or more."""
    size = piece_cells(width)

    def run(table: pa.Table) -> pa.Table:
        row, piece = table.column("row")[0].as_py(), table.column("piece")[0].as_py()
        base, counts = piece * size, np.zeros(size, np.uint8)
        for once, again in zip(table.column("once").to_pylist(), table.column("again").to_pylist()):
            for data in (once, again):
                at = (unpacked(data, base) - np.uint64(base)).astype(np.int64)
                counts[at] = np.minimum(counts[at] + 1, 2)
        bits = [np.packbits(counts > 1).tobytes()]
        return pa.table({"row": pa.array([row], pa.int32()), "piece": pa.array([piece], pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def sketch(keys: DataFrame, n: int, most_cells: int = MOST_CELLS) -> np.ndarray:
    """For each row of a count-min sketch of ``keys`` (k1, k2), a bit per cell: counted twice or more.

    At most ``SKETCH_ROWS * most_cells`` bits (48 MB) whatever ``n`` is; beyond that, fewer
    prefixes are proved to be single and more of them are grouped exactly.
    """
    width = max(LEAST_CELLS, min(most_cells, 1 << (4 * max(1, n) - 1).bit_length()))
    found = keys.mapInArrow(_partial(width), "row int, piece long, once binary, again binary")
    found = found.groupBy("row", "piece").applyInArrow(_several(width), "row int, piece long, bits binary")
    bits = np.zeros((SKETCH_ROWS, width // 8), np.uint8)
    size = piece_cells(width) // 8
    for row, piece, own in found.collect():
        bits[row, piece * size : (piece + 1) * size] = np.frombuffer(own, np.uint8)
    return bits


def _screen(spark, bits: np.ndarray):
    """Adds ``alone`` (the prefix is proved to have one member) and ``head`` (its parent is not, as far as seen)."""
    held, width = spark.sparkContext.broadcast(bits), bits.shape[1] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = held.value, (None, None, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            alone = np.zeros(batch.num_rows, bool)
            for i, cell in enumerate(cells(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), width)):
                alone |= (own[i][(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1) == 0
            conv, depth = batch.column("conv").to_numpy(), batch.column("depth").to_numpy()
            follows = np.r_[before[0] == conv[0] and before[1] == depth[0] - 1, (conv[1:] == conv[:-1]) & (depth[1:] == depth[:-1] + 1)]
            head = alone & ~(follows & np.r_[before[2], alone[:-1]])
            before = (conv[-1], depth[-1], alone[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(head)], [*batch.schema.names, "alone", "head"])

    return run


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of nodes, as text: a piece per batch and node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in NODE]
        ids = batch.column("conv").to_pylist()
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = [0, *new.tolist(), len(ids)]
        text = [",".join(map(str, ids[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
        at = np.array(bounds[:-1])
        yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array([ids[a] for a in bounds[:-1]], pa.int64()), pa.array(text)], [*NODE, "first", "ids"])


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order; one piece is held at a time."""

    def row(key, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([state.hexdigest()])], [*NODE, "ends_sha256"])

    last, state = None, None
    for batch in batches:
        for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in NODE)), batch.column("ids")):
            if key == last:
                state.update(b",")
            else:
                if last is not None:
                    yield row(last, state)
                last, state = key, hashlib.sha256()
            state.update(ids.as_py().encode())
    if last is not None:
        yield row(last, state)


def ends(members: DataFrame) -> DataFrame:
    """``k1, k2, depth, ends_sha256`` of ``k1, k2, depth, conv``: the digest of each node's ids in order.

    Ids are written out in ranges, also those of one node; a digest is made from such
    pieces of text, so the task that has a hot node reads a row per ten thousand ids.
    """
    parts = shuffle_parts(members.sparkSession)
    ranged = members.repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    pieces = saved(ranged.mapInArrow(_id_pieces, "k1 long, k2 long, depth long, first long, ids string"), "ends")
    return pieces.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digest_pieces, "k1 long, k2 long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The nodes of the trie of conversations ``convs`` (conv, n) with ``turns`` (conv, place, digest, points).

    One row per distinct prefix, the empty one included: ``conv_id`` (its smallest member),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (over its subtree, members
    less one times the points of the last turn), ``ends_sha256`` (of the ids of the members
    that end here, ascending, comma-joined). Without conversations there is no node.
    """
    spark = turns.sparkSession
    convs = saved(convs, "convs")
    mixed = lambda seed: F.xxhash64(F.lit(seed), "place", "digest")
    rows = turns.select("conv", F.col("place").alias("depth"), "points", mixed(1).alias("t1"), mixed(2).alias("t2"))
    rows = running(rows, "conv", ["depth"], ["t1", "t2"], "xor").select(
        "conv", "depth", "points", F.col("run_t1").alias("k1"), F.col("run_t2").alias("k2"),
        F.col("run_t1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("run_t2").bitwiseXOR(F.col("t2")).alias("p2"),
    )
    rows = saved(rows, "prefixes")
    bits = sketch(rows.select("k1", "k2"), rows.count(), most_cells)
    screened = rows.mapInArrow(_screen(spark, bits), "conv long, depth long, points long, k1 long, k2 long, p1 long, p2 long, alone boolean, head boolean")
    screened = saved(screened, "screened")
    single, zero, none = screened.filter("alone"), F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("points"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"))
    shared = screened.filter("not alone").drop("alone", "head").unionByName(root)

    # Nodes that may be shared, grouped exactly; every aggregate is combined before the shuffle.
    nodes = saved(
        shared.groupBy(*NODE).agg(
            F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
        ),
        "nodes",
    )
    heads = single.filter("head").select("p1", "p2")
    children = nodes.filter("depth > 0").select("p1", "p2").union(heads).groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("points"))
    nodes = saved(running(nodes, "conv", ["depth"], ["saves"]).withColumn("before", F.col("run_saves") - F.col("saves")), "counted")

    # What a conversation represents: the sum over its nodes, and a leaf or none.
    tip = single.join(convs.select("conv", F.col("n").alias("depth")).hint("merge"), ["conv", "depth"])
    holds = nodes.groupBy("conv").agg(F.sum("saves").alias("saves"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    holds = holds.union(tip.select("conv", zero, F.lit(1).cast("long"))).groupBy("conv").agg(F.sum("saves").alias("saves"), F.max("leaf").alias("leaf"))
    holds = saved(holds.filter("saves > 0 or leaf > 0"), "holds")
    sums = shared.select(*NODE, "conv").join(holds.hint("merge"), "conv").groupBy(*NODE).agg(F.sum("saves").alias("all_saves"), F.sum("leaf").alias("n_leaves"))
    ending = shared.join(convs.select("conv", F.col("n").alias("depth")).hint("merge"), ["conv", "depth"]).select(*NODE, "conv")

    below = nodes.filter("depth > 0").select(*NODE, "conv", "p1", "p2").union(single.filter("head").select(*NODE, "conv", "p1", "p2"))
    parents = saved(_parents(below, nodes), "parents")
    found = nodes.join(sums, NODE, "left").join(ends(ending), NODE, "left").join(parents.drop("conv"), NODE, "left")
    found = found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("all_saves") - F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    # Tails: all that there is to know of them is in the row.
    tails = single.join(convs.hint("merge"), "conv").join(parents.select("conv", "depth", "parent_conv_id").hint("merge"), ["conv", "depth"], "left")
    last, one = F.col("depth") == F.col("n"), F.lit(1).cast("long")
    return found.union(
        tails.select(
            "conv", "depth", F.coalesce("parent_conv_id", "conv"), one, (~last).cast("long"), one, zero,
            F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(EMPTY_SHA256),
        )
    )


def _parents(below: DataFrame, nodes: DataFrame) -> DataFrame:
    """``below`` with ``parent_conv_id`` of the node ``p1, p2``; where that is not among the nodes, it is a tail of the same conversation.

    The children of hot parents meet them by broadcast (fewer than ``HOT_SHARE`` rows), the
    others by shuffle.
    """
    total = nodes.agg(F.sum("n_children")).first()[0] or 0
    named = nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(named.filter(F.col("n_children") > total // HOT_SHARE + 1).drop("n_children"))
    rest = below.join(hot.drop("parent_conv_id"), ["p1", "p2"], "left_anti").join(named.drop("n_children").hint("merge"), ["p1", "p2"], "left")
    found = below.join(hot, ["p1", "p2"]).unionByName(rest)
    return found.select(*NODE, "conv", F.coalesce("parent_conv_id", "conv").alias("parent_conv_id"))


def prefix_trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The trie of conversations as they are (see ``numbered`` for their turns and ``trie`` for the rows)."""
    turns = numbered(conversations)
    return trie(turns, lengths(turns), most_cells)


def rebuilt_trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The trie of the conversations that ``rebuilt`` makes."""
    turns, convs = rebuilt(numbered(conversations))
    return trie(turns, convs, most_cells)
