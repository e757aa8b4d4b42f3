"""Hard negatives by an exact index: a multiway hyperplane tree with distance ranges.

Vectors become integers and get one more component that gives them all the same norm, so
the inner product with an anchor falls as the distance grows and a window of scores is a
ring (annulus) around the anchor. The tree is fitted on a bounded sample; each node has a
few split points, and every row of the table goes to the child of its nearest one. For
each split point the node stores the range of its distances to each sibling's rows, taken
over the whole table. A child is left out if some range, shifted by the anchor's distance
to the split point, does not meet the ring. Leaves that stay are compared exactly, block
of anchors by tile of a leaf, so the sample affects the work and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, saved, shuffle_parts
from .topk import exact_products, usable, whole_numbers

# Rows that the tree is fitted on, children of a node, and rows that a leaf is meant to hold.
SAMPLE_ROWS = 16_384
FAN_OUT = 8
LEAF_ROWS = 2_048
TILE_ROWS = 8_192
BLOCK_ROWS = 2_048
SCALE = 256
LOW, HIGH = -(2**63), 2**63 - 1


@dataclass
class Node:
    """Split points with their lifted component; a child is a node's number, or -1 - a leaf's."""

    points: np.ndarray
    lifts: np.ndarray
    children: list[int] = field(default_factory=list)


@dataclass
class Tree:
    """The nodes of vectors of one length, their root, and the ranges [node, point, child] once known."""

    nodes: list[Node]
    root: int
    leaves: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The component that brings each vector to the squared norm ``norm``."""
    return np.sqrt(np.maximum(0.0, norm - np.einsum("ij,ij->i", vectors, vectors)))


def distances(vectors: np.ndarray, lifts: np.ndarray, points: np.ndarray, point_lifts: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", vectors, vectors)[:, None] + np.einsum("ij,ij->i", points, points)[None, :]
    return np.sqrt(np.maximum(0.0, square - 2 * (vectors @ points.T) + (lifts[:, None] - point_lifts[None, :]) ** 2))


def fit(vectors: np.ndarray, norm: float, leaf_rows: int, fan_out: int = FAN_OUT) -> Tree:
    """A tree over a sample. Split points of a node lie far from each other, the first one far from its first row."""
    lifts, nodes, leaves = lift(vectors, norm), [], 0

    def grow(at: np.ndarray) -> int:
        nonlocal leaves
        own, own_lifts = vectors[at], lifts[at]
        chosen: list[int] = []
        if len(at) > leaf_rows:
            near = distances(own, own_lifts, own[:1], own_lifts[:1])[:, 0]
            while len(chosen) < fan_out and near.max() > 0:
                chosen.append(int(near.argmax()))
                to = distances(own, own_lifts, own[chosen[-1:]], own_lifts[chosen[-1:]])[:, 0]
                near = to if len(chosen) == 1 else np.minimum(near, to)
        if len(chosen) < 2:
            leaves += 1
            return -leaves
        node, number = Node(own[chosen], own_lifts[chosen]), len(nodes)
        nodes.append(node)
        nearest = distances(own, own_lifts, node.points, node.lifts).argmin(1)
        node.children = [grow(at[nearest == k]) for k in range(len(chosen))]
        return number

    root = grow(np.arange(len(vectors)))
    return Tree(nodes, root, leaves)


def descend(tree: Tree, vectors: np.ndarray, norm: float, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """The leaf of each vector; ``low`` and ``high`` are widened by its distances on the way."""
    lifts, leaf, open_ = lift(vectors, norm), np.zeros(len(vectors), np.int64), [(tree.root, np.arange(len(vectors)))]
    while open_:
        number, at = open_.pop()
        if not len(at):
            continue
        if number < 0:
            leaf[at] = -1 - number
            continue
        node = tree.nodes[number]
        far = distances(vectors[at], lifts[at], node.points, node.lifts)
        nearest = far.argmin(1)
        for k, child in enumerate(node.children):
            own = nearest == k
            if low is not None and own.any():
                m = len(node.children)
                low[number, :m, k] = np.minimum(low[number, :m, k], far[own].min(0))
                high[number, :m, k] = np.maximum(high[number, :m, k], far[own].max(0))
            open_.append((child, at[own]))
    return leaf


def surviving(tree: Tree, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray, norm: float) -> list[tuple[int, np.ndarray]]:
    """Leaves with the anchors (rows) that may have a row of one of their rings in them.

    ``inner`` and ``outer`` are distances, a column per ring; a ring whose inner distance
    is above its outer one is empty. Bounds are widened by more than rounding can move them.
    """
    lifts, slack = np.zeros(len(anchors)), 1e-6 * np.sqrt(norm + 1)
    found, open_ = [], [(tree.root, np.arange(len(anchors)))]
    while open_:
        number, at = open_.pop()
        if not len(at):
            continue
        if number < 0:
            found.append((-1 - number, at))
            continue
        node = tree.nodes[number]
        far = distances(anchors[at], lifts[at], node.points, node.lifts)
        for k, child in enumerate(node.children):
            low, high = tree.low[number, : len(node.children), k], tree.high[number, : len(node.children), k]
            if low[0] > high[0]:
                continue  # no row of the table is there
            least = np.maximum(0.0, np.maximum(far - high, low - far)).max(1) - slack
            most = (far + high).min(1) + slack
            meets = (inner[at] <= outer[at]) & (inner[at] <= most[:, None]) & (outer[at] >= least[:, None])
            open_.append((child, at[meets.any(1)]))
    return found


def ring(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the rows whose inner product lies in [low, high]; empty windows stay empty."""
    square = (np.einsum("ij,ij->i", anchors, anchors) + norm)[:, None]
    inner = np.sqrt(np.maximum(0.0, square - 2 * highs.astype(float)))
    outer = np.sqrt(np.maximum(0.0, square - 2 * lows.astype(float)))
    return np.where(lows > highs, 1.0, inner), np.where(lows > highs, 0.0, outer)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of each vector length in the batch, with their vectors."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield int(width), at, _vectors(batch.column("v").take(pa.array(at)), int(width))


class Index:
    """Trees by vector length, shared by broadcast, and the rows of the table by leaf and tile."""

    def __init__(self, base: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, tile_rows: int = TILE_ROWS):
        spark = base.sparkSession
        self.spark = spark
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        norm, rows = base.agg(F.max(square), F.count("*")).first()
        self.norm = norm or 0.0
        sample = base.select("width", "v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(sample_rows).collect()
        trees: dict[int, Tree] = {}
        for width in sorted({r.width for r in sample}):
            own = [r.v for r in sample if r.width == width]
            trees[width] = fit(np.array(own, float).reshape(len(own), width), self.norm, max(4, leaf_rows * len(sample) // max(1, rows)))
        self.trees = trees
        rows = saved(base.mapInArrow(_homes(spark.sparkContext.broadcast(trees), self.norm), "kind int, vec_id long, label long, asks boolean, width int, v array<double>, leaf long, low double, high double"), "leaves")
        self._ranges(rows)
        held = rows.filter("kind = 0").drop("kind", "low", "high")
        # Leaves are bounded by the sample; lengths without a tree are one leaf each.
        tiles = held.groupBy("width", "leaf").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
        self.rows = saved(held.join(tiles, ["width", "leaf"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), "tiles").cast("int")).drop("tiles"), "tiles")

    def _ranges(self, rows: DataFrame) -> None:
        """The ranges of all tasks put together: a number per node, split point and child."""
        for tree in self.trees.values():
            shape = (len(tree.nodes), FAN_OUT, FAN_OUT)
            tree.low, tree.high = np.full(shape, np.inf), np.full(shape, -np.inf)
        ranges = rows.filter("kind = 1").groupBy("width", "leaf").agg(F.min("low"), F.max("high"))
        for width, place, low, high in ranges.collect():
            self.trees[width].low.reshape(-1)[place], self.trees[width].high.reshape(-1)[place] = low, high

    def search(self, anchors: DataFrame, k: int, same_label: bool, home_only: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """``query_id, window, rank, vec_id, score``: the k best rows of each window of each anchor.

        ``anchors`` has query_id, label, width, v and ``windows`` (array of low and high
        score, both included). Rows of the anchor's id are left out; with ``same_label``
        rows of another label are, else rows of its own.
        """
        blocks = max(1, -(-anchors.count() // block_rows))
        trees = self.spark.sparkContext.broadcast(self.trees)
        kind = "query_id long, label long, width int, v array<double>, windows array<struct<low:long,high:long>>, leaf long"
        asked = anchors.select("query_id", "label", "width", "v", "windows").mapInArrow(_targets(trees, self.norm, home_only), kind)
        asked = saved(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "asked")
        # A leaf's rows go to the blocks that ask for them only.
        wanted = asked.groupBy("width", "leaf").agg(F.collect_set("block").alias("blocks"))
        held = self.rows.join(wanted, ["width", "leaf"]).withColumn("block", F.explode("blocks")).drop("blocks", "asks")
        tiles = self.rows.select("width", "leaf", "tile").distinct()
        asked = asked.join(tiles, ["width", "leaf"])
        cell = ["width", "leaf", "tile", "block"]
        own = asked.select(*(F.col(c).alias(f"a_{c}") for c in cell), "query_id", F.col("label").alias("own_label"), F.col("v").alias("q"), "windows")
        hits = (
            own.groupBy(*(f"a_{c}" for c in cell)).cogroup(held.groupBy(*cell))
            .applyInArrow(_tile(k, same_label), "query_id long, window int, vec_id long, score long")
        )
        best = Window.partitionBy("query_id", "window").orderBy(F.col("score").desc(), "vec_id")
        # Spark cuts each task's rows of a window to k before the shuffle.
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "window", "rank", "vec_id", "score")


def _homes(trees, norm: float):
    """The rows with their leaf (kind 0), and at the end of a task its ranges (kind 1, place in ``leaf``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {w: (np.full((len(t.nodes), FAN_OUT, FAN_OUT), np.inf), np.full((len(t.nodes), FAN_OUT, FAN_OUT), -np.inf)) for w, t in trees.value.items()}
        names = ["kind", "vec_id", "label", "asks", "width", "v", "leaf", "low", "high"]
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for width, at, vectors in _by_width(batch):
                if width in found:
                    leaf[at] = descend(trees.value[width], vectors, norm, *found[width])
            n = batch.num_rows
            own = [batch.column(c) for c in ("vec_id", "label", "asks", "width", "v")]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *own, pa.array(leaf), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names)
        for width, (low, high) in found.items():
            at = np.flatnonzero(low.reshape(-1) <= high.reshape(-1))
            n, long = len(at), pa.int64()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(n, np.int32)), pa.nulls(n, long), pa.nulls(n, long), pa.nulls(n, pa.bool_()), pa.array(np.full(n, width, np.int32)),
                pa.nulls(n, pa.list_(pa.float64())), pa.array(at), pa.array(low.reshape(-1)[at]), pa.array(high.reshape(-1)[at]),
            ], names)

    return run


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lows and highs, a row per anchor; missing ones are empty windows."""
    sizes = np.diff(column.offsets.to_numpy())
    shape = (len(column), max(1, int(sizes.max(initial=0))))
    lows, highs, flat = np.ones(shape, np.int64), np.zeros(shape, np.int64), column.flatten()
    at = np.arange(shape[1])[None, :] < sizes[:, None]
    lows[at], highs[at] = flat.field("low").to_numpy(), flat.field("high").to_numpy()
    return lows, highs


def _targets(trees, norm: float, home_only: bool):
    """Each anchor once for every leaf that its windows may reach, or its own leaf only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lows, highs = _windows(batch.column("windows"))
            for width, at, vectors in _by_width(batch):
                tree = trees.value.get(width)
                if tree is None:
                    found = [(0, np.arange(len(at)))]
                elif home_only:
                    leaf = descend(tree, vectors, norm)
                    found = [(k, np.flatnonzero(leaf == k)) for k in np.unique(leaf)]
                else:
                    found = surviving(tree, vectors, *ring(vectors, lows[at], highs[at], norm), norm)
                for leaf, rows in found:
                    own = batch.take(pa.array(at[rows]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(rows), leaf, np.int64))], [*own.schema.names, "leaf"])

    return run


def _tile(k: int, same_label: bool):
    """The best k rows of a tile for each window of a block of anchors."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "window", "vec_id", "score"]
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if not asked.num_rows or not held.num_rows:
            return pa.table(empty, names)
        held = held.sort_by("vec_id").combine_chunks()
        ids, labels, width = (held.column(c).to_numpy() for c in ("vec_id", "label", "width"))
        matrix = _vectors(pa.concat_arrays(held.column("v").chunks), int(width[0]))
        found = [empty]
        for start in range(0, asked.num_rows, 256):
            part = asked.slice(start, 256).combine_chunks()
            queries, own = (part.column(c).to_numpy() for c in ("query_id", "own_label"))
            scores = exact_products(_vectors(pa.concat_arrays(part.column("q").chunks), int(width[0])), matrix)
            lows, highs = _windows(pa.concat_arrays(part.column("windows").chunks))
            fits = ((labels[None, :] == own[:, None]) == same_label) & (ids[None, :] != queries[:, None])
            for w in range(lows.shape[1]):
                rows, at = np.nonzero(fits & (scores >= lows[:, w, None]) & (scores <= highs[:, w, None]))
                order = np.lexsort((ids[at], -scores[rows, at], rows))
                rows, at = rows[order], at[order]
                first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                rows, at = rows[first], at[first]
                found.append([queries[rows], np.full(len(rows), w, np.int32), ids[at], scores[rows, at]])
        return pa.table([np.concatenate(c) for c in zip(*found)], names)

    return run


def changed_label(vec_id: Column, label: Column) -> Column:
    """Where the id is divisible by 7, the next of ten labels."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    leaf_rows: int = LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    tile_rows: int = TILE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the exact inner product of floor(scale * x); higher comes first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of its label,
    and for each of them the ``negatives`` first rows of another label are returned whose
    score is at least half and at most 95 % of the positive's (so a negative positive score
    has none, and a score of zero only zeros).

    Rows without id or label, and vectors that are null or hold a null or non-finite
    component, take no part. A vector meets vectors of its own length only. Rows that
    repeat an id are rows of their own, but not candidates of an anchor of that id; a
    repeated anchor is asked once, with its smallest label and vector, and a repeated
    positive id gives the negatives of each of its scores once. Scores beyond a long stop
    at its ends. Tables may be empty.
    """
    require(vectors, id_col, vector_col)
    base = (
        vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col)))
        .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), whole_numbers(F.col(vector_col), scale).alias("v"))
        .withColumn("width", F.size("v"))
    )
    index = Index(saved(base.select("vec_id", "label", "asks", "width", "v"), "vectors"), leaf_rows, sample_rows, tile_rows)
    asks = index.rows.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "width", "v")).alias("a"))
    asks = saved(asks.select("query_id", "a.label", "a.width", "a.v"), "anchors")
    window = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))

    # A first look into the anchor's own leaf bounds the scores of its positives from below.
    near = index.search(asks.withColumn("windows", F.array(window(F.lit(LOW), F.lit(HIGH)))), positives, True, True, block_rows)
    bounds = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    least = F.when(F.col("n") == positives, F.col("least")).otherwise(LOW)
    bounded = asks.join(bounds, "query_id", "left").withColumn("windows", F.array(window(least, F.lit(HIGH))))
    best = saved(index.search(bounded, positives, True, False, block_rows).select("query_id", "rank", "vec_id", "score"), "positives")

    # The windows of an anchor's positives, in the order of their ranks.
    score = F.col("score")
    low = F.when(score < 0, F.lit(1)).otherwise(F.expr("score div 2 + score % 2"))
    high = F.when(score < 0, F.lit(0)).otherwise(F.expr("(score div 20) * 19 + ((score % 20) * 19) div 20"))
    ranked = best.select("query_id", F.struct("rank", window(low, high).alias("w")).alias("r"))
    windows = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("r")).select("query_id", F.transform("r", lambda r: r["w"]).alias("windows"))
    asked = saved(asks.join(windows, "query_id"), "windows")
    # What the own leaf holds narrows each ring: only rows as good as its last one can still come in.
    near = index.search(asked, negatives, False, True, block_rows).groupBy("query_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bounds = near.filter(F.col("n") == negatives).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("bounds"))
    narrowed = F.transform("windows", lambda w, i: F.struct(F.greatest(w["low"], F.try_element_at("bounds", i)).alias("low"), w["high"].alias("high")))
    asked = asked.join(bounds, "query_id", "left").withColumn("windows", narrowed)
    found = index.search(asked, negatives, False, False, block_rows)
    chosen = best.select("query_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"))
    return found.join(chosen, ["query_id", "window"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
