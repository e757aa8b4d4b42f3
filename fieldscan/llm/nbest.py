"""SentencePiece encoding and decoding with N-best segmentation.

A text's piece lattice has an arc for each piece that stands in it; a segmentation's score
is the sum of its pieces' scores. Forward Viterbi gives, at each place, the score of the
best way to it. Those scores are exact heuristics for an A* search backward from the end,
which therefore meets the best segmentations in order.

No piece reaches over the start of a word or over a character that stands in no longer
piece, so the lattice falls into units there. Forward and backward scores are worked out
for all distinct units of a batch at once; the search runs in the few units of a text
whose second-best segmentation can be part of the text's N best.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, lengths_to_starts, merged, require, utf8

MARK = "▁"
N_BEST = 3
# Fixed values of the library's lattice: an unknown character scores this much below the
# worst piece, and user-defined pieces score this much below the best one.
UNKNOWN_PENALTY = 10.0
USER_PENALTY = 0.1
LONG_UNIT = 64
# Units remembered by a task, and their characters at most; cells of a batch of lattices.
MEMO_UNITS = 300_000
MEMO_CHARS = 4_000_000
CELLS = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20


class Pieces:
    """The pieces of a model file, their scores, and how they cut texts into units."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        names = {i: model.id_to_piece(i) for i in plain}
        scores = {i: model.get_score(i) for i in plain}
        # Runs of blanks are user-defined pieces, which have no score of their own.
        user = {i for i in plain if scores[i] < -1e8}
        known = [s for i, s in scores.items() if i not in user]
        top, low = max(known, default=0.0), min(known, default=0.0)
        scores.update((i, len(names[i]) * top - USER_PENALTY) for i in user)
        self.scores = {names[i]: (scores[i], i) for i in plain}
        self.unknown_score = low - UNKNOWN_PENALTY
        self.longest = max(map(len, self.scores), default=1)
        self.dummy_prefix = bool(model.encode("a")) and model.id_to_piece(model.encode("a")[0]).startswith(MARK)
        by_word = all(MARK not in p[1:] or not p.strip(MARK) for p in self.scores)
        joined = re.escape("".join(sorted({c for p in self.scores if len(p) > 1 for c in p} - {MARK})))
        self.unit = re.compile(f"{MARK}*[{joined}]+|{MARK}+|[^{joined}{MARK}]" if by_word and joined else "(?s).+", re.S)
        self.bytes_of = [model.id_to_piece(i).encode() for i in every]
        for value, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([value])
        for i in every:
            if model.is_control(i):
                self.bytes_of[i] = b""
        self.bytes_of[self.unknown_id] = " ⁇ ".encode()
        hashes = {}
        for name, (score, i) in self.scores.items():
            hashes[_spelling_hash(name)] = (score, i)
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.hash_scores = np.array([hashes[h][0] for h in sorted(hashes)])
        self.hash_ids = np.array([hashes[h][1] for h in sorted(hashes)], np.int64)
        # Spellings by the upper bits of their hash; what finds its slot taken is searched for.
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        slot = (self.hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << _SLOT_BITS, bool)
        self.shared[slot[1:][slot[1:] == slot[:-1]]] = True

    def marked(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if text and self.dummy_prefix else text

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each spelling among the pieces, -1 for none."""
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at = self.slots[slot]
        at[self.hashes[at] != hashes] = -1
        unsure = np.flatnonzero(self.shared[slot])
        if len(unsure):
            near = np.minimum(np.searchsorted(self.hashes, hashes[unsure]), len(self.hashes) - 1)
            at[unsure] = np.where(self.hashes[near] == hashes[unsure], near, -1)
        return at

    def unknown(self, char: str) -> list[int]:
        """A character without a piece, as byte pieces if the model has them."""
        return [self.byte_ids[b] for b in char.encode()] if len(self.byte_ids) == 256 else [self.unknown_id]


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _PRIME
    return h ^ (h >> np.uint64(29))


def _spelling_hash(name: str) -> int:
    """As ``_step`` over the characters, for one spelling."""
    h = 0
    for c in name:
        h = (h ^ ord(c)) * int(_PRIME) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def arcs(pieces: Pieces, unit: str) -> list[list[tuple[int, float, list[int]]]]:
    """For each place, the arcs that end there: start, score, ids; longer ones first."""
    out: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(len(unit) + 1)]
    for end in range(1, len(unit) + 1):
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.scores.get(unit[start:end])
            if found:
                out[end].append((start, found[0], [found[1]]))
            elif start == end - 1:
                out[end].append((start, pieces.unknown_score, pieces.unknown(unit[start])))
    return out


def search(pieces: Pieces, unit: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a unit, best first, by A* backward from its end."""
    into = arcs(pieces, unit)
    forward = [0.0] * len(into)
    for end in range(1, len(into)):
        forward[end] = max(forward[start] + score for start, score, _ in into[end])
    # Partial segmentations of the end of the unit; the count keeps equals in the order they came.
    count = itertools.count()
    agenda = [(-forward[-1], next(count), len(unit), 0.0, ())]
    out = []
    while agenda and len(out) < n:
        _, _, place, score, path = heapq.heappop(agenda)
        if place == 0:
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((score, ids))
            continue
        for start, own, piece in into[place]:
            total = score + own
            heapq.heappush(agenda, (-(forward[start] + total), next(count), start, total, (piece, path)))
    return out


class Best:
    """Of several units, end to end: best scores, what the second best loses, and the best ids."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        kinds = (np.float64, np.float64, np.int64, np.int32)
        self.score, self.loss, self.sizes, self.ids = (np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))
        self.starts = lengths_to_starts(self.sizes)

    def part(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.score, self.loss, self.sizes, self.ids

    def ids_of(self, k: int) -> np.ndarray:
        return self.ids[self.starts[k] : self.starts[k + 1]]


def best_all(pieces: Pieces, units: list[str]) -> Best:
    """For each unit, the best score and segmentation, and how much the second best loses.

    Units of one length at once, in batches of bounded size: scores of the best way to each
    place and from each place to the end. A second-best way uses some arc that the best one
    does not.
    """
    by_length: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by_length.setdefault(len(u), []).append(i)
    order, parts = [], []
    for length, members in by_length.items():
        order += members
        if length > LONG_UNIT:
            for i in members:
                found = search(pieces, units[i], 2)
                loss = found[0][0] - found[1][0] if len(found) > 1 else np.inf
                parts.append((np.array([found[0][0]]), np.array([loss]), np.array([len(found[0][1])]), np.array(found[0][1], np.int32)))
            continue
        step = max(1, CELLS // (length * min(length, pieces.longest)))
        for a in range(0, len(members), step):
            parts.append(_best_of_length(pieces, [units[i] for i in members[a : a + step]], length))
    found = Best(parts)
    # Back into the order of the units.
    back = np.empty(len(order), np.int64)
    back[np.array(order, np.int64)] = np.arange(len(order))
    ids = found.ids[gather(found.starts[back], found.sizes[back])]
    return Best([(found.score[back], found.loss[back], found.sizes[back], ids)])


def best_of(pieces: Pieces, units: list[str]) -> list[tuple[float, list[int], float]]:
    """``best_all`` as a list of (score, ids, loss)."""
    found = best_all(pieces, units)
    return [(float(found.score[k]), found.ids_of(k).tolist(), float(found.loss[k])) for k in range(len(units))]


def _best_of_length(pieces: Pieces, units: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(units)
    chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).T.astype(np.uint64)
    into = np.full((length + 1, n), -np.inf)
    into[0] = 0
    back = np.zeros((length + 1, n), np.int16)
    found: dict[tuple[int, int], np.ndarray] = {}
    scores = np.append(pieces.hash_scores, -np.inf)
    for start in range(length):
        h = np.zeros(n, np.uint64)
        for end in range(start + 1, min(length, start + pieces.longest) + 1):
            h = _step(h, chars[end - 1])
            at = pieces.lookup(h)
            single = end == start + 1
            if not single and not (at >= 0).any():
                continue
            found[start, end] = at
            score = scores[at]
            if single:
                score[at < 0] = pieces.unknown_score
            way = into[start] + score
            better = way > into[end]
            into[end][better] = way[better]
            back[end][better] = start

    def score_of(start: int, end: int) -> np.ndarray:
        score = scores[found[start, end]]
        if end == start + 1:
            score[found[start, end] < 0] = pieces.unknown_score
        return score

    # The best way, from its end.
    rows, place = np.arange(n), np.full(n, length)
    taken = np.zeros((length + 1, n), bool)
    while (place > 0).any():
        taken[place, rows] = True
        place = np.where(place > 0, back[place, rows], 0)
    onward = np.full((length + 1, n), -np.inf)
    onward[length] = 0
    second = np.full(n, -np.inf)
    hits = []
    for start, end in sorted(found, key=lambda x: -x[0]):
        rest = score_of(start, end) + onward[end]
        np.maximum(onward[start], rest, out=onward[start])
        on_best = taken[end] & (back[end] == start)
        whole = into[start] + rest
        whole[on_best] = -np.inf
        np.maximum(second, whole, out=second)
        own = np.flatnonzero(on_best)
        hits.append((own, np.full(len(own), start), found[start, end][own]))
    row, start, at = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((start, row))
    row, start, at = row[order], start[order], at[order]
    sizes, ids = np.ones(len(row), np.int64), pieces.hash_ids[at]
    for k in np.flatnonzero(at < 0):
        more = pieces.unknown(units[row[k]][start[k]])
        sizes[k], ids[k] = len(more), more[0]
    if (sizes > 1).any():
        # Characters without a piece that are several bytes.
        wide = np.repeat(ids, sizes)
        at_ = lengths_to_starts(sizes)
        for k in np.flatnonzero(sizes > 1):
            wide[at_[k] : at_[k + 1]] = pieces.unknown(units[row[k]][start[k]])
        ids = wide
    # Rounding may not make the second best better than the best.
    loss = np.maximum(into[length] - second, 0.0)
    return into[length].copy(), loss, np.bincount(row, sizes, n).astype(np.int64), ids.astype(np.int32)


def _swapped(ids: np.ndarray, starts: np.ndarray, changes: tuple) -> np.ndarray:
    """The ids of a text, whose units begin at ``starts``, with those of some units changed."""
    if not changes:
        return ids
    parts, at = [], 0
    for unit, new in sorted(changes):
        parts += [ids[at : starts[unit]], np.array(new, np.int32)]
        at = starts[unit + 1]
    return np.concatenate([*parts, ids[at:]])


class Encoder:
    """Encodes texts by their distinct units and remembers them for the task."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.lists: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self.forget()

    def forget(self) -> None:
        """The units met so far, numbered in the order they came, and what is known of them."""
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.units: list[str] = []
        self.chars = 0
        self.best = Best([])

    def learn(self) -> None:
        """Works out the units that have come since it was called last."""
        new = list(itertools.islice(self.codes, len(self.units), None))
        if new:
            self.units += new
            self.chars += sum(map(len, new))
            self.best = Best([self.best.part(), best_all(self.pieces, new).part()])

    def alternatives(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        if len(self.lists) > MEMO_UNITS // 30:
            self.lists.clear()
        key = (unit, n)
        if key not in self.lists:
            self.lists[key] = search(self.pieces, unit, n)
        return self.lists[key]

    def encode(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, list[float]]]:
        """For each text the ids of its best segmentation and the scores of its ``n`` best ones."""
        for found in self.encode_all(texts, n):
            yield found[0][1], [s for s, _ in found]

    def encode_all(self, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its ``n`` best segmentations, best first, as score and ids."""
        if len(self.units) > MEMO_UNITS or self.chars > MEMO_CHARS:
            self.forget()
        cut, code = self.pieces.unit.findall, self.codes.__getitem__
        split = [np.fromiter(map(code, cut(self.pieces.marked(t))), np.int32) for t in texts]
        self.learn()
        best = self.best
        for at in split:
            if not len(at):
                yield [(0.0, np.zeros(0, np.int32))]
                continue
            sizes = best.sizes[at]
            ids, total = best.ids[gather(best.starts[at], sizes)], float(best.score[at].sum())
            ends = lengths_to_starts(sizes)
            yield [(total - x, _swapped(ids, ends, changes)) for x, changes in self._changes(at, best.loss[at], n)]

    def _changes(self, at: np.ndarray, loss: np.ndarray, n: int) -> list[tuple[float, tuple]]:
        """Of the n best, each differs from the best in one of the n - 1 units that lose least, or more
        of them: what it loses, and the places and ids of its changed units. The best comes first."""
        lists: list[tuple[float, tuple]] = [(0.0, ())]
        if n > 1:
            few = np.argpartition(loss, n - 2)[: n - 1] if len(loss) >= n else np.arange(len(loss))
            for i in few:
                if np.isfinite(loss[i]):
                    own, first = self.alternatives(self.units[at[i]], n), self.best.ids_of(at[i]).tolist()
                    # Of equally good ones the search may meet another first.
                    others = [(max(own[0][0] - s, 0.0), ((int(i), ids),)) for s, ids in own if ids != first]
                    ways = [(0.0, ()), *others[: n - 1]]
                    lists = heapq.nsmallest(n, ((a + x, c + more) for a, c in lists for x, more in ways), key=lambda x: x[0])
        return lists

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text with their ids, best first; equals in any order."""
        units = self.pieces.unit.findall(self.pieces.marked(text))
        lists: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for unit in units:
            lists = heapq.nsmallest(n, ((a - s, ids + tuple(more)) for a, ids in lists for s, more in self.alternatives(unit, n)), key=lambda x: x[0])
        return [(-a, list(ids)) for a, ids in lists]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids. The blank put before the text goes; other marks become blanks."""
        of = self.pieces.bytes_of
        text = b"".join([of[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text


ENCODED = "ids array<int>, n_pieces long, scores array<double>, decodes boolean, digests array<long>, n_best array<struct<score:double,ids:array<int>>>"


def _listed(found: list[list[tuple[float, np.ndarray]]]) -> pa.ListArray:
    """The segmentations of several texts as a column ``n_best``."""
    every = [x for text in found for x in text]
    sizes = np.array([len(ids) for _, ids in every], np.int64)
    flat = np.concatenate([ids for _, ids in every]) if every else np.zeros(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(lengths_to_starts(sizes), pa.int32()), pa.array(flat, pa.int32()))
    rows = pa.StructArray.from_arrays([pa.array([s for s, _ in every], pa.float64()), ids], ["score", "ids"])
    return pa.ListArray.from_arrays(pa.array(lengths_to_starts(np.array([len(x) for x in found], np.int64)), pa.int32()), rows)



def encode(docs: DataFrame, model: str, keep: list[str], text_col: str = "text", n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """The columns ``keep`` as the struct ``row``, and for each text: the ``ids`` of its best
    segmentation (null unless ``with_ids``), ``n_pieces``, the ``scores`` of its ``n`` best ones,
    whether decoding the ids gives the text back, ``digests`` (of each of the ``n`` best, the
    unsigned CRC-32 of its ids as little-endian 32-bit integers) and ``n_best``: score and
    ids of each of the ``n`` best, best first (null unless ``with_ids``).

    ``model`` is a sentencepiece file whose normaliser leaves characters as they are. Empty
    and null texts have no pieces and the one score 0. A text with fewer segmentations
    has fewer scores. The mark U+2581 in a text decodes to a blank, as with the library,
    and does not count as a difference. Other columns do not matter; repeated rows come
    out repeatedly; an empty table has an empty result.
    """
    require(docs, text_col, *keep)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), utf8(text_col).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for table in merged(batches, "content"):
            texts = [t.decode("utf-8", "replace") for t in table.column("content").to_pylist()]
            every, counts, scores, same, digests, lists = [], [], [], [], [], []
            for text, found in zip(texts, encoder.encode_all(texts, n)):
                ids = found[0][1]
                every.append(ids if with_ids else None)
                counts.append(len(ids))
                scores.append([s for s, _ in found])
                if with_ids:
                    lists.append(found)
                digests.append([zlib.crc32(i.astype("<u4").tobytes()) for _, i in found])
                same.append(encoder.decode(ids.tolist()) == text.replace(MARK, " "))
            columns = [table.column("row"), pa.array(every, pa.list_(pa.int32())), pa.array(counts, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(same), pa.array(digests, pa.list_(pa.int64()))]
            empty = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
            columns.append(_listed(lists) if with_ids else pa.nulls(len(texts), empty))
            yield from pa.Table.from_arrays(columns, ["row", "ids", "n_pieces", "scores", "decodes", "digests", "n_best"]).to_batches()

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {ENCODED}")


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids_col`` as ``text_col``; null ids give a null text."""
    require(rows, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    kept = [c for c in rows.columns if c != text_col]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(ids_col).alias("ids"))
    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return found.select("row.*", F.col("text").alias(text_col))
