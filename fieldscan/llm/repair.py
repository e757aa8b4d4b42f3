"""Token ids in files compressed by Re-Pair.

Texts are dealt to shards in ascending order of their ids, encoded, and cut into blocks.
In each block frequent pairs of ids are replaced by nonterminals, round by round, most
frequent pairs first, until none is left; a block keeps the rules, how many ids each nonterminal stands for,
and where each document starts, so one document is decoded without the others.

The files are a Parquet table of blocks (``shard, block, n_docs, n_ids, content``). ``content``
is little-endian: the five numbers of ``HEAD``, then rules (pairs of u4), expansion lengths
(u4), document ids (i8) and a null mark each (u1), first symbol of each document and the
end (u8), ids before each document in the block and the end (u8), symbols (u2 or u4).
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gather, lengths_to_starts, merged, require

END_ID = 1
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
LEAST_COUNT = 8
MEMO_WORDS = 1_200_000
# Number of terminals, rules, documents, symbols, bytes per symbol.
HEAD = "<IIIQB"


class Encoder:
    """Ids as the tokenizers library gives them, without added special tokens.

    For a tokenizer whose words never reach over white space, each distinct part of a block is
    looked up, and encoded only when it is new: plain parts by the library's model, other words
    by its whole chain. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            self.by_word = word_by_word(json.load(f))
        self.model = self.whole.model
        # Known parts, and the ids of each; their hashes in order, and the part of each.
        self.memo, self.part_ids = pa.array([], pa.binary()), _Lists()
        self.hashes, self.of_hash = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.latest = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """All parts but the latest ones."""
        kept = self.part_ids.of(self.latest)
        self.memo, self.part_ids = self.memo.take(pa.array(self.latest)), _Lists()
        self.part_ids.add(*kept)
        hashes = _hashes(self.memo)
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], order.astype(np.int32)

    def _known(self, parts: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each part in ``memo``, -1 if it is not found there. Of parts of one hash the first is found."""
        if not len(self.hashes):
            return np.full(len(parts), -1, np.int64)
        order = np.argsort(hashes)
        at = np.empty(len(parts), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        numbers = self.of_hash.take(at, mode="clip").astype(np.int64)
        alike = pc.equal(parts, self.memo.take(pa.array(numbers)))
        return np.where(alike.to_numpy(zero_copy_only=False), numbers, -1)

    def _learn(self, parts: pa.Array, kinds: np.ndarray) -> None:
        """Ids of parts that are not known."""
        flat, lengths, tokenize, id_of = array("i"), array("q"), self.model.tokenize, operator.attrgetter("id")
        is_odd = kinds == _ODD
        plain, odd = np.flatnonzero(~is_odd), np.flatnonzero(is_odd)
        if len(plain):
            lower = b"\n".join(parts.take(pa.array(plain)).to_pylist()).decode().lower()
            for p in byte_letters(lower).split(byte_letters("\n")):
                found = tokenize(p)
                lengths.append(len(found))
                flat.extend(map(id_of, found))
        if len(odd):
            texts = [w.decode("utf-8", "replace") for w in parts.take(pa.array(odd)).to_pylist()]
            for x in self.whole.encode_batch_fast(texts, add_special_tokens=False):
                lengths.append(len(x.ids))
                flat.extend(x.ids)
        self.memo = pa.concat_arrays([self.memo, parts.take(pa.array(np.r_[plain, odd]))])
        self.part_ids.add(np.frombuffer(flat, np.int32), np.frombuffer(lengths, np.int64))

    def numbers(self, parts: pa.Array, kinds: np.ndarray) -> np.ndarray:
        """The place of each part in ``memo``; parts must be distinct."""
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        hashes = _hashes(parts)
        numbers = self._known(parts, hashes)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            n, is_odd = len(self.memo), kinds[unknown] == _ODD
            self._learn(parts.take(pa.array(unknown)), kinds[unknown])
            unknown = np.r_[unknown[~is_odd], unknown[is_odd]]
            numbers[unknown] = np.arange(n, len(self.memo))
            fresh = unknown[np.argsort(hashes[unknown], kind="stable")]
            # After those of the same hash.
            to = np.searchsorted(self.hashes, hashes[fresh], "right")
            self.hashes, self.of_hash = np.insert(self.hashes, to, hashes[fresh]), np.insert(self.of_hash, to, numbers[fresh])
        self.latest = numbers
        return numbers

    def encode(self, texts: list[bytes] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, each followed by ``end_id`` if given, and how many each text has."""
        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        if not self.by_word:
            end = [] if end_id is None else [end_id]
            found = [x.ids + end for x in self.whole.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)
        distinct, kinds, codes, starts = parted(texts)
        # Before the lists are asked for: they can begin anew.
        numbers = self.numbers(distinct, kinds)
        ids, lengths = self.part_ids.of(numbers[codes])
        stops = lengths_to_starts(lengths)[starts]
        if end_id is not None:
            ids = np.insert(ids, stops[1:], end_id)
            stops += np.arange(len(stops))
        return ids, np.diff(stops)


def _hashes(parts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each part, which must not be empty."""
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    if not len(parts):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(parts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    # A random number for each byte at its place, added up.
    place = gather(np.zeros(len(parts), np.int64), np.diff(offsets)) & 63
    return np.add.reduceat(_RANDOM[place.astype(np.uint16) << 8 | data], offsets[:-1])


_RANDOM = np.random.default_rng(5).integers(0, 2**64, 64 << 8, np.uint64)


class _Lists:
    """Lists of ids by number, end to end."""

    def __init__(self):
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(lengths)]
        self.flat = np.concatenate([self.flat, flat])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers, end to end, and how many each has."""
        lengths = np.diff(self.starts)[numbers]
        return self.flat[gather(self.starts[numbers], lengths)], lengths


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, which later tasks use again: words keep their ids."""
    return Encoder(path)


# What a byte is part of. Odd are all but printable ASCII, as is ' (contractions); then letters of two bytes.
_WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_ASCII = ((rb"\s", _WHITE), (rb"[A-Za-z]", _LETTER), (rb"[0-9]", _DIGIT), (rb"[!-&(-/:-@[-`{-~]", _MARK))
_KINDS = bytes(next((kind for of, kind in _ASCII if re.match(of, bytes([c]))), _ODD) for c in range(256))
# U+00C0 to U+024F and U+0400 to U+047F: composed letters but for two signs, each with a lower case of one letter but for I with a dot.
_LETTERS = np.zeros(65536, bool)
_LETTERS[[int.from_bytes(chr(c).encode(), "big") for c in (*range(0xC0, 0x250), *range(0x400, 0x480)) if c not in (0xD7, 0xF7, 0x130)]] = True


def parted(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parts in ASCII lower case, the kind of each, the parts of all texts as codes, and where each text starts and ends.

    Parts are runs of letters and of marks, and single digits; a word with anything odd is one part as it is.
    """
    raw = b"\n".join([b"", *texts, b""])
    data = np.frombuffer(raw, np.uint8)
    kinds, lower = np.frombuffer(bytearray(raw.translate(_KINDS)), np.uint8), np.frombuffer(bytearray(raw.lower()), np.uint8)
    high = np.flatnonzero(data >= 128)
    high = high[_LETTERS[data[high].astype(np.uint16) << 8 | data[high + 1]]]
    kinds[high] = kinds[high + 1] = _LETTER
    # Special tokens.
    signs = np.flatnonzero(data == ord("<"))
    kinds[signs[data[signs + 1] == ord("|")]] = _ODD
    odd = np.flatnonzero(kinds == _ODD)
    if len(odd):
        white = np.flatnonzero(kinds == _WHITE)
        after = np.unique(np.searchsorted(white, odd))
        at = gather(white[after - 1] + 1, white[after] - white[after - 1] - 1)
        kinds[at], lower[at] = _ODD, data[at]
    # The first byte is white.
    begins = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)) + 1
    lengths, kind = np.diff(begins, append=len(data)), kinds[begins]
    dark = kind != _WHITE
    begins, kind = begins[dark], kind[dark]
    offsets, letters = lengths_to_starts(lengths[dark]).astype(np.int32), lower[kinds != _WHITE]
    parts = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    codes = parts.indices.to_numpy()
    kind_of = np.zeros(len(parts.dictionary), np.uint8)
    kind_of[codes] = kind
    starts = lengths_to_starts(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return parts.dictionary, kind_of, codes, np.searchsorted(begins, starts + 1)


# Fixed value: how the tokenizer below parts a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# How byte-level tokenizers spell bytes: printable ones of Latin-1 as themselves, the others
# in order from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = np.arange(256, dtype="<u2")
_SPELLED[[b for b in range(256) if b not in _PRINTABLE]] = np.arange(256, 512 - len(_PRINTABLE))


def byte_letters(text: str) -> str:
    return _SPELLED[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


def word_by_word(spec: dict) -> bool:
    """Lower case after NFC, parted by ``WORD_PATTERN``, byte-level: no word holds white space, and
    what a plain word becomes is known."""
    norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"].get("Regex") == WORD_PATTERN
        and (parts[0]["behavior"], parts[0]["invert"], parts[1]["add_prefix_space"]) == ("Removed", True, False)
        and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
        and all(t["special"] and t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
    )


def _chosen(left: np.ndarray, right: np.ndarray, counts: np.ndarray, most: int) -> list[int]:
    """The pairs of one round, most frequent first, and none under a sixteenth of the first.

    A symbol is the left one of chosen pairs or the right one, never both, so occurrences
    cannot overlap; a pair of equal symbols has its symbol to itself. Pairs left out have
    their turn in a later round.
    """
    near = np.flatnonzero(counts * 16 >= counts.max(initial=0))
    order = near[np.lexsort((right[near], left[near], -counts[near]))]
    lefts, rights, out = set(), set(), []
    for i, a, b in zip(order.tolist(), left[order].tolist(), right[order].tolist()):
        if a not in rights and b not in lefts and (a != b or a not in lefts and a not in rights):
            if len(out) >= most:
                break
            lefts.add(a)
            rights.add(b)
            out.append(i)
    return out


def _second_of_equals(at: np.ndarray) -> np.ndarray:
    """Which of the ascending places of pairs of equal symbols are the second, fourth … of a run."""
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = at[1:] == at[:-1] + 1
    number = np.arange(len(at))
    return (number - np.maximum.accumulate(np.where(goes_on, 0, number))) % 2 == 1


def compress(ids: np.ndarray, lengths: np.ndarray, terminals: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, symbols, and symbols per document. Pairs do not reach over documents.

    Goes on until no pair occurs ``least`` times without overlap, or the nonterminals are
    used up: they are numbered from ``terminals`` on, and no further than two bytes hold if
    the terminals leave room there.
    """
    narrow = terminals < 65536
    room = (65536 if narrow else 2**32) - terminals
    # A pair is one number of twice a symbol's width.
    kind, bits = (np.uint32, 16) if narrow else (np.uint64, 32)
    # What is left of the ids, and where. Work goes on with the symbols of pairs that can be frequent.
    out, held = ids.astype(kind), np.ones(len(ids), bool)
    symbols, at = out.copy(), np.arange(len(ids), dtype=np.int32 if len(ids) < 2**31 else np.int64)
    starts = lengths_to_starts(lengths)
    # A table of hashed counts tells which pairs can be among the frequent ones; only
    # those are counted exactly. The slot at its end is for places without a pair that matters.
    slot = np.full(len(symbols), _SLOTS, np.intp)
    slot[:-1] = _slots(symbols[:-1] << kind(bits) | symbols[1:])
    slot[starts[1:][lengths > 0] - 1] = _SLOTS
    rules: list[tuple[int, int]] = []
    place = np.full(_SLOTS + 1, -1, np.int32)
    while len(rules) < room:
        counted = np.bincount(slot, minlength=_SLOTS + 1).astype(np.int32)
        counted[_SLOTS] = 0
        in_slot = counted.take(slot)
        # A pair that is rare stays rare, and so do all that come to stand where it stands: new symbols
        # at two places can only be alike where the old ones are.
        live = in_slot >= least
        bar = max(least, int(counted.max()) // 32)
        while True:
            often = np.flatnonzero(in_slot >= bar)
            pairs, right = symbols.take(often), symbols[1:].take(often)
            equal = np.flatnonzero(pairs == right)
            pairs <<= kind(bits)
            pairs |= right
            if len(equal):
                second = equal[_second_of_equals(often[equal])]
                often, pairs = np.delete(often, second), np.delete(pairs, second)
            distinct, counts = np.unique(pairs, return_counts=True)
            enough = counts >= bar
            distinct, counts = distinct[enough], counts[enough]
            if len(distinct) or bar == least:
                break
            # Slots shared by many rare pairs: look at all that can be frequent.
            bar = least
        left, right = (distinct >> kind(bits)).astype(np.int64), (distinct & kind((1 << bits) - 1)).astype(np.int64)
        picked = _chosen(left, right, counts, room - len(rules))
        if not picked:
            break
        # Of chosen pairs that share a slot one is replaced now, the others have their turn later.
        of_keys = _slots(distinct[picked])
        place[of_keys] = picked
        picked = np.unique(place[of_keys])
        place[of_keys] = -1
        keys = distinct[picked]
        used = _slots(keys)
        place[used] = np.arange(len(keys))
        found = place.take(slot.take(often))
        known = np.flatnonzero(found >= 0)
        known = known[keys[found[known]] == pairs[known]]
        place[used] = -1
        hit = often[known]
        new = found[known].astype(kind) + kind(terminals + len(rules))
        rules += zip(left[picked].tolist(), right[picked].tolist())
        out[at[hit]] = symbols[hit] = new
        held[at[hit + 1]] = False
        # A new symbol stands before what the second one of its pair stood before.
        slot[hit] = np.where(live[hit + 1], -1, _SLOTS)
        slot[hit - 1] = np.where(live[hit - 1], -1, _SLOTS)
        stays = live.copy()
        stays[1:] |= live[:-1]
        stays[hit] = True
        stays[hit + 1] = False
        slot[np.flatnonzero(stays & ~live)] = _SLOTS
        kept = np.flatnonzero(stays)
        symbols, slot, at = symbols.take(kept), slot.take(kept), at.take(kept)
        fresh = np.flatnonzero(slot < 0)
        slot[fresh] = _slots(symbols[fresh] << kind(bits) | symbols[fresh + 1])
    kept = np.flatnonzero(held)
    return np.array(rules, np.int64).reshape(-1, 2), out[kept].astype(np.int64), np.diff(np.searchsorted(kept, starts))


_SLOTS = 1 << 19


def _slots(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1) >> np.uint32(13)).view(np.int32)
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int32)


def expansions(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """What each nonterminal stands for, end to end, and where each one starts."""
    sizes, levels = [1] * terminals, [0] * terminals
    for a, b in rules.tolist():
        sizes.append(sizes[a] + sizes[b])
        levels.append(max(levels[a], levels[b]) + 1)
    size, level = np.array(sizes, np.int64), np.array(levels[terminals:], np.int64)
    starts = lengths_to_starts(size[terminals:])
    # The ids themselves, then what the nonterminals stand for, level by level.
    flat, first = np.arange(terminals + starts[-1]), np.r_[np.arange(terminals), terminals + starts[:-1]]
    for n in range(1, int(level.max(initial=0)) + 1):
        now = np.flatnonzero(level == n)
        left, right = rules[now].T
        to = first[terminals + now]
        flat[gather(to, size[left])] = flat[gather(first[left], size[left])]
        flat[gather(to + size[left], size[right])] = flat[gather(first[right], size[right])]
    return flat[terminals:], starts


def expanded(symbols: np.ndarray, terminals: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    table = np.concatenate([np.arange(terminals, dtype=np.uint32), flat.astype(np.uint32)])
    first = np.concatenate([np.arange(terminals), terminals + starts[:-1]])
    size = np.concatenate([np.ones(terminals, np.int64), np.diff(starts)])
    return table[gather(first[symbols], size[symbols])]


def pack_block(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, terminals: int) -> bytes:
    rules, symbols, per_doc = compress(ids, lengths, terminals)
    sizes: list[int] = []
    for a, b in rules.tolist():
        sizes.append((sizes[a - terminals] if a >= terminals else 1) + (sizes[b - terminals] if b >= terminals else 1))
    width = 2 if terminals + len(rules) <= 65536 else 4
    parts = [
        rules.astype("<u4"), np.array(sizes, "<u4"), np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"),
        lengths_to_starts(per_doc).astype("<u8"), lengths_to_starts(lengths).astype("<u8"), symbols.astype(f"<u{width}"),
    ]
    return struct.pack(HEAD, terminals, len(rules), len(doc_ids), len(symbols), width) + b"".join(p.tobytes() for p in parts)


class Block:
    """A block of a file; documents are decoded one by one or all together."""

    def __init__(self, content: bytes):
        self.terminals, n_rules, n_docs, n_symbols, width = struct.unpack_from(HEAD, content)
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).astype(np.int64).reshape(-1, 2)
        self.sizes = take("<u4", n_rules).astype(np.int64)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if n else int(x) for x, n in zip(ids, null)]
        self.first_symbol, self.first_id = take("<u8", n_docs + 1).astype(np.int64), take("<u8", n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)

    def all_ids(self) -> np.ndarray:
        return expanded(self.symbols.astype(np.int64), self.terminals, *expansions(self.rules, self.terminals))

    def ids_at(self, doc: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Ids ``start`` to ``stop`` of one document: symbols before them are skipped by their length."""
        out, seen = [], 0
        stop = int(self.first_id[doc + 1] - self.first_id[doc]) if stop is None else stop
        stack = list(map(int, self.symbols[self.first_symbol[doc] : self.first_symbol[doc + 1]][::-1]))
        while stack and seen < stop:
            s = stack.pop()
            size = int(self.sizes[s - self.terminals]) if s >= self.terminals else 1
            if seen + size <= start:
                seen += size
            elif s >= self.terminals:
                a, b = self.rules[s - self.terminals]
                stack += [int(b), int(a)]
            else:
                out.append(s)
                seen += 1
        return out


FILES = "shard int, block int, n_docs long, n_ids long, content binary"


def write_ids(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encodes all texts and writes the files; shards and blocks ascend with the document ids.

    Null texts are empty, so their only id is ``end_id``. Rows without id come first; rows that
    repeat an id follow one another in the order of their texts. An empty table gives files
    without blocks. Rows of one id can be dealt to several shards.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")).cast("binary"), F.lit(b"")).alias("content"))
    size = rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    # Large shards: a task encodes each distinct word once.
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    dealt = rows.withColumn("salt", F.xxhash64("content")).repartitionByRange(shards, "id", "salt").sortWithinPartitions("id", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(tokenizer), TaskContext.get().partitionId()
        for block, table in enumerate(merged(batches, "content", BLOCK_BYTES)):
            ids, lengths = encoder.encode(table.column("content").combine_chunks(), end_id)
            content = pack_block(table.column("id").to_pylist(), ids, lengths, max(encoder.size, end_id + 1))
            columns = [[shard], [block], [len(lengths)], [len(ids)], [content]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "block", "n_docs", "n_ids", "content"])

    dealt.select("id", "content").mapInArrow(run, FILES).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def per_document(blocks: DataFrame, schema: str, make: Callable[[np.ndarray], list]) -> DataFrame:
    """``doc_id, start, n_tokens`` of every document in the files, and what ``make`` has of its ids.

    ``start`` is the number of ids before the document in all files. Only one row per shard
    goes through one task to sum the shards before it.
    """
    sizes = blocks.select("shard", "block", "n_ids")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    offsets = in_shard.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("shard_start")).alias("offset"))
    extra = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, content in zip(*(batch.column(c) for c in ("shard", "block", "content"))):
                found = Block(content.as_py())
                ids, first = found.all_ids(), found.first_id
                n = len(found.doc_ids)
                made = list(zip(*(make(ids[a:b]) for a, b in zip(first[:-1], first[1:]))))
                columns = [pa.array(found.doc_ids, pa.int64()), pa.array([shard.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), pa.array(first[:-1]), pa.array(np.diff(first))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c) for c in made], ["doc_id", "shard", "block", "at", "n_tokens", *extra])

    rows = blocks.select("shard", "block", "content").mapInArrow(run, f"doc_id long, shard int, block int, at long, n_tokens long, {schema}")
    return rows.join(offsets, ["shard", "block"]).select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", *extra)


def digests(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files."""
    return per_document(blocks, "ids_crc32 long", lambda ids: [zlib.crc32(ids.astype("<u4").tobytes())])
