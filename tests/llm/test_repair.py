import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldscan.llm import repair
from fieldscan.llm.common import Words, new_folder
from tests.llm.conftest import EDGES

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["Öung. ÄÖÜ ǅungla Ǆ ẞß ſt ﬁn ªº ЖИЗНЬ, ΣΑΣ ΑΣ. İI ıi 漢字", "It's 5 o'clock <|endoftext|>x", "a\x1cb\x85c d e", "ÄÖ Ü ß é é q́ ́", "don't WE'LL ''s 's", "!!«»!! a-b_c 12345 １２", "​﻿ x\x00y", "İstanbul ΑΣ ΣΑΣ", "<|startoftext|><|"]


def test_words_encode_as_whole_texts():
    encoder, whole = repair.Encoder(WORDS), Tokenizer.from_file(WORDS)
    assert encoder.by_word and not repair.Encoder(BYTES).by_word

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(ODD), st.text(alphabet="abAZ '<|>!é\n\t09ſ́", max_size=20)), max_size=4))
    def same(texts):
        ids, lengths = encoder.encode([t.encode() for t in texts])
        expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])

    same()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(2, 9))
def test_blocks_come_back_and_documents_are_found(seed, n_docs, alphabet):
    rng = random.Random(seed)
    lists = [[rng.randrange(alphabet) for _ in range(rng.randrange(80))] for _ in range(n_docs)]
    ids, lengths = np.array(sum(lists, []), np.int64), np.array([len(x) for x in lists])
    rules, symbols, _ = repair.compress(ids, lengths, alphabet, least=2)
    assert len(symbols) + 2 * len(rules) <= len(ids) + len(rules) * 2
    block = repair.Block(repair.pack_block([None, *range(n_docs - 1)], ids, lengths, alphabet))
    assert block.all_ids().tolist() == ids.tolist() and block.doc_ids[0] is None
    k = rng.randrange(n_docs)
    assert block.ids_at(k) == lists[k] and block.ids_at(k, 3, 17) == lists[k][3:17]


def test_frequent_pairs_shrink_a_block():
    ids = np.array([5, 6, 7, 8] * 5000)
    rules, symbols, per_doc = repair.compress(ids, np.array([10_000, 10_000]), 10)
    assert len(symbols) < len(ids) / 3 and per_doc.sum() == len(symbols)


def test_files_hold_every_text_in_order(spark, docs):
    rows = EDGES + [(100 - i, t) for i, t in enumerate(ODD)] + [(i, f"text {i} of many") for i in range(200, 260)]
    path = new_folder(spark, "test-ids")
    repair.write_ids(docs(rows), WORDS, path)
    whole = Tokenizer.from_file(WORDS)
    lists = {(i, t): [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = repair.digests(repair.read_blocks(spark, path)).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((i, len(lists[i, t]), crc(lists[i, t])) for i, t in rows), key=str)
    ordered = sorted(got, key=lambda r: (r["start"]))
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    assert [r["doc_id"] for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    empty = new_folder(spark, "test-ids")
    repair.write_ids(docs([]), WORDS, empty)
    assert repair.digests(repair.read_blocks(spark, empty)).collect() == []


def most_frequent(symbols, per_doc):
    """How often the most frequent pair occurs without overlap."""
    counts, at = {}, 0
    for n in per_doc:
        ends = {}
        for i in range(at, at + n - 1):
            pair = (symbols[i], symbols[i + 1])
            if ends.get(pair, -1) != i:
                ends[pair] = i + 1
                counts[pair] = counts.get(pair, 0) + 1
        at += n
    return max(counts.values(), default=0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 30), st.integers(1, 9), st.integers(2, 8))
def test_no_frequent_pair_is_left(seed, n_docs, alphabet, least):
    rng = random.Random(seed)
    lists = [[min(rng.randrange(alphabet), rng.randrange(alphabet)) for _ in range(rng.randrange(200))] for _ in range(n_docs)]
    ids, lengths = np.array(sum(lists, []), np.int64), np.array([len(x) for x in lists])
    rules, symbols, per_doc = repair.compress(ids, lengths, alphabet, least=least)
    assert most_frequent(symbols.tolist(), per_doc.tolist()) < least
    assert repair.expanded(symbols, alphabet, *repair.expansions(rules, alphabet)).tolist() == ids.tolist()


def test_a_repeated_id_does_not_bar_other_pairs():
    ids = np.array([3] * 100_001 + [4, 5, 6, 7, 8, 9] * 50)
    rules, symbols, per_doc = repair.compress(ids, np.array([100_001, 300]), 10)
    assert len(symbols) < 40 and most_frequent(symbols.tolist(), per_doc.tolist()) < repair.LEAST_COUNT
    block = repair.Block(repair.pack_block([1, 2], ids, np.array([100_001, 300]), 10))
    assert block.all_ids().tolist() == ids.tolist() and block.ids_at(1, 3, 9) == [7, 8, 9, 4, 5, 6]


def test_words_forgotten_are_learned_again(monkeypatch):
    monkeypatch.setattr(repair, "MEMO_WORDS", 5)
    encoder, whole = repair.Encoder(WORDS), Tokenizer.from_file(WORDS)
    for k in range(6):
        texts = [f" One two{k}, thrée{k % 2} Öl. it's <|x ", "", f"two{k} One! \x0b endé.{k}"]
        ids, lengths = encoder.encode([t.encode() for t in texts], 1)
        expected = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])
    assert len(encoder.memo) < 20


def test_words_are_split_like_bytes():
    texts = [b"", b" ", b"a b", b" b\tc\x0b ", b"\x0c\x1c\x85 \xc3\xa9\r\n", b"a"]
    lists = [t.split() for t in texts]
    for column in (pa.array(texts, pa.binary()), pa.array([b"x y", *texts], pa.binary())[1:]):
        view = Words.split(column)
        assert [[view.distinct[c] for c in view.codes[a:b]] for a, b in zip(view.starts[:-1], view.starts[1:])] == lists
        assert view.lengths.tolist() == list(map(len, lists)) and len(set(view.distinct)) == len(view.distinct)


def test_a_worker_keeps_its_encoder():
    """Before, each task loaded the tokenizer and learned all words anew."""
    assert repair.encoder_of(WORDS) is repair.encoder_of(WORDS)


def test_letters_of_two_bytes_encode_as_whole_texts():
    encoder, whole = repair.Encoder(WORDS), Tokenizer.from_file(WORDS)
    chars = [chr(c) for c in (*range(0x3000), 0x1F600, 0xFB01, 0x1E9E) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c} a{c}B É{c}1,{c}" for c in chars[k : k + 256]) for k in range(0, len(chars), 256)]
    ids, lengths = encoder.encode([t.encode() for t in texts])
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])


def test_parts_of_new_words_are_not_learned_again(monkeypatch):
    """Before, each new word was parted and tokenized, and a word with a letter beyond ASCII went through the whole chain."""
    encoder = repair.Encoder(WORDS)
    encoder.encode(["été Été voilà 1 2 , ### $$$ жизнь".encode()])
    learned = []
    monkeypatch.setattr(encoder, "_learn", lambda parts, kinds: learned.append(parts))
    text = "Été### voilà,12 Été$$$voilà жизнь2été"
    assert encoder.encode([text.encode()])[0].tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert learned == []


def test_places_of_rare_pairs_are_left_alone(monkeypatch):
    """Before, each round went over all symbols and hashed the pairs around each replaced one."""
    ids = np.array([x for k in range(1000) for x in (10 + 2 * k, 5, 6, 11 + 2 * k)])
    hashed, slots = [], repair._slots
    monkeypatch.setattr(repair, "_slots", lambda pairs: hashed.append(len(pairs)) or slots(pairs))
    rules, symbols, per_doc = repair.compress(ids, np.array([4000]), 3000)
    assert rules.tolist() == [[5, 6]] and len(symbols) == per_doc.sum() == 3000
    assert sum(hashed) < 4100
    assert repair.expanded(symbols, 3000, *repair.expansions(rules, 3000)).tolist() == ids.tolist()


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(repair, "_hashes", lambda parts: np.full(len(parts), 7, np.uint64))
    encoder, whole = repair.Encoder(WORDS), Tokenizer.from_file(WORDS)
    for text in ("one two three", "three, one four", "two it's three five one"):
        assert encoder.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
