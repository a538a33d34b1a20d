import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stockloom.llm import packing
from tests.llm.edge import LONG, documents

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_places(lengths, placed, size):
    """Each piece once, gapless from 0, none beyond ``size``."""
    by = {}
    for length, sequence, offset in placed:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(x for x, _, _ in placed) == sorted(lengths)
    return len(by)


def unfolded(slots):
    return [(length, first + i, offset) for length, _, n, first, offset in slots for i in range(n)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_slots_hold_every_piece_once(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    slots = packing.plan_slots(counts, 64)
    check_places(lengths, unfolded(slots), 64)
    for x, n in counts.items():  # ranks of a length are covered from 0 without a gap
        assert sorted(r for length, rank, k, _, _ in slots if length == x for r in range(rank, rank + k)) == list(range(n))


def test_few_sequences_more_than_tokens_need():
    rng = random.Random(1)
    lengths = [min(1024, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20_000)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    used = check_places(lengths, unfolded(packing.plan_slots(counts, 1024)), 1024)
    assert used <= 1.005 * -(-sum(lengths) // 1024) + 1


def test_fit_repeats_finds_the_mix():
    rows = np.array([[3, 5, 0], [4, 4, 0], [2, 2, 4]])
    histogram = np.zeros(9)
    for repeat, row in zip([7, 2, 3], rows):
        np.add.at(histogram, row[row > 0], repeat)
    assert np.allclose(packing.fit_repeats(rows, histogram, 3000), [7, 2, 3], atol=0.01)


ROWS = [
    (None, "an unnamed text"), (1, None), (2, ""), (3, LONG), (4, "again"), (4, "again"), (5, "Größe 漢字 🙂 <|endoftext|> x"),
    (6, "word " * 1023), (7, "word " * 2047), (8, "  spaces\n\n\tand 1234567 it's"),
]


@pytest.mark.parametrize("size", [16, 1024])
def test_round_trip(spark, size):
    rows = packing.pack(documents(spark, ROWS), size=size).collect()
    check_places([r.length for r in rows], [(r.length, r.sequence_id, r.offset) for r in rows], size)
    want = sorted([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2] for _, t in ROWS)
    texts = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and (r.length == size or r.piece == 0 or r.start == 0)
        texts.setdefault(r.doc_id if r.doc_id != 4 else (4, r.sequence_id, r.offset), []).extend(ids)
    assert sorted(texts.values()) == want
    crcs = packing.pack(documents(spark, ROWS), size=size, with_ids=False).collect()
    assert sorted(crc32(r.ids) for r in rows) == sorted(r.ids for r in crcs)


def test_sequences_hold_their_pieces(spark):
    pieces = packing.pack(documents(spark, ROWS), size=64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_ids_are_those_of_tokenizers_for_all_characters(spark):
    encode = packing.encoder(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),)
    ).encode
    for lo in range(0, 0x110000, 64):
        text = "".join(f"a1{c}b  {c}{c} {c}2'{c}  ." for c in map(chr, range(lo, lo + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert encode(text, allowed_special="all") == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("least", [2, 3, 7])
def test_long_gaps_are_cut_where_matches_end(least):
    rng = random.Random(least)
    encoding = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))
    bits = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "a", "word", "7", "!", "é", "<|endoftext|>", "'s"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert packing.token_ids(encoding, text, least).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x85", "\xa0", " ", "　", " \n"])
def test_millions_of_white_characters(white):
    encoding = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))
    n = 1_000_000 // len(white)
    run = encoding._encode_single_piece
    assert packing.token_ids(encoding, white * n).tolist() == run(white * n)
    both = packing.token_ids(encoding, "x" + white * n + "y").tolist()
    assert both == [*encoding.encode("x"), *run((white * n)[:-1]), *encoding.encode(white[-1] + "y")]
    if white in " \n":
        assert both == TOKENIZER.encode("x" + white * n + "y", add_special_tokens=False).ids


def test_five_million_of_one_character_are_packed(spark):
    n = 5_000_000
    rows = [(1, " " * n), (2, "a" + "\n" * n), (3, "\t" * n + "<|endoftext|> b"), (4, "7" * n), (5, "b" * n), (6, "!" * n)]
    got = packing.pack(documents(spark, rows), with_ids=False).groupBy("doc_id").sum("length").collect()
    counts = {r[0]: r[1] for r in got}
    assert (counts[1], counts[2], counts[3]) == (n + 1, 1 + n // 2 + 1, n + 3)
    assert set(counts) == {1, 2, 3, 4, 5, 6}
