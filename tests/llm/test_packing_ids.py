"""Token ids are the tokenizer's own, and the level array survives a bound on open windows."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm.packing import UNSETTLED, SumOfSquaresPacker, UnitEncoder


def test_ids_of_random_strings():
    own, dealt = UnitEncoder(), Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(1)
    plain = list("abcXY 'tsre'llm0189  \n\t.,;!?-<|>")
    settled = [c for c in map(chr, range(0x10000)) if not UNSETTLED.search(c)]
    other = [c for c in (chr(rng.randrange(0x110000)) for _ in range(3000)) if not "\ud800" <= c <= "\udfff"]
    for _ in range(20_000):
        text = [rng.choice(plain) if rng.random() < 0.6 else rng.choice(settled if rng.random() < 0.7 else other) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.2:
            text.insert(rng.randrange(len(text)), "<|endoftext|>")
        text = "".join(text)
        assert own.encode(text).tolist() == dealt.encode(text, add_special_tokens=False).ids, text


def test_settled_characters_are_classed_alike():
    own, dealt = UnitEncoder(), Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for c in map(chr, range(0x10000)):
        if not UNSETTLED.search(c):
            assert own.encode(f"a{c}'t 1{c}").tolist() == dealt.encode(f"a{c}'t 1{c}", add_special_tokens=False).ids, hex(ord(c))


def test_a_bound_on_open_windows_cuts_items_and_keeps_the_level_array():
    rng = random.Random(4)
    packer, lengths, rows = SumOfSquaresPacker(100, most_open=3), {}, []
    for k in range(500):
        lengths[k] = rng.choice([3, 51, 52, 70, 99])
        rows += packer.add((k, 0, np.full(lengths[k], k, np.uint32), lengths[k]), lengths[k])
        assert packer.n_open <= 3 and int(packer.counts.sum()) == packer.n_open == sum(map(len, packer.open.values()))
    rows += packer.drain()
    windows, covered = defaultdict(list), defaultdict(list)
    for window, offset, (doc, start, ids, total) in rows:
        assert (ids == doc).all() and total == lengths[doc]
        windows[window].append((offset, len(ids)))
        covered[doc].append((start, len(ids)))
    for parts in (*windows.values(), *covered.values()):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert {d: sum(n for _, n in c) for d, c in covered.items()} == lengths
    assert sum(sum(n for _, n in w) < 100 for w in windows.values()) <= 1


def test_units_known_stay_within_the_bound_inside_one_text():
    """Each unit is looked up once and learned there, so a text of many units does not outgrow the memory; ids stay the same."""
    encoder, batched = UnitEncoder(most=4), UnitEncoder(most=4)
    batched.merge = None
    for text in ["one two three one", "", "four\n five six, seven eight's nine 1234 one two", "one two"]:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want and batched.encode(text).tolist() == want
        assert len(encoder.known) <= 4
