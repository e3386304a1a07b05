"""Base measures of several texts end to end against a count of each text by itself."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.kneser_ney import split_words
from siltstone.llm.quality_rules import base_measures


def alone(text: str) -> tuple[int, ...]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def together(texts: list[str]) -> list[tuple[int, ...]]:
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    return list(zip(*(m.tolist() for m in base_measures(data, offsets, *split_words(data, offsets))), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a ", "b ", "ü\n", "|", "\n", "c\x0b", " ", "中 "]), max_size=40).map("".join), max_size=6))
def test_texts_do_not_mix(texts):
    assert together(texts) == [alone(t) for t in texts]


def test_equal_texts_and_empty_ones():
    one = "one two three four five"
    texts = ["", one, one, f"{one} {one}", "", "a b c d", one]
    assert together(texts) == [alone(t) for t in texts]
    assert [m[4] for m in together(texts)] == [0, 0, 0, 10, 0, 0, 0]
    assert together([]) == [] and together(["", ""]) == [(0,) * 5] * 2
