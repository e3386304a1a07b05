"""Greedy word-piece counts by a linear longest-match automaton, without building pieces."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import pieces, text_bytes


class LongestMatchCounter:
    """A trie over the vocabulary with failure links; popped[v] is the number of pieces that following v's link completes.

    Reading a word takes one pass: at a missing edge the current node's popped count is added and its failure link
    followed, so no piece is ever built and no byte is read twice. A word that cannot be covered counts as one unknown
    piece. `continuation` marks vocabulary entries that only stand inside a word (as "##" does); empty: one vocabulary
    for both places.
    """

    def __init__(self, vocabulary: Iterable[bytes], continuation: bytes = b""):
        self.edges: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                to = self.edges[node].get(byte)
                if to is None:
                    to = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    is_piece.append(False)
                node = to
            is_piece[node] = bool(node)
        inner = 0
        for byte in continuation:
            inner = self.edges[inner].setdefault(byte, len(self.edges))
            if inner == len(self.edges):
                self.edges.append({})
                is_piece.append(False)
        self.inner = inner
        none = -1
        self.fail, self.popped = [none] * len(self.edges), [0] * len(self.edges)
        queue = deque([0] if inner == 0 else [0, inner])
        seen = set(queue)
        while queue:
            node = queue.popleft()
            for byte, to in self.edges[node].items():
                if to in seen:
                    continue
                seen.add(to)
                queue.append(to)
                if is_piece[to]:
                    self.fail[to], self.popped[to] = inner, 1
                    continue
                back, count = self.fail[node], self.popped[node]
                while back != none and byte not in self.edges[back]:
                    count += self.popped[back]
                    back = self.fail[back]
                if back != none:
                    self.fail[to], self.popped[to] = self.edges[back][byte], count

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in word:
            to = edges[node].get(byte)
            while to is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = edges[node].get(byte)
            node = to
        while node != self.inner and node != 0:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes; a word's first piece starts with a space there."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in p) for p in pieces if all(c in alphabet for c in p)]


_counters: dict[tuple, LongestMatchCounter] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, most_known: int = 500_000) -> DataFrame:
    """One row per document: id_col, n_words, n_tokens, most_tokens_in_word, words split at ASCII white space.

    Each word is read with a space before it. Null, empty and blank texts count 0. A worker keeps up to most_known word
    counts and starts anew beyond. Repeated rows are counted again; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get((vocabulary_path,))
        if counter is None:
            counter = _counters[(vocabulary_path,)] = LongestMatchCounter(byte_vocabulary(vocabulary_path))
        known: dict[bytes, int] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            result = np.zeros((3, batch.num_rows), np.int64)
            for first, last in pieces(offsets, 1 << 22):
                for row in range(first, last):
                    words = data[offsets[row] : offsets[row + 1]].tobytes().split()
                    if not words:
                        continue
                    try:
                        counts = [known[w] for w in words]
                    except KeyError:
                        if len(known) > most_known:
                            known.clear()
                        for w in words:
                            if w not in known:
                                known[w] = counter.count(b" " + w)
                        counts = [known[w] for w in words]
                    result[:, row] = len(words), sum(counts), max(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, result)], ["id", "n_words", "n_tokens", "most_tokens_in_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_tokens long, most_tokens_in_word long"
    )
    return counted.withColumnRenamed("id", id_col)
