"""SimHash near-dedup: byte-position inverted index with count filtering, verified, joined to components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import connected_components
from siltstone.llm.shared import written

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z lower-cased); no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Two fingerprints that differ in at most 3 bits share at least 5 of 8 positional bytes, and of any 5 byte positions
#: 3 lie within the first four or within the last four: eight triples of positions index every such pair.
TRIPLES = [signed(byte_mask(p)) for half in (range(4), range(4, 8)) for p in combinations(half, 3)]


def wider(mask: int) -> list[int]:
    """Longer keys that still index every pair under this one: 3 bytes -> 5 bytes -> 5 bytes and 15 of 24 bits."""
    mask &= (1 << 64) - 1
    have = [p for p in range(8) if mask >> (8 * p) & 0xFF == 0xFF]
    rest = [p for p in range(8) if p not in have]
    if len(have) < 5:
        return [signed(mask | byte_mask(more)) for more in combinations(rest, 5 - len(have))]
    blocks = [7 << (8 * p + low) for p in rest for low in (0, 3)]  # bits 6, 7 of each byte make two blocks more
    blocks += [sum(1 << (8 * p + 6) for p in rest), sum(1 << (8 * p + 7) for p in rest)]
    return [signed(mask | sum(some)) for some in combinations(blocks, 5)]


def links_within(fps: np.ndarray, most_bits: int = 3, least_bytes: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Tally the equal positional bytes of each pair, keep pairs with at least 5, verify the bits; (node, lowest linked node) of each component found."""
    n = len(fps)
    label = np.arange(n)
    linked = np.zeros((n, n), bool)
    octets = fps.view(np.uint8).reshape(n, 8)
    for a in range(0, n, 256):
        shared = np.zeros((min(256, n - a), n), np.uint8)
        for p in range(8):
            shared += octets[a : a + 256, p][:, None] == octets[:, p][None, :]
        i, j = np.nonzero(shared >= least_bytes)
        near = np.bitwise_count(fps[a + i] ^ fps[j]) <= most_bits
        linked[a + i[near], j[near]] = True
    while True:
        lower = np.where(linked, label[None, :], n).min(axis=1)
        if (lower == label).all():
            return fps, fps[label]
        label = np.minimum(lower, label)


def near_links(distinct: DataFrame, bucket_cap: int = 1024) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of distinct fingerprints within 3 bits.

    The index key is three positional bytes. A posting list over bucket_cap is not dealt with as it is: its members are
    indexed again under longer keys, which keep every pair, down to keys that leave 9 bits and so at most 512 members.
    """

    @F.pandas_udf("array<long>")
    def longer(masks: pd.Series) -> pd.Series:
        table = {m: wider(int(m)) for m in masks.unique()}
        return masks.map(table)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fps in frame["fps"]:
                a, b = links_within(np.sort(np.asarray(fps, np.int64)).view(np.uint64))
                moved = a != b
                if moved.any():
                    yield pd.DataFrame({"a": a[moved].view(np.int64), "b": b[moved].view(np.int64)})

    entries = distinct.select("fp", F.explode(F.array(*map(F.lit, TRIPLES))).alias("mask"))
    edges = None
    for level in range(3):
        entries = entries.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        if level < 2:
            entries = written(entries, "postings") if level else entries
            sizes = entries.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
            sized = entries.join(sizes, ["mask", "key"])
            small, hot = sized.where(F.col("n") <= bucket_cap), sized.where(F.col("n") > bucket_cap)
        else:
            small, hot = entries, None
        lists = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found = lists.select("fps").mapInPandas(solve, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if hot is None:
            break
        hot = written(hot.select("fp", "mask"), "postings")
        if hot.isEmpty():
            break
        entries = hot.select("fp", F.explode(longer("mask")).alias("mask")).distinct()
    return edges


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links of at most 3 bits).

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node, so copies cost
    one row each. Repeated rows each get a row. An empty table gives an empty result; other columns are ignored.
    """
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first_id"))
    nodes = connected_components(near_links(distinct))
    classes = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    classes = written(classes, "classes")
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
