"""Suffix-array dedup of byte strings: a difference-cover suffix sort per shard, adjacent suffixes compared.

The texts are dealt over shards by the minimizers of their 200-byte windows (see superkmers), so that all places of a
window meet in one shard; each shard sorts its suffixes by the difference-cover algorithm and marks windows that agree
with a neighbour in the suffix order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import scratch, written
from siltstone.llm.substring_dedup import RANGES, merged
from siltstone.llm.superkmers import Scheme, Texts, bodies_of, different_bodies, distinct_texts, joined_runs, one_text_a_digest, ranges_at_places, segments_of, shared_minimizers, shards, windows_of


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an array of numbers >= 1, by the difference cover {1, 2} modulo 3.

    Sort the triples at places 1 and 2 modulo 3 and name them; if names repeat, recurse on the string of names; merge
    the suffixes at places 0 modulo 3, each being one number and a sampled suffix.
    """
    n = len(text)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate((text.astype(np.int64), [0, 0, 0]))
    sigma = int(text.max()) + 1
    # place n is added to class 1 if n % 3 == 1, so that each class-1 name string ends in a name of its own
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    if sigma < 1 << 20:
        triples = (t[sample] * sigma + t[sample + 1]) * sigma + t[sample + 2]
        order = np.argsort(triples, kind="stable")
        ranked = triples[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        s = sample[order]
        new = np.concatenate(([True], (t[s[1:]] != t[s[:-1]]) | (t[s[1:] + 1] != t[s[:-1] + 1]) | (t[s[1:] + 2] != t[s[:-1] + 2])))
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    sampled = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    size = len(sample) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * size + rank[rest + 1], kind="stable")]
    # a suffix of the rest stands after the sampled ones of either class that are smaller
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[first] * size + rank[first + 1], t[rest] * size + rank[rest + 1])
    if sigma * sigma * size < 1 << 62:
        pair = lambda i: (t[i] * sigma + t[i + 1]) * size + rank[i + 2]
        before += np.searchsorted(pair(second), pair(rest))
    else:
        both = np.concatenate((second, rest))
        place = np.empty(len(both), np.int64)
        mixed = np.lexsort((rank[both + 2], t[both + 1], t[both]))
        place[mixed] = np.cumsum(mixed < len(second))
        before += place[len(second) :]
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def agree(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether `width` bytes from a and from b are equal, eight at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(len(data), "<u8", padded, strides=(1,))
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    for step in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        equal = words[a[live] + step] == words[b[live] + step]
        same[live[~equal]] = False
        live = live[equal]
    return same


def repeated(bodies: list[bytes], weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the bodies laid end to end (with a separator): do its next `width` bytes occur twice, a body counting as often as its weight? And each body's start."""
    lengths = np.array([len(b) for b in bodies], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    total = len(text)
    numbers = text.astype(np.int64) + 2
    numbers[starts + lengths] = 1
    left = np.repeat(starts + lengths, lengths + 1) - np.arange(total)  # bytes before the separator
    weight = np.repeat(weights, lengths + 1)
    order = suffix_array(numbers)
    order = order[left[order] >= width]
    flags = np.zeros(total, bool)
    if len(order):
        same = agree(text, order[1:], order[:-1], width)
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        sums = np.add.reduceat(weight[order], heads)
        flags[order[np.repeat(sums > 1, np.diff(np.append(heads, len(order))))]] = True
    return flags, starts


def shard_ranges(table: pa.Table, width: int) -> pa.Table:
    """(id, name, low, high): byte ranges of each text covered by strings that occur more than once."""
    keys, reps = table["key"].to_numpy(), table["reps"].to_numpy().astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    shared = np.add.reduceat(reps, heads) > 1
    rows = np.flatnonzero(np.repeat(shared, np.diff(np.append(heads, len(keys)))))
    if not len(rows):
        return pa.table({"id": table["id"].slice(0, 0), "name": table["name"].slice(0, 0), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
    bodies = table["body"].combine_chunks().take(pa.array(rows)).to_pylist()
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(b, len(number)) for b in bodies])
    reps = reps[rows]
    flags, starts = repeated(list(number), np.bincount(which, reps).astype(np.int64), width)
    at, n = (table[c].to_numpy()[rows].astype(np.int64) for c in ("at", "n"))
    row = np.repeat(np.arange(len(rows)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first, last = joined_runs(flags[starts[which][row] + within], row)
    owner = row[first]
    low = at[owner] + within[first]
    # the windows of a segment that repeats itself all occur twice, so its range runs to the last repeat
    high = at[owner] + within[last] + (reps[owner] - 1) * n[owner] + width
    texts = table.select(["id", "name"]).take(pa.array(rows[owner]))
    return texts.append_column("low", pa.array(low)).append_column("high", pa.array(high))


def body_answers(table: pa.Table, width: int) -> pa.Table:
    """(key, digest, low, last): runs of each different segment's windows that occur more than once."""
    n = table["n"].to_numpy().astype(np.int64)
    flags, starts = repeated(table["body"].to_pylist(), table["reps"].to_numpy(), width)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first, last = joined_runs(flags[starts[row] + within], row)
    return table.select(["key", "digest"]).take(pa.array(row[first])).append_column("low", pa.array(within[first])).append_column("last", pa.array(within[last]))


def repeated_ranges(texts: Texts, scheme: Scheme, shard_bytes: int = 2 << 20, **limits: int) -> DataFrame:
    """(id, name, low, high) over different texts."""
    shared = shared_minimizers(texts.different, texts.parts, scheme, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, shard_bytes):
            yield from shard_ranges(table, scheme.width).to_batches(max_chunksize=20_000)

    found = segments_of(shared.cold, scheme).repartition(shared.parts, "key").sortWithinPartitions("key").mapInArrow(run, RANGES)
    found = written(found, "ranges")
    if shared.crowded is not None:

        def answer_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in shards(batches, shard_bytes):
                yield from body_answers(one_text_a_digest(table), scheme.width).to_batches(max_chunksize=20_000)

        different = different_bodies(bodies_of(shared.crowded, scheme, True), shared.parts)
        answers = written(different.mapInArrow(answer_bodies, "key long, digest binary, low long, last long"), "bodies")
        hits = bodies_of(shared.crowded, scheme, False).drop("body").join(answers, ["key", "digest"])
        found = found.unionByName(ranges_at_places(hits, scheme.width, "low", "last"))
    if shared.hot is not None:

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in shards(batches, shard_bytes):
                flags, starts = repeated(one_text_a_digest(table)["body"].to_pylist(), table["reps"].to_numpy(), scheme.width)
                yield from table.select(["key", "digest"]).filter(pa.array(flags[starts])).to_batches(max_chunksize=20_000)

        # windows of hot minimizers: equal ones are combined before the shuffle, answered once, and joined to their places
        different = different_bodies(windows_of(shared.hot, scheme, True), shared.parts)
        answers = written(different.mapInArrow(answer, "key long, digest binary"), "answers")
        hits = windows_of(shared.hot, scheme, False).drop("body").join(answers, ["key", "digest"])
        found = found.unionByName(ranges_at_places(hits, scheme.width))
    return found


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, k: int = 24) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (array of removed byte ranges).

    Each byte covered by a string of `width` bytes that also starts anywhere else, in this or another document, is
    removed; overlaps count; judged on the input. Null counts as empty. Ids are whole numbers below 2^63 - 1 or null; rows
    that repeat an id are documents of their own. An empty table gives an empty result; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(removed_bytes(docs, id_col, text_col, width, k), "suffix-dedup")


def removed_bytes(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    texts = distinct_texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = repeated_ranges(texts, Scheme(width, k, False)).groupBy("id", "name").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    @F.pandas_udf("struct<n_removed: long, n_spans: long, kept_sha256: string, spans: array<struct<low: long, high: long>>>")
    def apply(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(text, ranges, strict=True):
            data = t.encode("utf-8", "surrogatepass")
            low, high = merged([x["low"] for x in r], [x["high"] for x in r])
            kept = b"".join(data[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(data)], strict=True))
            spans = [{"low": int(a), "high": int(b)} for a, b in zip(low, high, strict=True)]
            out.append((len(data) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), spans))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "spans"])

    # texts with copies are removed whole or kept whole, so only single ones are cut, and untouched ones have their digest
    single = texts.rows.where("copies = 1").select("id", "name")
    ranges = ranges.join(single, ["id", "name"], "left_semi")
    done = texts.different.join(ranges, ["id", "name"]).select("name", apply("text", "ranges").alias("r")).select("name", "r.*")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    zero = F.lit(0).cast("long")
    everything = F.array(F.struct(zero.alias("low"), F.col("n_bytes").alias("high")))
    return texts.rows.join(done, "name", "left").select(
        F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(whole, everything).otherwise(F.coalesce("spans", F.array().cast("array<struct<low:bigint,high:bigint>>"))).alias("spans"),
    )
