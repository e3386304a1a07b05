"""Substring dedup of word windows: an FM-index per shard answers which windows stand in an earlier document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.fm_index import FMIndex, window_intervals
from siltstone.llm.shared import scratch, written
from siltstone.llm.superkmers import Scheme, Texts, bodies_of, different_bodies, distinct_texts, joined_runs, one_text_a_digest, ranges_at_places, segments_of, shared_minimizers, shards, windows_of

RANGES = "id long, name binary, low long, high long"


def earliest(bodies: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of space-joined words: the least owner of each word's next window (2^63 - 1: no window), text starts and lengths.

    All texts are indexed; the same texts are streamed through backward search, and each window's interval of the
    suffix order covers all its occurrences in the shard.
    """
    words = [b.split(b" ") for b in bodies]
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    number: dict[bytes, int] = {}
    sequence = np.zeros(int((lengths + 1).sum()), np.int64)
    for at, text in zip(starts.tolist(), words, strict=True):
        sequence[at : at + len(text)] = [number.setdefault(w, len(number) + 1) for w in text]
    index = FMIndex(sequence, width, np.repeat(owners, lengths + 1))
    low, high = window_intervals(index, sequence, starts, lengths, width)
    found = high > low
    result = np.full(len(sequence), np.iinfo(np.int64).max)
    result[found] = index.least_owners(low[found])
    return result, starts, lengths


def shard_intervals(table: pa.Table, width: int) -> pa.Table:
    """(id, name, low, high): word ranges of each document that its windows with an earlier owner cover."""
    keys, ids = table["key"].to_numpy(), table["id"].to_numpy()
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    shared = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
    rows = np.flatnonzero(np.repeat(shared, np.diff(np.append(heads, len(keys)))))
    if not len(rows):
        return pa.table({"id": table["id"].slice(0, 0), "name": table["name"].slice(0, 0), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
    bodies = table["body"].combine_chunks().take(pa.array(rows)).to_pylist()
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(b, len(number)) for b in bodies])
    ids = ids[rows]
    names = table["name"].combine_chunks().take(pa.array(rows))
    owners = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(owners, which, ids)
    least, starts, _ = earliest(list(number), owners, width)
    at, n, reps = (table[c].to_numpy()[rows].astype(np.int64) for c in ("at", "n", "reps"))
    # one entry for each window of each row
    total = int(n.sum())
    row = np.repeat(np.arange(len(rows)), n)
    within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    first, last = joined_runs(least[starts[which][row] + within] < ids[row], row)
    owner = row[first]
    # a segment has fewer windows than a window has words, so the ranges of its repeats join
    low, high = at[owner] + within[first], at[owner] + within[last] + (reps[owner] - 1) * n[owner] + width
    return pa.table({"id": pa.array(ids[owner]), "name": names.take(pa.array(owner)), "low": low, "high": high})


def body_answers(table: pa.Table, width: int) -> pa.Table:
    """(key, digest, low, last, least): runs of each different segment's windows that have the same least owner."""
    n = table["n"].to_numpy().astype(np.int64)
    least, starts, _ = earliest(table["body"].to_pylist(), table["id"].to_numpy(), width)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    least = least[starts[row] + within]
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (least[1:] != least[:-1]))))
    last = within[np.append(head[1:] - 1, len(row) - 1)]
    named = table.select(["key", "digest"]).take(pa.array(row[head]))
    return named.append_column("low", pa.array(within[head])).append_column("last", pa.array(last)).append_column("least", pa.array(least[head]))


def covered(texts: Texts, scheme: Scheme, shard_bytes: int = 4 << 20, **limits: int) -> DataFrame:
    """(id, name, low, high) over different texts: ranges of words in windows that start in a text of a smaller id."""
    shared = shared_minimizers(texts.different, texts.parts, scheme, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, shard_bytes):
            yield from shard_intervals(table, scheme.width).to_batches(max_chunksize=20_000)

    found = segments_of(shared.cold, scheme).repartition(shared.parts, "key").sortWithinPartitions("key").mapInArrow(run, RANGES)
    found = written(found, "ranges")
    if shared.crowded is not None:

        def answer_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in shards(batches, shard_bytes):
                yield from body_answers(one_text_a_digest(table), scheme.width).to_batches(max_chunksize=20_000)

        different = different_bodies(bodies_of(shared.crowded, scheme, True), shared.parts)
        answers = written(different.mapInArrow(answer_bodies, "key long, digest binary, low long, last long, least long"), "bodies")
        hits = bodies_of(shared.crowded, scheme, False).drop("body").join(answers, ["key", "digest"]).where("least < id")
        found = found.unionByName(ranges_at_places(hits, scheme.width, "low", "last"))
    if shared.hot is not None:

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in shards(batches, shard_bytes):
                least, starts, _ = earliest(one_text_a_digest(table)["body"].to_pylist(), table["id"].to_numpy(), scheme.width)
                yield from table.select(["key", "digest"]).append_column("least", pa.array(least[starts])).to_batches(max_chunksize=20_000)

        # windows of hot minimizers: equal ones are combined before the shuffle, answered once, and joined to their places
        different = different_bodies(windows_of(shared.hot, scheme, True), shared.parts)
        answers = written(different.mapInArrow(answer, "key long, digest binary, least long"), "answers")
        hits = windows_of(shared.hot, scheme, False).drop("body").join(answers, ["key", "digest"]).where("least < id")
        found = found.unionByName(ranges_at_places(hits, scheme.width))
    return found


def merged(lows, highs) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges, as sorted disjoint ranges."""
    order = np.argsort(lows, kind="stable")
    low, high = np.asarray(lows)[order], np.maximum.accumulate(np.asarray(highs)[order])
    new = np.concatenate(([True], low[1:] > high[:-1]))
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:] - 1, len(low) - 1)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, k: int = 10) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256, spans (array of removed word ranges).

    Words are runs of what is not ASCII white space; each word in a window of `width` words that also starts in a
    document with a smaller id is removed, judged on the input. Ids are whole numbers below 2^63 - 1. Null and empty texts
    have no words. A null id counts as larger than all others, and rows of one id, or without one, are not smaller than
    each other: they do not remove each other's words. An empty table gives an empty result; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(removed_words(docs, id_col, text_col, width, k), "substring-dedup")


def removed_words(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    texts = distinct_texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = covered(texts, Scheme(width, k, True)).groupBy("id", "name").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    @F.pandas_udf("struct<n_words: long, spans: array<struct<low: long, high: long>>, n_removed: long, kept_sha256: string>")
    def apply(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(text, ranges, strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            spans = []
            if r is not None and len(r):
                low, high = merged([x["low"] for x in r], [x["high"] for x in r])
                spans = [{"low": int(a), "high": int(b)} for a, b in zip(low, high, strict=True)]
                kept = [w for a, b in zip([0, *high.tolist()], [*low.tolist(), len(words)], strict=True) for w in words[a:b]]
            else:
                kept = words
            out.append((len(words), spans, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "spans", "n_removed", "kept_sha256"])

    done = texts.different.join(ranges, ["id", "name"], "left").select("name", apply("text", "ranges").alias("r")).select("name", "r.*")
    whole = (F.col("id") != F.col("rep")) & (F.col("n_words") >= width)  # a later copy: every window starts in the first
    everything = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_words").alias("high")))
    return texts.rows.join(done, "name").select(
        F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, everything).otherwise(F.col("spans")).alias("spans"),
    )
