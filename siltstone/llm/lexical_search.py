"""Ranked lexical search over documents reordered by recursive graph bisection, visited by cluster bound, stopped exactly.

Scores are whole numbers, so bounds and sums are exact. A shard holds at most about a million postings of the query
set's terms; its documents are reordered by bisection and cut into clusters, each with the greatest part that a term
adds to a score within it. For an item, the sum of these over its terms bounds every score of the cluster.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from siltstone.llm.shared import LOWER, UPPER, pieces, scratch, text_bytes, with_conf, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(UPPER, LOWER)
MULTIPLIER = 0x5851F42D4C957F2D
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
FILTER_BITS = 18


def terms_of(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").translate(FOLD)))


@cache
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte with A-Z lower-cased, and whether it belongs to a term: letters, digits and all of non-ASCII characters."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.array([bool(TERM.match(chr(b))) for b in range(128)] + [True] * 128)
    return lower, inside


@cache
def powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    up, down = np.full(least, MULTIPLIER, np.uint64), np.full(least, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each byte range, from sums over prefixes."""
    up, down = powers(1 << max(len(data), 1).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    x = (sums[ends] - sums[starts]) * down[starts]
    x ^= x >> np.uint64(32)
    return x * np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The query set's terms, numbered; a text's terms are looked up by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        # a term that shares its hash with an earlier one (never seen) is kept apart and compared in the same way
        encoded = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        ends = np.cumsum([len(b) for b in encoded], dtype=np.int64) if encoded else np.zeros(0, np.int64)
        starts = ends - np.array([len(b) for b in encoded], np.int64)
        hashes = term_hashes(data, starts, ends) if encoded else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.data, self.starts, self.sizes = data, starts, ends - starts
        self.size, self.layers = len(terms), []
        while len(order):
            first = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
            own = order[first]
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[hashes[own] >> np.uint64(64 - FILTER_BITS)] = True
            self.layers.append((hashes[own], own, seen))
            order = order[~first]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the ranges, term numbers) of ranges that are terms of the vocabulary."""
        if not len(starts) or not self.layers:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes, places, found = term_hashes(data, starts, ends), [], []
        for own, number, seen in self.layers:
            at = np.flatnonzero(seen[hashes >> np.uint64(64 - FILTER_BITS)])
            k = np.minimum(np.searchsorted(own, hashes[at]), len(own) - 1)
            term = number[k]
            hit = (own[k] == hashes[at]) & (self.sizes[term] == ends[at] - starts[at])
            at, term = at[hit], term[hit]
            if len(at):
                sizes = self.sizes[term]
                begin = np.cumsum(sizes) - sizes
                within = np.arange(sizes.sum()) - np.repeat(begin, sizes)
                same = data[np.repeat(starts[at], sizes) + within] == self.data[np.repeat(self.starts[term], sizes) + within]
                whole = np.logical_and.reduceat(same, begin)
                places.append(at[whole])
                found.append(term[whole])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64),) * 2


def query_postings(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: n counts all its terms, the arrays those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items, bounded by its bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        lower, inside = byte_tables()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for first, last in pieces(offsets, 1 << 21):
                at = offsets[first : last + 1] - offsets[first]
                own = lower[data[offsets[first] : offsets[last]]]
                term = inside[own]
                # a term never crosses texts
                begin = term & ~np.concatenate(([False], term[:-1]))
                edges = at[:-1][at[:-1] < len(own)]
                begin[edges] = term[edges]
                stop = term & ~np.concatenate((term[1:], [False]))
                stop[edges[edges > 0] - 1] = term[edges[edges > 0] - 1]
                starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
                rows = np.searchsorted(at, starts, side="right") - 1
                n = np.bincount(rows, minlength=last - first)
                places, terms = vocabulary.find(own, starts, ends)
                key, tf = np.unique(rows[places] * max(vocabulary.size, 1) + terms, return_counts=True)
                row, terms = key // max(vocabulary.size, 1), key % max(vocabulary.size, 1)
                cuts = pa.array(np.searchsorted(row, np.arange(last - first + 1)), pa.int32())
                some = pa.array(n > 0)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(terms.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))],
                    ["id", "n", "terms", "tfs"],
                )
                yield out.filter(some)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def document_frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands: each task counts its own, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "n"])

    out = np.zeros(size, np.int64)
    sums = postings.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out


def bisected(indptr: np.ndarray, terms: np.ndarray, order: np.ndarray, size: int, leaf: int, rounds: int = 10) -> list[np.ndarray]:
    """Documents in clusters of at most `leaf`, by recursive bisection of the document-term graph.

    A half is refined by swapping the documents whose moves shorten most the estimated gaps of the terms' postings,
    in pairs, as long as a pair gains.
    """
    done, open_ = [], [order]
    log = np.log2(np.arange(1, len(order) + 4, dtype=np.float64))  # log[k] = log2(k + 1)
    while open_:
        docs = open_.pop()
        if len(docs) <= leaf:
            done.append(docs)
            continue
        sizes = indptr[docs + 1] - indptr[docs]
        begin = np.cumsum(sizes) - sizes
        t = terms[np.repeat(indptr[docs] - begin, sizes) + np.arange(sizes.sum())]
        present = np.zeros(size, bool)
        present[t] = True
        t = (np.cumsum(present) - 1)[t]
        owner = np.repeat(np.arange(len(docs)), sizes)
        half = len(docs) // 2
        right = np.arange(len(docs)) >= half
        n_left, n_right, width = half, len(docs) - half, int(present.sum())
        total = np.bincount(t, minlength=width)
        cost = lambda d, n: np.maximum(d, 0) * (log[n - 1] - log[np.maximum(d, 0)])
        for _ in range(rounds):
            in_right = np.bincount(t[right[owner]], minlength=width)
            in_left = total - in_right
            now = cost(in_left, n_left) + cost(in_right, n_right)
            to_right = now - cost(in_left - 1, n_left) - cost(in_right + 1, n_right)
            to_left = now - cost(in_left + 1, n_left) - cost(in_right - 1, n_right)
            gain = np.bincount(owner, np.where(right[owner], to_left[t], to_right[t]), minlength=len(docs))
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            pairs = min(len(a), len(b))
            swaps = int((gain[a[:pairs]] + gain[b[:pairs]] > 1e-9).sum())
            if not swaps:
                break
            right[a[:swaps]], right[b[:swaps]] = True, False
        open_ += [docs[right], docs[~right]]
    return done


SHARD = "ids array<{kind}>, ranks array<int>, cluster_starts array<int>, keys array<long>, key_starts array<long>, members array<int>, parts array<int>"


def clustered_index(postings: DataFrame, df: np.ndarray, n_docs: int, n_terms: int, per_shard: int, leaf: int) -> DataFrame:
    """Shards of documents in clusters, one row each, with postings by cluster and term.

    Documents come in the order of a min-hash over the rarer half of their terms, so that those of a shard are alike to
    begin with; equal ones are dealt out by a digest, so a group of copies of any size spreads over shards.
    """
    size = len(df)
    kind = postings.schema["id"].dataType.simpleString()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        for batch in batches:
            lists = batch.column(2)
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            mark = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                t = flat[cuts[k] : cuts[k + 1]]
                mark[k] = mixed[t[np.argsort(df[t], kind="stable")[: (len(t) + 1) // 2]]].min()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark)], [*batch.schema.names, "mark"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        column = lambda c: table.column(c).chunk(0)
        ids, n = column("id"), column("n").to_numpy()
        indptr = np.concatenate(([0], np.cumsum(column("terms").value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        terms, tfs = (column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
        clusters = bisected(indptr, terms, np.arange(table.num_rows), size, leaf)
        place = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        by_id = np.empty(len(place), np.int64)
        by_id[place] = np.arange(len(place))
        order = np.concatenate([c[np.argsort(by_id[c])] for c in clusters])  # within a cluster by id, so that places stand for ids in ties
        cluster = np.repeat(np.arange(len(clusters)), [len(c) for c in clusters])
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        owner = np.repeat(np.arange(table.num_rows), np.diff(indptr))
        m = 50 + 50 * n * n_docs // n_terms
        parts = 1_000_000_000 * tfs // (1000 * tfs + 20 * m[owner])
        key = cluster[position[owner]] * size + terms
        sort = np.lexsort((position[owner], key))
        keys, starts = np.unique(key[sort], return_index=True)
        wrap = lambda x, t: pa.array([x], pa.list_(t))
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order))), wrap(by_id[order].astype(np.int32), pa.int32()), wrap(np.searchsorted(cluster, np.arange(len(clusters) + 1)).astype(np.int32), pa.int32()),
             wrap(keys, pa.int64()), wrap(starts, pa.int64()), wrap(position[owner][sort].astype(np.int32), pa.int32()), wrap(parts[sort].astype(np.int32), pa.int32())],
            ["ids", "ranks", "cluster_starts", "keys", "key_starts", "members", "parts"],
        )

    some = postings.where(F.size("terms") > 0)
    shards = max(1, -(-int(df.sum()) // per_shard))
    dealt = some.mapInArrow(marked, f"id {kind}, n long, terms array<int>, tfs array<int>, mark long")
    dealt = dealt.repartitionByRange(shards, "mark", F.xxhash64("id", "n", "terms"))
    return dealt.drop("mark").mapInArrow(build, SHARD.format(kind=kind))


class Items(NamedTuple):
    """A block of items: their terms' numbers end to end, where each item's begin, and every term's weight."""

    ids: list
    terms: np.ndarray
    starts: np.ndarray
    weights: np.ndarray


class Shard:
    """One shard in memory: its clusters, their bounds for a block of items, and exact scores."""

    def __init__(self, row: dict, size: int) -> None:
        self.size = size
        self.ids, self.ranks, self.clusters, self.members = row["ids"], row["ranks"], row["cluster_starts"], row["members"]
        self.parts, self.keys = row["parts"].astype(np.int64), row["keys"]
        self.starts = np.append(row["key_starts"], len(self.members))
        self.most = np.maximum.reduceat(self.parts, row["key_starts"])
        self.n = len(self.clusters) - 1

    def bounds(self, items: Items, first: int, last: int) -> np.ndarray:
        """bounds[cluster, item] of items first to last - 1; every item has a term."""
        terms = items.terms[items.starts[first] : items.starts[last]]
        own = np.unique(terms)
        column = np.full(self.size, -1)
        column[own] = np.arange(len(own))
        at = column[self.keys % self.size]
        some = at >= 0
        most = np.zeros((self.n, len(own)), np.int64)
        most[self.keys[some] // self.size, at[some]] = self.most[some] * items.weights[own][at[some]]
        return np.add.reduceat(most[:, column[terms]], items.starts[first:last] - items.starts[first], axis=1)

    def scores(self, cluster: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of a cluster's documents."""
        wanted = cluster * self.size + terms
        k = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[k] == wanted
        k, weight = k[hit], weights[terms[hit]]
        sizes = self.starts[k + 1] - self.starts[k]
        at = np.repeat(self.starts[k] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        base = self.clusters[cluster]
        out = np.zeros(self.clusters[cluster + 1] - base, np.int64)
        np.add.at(out, self.members[at] - base, np.repeat(weight, sizes) * self.parts[at])
        return out


def may_be_among(a, last) -> bool:
    """Whether an id may stand at or before the last of the best at an equal score; a missing id comes last."""
    return last is None or a is not None and a <= last


def visit(shard: Shard, items: Items, known: dict[int, tuple] | None, top: int) -> Iterator[tuple[int, int, object]]:
    """(item, score, id) of documents that may be among an item's best.

    known is None: only each item's cluster of the greatest bound is scored. Otherwise known[item] is the score and id
    that stand last among its best so far (items with fewer are absent): clusters are visited from the greatest bound
    down, until no document of the next ones can reach the last of the best found so far, here or elsewhere. At an
    equal bound a cluster can only bring a smaller id; one whose least id is not is passed over.
    """
    step = max(1, (1 << 21) // (shard.n * max(1, len(items.terms) // max(1, len(items.ids)))))
    for first in range(0, len(items.ids), step):
        last = min(first + step, len(items.ids))
        bounds = shard.bounds(items, first, last)
        floor = np.array([known[k][0] if known and k in known else 1 for k in range(first, last)], np.int64)
        for j in np.flatnonzero((bounds >= floor).any(axis=0)):
            item, least = first + int(j), int(floor[j])
            terms = items.terms[items.starts[item] : items.starts[item + 1]]
            score, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
            order = np.argsort(-bounds[:, j], kind="stable")
            for c in order if known is not None else order[:1]:
                bound, head = bounds[c, j], shard.clusters[c]
                full = len(score) == top
                if bound < least or full and bound < score[-1]:
                    break
                if known and item in known and bound == least and not may_be_among(shard.ids[head], known[item][1]):
                    continue
                if full and bound == score[-1] and shard.ranks[head] > shard.ranks[place[-1]]:
                    continue
                new = shard.scores(int(c), terms, items.weights)
                at = np.flatnonzero(new >= least)
                score, place = np.append(score, new[at]), np.append(place, at + head)
                best = np.lexsort((shard.ranks[place], -score))[:top]
                score, place = score[best], place[best]
            for s, k in zip(score.tolist(), place.tolist(), strict=True):
                yield item, s, shard.ids[k]


def visited(index: DataFrame, items: Items, known: dict[int, tuple] | None, top: int, size: int) -> DataFrame:
    """(item, score, id) found by visiting every shard."""
    shared = index.sparkSession.sparkContext.broadcast((items, known))  # one block of items
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = shared.value
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ranks", "cluster_starts", "keys", "key_starts", "members", "parts")}
                row["ids"] = batch.column("ids")[k].as_py()
                found = list(visit(Shard(row, size), items, known, top))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], id_type)], ["item", "score", "id"])

    return index.mapInArrow(run, f"item int, score long, id {kind}")


def best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list]:
    """The items, in blocks of about block_bytes of text; all rows of one id are in one block."""
    own = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        yield own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, per_shard: int = 1 << 20, leaf: int = 256) -> DataFrame:
    """(item_id, rank, id_col, score): each item's `top` documents of the greatest score above 0, equal scores by id.

    Items are a stated set of queries, taken in blocks of block_bytes of text; each block reads all documents once and
    indexes its terms of all of them. Null and empty texts have no terms: such documents are not found and not counted,
    such items have no rows. Rows of one item id are one item with all their terms. Rows that share a document id are
    documents of their own, one without an id comes last among equal scores. Other columns are ignored; empty tables
    give none.
    """
    spark = docs.sparkSession
    out = None
    with scratch(spark) as keep:
        for block in item_blocks(items, item_id, item_text, block_bytes):
            found = search_block(spark, docs, block, top, id_col, text_col, per_shard, leaf, items.schema[item_id].dataType)
            if found is not None:
                found = keep(found, "search-found")
                out = found if out is None else out.unionByName(found)
    if out is None:
        kind = docs.schema[id_col].dataType.simpleString()
        out = spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, id {kind}, score long")
    return out.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_col), "score")


def search_block(spark: SparkSession, docs: DataFrame, block: list, top: int, id_col: str, text_col: str, per_shard: int, leaf: int, item_type: DataType) -> DataFrame | None:
    words: dict = {}
    for row in block:
        words.setdefault(row["item_id"], set()).update(terms_of(row["text"]))
    words = {k: sorted(t) for k, t in words.items() if t}
    names = sorted(set().union(*words.values())) if words else []
    if not names:
        return None
    number = {t: k for k, t in enumerate(names)}
    postings = written(query_postings(docs, Vocabulary(names), id_col, text_col), "search-postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = document_frequencies(postings, len(names))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    ids = list(words)
    flat = np.array([number[t] for k in ids for t in words[k]], np.int64)
    asked = Items(ids, flat, np.concatenate(([0], np.cumsum([len(words[k]) for k in ids]))).astype(np.int64), weights)
    with with_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "4096"):
        index = written(clustered_index(postings, df, n_docs, n_terms, per_shard, leaf), "search-index")
    with with_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):  # a row is a shard
        first = best_of(visited(index, asked, None, top, len(names)), top).where(F.col("rank") == top).toArrow()
        known = {r["item"]: (r["score"], r["id"]) for r in first.to_pylist()}
        found = best_of(written(visited(index, asked, known, top, len(names)), "search-hits"), top)
    named = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", IntegerType()), StructField("item_id", item_type)]))
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "id", "score")  # one block of items

