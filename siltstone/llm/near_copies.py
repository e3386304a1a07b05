"""Near copies by 5-word shingles: SimHash fingerprints in a byte-position inverted index, shared positional bytes tallied, exact Jaccard similarity decides, components join them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.components import connected_components
from siltstone.llm.shared import pieces, small_batches, text_bytes, written

WIDTH = 5
#: A fingerprint is so many words of 64 SimHash bits. Of sets of similarity 0.8 a bit differs with chance 0.15, a byte is
#: equal with chance 0.27, and no key of any word is shared with chance 5e-6.
WORDS = 96
#: The index keys of a word are three of its bytes within one half, as in op6. Sets of at most TINY shingles (of which a
#: pair's bits differ with chance up to 0.19) have all triples of bytes as keys.
TRIPLES = [p for half in (range(4), range(4, 8)) for p in combinations(half, 3)]
TRIPLES += [p for p in combinations(range(8), 3) if p not in TRIPLES]
HALVES, TINY = 8, 5
#: Words of the fingerprint that are indexed at a time, so that a shuffle stays small.
AT_ONCE = 16
#: In a posting list, the word after the indexed one differs in at most so many bits (10 of 64 at similarity 0.8; 25 or more with chance 3e-6).
MOST_BITS = 24
#: Postings of at most so many nodes are looked through at once; longer ones are passed on whole.
CROWDED = 32
#: Rounds in which nodes and keys settle on references.
VOTES = 3
#: Of a pair's positional bytes at least so many are equal (206 of 768 at similarity 0.8, with a standard deviation of 12).
LEAST_EQUAL = 96

_rng = np.random.default_rng(42)
BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
BYTES[65:91] = BYTES[97:123]  # A-Z count as a-z
PLACES = _rng.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
FACTORS = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A hash of each word's bytes, by prefix sums over `most` bytes at a time (a longer word stands alone)."""
    out = np.zeros(len(starts), np.uint64)
    up, down = powers(BASE, 0), powers(BASE, 0)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        low, n = starts[at], int(ends[stop - 1] - starts[at])
        if n > len(up):
            up, down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[data[low : low + n]] * up[:n], out=sums[1:])
        first, last = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        at = stop
    return mixed(out)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of texts end to end, and len + 1 offsets; a shorter text with words is one shingle."""
    solid = np.concatenate(([False], ~SPACES[data], [False]))
    begins, stops = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a text's edge ends a word
    begins[edges] |= solid[1:-1][edges]
    stops[edges - 1] |= solid[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.searchsorted(starts, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(bounds)
    counts = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    total = np.arange(out_offsets[-1]) + np.repeat(bounds[:-1] - out_offsets[:-1], counts)
    left = np.repeat(n, counts)
    out = np.zeros(len(total), np.uint64)
    for k in range(WIDTH):
        there = k < left
        out += np.where(there, words[np.minimum(total + k, max(len(words) - 1, 0))], 0).astype(np.uint64) * PLACES[k] if len(words) else 0
    return mixed(out), out_offsets


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, WORDS): a bit is 1 if set in over half of the set's hashes; each word has the hashes scrambled anew. No set is empty.

    Hashes stand in groups of 32 of one set. The bits of a group are counted in binary, 64 side by side: bit i of all
    counts is one word, and the halves of a group are added by the rules of a binary adder.
    """
    n = np.diff(offsets)
    groups = -(-n // 32)
    firsts = np.concatenate(([0], np.cumsum(groups)))
    place = np.arange(len(hashes)) + np.repeat(firsts[:-1] * 32 - offsets[:-1], n)
    place = place % 32 * firsts[-1] + place // 32
    x, there = np.zeros(32 * firsts[-1], np.uint64), np.zeros(32 * firsts[-1], np.uint64)
    x[place], there[place] = hashes, ~np.uint64(0)
    out = np.zeros((len(n), WORDS), np.uint64)
    for k in range(WORDS if len(n) else 0):
        x *= FACTORS[k]
        x ^= x >> np.uint64(32)
        planes = [x & there]
        while len(planes[0]) > firsts[-1]:
            half, sums, carry = len(planes[0]) // 2, [], None
            for plane in planes:
                a, b = plane[:half], plane[half:]
                odd, both = a ^ b, a & b
                if carry is None:
                    sums.append(odd)
                    carry = both
                else:
                    sums.append(odd ^ carry)
                    odd &= carry
                    both |= odd
                    carry = both
            planes = [*sums, carry]
        counts = np.unpackbits(planes[-1].view(np.uint8), bitorder="little")
        for plane in planes[-2::-1]:
            counts += counts
            counts += np.unpackbits(plane.view(np.uint8), bitorder="little")
        total = np.add.reduceat(counts.reshape(-1, 64), firsts[:-1], axis=0, dtype=np.int32)
        out[:, k] = np.packbits(total * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts, a few at a time: (first, last row, a digest of each set, the sorted distinct shingle hashes, len + 1 offsets)."""
    data, offsets = text_bytes(column)
    for first, last in pieces(offsets, 1 << 18):
        hashes, bounds = shingles(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        nodes = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=8).digest() for s in sets), np.int64)
        yield first, last, nodes, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, n, prints): a digest of the set of shingles, its size, and its fingerprint (none: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, nodes, hashes, ends in shingle_sets(batch.column(1)):
                n = np.diff(ends)
                prints = fingerprints(hashes, np.concatenate(([0], np.cumsum(n[n > 0]))))
                starts = np.concatenate(([0], np.cumsum((n > 0) * WORDS)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(nodes), pa.array(n), lists(prints.ravel(), starts)], ["id", "node", "n", "prints"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, node long, n long, prints array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes): the sets of shingles of the rows with these ids, taken from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, nodes, hashes, ends in shingle_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(nodes), lists(hashes, ends)], ["node", "hashes"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(ids, texts.id.eqNullSafe(ids.first_id), "left_semi").select("text").mapInArrow(run, "node long, hashes array<long>")


def postings(nodes: DataFrame, first: int) -> DataFrame:
    """(key, node, after): the index of AT_ONCE words from `first`: the word's place, a triple of byte positions and the bytes there; and the word after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = (batch.column(k).to_numpy() for k in range(2))
            words = batch.column(2).flatten().to_numpy().reshape(-1, WORDS)
            places = np.arange(first, min(first + AT_ONCE, WORDS))
            after = np.ascontiguousarray(words[:, (places + 1) % WORDS])
            octets = np.ascontiguousarray(words[:, places]).view(np.uint8).reshape(len(ids), len(places), 8).astype(np.int64)
            for t, (a, b, c) in enumerate(TRIPLES):
                rows = slice(None) if t < HALVES else np.flatnonzero(n <= TINY)
                some = octets[rows]
                keys = ((places * len(TRIPLES) + t) << 24) | (some[:, :, a] << 16) | (some[:, :, b] << 8) | some[:, :, c]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[rows], len(places))), pa.array(after[rows].ravel())], ["key", "node", "after"])

    return nodes.where("n > 0").select("node", "n", "prints").mapInArrow(run, "key long, node long, after long")


def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in the order of their keys, those with a possible partner under their key: one whose word after differs in at most MOST_BITS bits. Crowded lists pass whole."""
    names, held, hot = ["key", "node", "after"], None, None

    def chosen(keys: np.ndarray, after: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        keep = np.repeat(sizes > CROWDED, sizes) | (keys == hot if hot is not None else False)
        for d in range(1, min(CROWDED, int(sizes.max()))):
            pairs = np.flatnonzero(keys[d:] == keys[:-d])
            pairs = pairs[np.bitwise_count(after[pairs] ^ after[pairs + d]) <= MOST_BITS]
            keep[pairs] = keep[pairs + d] = True
        return keep

    for batch in chain_end(batches):
        columns = [np.concatenate(both) for both in zip(held, batch, strict=True)] if held and batch else batch or held
        if not columns or not len(columns[0]):
            continue
        keys = columns[0]
        last = int(np.searchsorted(keys, keys[-1])) if batch else len(keys)  # the last key's list may go on
        if batch and (len(keys) - last > CROWDED or keys[-1] == hot):
            last = len(keys)
        if last:
            keep = chosen(keys[:last], columns[2][:last].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(c[:last][keep]) for c in columns], names)
        hot = keys[-1] if last == len(keys) else None
        held = [c[last:] for c in columns]


def chain_end(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray] | None]:
    """The columns of each batch that has rows, and None at the end."""
    for batch in batches:
        if batch.num_rows:
            yield [c.to_numpy() for c in batch.columns]
    yield None


def equal_bytes(a: str, b: str) -> Column:
    """How many positional bytes of two fingerprints are equal: each byte of a word that differs leaves one bit."""

    def unequal(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for step in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, step))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(F.zip_with(a, b, unequal), F.lit(8 * WORDS), lambda total, x: total - x)


def most_common(votes: DataFrame, by: str, weight: Column) -> DataFrame:
    """(by, ref): the ref of each `by` that has most weight; of equal ones, that of the highest degree."""
    counted = votes.groupBy(by, "ref").agg(F.sum(weight).alias("k"))
    return counted.groupBy(by).agg(F.max(F.struct("k", "ref")).alias("best")).select(by, "best.ref")


def references(shared: DataFrame) -> DataFrame:
    """(ref, node): groups of nodes, named by one of them; all nodes of a key are in one group together, and in others too.

    Keys begin with their node of most partners; then nodes take the reference of most of their partners and keys that of
    most of their nodes, so that the keys of a loose group come to agree.
    """
    refs = shared.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("ref"))
    for _ in range(VOTES):
        votes = most_common(shared.select("key", "node", "m").join(refs, "key"), "node", F.col("m"))
        refs = written(most_common(shared.select("key", "node").join(votes, "node"), "key", F.lit(1)), "refs")
    found = shared.select("key", "node").join(refs, "key").select(F.col("ref.node").alias("ref"), "node").distinct()
    return found.unionByName(found.select("ref", F.col("ref").alias("node"))).distinct()


def differences(grouped: DataFrame, tenths: int) -> DataFrame:
    """(ref, node, n, w, d) of (ref, node, size, hashes), size being that of the group: n the set's size, d the shingles in
    which it differs from its group's center, the set of what is in more than half of the group's sets."""
    counted = grouped.select("ref", "size", F.explode("hashes").alias("e")).groupBy("ref", "size", "e").agg(F.count("*").alias("k"))
    centers = counted.where("2 * k > size").groupBy("ref").agg(F.collect_list("e").alias("center"))
    center = F.coalesce("center", F.array().cast("array<long>"))
    d = F.concat(F.array_except("hashes", center), F.array_except(center, "hashes"))
    found = grouped.join(centers, "ref", "left").select("ref", "node", F.size("hashes").alias("n"), d.alias("d"))
    return found.withColumn("w", (10 + tenths) * F.size("d") - (10 - tenths) * F.col("n"))


def rare_pairs(deltas: DataFrame, tenths: int) -> DataFrame:
    """(a, b), repeats allowed: of (ref, node, n, w, d, label, far, hub_w), pairs of a group that may be similar, not of one label.

    Two sets are similar if they differ in at most q (n + n') shingles, q = (10 - tenths) / (10 + tenths). They differ where
    their d differ, so their d share at least s = (w + w') / (2 (10 + tenths)), and at least |d| - n (10 - tenths) / tenths,
    as n' is at most 10 n / tenths. The hub is the node of least w; all others were held against it. One that is not
    similar to it is far and has w over -hub_w. Of a pair at least one is far, so s is over 0. With the elements of a group in
    one order, rare ones first, the first that two d share has s - 1 more behind it in each. `last` counts from the end of
    that order; what no other d has stands before all that and is left out.
    """
    sides, d, n, w, hub = 2 * (10 + tenths), F.size("d"), F.col("n"), F.col("w"), F.col("hub_w")
    least = F.greatest(F.lit(1), d - F.floor((10 - tenths) * n / tenths), F.ceil((w + hub) / sides))
    short = F.greatest(least, F.ceil((w + F.greatest(hub, 1 - hub)) / sides))
    limits = (F.when(F.col("far"), least).otherwise(short).cast("int").alias("least"), short.cast("int").alias("short"))
    each = deltas.select("ref", "node", "label", "w", "far", *limits, F.explode("d").alias("e"))
    counted = each.withColumn("df", F.count("*").over(Window.partitionBy("ref", "e"))).where("df > 1")
    ranked = counted.withColumn("last", F.row_number().over(Window.partitionBy("ref", "node").orderBy(F.desc("df"), "e")))
    rare = written(ranked.where("last >= least").select("ref", "e", "node", "label", "w", "far", "last", F.expr("last >= short").alias("brief")), "differences")
    a, b = (rare.where(of).select("ref", "e", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "w", "far", "last", "brief"))) for side, of in (("a", "far"), ("b", "brief")))
    once = "label_a <> label_b AND (node_a < node_b OR NOT far_b OR NOT brief_a)"
    both = a.join(b, ["ref", "e"]).where(f"{once} AND {sides} * least(last_a, last_b) >= w_a + w_b")
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tenths: int = 8) -> DataFrame:
    """One row per document: id_col, component_id (smallest id reachable by links of similarity at least tenths / 10).

    Similarity is the exact Jaccard similarity of the sets of 5-word shingles (A-Z lower-cased). Texts of equal sets are
    one node, texts without words too. Nodes with SimHash fingerprints that share three positional bytes of a word stand
    under one key. Two alone that share no group are compared; more are in one group, and held against its reference. Where this leaves some
    out, all are held against the node nearest to the group's majority of shingles; then two are compared only if they share rare differences from that majority, as many as every similar pair does.
    A pair with enough equal positional bytes is verified on its texts, which are read again.
    Rows repeat as given; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        marked = written(sketches(docs, id_col, text_col), "sketches")
    nodes = written(marked.groupBy("node").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("prints").alias("prints")), "nodes")
    shared = None
    for first in range(0, WORDS, AT_ONCE):
        with small_batches(spark):
            entries = postings(nodes, first).repartition("key").sortWithinPartitions("key").mapInArrow(partnered, "key long, node long, after long")
            entries = written(entries.select("key", "node"), "postings")
        shared = entries if shared is None else shared.unionByName(entries)
    shared = shared.join(shared.groupBy("key").agg(F.count("*").alias("m")), "key")
    degrees = written(shared.groupBy("node").agg(F.sum("m").alias("degree")), "degrees")
    shared = written(shared.join(degrees, "node"), "shared")

    def sets_for(wanted: DataFrame, tag: str) -> DataFrame:
        """(node, hashes) of these nodes, which may repeat."""
        ids = written(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("first_id"), f"asked-{tag}")
        with small_batches(spark):
            return written(sets_of(docs, ids, id_col, text_col).groupBy("node").agg(F.first("hashes").alias("hashes")), f"sets-{tag}")

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        """Of (a, b), the pairs of enough similarity."""
        wanted = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"pairs-{tag}")
        tallied = wanted
        for c, size, prints in (("a", "p", "x"), ("b", "q", "y")):
            tallied = tallied.join(nodes.select(F.col("node").alias(c), F.col("n").alias(size), F.col("prints").alias(prints)), c)
        able = 10 * F.least("p", "q") >= tenths * F.greatest("p", "q")
        wanted = written(tallied.where(able).where(equal_bytes("x", "y") >= LEAST_EQUAL).select("a", "b"), f"tallied-{tag}")
        sets = sets_for(wanted.select(F.explode(F.array("a", "b")).alias("node")), tag)
        both = wanted.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
        return written(counted.where(10 * F.col("common") >= tenths * (F.col("sizes") - F.col("common"))).select("a", "b"), f"links-{tag}")

    def held(rows: DataFrame, links: DataFrame, against: str) -> DataFrame:
        """The rows, with near_<against>: whether the node is linked with it, or is it."""
        sides = [f(against, "node").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
        found = rows.select("*", *sides).join(links.withColumn("link", F.lit(True)), ["a", "b"], "left")
        return found.withColumn(f"near_{against}", F.col("link").isNotNull() | (F.col("node") == F.col(against))).drop("a", "b", "link")

    members = written(references(shared.where("m > 2")), "members")
    pairs = shared.where("m = 2").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct()
    grouped = pairs.join(members.withColumnRenamed("node", "a"), "a").join(members.withColumnRenamed("node", "b"), ["ref", "b"]).select("a", "b").distinct()
    pairs = pairs.join(grouped, ["a", "b"], "left_anti")
    edges = linked(pairs.unionByName(members.select(F.col("ref").alias("a"), F.col("node").alias("b"))), "refs")
    members = held(members, edges, "ref")
    several = members.groupBy("ref").agg(F.count("*").alias("size"), F.min("near_ref").alias("closed")).where("size > 2 AND NOT closed").select("ref", "size")
    left = written(members.join(several, "ref"), "left")
    if not left.isEmpty():
        deltas = written(differences(left.join(sets_for(left, "left"), "node"), tenths), "deltas")
        hubs = deltas.groupBy("ref").agg(F.min(F.struct("w", "node")).alias("hub")).select("ref", F.col("hub.node").alias("hub"), F.col("hub.w").alias("hub_w"))
        placed = written(left.join(hubs, "ref"), "placed")
        found = linked(placed.select(F.col("hub").alias("a"), F.col("node").alias("b")), "hubs")
        placed = held(placed, found, "hub")
        joined = placed.where("near_hub AND near_ref").select("ref").distinct().withColumn("joined", F.lit(True))
        placed = placed.join(joined, "ref", "left")
        label = F.expr("CASE WHEN near_hub OR near_ref AND joined IS NOT NULL THEN hub WHEN near_ref THEN ref ELSE node END")
        placed = written(placed.select("ref", "node", label.alias("label"), (label != F.col("hub")).alias("far"), "hub_w"), "placed")
        placed = placed.join(placed.where("far").select("ref").distinct(), "ref", "left_semi")
        rest = rare_pairs(deltas.join(placed, ["ref", "node"]), tenths)
        edges = edges.unionByName(found).unionByName(linked(rest, "left"))
    labels = connected_components(edges)
    classes = written(nodes.join(labels, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component")), "classes")
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "component").select("node", "component_id")
    return marked.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "component_id")
