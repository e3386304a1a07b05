"""Content-defined sharding of all windows of W units: the scheme by which equal windows meet in one shard.

A window's minimizer is the k-gram in it with the least hash, the leftmost of equals. Equal windows have equal
minimizers, so shards by minimizer hold all places of a window. Neighbouring windows mostly share their minimizer;
such a run is sent as one segment, so a text is sent about 3.3 times, whatever W. Of minimizers that stand in very many
segments, equal segments are combined first and joined back to their places (see bodies_of); those that stand in very
many different segments are dealt by whole windows instead, combined before they are shuffled (see windows_of).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bucketed, pieces, text_bytes, written

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
SEGMENTS = "key long, id long, name binary, at int, n int, reps int, body binary"
#: The id of rows without one: the largest.
LAST = (1 << 63) - 1
#: Bytes of text in a bucket or a shuffle partition, where these are more than spark.sql.shuffle.partitions.
PART_BYTES = 256 << 20


@dataclass(frozen=True)
class Scheme:
    """width: units in a window; k: units in a minimizer; words: units are words, else bytes."""

    width: int
    k: int
    words: bool


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """64-bit hashes of any slices of a byte array, after one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(getattr(Hasher, "up", ())) < n + 1:
            Hasher.up, Hasher.down = powers(BASE, n), powers(INVERSE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hasher.up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * Hasher.down[starts]
        x ^= (ends - starts).astype(np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - span : width - span + n])


def units(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, unit starts, unit ends, first unit of each text and the end). Texts of words are first joined by single spaces."""
    if not words:
        at = np.arange(len(data))
        return data, at, at + 1, offsets
    texts = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    joined = b" ".join(b" ".join(t) for t in texts if t)
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data)) if len(data) else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return data, starts, ends, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


@dataclass
class Segments:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # first window of each segment, as a unit number in data
    counts: np.ndarray  # windows in it
    keys: np.ndarray  # its minimizer's hash
    rows: np.ndarray  # the text it lies in
    begins: np.ndarray  # first unit of each text
    hasher: Hasher

    def stops(self, scheme: Scheme) -> np.ndarray:
        return self.ends[self.firsts + self.counts + scheme.width - 2]

    def hashes(self, scheme: Scheme) -> np.ndarray:
        return self.hasher(self.starts[self.firsts], self.stops(scheme))


def segments(data: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> Segments | None:
    data, starts, ends, begins = units(data, offsets, scheme.words)
    n, w = len(starts), scheme.width - scheme.k + 1
    if n < scheme.width:
        return None
    hasher = Hasher(data)
    grams = hasher(starts[: n - scheme.k + 1], ends[scheme.k - 1 :])
    packed = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(packed, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(least)]
    inside = np.arange(len(least)) + scheme.width <= begins[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    firsts = np.flatnonzero(new & inside)  # a text's windows that fit come first, so a run begins inside
    if not len(firsts):
        return None
    fits = np.concatenate(([0], np.cumsum(inside)))
    stops = np.append(np.flatnonzero(new), len(least))
    counts = fits[stops[np.searchsorted(stops, firsts, side="right")]] - fits[firsts]
    return Segments(data, starts, ends, firsts, counts, grams[least[firsts]], row[firsts], begins, hasher)


def runs_of_equals(s: Segments, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Segments that repeat their predecessor's bytes (periodic text) join it: kept segments, repeats of each."""
    a, b = s.starts[s.firsts], s.stops(scheme)
    same = np.zeros(len(s.firsts), bool)
    near = (s.firsts[1:] == s.firsts[:-1] + s.counts[:-1]) & (s.counts[1:] == s.counts[:-1]) & (s.rows[1:] == s.rows[:-1]) & (s.keys[1:] == s.keys[:-1])
    for k in np.flatnonzero(near) + 1:
        same[k] = s.data[a[k] : b[k]].tobytes() == s.data[a[k - 1] : b[k - 1]].tobytes()
    keep = np.flatnonzero(~same)
    return keep, np.diff(np.append(keep, len(same)))


def binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def batch_of(ids: pa.Array, names: pa.Array, rows: np.ndarray, keys, at, n, reps, data: np.ndarray, a: np.ndarray, b: np.ndarray, with_body: bool = True) -> pa.RecordBatch:
    lengths = b - a if with_body else np.zeros(len(a), np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    # gather all bodies at once: each output byte's place in data
    places = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], lengths)
    which = pa.array(rows)
    columns = [pa.array(np.ascontiguousarray(keys).view(np.int64)), ids.take(which), names.take(which), *(pa.array(np.asarray(x, np.int32)) for x in (at, n, reps)), binary(offsets, data[places].tobytes())]
    return pa.RecordBatch.from_arrays(columns, ["key", "id", "name", "at", "n", "reps", "body"])


def different_slices(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which of the different slices data[a:b] each one is, by their bytes, and the different ones."""
    whole = data.tobytes()
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(whole[x:y], len(number)) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
    return which, list(number)


def digests(slices: list[bytes]) -> pa.Array:
    return binary(np.arange(len(slices) + 1) * 16, b"".join(blake2b(x, digest_size=16).digest() for x in slices))


def one_text_a_digest(table: pa.Table) -> pa.Table:
    """Rows of different bodies, all of a key together: that no two of a key have the same 128-bit digest, by which places are joined."""
    named = set(zip(table["key"].to_pylist(), table["digest"].to_pylist(), strict=True))
    if len(named) < table.num_rows:
        raise RuntimeError("two different texts have one 128-bit digest")
    return table


def mapped(texts: DataFrame, schema: str, per_piece: Callable, piece_bytes: int = 1 << 22) -> DataFrame:
    """mapInArrow over (id, name, text[, keys]), a few MB of whole texts at a time; per_piece also gets the sorted keys of its texts."""
    keyed = "keys" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for first, last in pieces(offsets, piece_bytes):
                keys = np.unique(batch.column(3).slice(first, last - first).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) if keyed else None
                ids, names = (batch.column(k).slice(first, last - first) for k in (0, 1))
                for out in per_piece(ids, names, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], keys):
                    for at in range(0, out.num_rows, 20_000):
                        yield out.slice(at, 20_000)

    return texts.select("id", "name", "text", *(["keys"] if keyed else [])).mapInArrow(run, schema)


@dataclass
class Shared:
    """Minimizers that stand in more than one segment, and the texts that hold them.

    Each is a table (id, name, text, keys) with the keys of one kind that a text holds. cold: minimizers in few segments.
    crowded: those whose segments alone would fill more than a quarter of a mean shuffle partition (and there are more
    than `least`), so there are at most `share` = 4 x partitions of them. hot: crowded ones whose different segments still
    would. crowded and hot are None where there are none.
    """

    cold: DataFrame
    crowded: DataFrame | None
    hot: DataFrame | None
    parts: int


def shared_minimizers(texts: DataFrame, parts: int, scheme: Scheme, least: int = 4_000, share: int | None = None) -> Shared:
    """Count minimizers first, from hashes alone, so that segments found nowhere else are never sent with their bytes.

    Here hashes only choose between ways that have the same result.
    """

    def per_piece(ids, names, data, offsets, _):
        s = segments(data, offsets, scheme)
        if s is not None:
            keep, reps = runs_of_equals(s, scheme)
            which = pa.array(s.rows[keep])
            yield pa.RecordBatch.from_arrays([ids.take(which), names.take(which), *(pa.array(x.view(np.int64)) for x in (s.keys[keep], s.hashes(scheme)[keep])), pa.array(reps.astype(np.int64))], ["id", "name", "key", "hash", "reps"])

    places = written(mapped(texts, "id long, name binary, key long, hash long, reps long", per_piece), "places")
    counts = written(places.groupBy("key").agg(F.count("*").alias("n"), F.sum("reps").alias("reps")).where("reps > 1"), "minimizers")
    share = share or 4 * parts
    cut = max(least, places.count() // share)
    many = counts.where(F.col("n") > cut).select("key")
    pairs = places.select("id", "name", "key")

    def with_keys(pairs: DataFrame) -> DataFrame:
        return texts.join(pairs.groupBy("id", "name").agg(F.collect_set("key").alias("keys")), ["id", "name"])

    def holding(keys: DataFrame) -> DataFrame | None:
        return None if keys.isEmpty() else with_keys(pairs.join(F.broadcast(keys), "key", "left_semi"))

    # at most `share` crowded keys, so they may be broadcast; they leave before the join that brings the others together
    if some := not many.isEmpty():
        different = places.join(F.broadcast(many), "key", "left_semi").select("key", "hash").distinct().groupBy("key").count()
        many = written(different.select("key", (F.col("count") > cut).alias("hot")), "crowded")
    cold = pairs.join(F.broadcast(many.select("key")), "key", "left_anti") if some else pairs
    cold = cold.join(counts.where(F.col("n") <= cut).select("key"), "key", "left_semi")
    return Shared(with_keys(cold), *((holding(many.where(kind).select("key")) if some else None) for kind in ("not hot", "hot")), parts)


def is_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


def segments_of(cold: DataFrame, scheme: Scheme) -> DataFrame:
    """One row per segment whose minimizer is among its text's keys; `at` counts units from the text's start."""

    def per_piece(ids, names, data, offsets, wanted):
        s = segments(data, offsets, scheme)
        if s is None:
            return
        keep, reps = runs_of_equals(s, scheme)
        some = is_in(s.keys[keep], wanted)
        keep, reps = keep[some], reps[some]
        first, n, rows = s.firsts[keep], s.counts[keep], s.rows[keep]
        yield batch_of(ids, names, rows, s.keys[keep], first - s.begins[rows], n, reps, s.data, s.starts[first], s.ends[first + n + scheme.width - 2])

    return mapped(cold, SEGMENTS, per_piece)


def first_of_equals(which: np.ndarray, ids: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row with the least id of each different slice, in their order, and the slice's summed reps."""
    order = np.lexsort((ids, which))
    head = np.flatnonzero(np.diff(which[order], prepend=-1))
    return order[head], np.add.reduceat(reps[order], head) if len(head) else reps[:0]


def bodies_of(crowded: DataFrame, scheme: Scheme, with_body: bool) -> DataFrame:
    """Segments whose minimizer is among its text's keys, with the digest of their bytes, which names equal ones.

    Without bodies, one row per segment: its place. With bodies, equal segments of a piece of texts become one row, at
    its least id and with the summed reps.
    """

    def per_piece(ids, names, data, offsets, wanted):
        s = segments(data, offsets, scheme)
        if s is None:
            return
        keep, reps = runs_of_equals(s, scheme)
        some = is_in(s.keys[keep], wanted)
        keep, reps = keep[some], reps[some]
        which, different = different_slices(s.data, s.starts[s.firsts[keep]], s.stops(scheme)[keep])
        named = digests(different)
        if with_body:
            one, reps = first_of_equals(which, ids.to_numpy()[s.rows[keep]], reps)
            keep, which = keep[one], which[one]
        first, n, rows = s.firsts[keep], s.counts[keep], s.rows[keep]
        out = batch_of(ids, names, rows, s.keys[keep], first - s.begins[rows], n, reps, s.data, s.starts[first], s.ends[first + n + scheme.width - 2], with_body)
        yield out.append_column("digest", named.take(pa.array(which)))

    return mapped(crowded, SEGMENTS + ", digest binary", per_piece)


def different_bodies(bodies: DataFrame, parts: int) -> DataFrame:
    """(key, digest, body, id, n, reps): one row per different body of a key, compared by bytes, at its least id and with the summed reps; sorted by key."""
    found = bodies.groupBy("key", "digest", "body").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.sum("reps").alias("reps"))
    return found.repartition(parts, "key").sortWithinPartitions("key")


def ranges_at_places(places: DataFrame, width: int, low: str = "0", last: str = "0") -> DataFrame:
    """(id, name, low, high) of windows low to last of segments; a segment that repeats itself covers all up to its last repeat."""
    return places.selectExpr("id", "name", f"cast(at + {low} as long) AS low", f"at + (cast(reps as long) - 1) * n + {last} + {width} AS high")


def windows_of(hot: DataFrame, scheme: Scheme, with_body: bool) -> DataFrame:
    """One row per window whose minimizer is among its text's keys, with its digest; key is a hash of the window; it stands `reps` times, n units apart.

    With bodies, equal windows of a piece become one row, at its least id and with the summed reps.
    """

    def per_piece(ids, names, data, offsets, wanted):
        s = segments(data, offsets, scheme)
        if s is None:
            return
        keep, reps = runs_of_equals(s, scheme)
        warm = is_in(s.keys[keep], wanted)
        keep, reps = keep[warm], reps[warm]
        n = s.counts[keep]
        rows, apart, reps = (np.repeat(x, n) for x in (s.rows[keep], n, reps))
        first = np.arange(n.sum()) + np.repeat(s.firsts[keep] - np.cumsum(n) + n, n)
        a, b = s.starts[first], s.ends[first + scheme.width - 1]
        which, different = different_slices(s.data, a, b)
        named = digests(different)
        if with_body:
            one, reps = first_of_equals(which, ids.to_numpy()[rows], reps)
            which, rows, apart, first, a, b = (x[one] for x in (which, rows, apart, first, a, b))
        keys = s.hasher(a, b)
        for k in range(0, len(first), 20_000):
            c = slice(k, k + 20_000)
            out = batch_of(ids, names, rows[c], keys[c], (first - s.begins[rows])[c], apart[c], reps[c], s.data, a[c], b[c], with_body)
            yield out.append_column("digest", named.take(pa.array(which[c])))

    return mapped(hot, SEGMENTS + ", digest binary", per_piece)


def shards(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """A sorted partition's rows in tables that end where a key ends, of about most_bytes of bodies."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("body").nbytes
        if size >= most_bytes:
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or len(held) > 1 and held[-2].column("key")[-1] != batch.column("key")[0]:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                size = held[0].column("body").nbytes * held[0].num_rows // max(batch.num_rows, 1)
    if held:
        yield pa.Table.from_batches(held)


def joined_runs(flags: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of set flags that do not leave their group: first and last place of each."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(flags), bool)
    edge[1:] = ~flags[:-1] | (groups[1:] != groups[:-1])
    first = np.flatnonzero(flags & edge)
    edge = np.ones(len(flags), bool)
    edge[:-1] = ~flags[1:] | (groups[1:] != groups[:-1])
    return first, np.flatnonzero(flags & edge)


@dataclass
class Texts:
    """rows: id, no_id, name, digest, n_bytes, rep, copies of every row; different: id, name, text, a row per different text; parts: its buckets.

    name is the text's 128-bit name (the first half of its SHA-256), rep the least id that has the text, and the id
    under which the text itself stands; a missing id counts as the largest. Ids may repeat: a text is known by (id, name).
    """

    rows: DataFrame
    different: DataFrame
    parts: int


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> Texts:
    """Of equal texts, the one with the least id is stored, in buckets by (id, name), so later joins with it do not shuffle text.

    The join that leaves one row per text is on both, so copies of one text, and texts of one id, are spread over all tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(id_col).isNull().alias("no_id"), text.alias("text"))
    named = named.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("name", F.substring("digest", 1, 16))
    marks = written(named.select("id", "no_id", "name", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    groups = marks.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    groups = written(groups, "groups")
    bytes_ = groups.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // PART_BYTES))
    rows = marks.join(groups.drop("n_bytes"), "digest")
    texts = named.select("id", "name", "text")
    if not marks.groupBy("id", "name").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "name"])  # repeated rows meet already combined
    firsts = groups.select(F.col("rep").alias("id"), F.substring("digest", 1, 16).alias("name"))
    texts = texts.repartition(parts, "id", "name").join(firsts.repartition(parts, "id", "name"), ["id", "name"], "left_semi")
    return Texts(rows, bucketed(texts, parts, ["id", "name"], "texts"), parts)
