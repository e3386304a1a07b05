"""Interpolated modified Kneser-Ney n-gram models over the code points of words.

A word is read with a space after it and, before it, a space and the ASCII mark that ends the word before (a space if
that ends otherwise, a line feed at a text's start). So an n-gram holds up to ORDER code points of one word and its edges. The model has
as many n-grams as the text it is counted from; nothing bounds them. All counts cover all rows given. Texts are scored
from sorted hash arrays on every executor if the model is counted to have at most MOST_ENTRIES entries, and by joins of
tables sharded on the n-gram, the word and the text beyond that; both ways add up the same values.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import pieces, small_batches, text_bytes, written

ORDER = 5
PAD = " "  # no word holds one
#: ASCII marks: what is neither letter, digit nor white space.
MARK = r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]"
MARKS = np.array([re.fullmatch(MARK, chr(b)) is not None for b in range(128)] + [False] * 128)
AFTER_MARK = [bytes((b, 32)) for b in range(128)]
#: Surprise is added up in whole numbers of 1 / UNIT.
UNIT = 1 << 24
#: Resolution of quantiles: of bits a n-gram, and of deviations.
BIN, DEVIATION_BIN = 0.001, 0.01
#: Entries (20 bytes each) of a model that is sent to every executor.
MOST_ENTRIES = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"
FACTORS = np.random.default_rng(7).integers(1, 1 << 63, ORDER, np.uint64) << np.uint64(1) | np.uint64(1)


def edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that start a word and bytes that end one, of texts end to end."""
    space = (data == 32) | (data >= 9) & (data <= 13)
    after = np.concatenate((np.ones(min(len(data), 1), bool), space[:-1]))
    before = np.concatenate((space[1:], np.ones(min(len(data), 1), bool)))
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a text's edge ends a word
    after[cut] = before[cut - 1] = True
    return ~space & after, ~space & before


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words of texts end to end, and len + 1 offsets."""
    out: list[bytes] = []
    bounds = [0]
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out += whole[a:b].split()
        bounds.append(len(out))
    return out, np.array(bounds)


def units(data: np.ndarray, offsets: np.ndarray, words: list[bytes] | None = None, bounds: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
    """The words (split already, or not) of texts end to end, and len + 1 offsets; a word at a text's start, or after a mark, has that and a space before it."""
    if words is None:
        words, bounds = split_words(data, offsets)
    out = words.copy()
    last = data[edges(data, offsets)[1]]
    after = MARKS[last[:-1]]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    after[first[first > 0] - 1] = False
    at = np.flatnonzero(after)
    for k, mark in zip((at + 1).tolist(), last[at].tolist(), strict=True):
        out[k] = AFTER_MARK[mark] + out[k]
    for k in first.tolist():
        out[k] = b"\n " + out[k]
    return out, bounds


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the words with ORDER - 1 before and one after each, the place of each n-gram, n-grams of each word)."""
    words = [w if w[1:2] == PAD else PAD * 2 + w for w in words]
    whole = PAD * (ORDER - 3) + (PAD * (ORDER - 2)).join(words) + PAD
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) - 2
    starts, n = np.cumsum(lengths + ORDER) - lengths - ORDER, lengths + 1
    return points, np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), n


def hashes(points: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the `length` code points at each place."""
    x = np.zeros(len(at), np.uint64)
    for k in range(length):
        x += (points[at + k].astype(np.uint64) + np.uint64(1)) * FACTORS[k]
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def grams_of(words: dict[bytes, int]) -> tuple[list[str], np.ndarray]:
    """The n-grams of counted words, and how often each stands there."""
    points, at, n = padded([w.decode("utf-8", "replace") for w in words])
    _, first, which = np.unique(hashes(points, at, ORDER), return_index=True, return_inverse=True)
    counts = np.bincount(which, np.repeat(np.fromiter(words.values(), np.int64, len(words)), n)).astype(np.int64)
    whole = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[place : place + ORDER] for place in at[first].tolist()], counts


def count_ngrams(docs: DataFrame, text_col: str = "text", once: bool = False, most_words: int = 150_000, most_bytes: int = 32 << 20, most_grams: int = 100_000) -> DataFrame:
    """(gram, n) over whole texts. A task counts words first, then their n-grams, most_words different words at a time, and hands them on in batches of most_grams; Spark adds them up in the task before it sends them.

    once: each different word of a text counts once, so that a text of one word a thousand times does not make that word usual.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        size = 0

        def settled() -> Iterator[pa.RecordBatch]:
            if words:
                grams, n = grams_of(words)
                words.clear()
                for at in range(0, len(grams), most_grams):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + most_grams], pa.string()), pa.array(n[at : at + most_grams])], ["gram", "n"])

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for first, last in pieces(offsets, 1 << 22):
                found, bounds = units(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                if once:
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        words.update(set(found[a:b]))
                else:
                    words.update(found)
                size += offsets[last] - offsets[first]
                if len(words) >= most_words or size >= most_bytes:
                    yield from settled()
                    size = 0
        yield from settled()

    return docs.select(text_col).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def model_tables(counts: DataFrame) -> DataFrame:
    """The model as rows (level, gram, p, backoff), by joins of count tables sharded on the n-gram and on its context.

    Level ORDER uses counts, lower levels the number of distinct left neighbours. p is the discounted share of a seen
    n-gram, backoff the weight its context gives to the next lower level (rows with p null carry it).
    """
    levels = {ORDER: counts.withColumnRenamed("n", "c")}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))
    out = None
    for n, level in levels.items():
        level = level.withColumn("context", F.substring("gram", 1, n - 1))
        n1, n2, n3, n4 = (x or 0 for x in level.agg(*(F.sum((F.col("c") == k).cast("long")) for k in range(1, 5))).first())
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        # each discount stays within (0, k]: small corpora may lack a count
        d = [min(max(k - (k + 1) * y * b / a if a else 0.5 * k, 0.05 * k), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = level.groupBy("context").agg(F.sum("c").alias("total"), F.sum(discount).alias("freed"))
        shares = level.join(contexts, "context").select(F.lit(n).alias("level"), "gram", ((F.col("c") - discount) / F.col("total")).alias("p"), F.lit(None).cast("double").alias("backoff"))
        weights = contexts.select(F.lit(n).alias("level"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), (F.col("freed") / F.col("total")).alias("backoff"))
        both = shares.unionByName(weights)
        out = both if out is None else out.unionByName(both)
    return out


class HashArrays:
    """Per level, sorted hashes of n-grams with their shares, and of contexts with their backoff weights."""

    def __init__(self, level: np.ndarray, key: np.ndarray, value: np.ndarray, is_share: np.ndarray):
        self.levels = []
        for n in range(1, ORDER + 1):
            for kind in (True, False):
                some = np.flatnonzero((level == n) & (is_share == kind))
                some = some[np.argsort(key[some], kind="stable")]
                self.levels.append((key[some], value[some]))
        self.symbols = len(self.levels[0][0]) + 1

    def lookup(self, level: int, wanted: np.ndarray, is_share: bool, missing: float) -> np.ndarray:
        keys, values = self.levels[2 * level - 2 + (not is_share)]
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def shares(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """p of the last of the ORDER code points at each place given the others, interpolated from level 1 up."""
        p = np.full(len(at), 1 / self.symbols)
        for n in range(1, ORDER + 1):
            tail = at + ORDER - n
            p = self.lookup(n, hashes(points, tail, n), True, 0.0) + self.lookup(n, hashes(points, tail, n - 1), False, 1.0) * p
        return p

    def surprise(self, words: list[str]) -> np.ndarray:
        """Each word's summed -log2 p, in whole numbers of 1 / UNIT."""
        points, at, n = padded(words)
        _, first, which = np.unique(hashes(points, at, ORDER), return_index=True, return_inverse=True)
        units = np.floor(-np.log2(self.shares(points, at[first])) * UNIT).astype(np.int64)
        return np.add.reduceat(units[which], np.cumsum(n) - n)


class Surprises(dict[bytes, int]):
    """Word: surprise. A word that is missing is noted and stands for -1."""

    def __init__(self):
        super().__init__()
        self.noted: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.noted.append(word)
        return -1


class Scorer:
    """Sums over the words of texts; the surprise of up to `most` different words is kept, then the memory starts anew."""

    def __init__(self, arrays: HashArrays, most: int = 400_000):
        self.arrays, self.most = arrays, most
        self.known = Surprises()

    def __call__(self, data: np.ndarray, offsets: np.ndarray, words: list[bytes] | None = None, bounds: np.ndarray | None = None) -> np.ndarray:
        """Each text's surprise; words and bounds as split_words gives them, if they are at hand."""
        words, bounds = units(data, offsets, words, bounds)
        known = self.known
        known.noted = []
        values = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.noted:
            wanted = dict.fromkeys(known.noted)
            listed = list(wanted)
            if len(known) + len(listed) > self.most:
                known.clear()
            for at in range(0, len(listed), 65_536):
                part = listed[at : at + 65_536]
                wanted.update(zip(part, self.arrays.surprise([w.decode("utf-8", "replace") for w in part]).tolist(), strict=True))
            values[values < 0] = np.fromiter(map(wanted.__getitem__, known.noted), np.int64, len(known.noted))
            known.update(wanted)
            known.noted = []
        running = np.concatenate(([0], np.cumsum(values)))
        return (running[bounds[1:]] - running[bounds[:-1]]) / UNIT


@dataclass
class Model:
    """rows: (level, gram, p, backoff), written; entries: their number."""

    rows: DataFrame
    entries: int
    most_entries: int

    @property
    def small(self) -> bool:
        return self.entries <= self.most_entries

    @cached_property
    def arrays(self) -> HashArrays:
        """At most most_entries entries, hashed where they lie and fetched."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                level, share = batch.column("level").to_numpy(), batch.column("p").is_valid().to_numpy(zero_copy_only=False)
                points = np.frombuffer("".join(g.ljust(ORDER) for g in batch.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
                key = np.zeros(len(level), np.uint64)
                for n in range(1, ORDER + 1):
                    for kind in (True, False):
                        some = np.flatnonzero((level == n) & (share == kind))
                        key[some] = hashes(points, some * ORDER, n if kind else n - 1)
                value = np.where(share, batch.column("p").to_numpy(zero_copy_only=False), batch.column("backoff").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("level"), pa.array(key.view(np.int64)), pa.array(value), pa.array(share)], ["level", "key", "value", "share"])

        table = self.rows.mapInArrow(run, "level int, key long, value double, share boolean").toArrow()
        return HashArrays(table["level"].to_numpy(), table["key"].to_numpy().view(np.uint64), table["value"].to_numpy(), table["share"].to_numpy())


def fit(docs: DataFrame, text_col: str = "text", most_entries: int = MOST_ENTRIES, once: bool = False) -> Model:
    """Count over all rows, and estimate by joins of the count tables."""
    with small_batches(docs.sparkSession):
        counts = written(count_ngrams(docs, text_col, once), "ngram-counts")
    rows = written(model_tables(counts), "model")
    return Model(rows, rows.count(), most_entries)


def n_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: the code points of its words and one for each word's end."""
    space = (data == 32) | (data >= 9) & (data <= 13)
    running = np.concatenate(([0], np.cumsum((~space & ((data & 0xC0) != 0x80)).astype(np.int64) + edges(data, offsets)[0])))
    return running[offsets[1:]] - running[offsets[:-1]]


def joined_surprise(texts: DataFrame, model: Model) -> DataFrame:
    """(name, surprise, n_grams) of each different text of (name, text), by joins only: n-grams with their shares and weights, words with their n-grams, texts with their words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word_id, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, times = grams_of({word.encode("utf-8", "surrogatepass"): 1})
                for at in range(0, len(found), 20_000):
                    part = found[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([word_id] * len(part), pa.binary()), pa.array(part), pa.array(times[at : at + 20_000])], ["word_id", "gram", "times"])

    split = texts.select("name", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))

    def unit(word: Column, k: Column) -> Column:
        mark = F.substring(F.get("w", k - 1), -1, 1)
        return F.when(k == 0, F.concat(F.lit("\n "), word)).when(mark.rlike(MARK), F.concat(mark, F.lit(" "), word)).otherwise(word)

    words = written(split.select("name", F.explode(F.transform("w", unit)).alias("word")).groupBy("name", "word").agg(F.count("*").alias("times")), "words")
    words = words.withColumn("word_id", F.unhex(F.md5("word")))
    copies = texts.groupBy("name").agg(F.count("*").alias("copies"))
    grams = written(words.select("word_id", "word").distinct().mapInArrow(windows, "word_id binary, gram string, times long"), "word-grams")
    symbols = model.rows.where("level = 1 and p is not null").count() + 1
    valued = grams.select("gram").distinct().withColumn("share", F.lit(1 / symbols))
    for n in range(1, ORDER + 1):
        level = model.rows.where(F.col("level") == n)
        shares = level.where("p is not null").select(F.col("gram").alias("tail"), "p")
        weights = level.where("p is null").select(F.col("gram").alias("context"), "backoff")
        valued = valued.withColumns({"tail": F.substring("gram", ORDER - n + 1, n), "context": F.substring("gram", ORDER - n + 1, n - 1)})
        valued = valued.join(shares, "tail", "left").join(weights, "context", "left")
        valued = valued.select("gram", (F.coalesce("p", F.lit(0.0)) + F.coalesce("backoff", F.lit(1.0)) * F.col("share")).alias("share"))
    valued = valued.select("gram", F.floor(-F.log2("share") * UNIT).alias("units"))
    scored = grams.join(valued, "gram").groupBy("word_id").agg(F.sum(F.col("times") * F.col("units")).alias("units"), F.sum("times").alias("grams"))
    sums = words.join(scored, "word_id").groupBy("name").agg(F.sum(F.col("times") * F.col("units")).alias("units"), F.sum(F.col("times") * F.col("grams")).alias("grams"))
    # equal texts were counted together
    each = copies.join(sums, "name", "left").select("name", *(F.expr(f"coalesce({c} div copies, 0L)").alias(c) for c in ("units", "grams")))
    return each.select("name", (F.col("units") / UNIT).alias("surprise"), F.col("grams").alias("n_grams"))


def quantiles(scores: DataFrame, group: str, value: str, ranks: list[float], bin_width: float = BIN) -> DataFrame:
    """(group, q array): each group's quantiles of value at a resolution of bin_width, from a histogram of all rows.

    The histogram has a row per group and bin, so no group's values meet in one task.
    """
    from pyspark.sql import Window

    bins = scores.where(F.col(value).isNotNull()).groupBy(group, F.floor(F.col(value) / bin_width).alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(group)
    summed = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    at = [F.min(F.when(F.col("upto") >= F.lit(r) * F.col("all"), F.col("bin"))) * bin_width for r in ranks]
    return summed.groupBy(group).agg(F.array(*at).alias("q"))


def deviation(total: Column, n: Column, centre: Column) -> Column:
    """How far a text's surprise lies from its language's median, in bits for the root of its n-grams.

    A mean varies with the root of a text's length, so this has one spread for short and long texts, and one band fits all.
    """
    return F.try_divide(total - n * centre, F.sqrt(n))


def bounds_at(limit: Column, n: Column, centre: Column) -> Column:
    """The perplexity, in bits a n-gram, at which a text of n n-grams reaches a deviation."""
    return centre + F.try_divide(limit, F.sqrt(n))
