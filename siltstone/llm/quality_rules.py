"""Quality rules: base rules on words and repeats, then perplexity bands of a corpus-wide n-gram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kneser_ney import DEVIATION_BIN, MOST_ENTRIES, Scorer, bounds_at, deviation, fit, joined_surprise, n_grams, quantiles, split_words
from siltstone.llm.shared import if_small, pieces, small_batches, text_bytes, written

SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A hash of each run of `width` words; equal runs have equal hashes within a process."""
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    count = max(len(words) - width + 1, 0)
    mixed = np.zeros(count, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[k : k + count]
        mixed ^= mixed >> np.uint64(31)
    return mixed


def repeated_words(words: list[bytes], width: int) -> int:
    """Words that lie in a window of `width` words which stands at two or more places of the text."""
    n = len(words)
    if n <= width:
        return 0
    distinct = set(words)
    if len(distinct) == n:
        return 0
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    keys, have = ids, 1
    while have < width:  # exact: each step ranks the pairs of what it has
        step = min(have, width - have)
        pairs = keys[: len(keys) - step] * n + keys[step:]
        ordered = np.sort(pairs)
        if not (ordered[1:] == ordered[:-1]).any():
            return 0
        have += step
        keys = np.unique(pairs, return_inverse=True)[1] if have < width else pairs
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(n, bool)
    at = np.flatnonzero(np.isin(keys, twice))
    for k in range(width):
        covered[at + k] = True
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_measures(data: np.ndarray, offsets: np.ndarray, words: list[bytes], bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of texts end to end, with their words."""

    def per_text(marked: np.ndarray) -> np.ndarray:
        running = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
        return running[offsets[1:]] - running[offsets[:-1]]

    chars = per_text(~((data == 32) | (data >= 9) & (data <= 13)) & ((data & 0xC0) != 0x80))
    whole = data.tobytes()
    lines = [repeated_lines(whole[a:b]) if whole.find(b"\n", a, b) >= 0 else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    mixed = window_hashes(words, width)
    repeats = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.sort(mixed[a : max(b - width + 1, a)])
        repeats.append(repeated_words(words[a:b], width) if (own[1:] == own[:-1]).any() else 0)
    return [np.diff(bounds), chars, per_text(IS_SYMBOL[data]), np.array(lines, np.int64), np.array(repeats, np.int64)]


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tails: tuple[float, float] = (0.05, 0.05), most_entries: int = MOST_ENTRIES
) -> DataFrame:
    """One row per document: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log2_perplexity, lower_band, upper_band.

    base_failed: under 10 words, or over 20 % of words in repeated 5-word windows. The rest is kept when its perplexity under
    the model counted over all documents (each different word of a document once) lies within its language's bands. These are quantiles of the
    deviation (see there) among documents that pass the base rules, so a share of `tails` (below, above) of those is rejected whatever
    they are; lower_band and upper_band give them for a text of this length. Null and empty texts have no words and fail; a null language
    is a language of its own (""). A language without documents that pass has no bands. Repeated rows each count.
    """
    spark = docs.sparkSession
    model = fit(docs, text_col, most_entries, once=True)
    arrays = spark.sparkContext.broadcast(model.arrays) if model.small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(arrays.value) if arrays is not None else None
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            n = n_grams(data, offsets)
            for first, last in pieces(offsets, 1 << 22):
                part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                words, bounds = split_words(part, at)
                base = base_measures(part, at, words, bounds)
                sums = scorer(part, at, words, bounds) if scorer else np.zeros(last - first)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), *map(pa.array, base), pa.array(sums), pa.array(n[first:last])], names)

    names = ["id", "lang", "name", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise", "n_grams"]
    kind = docs.schema[id_col].dataType.simpleString()
    language = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.lit(None).cast("binary") if model.small else F.unhex(F.sha2(text, 256))
    named = docs.select(F.col(id_col).alias("id"), language.alias("lang"), name.alias("name"), text.alias("text"))
    measured = named.mapInArrow(run, f"id {kind}, lang string, name binary, " + ", ".join(f"{x} long" for x in names[3:8]) + ", surprise double, n_grams long")
    if not model.small:
        measured = measured.drop("surprise", "n_grams").join(joined_surprise(named, model), "name")
    measured = measured.drop("name")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    with small_batches(spark):
        measured = written(measured.withColumn("base_failed", failed), "rules")
    passing = measured.where("not base_failed and n_grams > 0").withColumn("mean", F.col("surprise") / F.col("n_grams"))
    centres = quantiles(passing, "lang", "mean", [0.5]).select("lang", F.col("q")[0].alias("centre"))
    # the tables below have a row per language: broadcast where they are counted to be small, else joined by language
    valued = measured.join(if_small(written(centres, "centres")), "lang", "left").withColumn("deviation", deviation(F.col("surprise"), F.col("n_grams"), F.col("centre")))
    bands = quantiles(valued.where("not base_failed"), "lang", "deviation", [tails[0], 1 - tails[1]], DEVIATION_BIN).select(
        "lang", F.col("q")[0].alias("lower"), (F.col("q")[1] + DEVIATION_BIN).alias("upper")
    )
    inside = F.coalesce(F.col("deviation").between(F.col("lower"), F.col("upper")), F.lit(True))
    at = {f"{side}_band": bounds_at(F.col(side), F.col("n_grams"), F.col("centre")) for side in ("lower", "upper")}
    return valued.join(if_small(written(bands, "bands")), "lang", "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "lang", F.try_divide("surprise", "n_grams").alias("log2_perplexity"), *(v.alias(k) for k, v in at.items()),
    )
