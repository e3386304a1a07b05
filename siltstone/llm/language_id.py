"""Language identification of spans: scripts narrow the languages, words are scored by trigrams, Viterbi labels them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import pieces, text_bytes

# Code point ranges of scripts; what lies in none of them is script 0.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"),
    (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0x20000, 0x3FFFF, "han"),
]
SCRIPTS = ["other", *dict.fromkeys(name for _, _, name in SCRIPT_RANGES)]
TABLED = 0x20000
#: Scores are whole numbers, this many to the unit of the natural logarithm.
UNIT = 256
#: The frequency that every trigram has beside its counted one.
FLOOR = 2e-6
#: What a letter costs a language that is not written in its script.
FOREIGN = 12 * UNIT
UNDETERMINED = "und"


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower case (where that is one), whether it is a letter (1) or mark (2), its script."""
    lower, kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(TABLED):
        sort = unicodedata.category(chr(c))[0]
        kind[c] = {"L": 1, "M": 2}.get(sort, 0)
        if sort == "L" and len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    kind[TABLED:0x40000] = 1
    script = np.zeros(0x110000, np.uint8)
    for first, last, name in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return lower, kind, script


class Words(NamedTuple):
    """Words of consecutive texts: first code point and the one behind, the text's number, letters, and a trigram's bucket for each code point and the end."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    letters: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray


def words_of(data: bytes, offsets: np.ndarray, bits: int) -> Words:
    """Words (runs of letters and marks that hold a letter) of UTF-8 texts end to end."""
    lower, kind, _ = tables()
    raw = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first_bytes = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
    at = np.concatenate(([0], np.cumsum(first_bytes)))[offsets]  # code points before each text
    # one separator behind each text
    n = len(offsets) - 1
    codes = np.zeros(len(raw) + n, np.uint32)
    rows_of_codes = np.repeat(np.arange(n), np.diff(at))
    codes[np.arange(len(raw)) + rows_of_codes] = raw
    at = at + np.arange(n + 1)
    sort = kind[codes]
    inside = sort > 0
    symbol = np.where(inside, lower[codes], 0).astype(np.uint64)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.add.reduceat((sort == 1).astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)
    good = letters > 0
    starts, ends, letters = starts[good], ends[good], letters[good]
    # places of trigrams: each code point of a word and the separator behind it
    sizes = ends - starts + 1
    gram_starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    place = np.repeat(starts - gram_starts, sizes) + np.arange(sizes.sum())
    b = symbol[place - 1]
    b[gram_starts] = 0
    a = symbol[place - 2]
    a[b == 0] = 0
    x = symbol[place] * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + a * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    rows = np.searchsorted(at, starts, side="right") - 1
    return Words(starts, ends, rows, letters, (x >> np.uint64(64 - bits)).astype(np.int64), gram_starts, codes, at)


class LanguageModel(NamedTuple):
    """Learned languages (most letters first), scores[bucket, language], and written[script, language]."""

    languages: list[str]
    bits: int
    scores: np.ndarray
    written: np.ndarray


def bits_for(n: int) -> int:
    """Buckets that keep all languages' tables within 2^22 entries; 2^18 of them for up to 16 languages, at least 2^12."""
    return max(12, min(18, 22 - (max(n, 1) - 1).bit_length()))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams and scripts of all labelled texts by language.

    Each task adds up its own counts, at most 2^22, and Spark adds those of the tasks; the driver gets one table of
    that bounded size. Rows without a language or text teach nothing.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    bits, n, scripts = bits_for(len(names)), len(names), len(SCRIPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: k for k, name in enumerate(names)}
        counts, written_in = np.zeros(n << bits, np.int64), np.zeros(n * scripts, np.int64)
        _, kind, script = tables()
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            data, offsets = text_bytes(batch.column(1))
            for first, last in pieces(offsets, 1 << 21):
                w = words_of(data[offsets[first] : offsets[last]].tobytes(), offsets[first : last + 1] - offsets[first], bits)
                lang = langs[first:last]
                counts += np.bincount((lang[w.rows] << bits).repeat(w.ends - w.starts + 1) + w.grams, minlength=len(counts))
                letter = np.flatnonzero(kind[w.codes] == 1)
                owner = lang[np.searchsorted(w.offsets, letter, side="right") - 1]
                written_in += np.bincount(owner * scripts + script[w.codes[letter]], minlength=len(written_in))
        for table, values in ((0, counts), (1, written_in)):
            at = np.flatnonzero(values)
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), table, np.int32)), pa.array(part), pa.array(values[part])], ["part", "at", "n"])

    counts, written_in = np.zeros(n << bits, np.int64), np.zeros(n * scripts, np.int64)
    if names:
        sums = known.mapInArrow(run, "part int, at long, n long").groupBy("part", "at").agg(F.sum("n").alias("n")).toArrow()
        part, at, number = (sums.column(k).to_numpy() for k in range(3))
        counts[at[part == 0]] = number[part == 0]
        written_in[at[part == 1]] = number[part == 1]
    counts, written_in = counts.reshape(n, 1 << bits), written_in.reshape(n, scripts)
    order = np.lexsort((np.arange(n), -written_in.sum(axis=1)))
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    scores = np.rint(np.log(share + FLOOR) * UNIT).astype(np.int16)
    used = written_in >= np.maximum(written_in.sum(axis=1, keepdims=True), 1) * 0.001
    return LanguageModel([names[k] for k in order], bits, np.ascontiguousarray(scores[order].T), np.ascontiguousarray(used[order].T))


def word_scores(w: Words, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(scores[word, language], letters of the word in scripts that some learned language is written in)."""
    _, kind, script = tables()
    scores = np.add.reduceat(model.scores[w.grams].astype(np.int32), w.gram_starts, axis=0)
    of = script[w.codes] * (kind[w.codes] == 1)
    place = np.repeat(w.starts - w.gram_starts, w.ends - w.starts + 1) + np.arange(len(w.grams))
    here = np.where(kind[w.codes[place]] == 1, script[w.codes[place]].astype(np.int64), -1)
    known = np.zeros(len(w.starts), np.int64)
    for k in np.unique(of if len(of) else np.zeros(1, np.uint8)):
        letters = np.add.reduceat((here == k).astype(np.int64), w.gram_starts)
        if model.written[k].any():
            known += letters
            # languages that are not written in this script are out wherever one is that is
            scores -= (letters[:, None] * np.where(model.written[k], 0, FOREIGN)).astype(np.int32)
    return scores, known


def viterbi(scores: np.ndarray, rows: np.ndarray, penalty: int) -> np.ndarray:
    """The labels of each text's words with the greatest sum of scores less `penalty` for every switch.

    A word that one language leads by twice the penalty has that label on a best path: a path without it gains by
    going there and back. Such words cut texts into segments that are solved side by side, each step over all of them.
    """
    n, k = scores.shape
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    top = np.partition(scores, k - 2, axis=1)
    sure = top[:, -1] - top[:, -2] >= 2 * penalty
    lead = scores.argmax(axis=1)
    begins = np.concatenate(([True], rows[1:] != rows[:-1]))
    starts = np.flatnonzero(begins | sure)
    sizes = np.diff(np.concatenate((starts, [n])))
    follows = np.concatenate((~begins[starts[1:]], [False]))  # whether the next segment goes on in the same text
    goal = np.concatenate((lead[starts[1:]], [0]))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, follows, goal = starts[order], sizes[order], follows[order], goal[order]
    low = np.int64(-1) << 40
    value = scores[starts].astype(np.int64)
    fixed = np.flatnonzero(sure[starts])
    value[fixed] = low
    value[fixed, lead[starts[fixed]]] = 0
    came = np.zeros((n, k), np.int16)
    active = len(starts)
    for step in range(1, int(sizes[0])):
        active = int(np.searchsorted(-sizes[:active], -step, side="left"))
        now, at = value[:active], starts[:active] + step
        best = now.argmax(axis=1)
        switched = now[np.arange(active), best] - penalty
        stay = now >= switched[:, None]
        came[at] = np.where(stay, np.arange(k), best[:, None])
        value[:active] = np.where(stay, now, switched[:, None]) + scores[at]
    final = value - np.where(follows[:, None] & (np.arange(k) != goal[:, None]), penalty, 0)
    label = final.argmax(axis=1)
    out = np.zeros(n, np.int64)
    out[starts + sizes - 1] = label
    for step in range(int(sizes[0]) - 1, 0, -1):
        active = int(np.searchsorted(-sizes, -step, side="left"))
        at = starts[:active] + step
        out[at - 1] = came[at, out[at]]
    return out


SPAN = "array<struct<lang:string,first_char:long,n_chars:long>>"


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 10.0) -> DataFrame:
    """One row per row: id_col, lang_pred, score, n_letters, spans (runs of words of one language, by code points).

    lang_pred is the language whose spans hold most letters (equal ones: the one with more training letters); score is
    its share of the letters, not counting letters in scripts that no learned language is written in. Null texts, and
    texts without a letter, are `und` with score 0 and no spans, as all are where nothing was learned. Repeated rows
    and rows without an id are judged like others; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^22 entries up to 1024 languages
    switch = int(penalty * UNIT)

    def spans_of(w: Words, labels: np.ndarray, names: pa.Array, n: int) -> pa.Array:
        cut = np.concatenate(([True], (labels[1:] != labels[:-1]) | (w.rows[1:] != w.rows[:-1])))[: len(labels)]
        first = np.flatnonzero(cut)
        last = np.concatenate((first[1:], [len(labels)]))[: len(first)] - 1
        begin = w.starts[first] - w.offsets[w.rows[first]]
        size = w.ends[last] - w.starts[first]
        offsets = np.searchsorted(w.rows[first], np.arange(n + 1))
        struct = pa.StructArray.from_arrays([names.take(pa.array(labels[first])), pa.array(begin), pa.array(size)], ["lang", "first_char", "n_chars"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        names, k = pa.array([*model.languages, UNDETERMINED], pa.string()), len(model.languages)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for first, last in pieces(offsets, 1 << 21):
                w = words_of(data[offsets[first] : offsets[last]].tobytes(), offsets[first : last + 1] - offsets[first], model.bits)
                n = last - first
                letters = np.bincount(w.rows, w.letters, minlength=n).astype(np.int64)
                pred, score = np.full(n, k), np.zeros(n)
                spans = pa.array([[]] * n, pa.list_(pa.struct([("lang", pa.string()), ("first_char", pa.int64()), ("n_chars", pa.int64())])))
                if k and len(w.starts):
                    scores, known = word_scores(w, model)
                    labels = viterbi(scores, w.rows, switch)
                    by = np.bincount(w.rows * k + labels, w.letters, minlength=n * k).reshape(n, k)
                    sure = np.bincount(w.rows * k + labels, known, minlength=n * k).reshape(n, k)
                    pred = np.where(letters > 0, by.argmax(axis=1), k)
                    score = np.where(letters > 0, sure[np.arange(n), np.minimum(pred, k - 1)] / np.maximum(letters, 1), 0.0)
                    spans = spans_of(w, labels, names, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), names.take(pa.array(pred)), pa.array(score), pa.array(letters), spans], ["id", "lang_pred", "score", "n_letters", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, n_letters long, spans {SPAN}")
    return found.withColumnRenamed("id", id_col)


def held_out(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds held_out: crc32 of the id as text is a multiple of 5; a row without an id counts as that of an empty text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.withColumn("held_out", F.crc32(key.cast("binary")) % 5 == 0)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out, then identifies all: id_col, held_out, lang_pred, score, n_letters, n_spans."""
    marked = held_out(docs.select(id_col, text_col, lang_col), id_col)
    model = train(marked.where("not held_out"), text_col, lang_col)
    found = identify(docs, model, id_col, text_col)
    return held_out(found, id_col).select(id_col, "held_out", "lang_pred", "score", "n_letters", F.size("spans").cast("long").alias("n_spans"))
