"""Near-duplicate files: winnowed k-gram fingerprints, shared-count Jaccard, clusters."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import ratio
from siltstone.operators.inventory import parents
from siltstone.sources.storage import cut
from siltstone.sources.text import exclude

TOKEN = re.compile("[A-Za-z0-9_]+")
#: k-grams are hashed as numbers in base BASE of their tokens' hashes, modulo the prime 2^61 - 1.
PRIME, BASE = (1 << 61) - 1, 1_000_003
MANY = 1_000_000
#: Tokens that are hashed at once: few enough to stay in a core's cache.
BLOCK = 16_384


def token_hash(token: str) -> int:
    """The first 60 bits of the token's md5."""
    return int(hashlib.md5(token.encode()).hexdigest()[:15], 16)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x below 2^62, by shifts."""
    x = (x & PRIME) + (x >> 61)
    return np.where(x >= PRIME, x - PRIME, x)


def times_base(x: np.ndarray) -> np.ndarray:
    """x * BASE modulo PRIME, in 64 bits: the high and low 31 bits apart, the high part turned back by a shift."""
    high, low = (x >> 31) * BASE, (x & ((1 << 31) - 1)) * BASE
    return reduced((high >> 30) + ((high & ((1 << 30) - 1)) << 31) + low)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k neighbouring tokens, all places at once."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = reduced(times_base(out) + hashes[j : j + n])
    return out


def winnow(texts: Iterable[str], k: int, w: int, known: dict[str, int]) -> list[list[int]]:
    """For each text the least of each window of w neighbouring k-grams' hashes, once each; with fewer than w k-grams, all.

    Texts are hashed end to end, BLOCK tokens and more at once; k-grams and windows that reach over an end are left out.
    """
    out: list[list[int]] = []
    held: list[list[str]] = []

    def take() -> None:
        sizes = [len(tokens) for tokens in held]
        grams = gram_hashes(np.fromiter((known[t] for tokens in held for t in tokens), np.int64, sum(sizes)), k)
        least = np.minimum.reduce([grams[j : len(grams) - w + 1 + j] for j in range(w)]) if len(grams) >= w else grams[:0]
        at = 0
        for size in sizes:
            n = size - k + 1
            own = least[at : at + n - w + 1] if n >= w else grams[at : at + max(n, 0)]
            out.append(np.unique(own).tolist())
            at += size
        held.clear()

    waiting = 0
    for text in texts:
        tokens = TOKEN.findall(text)
        if len(known) > MANY:
            if held:
                take()
            known.clear()
            waiting = 0
        for t in tokens:
            if t not in known:
                known[t] = token_hash(t)
        held.append(tokens)
        waiting += len(tokens)
        if waiting >= BLOCK:
            take()
            waiting = 0
    if held:
        take()
    return out


def fingerprints(contents: DataFrame, k: int = 25, w: int = 4, scope: str = "lang") -> DataFrame:
    """(scope, path, fp), distinct: the least hash of each window of w neighbouring k-grams of [A-Za-z0-9_]+ tokens; with fewer than w k-grams, all.

    A Pandas UDF, because the expression form slices k tokens anew at each place. Each different token is hashed once a
    batch, k-grams of a text all at once; scope "" compares all files with each other.
    """

    @F.pandas_udf("array<long>")
    def chosen(texts: pd.Series) -> pd.Series:
        return pd.Series(winnow(texts, k, w, {}))

    return contents.where("text is not null").select((F.col(scope) if scope else F.lit("")).alias("scope"), "path", F.explode(chosen("text")).alias("fp"))


def select_files(rows: DataFrame, max_files: int, max_file_bytes: int = 512_000, exclude_patterns: list[str] | None = None) -> DataFrame:
    """The parent files to compare: of at most max_file_bytes, not excluded, the max_files with most code (equal ones by path)."""
    some = exclude(parents(rows).where(F.col("bytes") <= max_file_bytes), exclude_patterns or [])
    return some.orderBy(F.desc("code"), "path").limit(max_files)


def selection_counts(rows: DataFrame, max_files: int, max_file_bytes: int = 512_000, exclude_patterns: list[str] | None = None) -> DataFrame:
    """One row: eligible_files, files_skipped beyond max_files, excluded_by_pattern."""
    small = parents(rows).where(F.col("bytes") <= max_file_bytes)
    both = small.agg(F.count("*").alias("n")).crossJoin(F.broadcast(exclude(small, exclude_patterns or []).agg(F.count("*").alias("eligible_files"))))  # one row each
    return both.select("eligible_files", F.greatest(F.col("eligible_files") - max_files, F.lit(0)).cast("long").alias("files_skipped"), (F.col("n") - F.col("eligible_files")).alias("excluded_by_pattern"))


def fold_equal(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of one file for each set of fingerprints, members: scope, path, representative).

    Files with the same set are told by a digest over it that adds up in any order, its size and its bounds; the least
    path stands for them. So a group of copies of any size is one file to what follows, and loses no link.
    """
    hashed = F.xxhash64("fp")
    sets = fps.groupBy("scope", "path").agg(F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(F.pmod(hashed, F.lit(PRIME >> 20)).cast("decimal(38,0)")).alias("s"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    key = ["scope", "n", "x", "s", "low", "high"]
    first = sets.groupBy(*key).agg(F.min("path").alias("representative"))
    members = cut(sets.join(first, key).select("scope", "path", "representative"))
    kept = members.where("path = representative").select("scope", "path")
    return fps.join(kept, ["scope", "path"]), members


def groups(fps: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(scope, path, representative, group): every file that is like another, with the least path that is reachable over pairs.

    Equal sets are folded first, so that nothing is dropped for being frequent among copies. What is still frequent
    among different files is not dropped either: a pair at the threshold shares one of the rarest fingerprints of
    either file (the first size - ceil(threshold * size) + 1 in order of frequency), so only these are met, and
    candidates are counted over all their fingerprints.
    """
    folded, members = fold_equal(fps)
    folded = cut(folded)
    sizes = folded.groupBy("scope", "path").agg(F.count("*").alias("n"))
    often = folded.groupBy("scope", "fp").agg(F.count("*").alias("often"))
    ranked = folded.join(often, ["scope", "fp"]).where("often > 1").join(sizes, ["scope", "path"])
    single = sizes.join(folded.join(often, ["scope", "fp"]).where("often = 1").groupBy("scope", "path").agg(F.count("*").alias("alone")), ["scope", "path"], "left").select("scope", "path", F.coalesce("alone", F.lit(0)).alias("alone"))
    place = F.row_number().over(Window.partitionBy("scope", "path").orderBy("often", "fp"))
    prefix = ranked.withColumn("place", place).join(single, ["scope", "path"]).where(F.col("place") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    prefix = cut(prefix.select("scope", "fp", "path", "n"))
    a, b = prefix.select("scope", "fp", F.col("path").alias("left_path"), F.col("n").alias("na")), prefix.select("scope", "fp", F.col("path").alias("right_path"), F.col("n").alias("nb"))
    fits = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    candidates = cut(a.join(b, ["scope", "fp"]).where((F.col("left_path") < F.col("right_path")) & fits).select("scope", "left_path", "right_path", "na", "nb").distinct())
    left = candidates.join(folded.select("scope", F.col("path").alias("left_path"), "fp"), ["scope", "left_path"])
    shared = left.join(folded.select("scope", F.col("path").alias("right_path"), "fp"), ["scope", "right_path", "fp"]).groupBy("scope", "left_path", "right_path", "na", "nb").agg(F.count("*").alias("shared"))
    union = F.col("na") + F.col("nb") - F.col("shared")
    near = shared.where(F.col("shared").cast("double") / union.cast("double") >= threshold).select("left_path", "right_path")
    labels = labelled(near)
    out = members.join(labels.select(F.col("a").alias("representative"), "label"), "representative", "left")
    several = members.groupBy("scope", "representative").agg(F.count("*").alias("copies"))
    out = out.join(several, ["scope", "representative"]).where("copies > 1 or label is not null")
    return out.select("scope", "path", "representative", F.coalesce("label", "representative").alias("group"))


def top_pairs(found: DataFrame, max_pairs: int) -> DataFrame:
    """The max_pairs most similar pairs, equal ones by their paths."""
    return found.orderBy(F.desc("similarity"), "left_path", "right_path").limit(max_pairs)


def pairs(fps: DataFrame, threshold: float = 0.8, max_postings: int = 50) -> DataFrame:
    """(scope, left_path, right_path, shared, similarity) at or above threshold, compared before rounding.

    The rule itself skips fingerprints in more than max_postings files of a scope, which also bounds the self-join: a
    posting list yields at most 1 225 pairs. A file's size still counts the skipped ones. Fingerprints are written once,
    since sizes, posting lists and both sides of the join read them.
    """
    fps = cut(fps)
    sizes = fps.groupBy("scope", "path").agg(F.count("*").alias("n"))
    # posting lists are bounded by the rule: longer ones leave before anything is collected
    lists = fps.groupBy("scope", "fp").agg(F.count("*").alias("m")).where((F.col("m") > 1) & (F.col("m") <= max_postings))
    kept = fps.join(lists.drop("m"), ["scope", "fp"])
    a, b = kept.select("scope", "fp", F.col("path").alias("left_path")), kept.select("scope", "fp", F.col("path").alias("right_path"))
    shared = a.join(b, ["scope", "fp"]).where("left_path < right_path").groupBy("scope", "left_path", "right_path").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.select("scope", F.col("path").alias("left_path"), F.col("n").alias("na")), ["scope", "left_path"])
    out = out.join(sizes.select("scope", F.col("path").alias("right_path"), F.col("n").alias("nb")), ["scope", "right_path"])
    union = F.col("na") + F.col("nb") - F.col("shared")
    near = out.where(F.col("shared").cast("double") / union.cast("double") >= threshold)
    return near.select("scope", "left_path", "right_path", "shared", ratio("shared", union).alias("similarity"))


def labelled(found: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, label) for every path of (left_path, right_path): the least path reachable.

    Each round takes the neighbours' least label and then the label's own label; its lineage is cut by a checkpoint in
    the shared folder.
    """
    edges = found.select(F.col("left_path").alias("a"), F.col("right_path").alias("b"))
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("a").alias("at"), F.col("label").alias("further"))
        nxt = cut(step.join(jump, step["label"] == jump["at"]).select("a", F.least("label", "further").alias("label"), "old"))
        done = nxt.where("label <> old").isEmpty()
        labels = nxt.drop("old")
        if done:
            break
    else:
        raise RuntimeError("clusters did not converge")
    return labels


def clusters(found: DataFrame) -> DataFrame:
    """(cluster, files, representative, pair_count, max_similarity): connected files; the representative has most pairs, of equals the smallest path."""
    found = cut(found)
    edges = found.select(F.col("left_path").alias("a"), F.col("right_path").alias("b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("degree"))
    labels = labelled(found)
    members = labels.join(degree, "a").groupBy("label").agg(F.count("*").alias("files"), F.min(F.struct((-F.col("degree")).alias("d"), "a")).alias("r"))
    pairs_of = found.join(labels.select(F.col("a").alias("left_path"), "label"), "left_path").groupBy("label").agg(F.count("*").alias("pair_count"), F.max("similarity").alias("max_similarity"))
    return members.join(pairs_of, "label").select(F.col("label").alias("cluster"), "files", F.col("r.a").alias("representative"), "pair_count", "max_similarity")
