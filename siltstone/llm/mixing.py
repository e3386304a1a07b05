"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text_col: str) -> Column:
    """A document's tokens here: its words, and one for its end, so that no document weighs nothing."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("long"), F.lit(0).cast("long")) + 1


def bisect(f: Callable[[float], float], target: float, low: float = 0.0, high: float = 1.0, steps: int = 30) -> float:
    """The exponent at which f, which falls or rises monotonically between low and high, meets target; else the nearer end."""
    at_low, at_high = f(low), f(high)
    rising = at_high >= at_low
    if not min(at_low, at_high) <= target <= max(at_low, at_high):
        return low if abs(at_low - target) <= abs(at_high - target) else high
    for _ in range(steps):
        middle = (low + high) / 2
        if (f(middle) < target) == rising:
            low = middle
        else:
            high = middle
    # the end at which a repetition limit still holds
    return high if not rising else low


def mixing_exponent(sources: DataFrame, repetition_limit: float | None, target_entropy: float | None) -> float:
    """Bisect the exponent of the source shares.

    target_entropy: bits of the mixed weights. repetition_limit: no source is repeated more often than this while
    every source is read at least once. Each step is an aggregate over the source table; sources are never collected.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.select((F.col("tokens") / F.lit(float(max(total, 1)))).alias("p"))
    if target_entropy is not None:

        def entropy(exponent: float) -> float:
            w = F.pow("p", F.lit(exponent))
            z, s = shares.agg(F.sum(w), F.sum(w * F.log2(w))).first()
            return 0.0 if not z else math.log2(z) - s / z

        return bisect(entropy, target_entropy)
    low, high = shares.agg(F.min("p"), F.max("p")).first()
    return 1.0 if not low else bisect(lambda a: (low / high) ** (a - 1), repetition_limit or 1.0)


def mixing_plan(docs: DataFrame, source_col: str, text_col: str, repetition_limit: float | None, target_entropy: float | None, budget_tokens: int | None, blocks: int, seed: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, _tokens, _source, _block: a document's row as a struct, so no column of it can clash; block table with copies of each block).

    A source's documents are dealt over `blocks` blocks by a seeded hash, and its blocks stand in a seeded order. Its
    budget is weight x budget_tokens: whole passes over all its blocks, then blocks in that order while they fit.
    budget_tokens None: the least at which every source is read once in full.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(F.col(id_col).cast("string"), source, F.lit(seed)), F.lit(blocks)).cast("int")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), tokens_of(text_col).alias("_tokens"), source.alias("_source"), block.alias("_block"))
    sized = written(marked.groupBy("_source", "_block").agg(F.sum("_tokens").alias("block_tokens"), F.count("*").alias("block_docs")), "blocks")
    sources = written(sized.groupBy("_source").agg(F.sum("block_tokens").alias("tokens")), "sources")
    exponent = mixing_exponent(sources, repetition_limit, target_entropy)
    power = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    norm, most = sources.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    weight = power / F.lit(float(norm or 1.0))
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.lit(float((most or 0.0) * (norm or 0.0)))
    weighted = sources.select("_source", "tokens", F.lit(exponent).alias("exponent"), weight.alias("weight"), F.floor(weight * budget + 0.5).cast("long").alias("budget_tokens"))
    # at most `blocks` rows stand in one window, whatever a source's size
    order = Window.partitionBy("_source").orderBy(F.xxhash64("_source", "_block", F.lit(seed + 1)), "_block")
    ranked = sized.withColumn("block_rank", F.row_number().over(order)).withColumn("upto", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    planned = ranked.join(weighted, "_source")
    passes = F.floor(F.col("budget_tokens") / F.col("tokens"))
    extra = (F.col("upto") <= F.col("budget_tokens") - passes * F.col("tokens")).cast("long")
    return marked, planned.withColumn("copies", passes + extra)


def mix_sources(
    docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", repetition_limit: float | None = 2.0,
    target_entropy: float | None = None, budget_tokens: int | None = None, blocks: int = 1024, seed: int = 17, small_plan: int = 200_000,
) -> DataFrame:
    """The input's columns, once per copy, with mix_epoch, mix_block_rank, mix_weight, mix_exponent and mix_budget_tokens.

    With the defaults every document is kept at least once and small sources are repeated, at most repetition_limit
    times. A null source is a source of its own (named ""); null and empty texts weigh one token; repeated rows are
    rows. The block table (sources x blocks rows) is broadcast only when counted to be small, else joined on
    (source, block), which splits a hot source over its blocks. Input columns named like the added ones are replaced.
    """
    marked, plan = mixing_plan(docs, source_col, text_col, repetition_limit, target_entropy, budget_tokens, blocks, seed, id_col)
    plan = written(plan.select("_source", "_block", "block_rank", "copies", "weight", "exponent", "budget_tokens"), "mix-plan")
    plan = plan.select("_source", "_block", *(F.col(c).alias(f"_plan_{c}") for c in ("block_rank", "copies", "weight", "exponent", "budget_tokens")))
    plan = F.broadcast(plan) if plan.count() <= small_plan else plan
    joined = marked.join(plan, ["_source", "_block"]).where("_plan_copies > 0")
    made = {
        "mix_epoch": F.explode(F.sequence(F.lit(1).cast("long"), "_plan_copies")), "mix_block_rank": F.col("_plan_block_rank"), "mix_weight": F.col("_plan_weight"),
        "mix_exponent": F.col("_plan_exponent"), "mix_budget_tokens": F.col("_plan_budget_tokens"), "mix_tokens": F.col("_tokens"),
    }
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in made]
    return joined.select(*kept, *(v.alias(k) for k, v in made.items()))
