"""Policy and ratchet gates over named metrics, as joins of a rule table with a metric table; and the same rules over JSON receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import round_away

RULES = "ord int, name string, pointer string, op string, value string, values array<string>, negate boolean, level string"


def pointer_metrics(receipts: DataFrame, pointers: list[str], column: str = "receipt") -> DataFrame:
    """(pointer, actual, present) read from a JSON column by JSON pointers (RFC 6901: ~1 is /, ~0 is ~)."""

    def path(pointer: str) -> str:
        keys = [k.replace("~1", "/").replace("~0", "~") for k in pointer.split("/")[1:]]
        return "$" + "".join(f"[{k}]" if k.isdigit() else f"['{k}']" for k in keys)

    values = [F.struct(F.lit(p).alias("pointer"), F.get_json_object(column, path(p)).alias("actual")) for p in pointers]
    return receipts.select(F.explode(F.array(*values)).alias("x")).select("x.*").withColumn("present", F.col("actual").isNotNull())


def evaluate_policy(metrics: DataFrame, rules: DataFrame, allow_missing: bool = False, fail_fast: bool = False) -> DataFrame:
    """(ord, name, pointer, level, passed) of each rule, in order; metrics: (pointer, actual).

    A comparison that cannot be made (not numeric, no value) fails even if negated. With fail_fast the rules after the
    first failed error are left out. The rule table is configuration and small; it is the side that is broadcast.
    """
    joined = rules.join(metrics.select("pointer", "actual"), "pointer", "left")
    a, b = F.expr("try_cast(actual as double)"), F.expr("try_cast(value as double)")
    equal = F.when(F.col("actual") == F.col("value"), True).otherwise(F.coalesce(F.abs(a - b) < 2.220446049250313e-16, F.lit(False)))
    test = (
        F.when(F.col("op") == "gt", a > b).when(F.col("op") == "gte", a >= b).when(F.col("op") == "lt", a < b).when(F.col("op") == "lte", a <= b)
        .when(F.col("op") == "eq", F.when(F.col("value").isNotNull(), equal)).when(F.col("op") == "ne", F.when(F.col("value").isNotNull(), ~equal))
        .when(F.col("op") == "in", F.array_contains("values", F.col("actual"))).when(F.col("op") == "contains", F.contains("actual", "value"))
    )
    held = F.when(F.col("op") == "exists", F.col("actual").isNotNull() != F.col("negate")).when(F.col("actual").isNull(), F.lit(allow_missing)).otherwise(F.coalesce(test != F.col("negate"), F.lit(False)))
    out = joined.select("ord", "name", "pointer", "level", held.alias("passed"))
    if fail_fast:
        stop = out.where("not passed and level = 'error'").agg(F.min("ord").alias("stop"))
        out = out.crossJoin(F.broadcast(stop)).where("stop is null or ord <= stop").drop("stop")
    return out.orderBy("ord")


def verdict(results: DataFrame) -> DataFrame:
    failed = lambda level: F.coalesce(F.sum((~F.col("passed") & (F.col("level") == level)).cast("long")), F.lit(0)).cast("long")
    return results.agg(failed("error").alias("errors"), failed("warn").alias("warnings")).withColumn("passed", F.col("errors") == 0)


def evaluate_ratchet(rules: DataFrame, baseline: DataFrame, current: DataFrame, allow_missing_baseline: bool = False, allow_missing_current: bool = False) -> DataFrame:
    """(pointer, baseline_value, current_value, change_pct, passed, reason); rules: (pointer, max_increase_pct, max_value, level).

    In order: current missing, above max_value, grown beyond max_increase_pct (0 to 0 is 0 %, 0 to more is infinite).
    """
    rows = rules.join(baseline.select("pointer", F.col("actual").alias("b")), "pointer", "left").join(current.select("pointer", F.col("actual").alias("c")), "pointer", "left")
    rows = rows.withColumn("baseline_value", F.expr("try_cast(b as double)")).withColumn("current_value", F.expr("try_cast(c as double)"))
    base, now = F.col("baseline_value"), F.col("current_value")
    pct = F.when(base.isNull() | now.isNull(), F.lit(None).cast("double")).when(base == 0, F.when(now == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise((now - base) / F.abs(base) * 100)
    rows = rows.withColumn("p", pct)
    reason = (
        F.when(now.isNull(), F.lit("missing current" if not allow_missing_current else "allowed"))
        .when(now > F.col("max_value"), "above maximum")
        .when(F.col("max_increase_pct").isNotNull() & base.isNull(), F.lit("missing baseline" if not allow_missing_baseline else "allowed"))
        .when(F.col("p") > F.col("max_increase_pct"), "increased")
        .otherwise("ok")
    )
    shown = F.when(F.col("p") == float("inf"), F.col("p")).otherwise(round_away("p", 2))
    return rows.select("pointer", "level", "baseline_value", "current_value", shown.alias("change_pct"), reason.isin("ok", "allowed").alias("passed"), reason.alias("reason"))


def finding_id(tool: Column, check: Column, code: Column) -> Column:
    return F.concat_ws(".", tool, check, code)


def finding_fingerprint(tool: Column, check: Column, code: Column, path: Column) -> Column:
    """32 hex digits that name a finding at a place; a missing path counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\0", tool, check, code, F.coalesce(path, F.lit(""))), 256), 1, 32)


def findings(places: DataFrame, tool: str, check: str, code: str) -> DataFrame:
    """(id, fingerprint, path, line) of places (path, line)."""
    given = [F.lit(tool), F.lit(check), F.lit(code)]
    return places.select(finding_id(*given).alias("id"), finding_fingerprint(*given, F.col("path")).alias("fingerprint"), "path", "line")
