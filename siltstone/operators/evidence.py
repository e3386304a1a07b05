"""Evidence artifacts of five schemas, read as VARIANT, with execution status, commit match and availability; the review map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of artifacts, as their schema names them before its version.
KINDS = ["proof_run_summary", "proof_run_observation", "proof_executor_observation", "coverage_receipt", "proof_pack_route"]
# What states say, and availability by precedence.
PASSED, FAILED, PLANNED = ["passed", "pass", "success"], ["failed", "fail", "error"], ["planned"]
DRY, SKIPPED = ["dry_run", "dry-run"], ["skipped", "not_executed", "not-executed"]
AVAILABILITY = ["missing", "stale", "degraded", "available", "skipped", "unavailable"]
ENTRY = "array<struct<scope:string,name:string,command:string,required:boolean,status:string,skip_reason:string,exit_code:bigint>>"
ARTIFACT = "array<struct<non_empty:boolean>>"


def blank_null(x: Column) -> Column:
    return F.nullif(F.trim(x, F.lit(" \t\r\n")), F.lit(""))


def execution_status(status: Column, exit_code: Column) -> Column:
    """By the stated status, else by the exit code."""
    s = F.lower(F.trim(status))
    named = F.when(s.isin(PASSED), "executed_passed").when(s.isin(FAILED), "executed_failed").when(s.isin(PLANNED), "planned").when(s.isin(DRY), "dry_run").when(s.isin(SKIPPED), "not_executed")
    return F.coalesce(named, F.when(exit_code == 0, "executed_passed").when(exit_code.isNotNull(), "executed_failed").otherwise("not_executed"))


def commit_match(base: Column, head: Column, own_base: str | None, own_head: str | None) -> Column:
    """exact or stale where both heads are commits, partial where anything is known, else unknown."""
    b, h, ob, oh = blank_null(base), blank_null(head), blank_null(F.lit(own_base).cast("string")), blank_null(F.lit(own_head).cast("string"))
    commit = lambda x: F.coalesce(x.rlike(r"^[0-9a-fA-F]{6,}$"), F.lit(False))
    known = b.isNotNull() | h.isNotNull() | ob.isNotNull() | oh.isNotNull()
    return F.when(commit(h) & commit(oh), F.when(h == oh, "exact").otherwise("stale")).when(known, "partial").otherwise("unknown")


def matched(availability: Column, match: Column) -> Column:
    """Evidence of another commit is stale; available evidence of an uncertain one is degraded."""
    return F.when(match == "stale", "stale").when((match != "exact") & (availability == "available"), "degraded").otherwise(availability)


def normalize(artifacts: DataFrame, base: str | None, head: str | None) -> DataFrame:
    """(source_path, kind, profile, scope, command, required, execution_status, availability, commit_match, run_url, ref), one row an entry.

    artifacts: (path, text). What is no JSON, names no known schema or lacks what its schema needs gives one row of kind
    malformed, which is unavailable. Evidence that is not required is advisory.
    """
    v = F.try_parse_json(F.col("text"))
    text = lambda p: F.try_variant_get(v, p, "string")
    flag = lambda p: F.try_variant_get(v, p, "boolean")
    rows = artifacts.select("path", v.alias("v")).withColumn("schema", F.try_variant_get("v", "$.schema", "string"))
    v = F.col("v")
    kind = F.nullif(F.regexp_extract("schema", rf"(?:^|\.)({'|'.join(KINDS)})\.v1$", 1), F.lit(""))
    coverage = kind == "coverage_receipt"
    entries = F.when(kind == "proof_run_summary", F.try_variant_get(v, "$.entries", ENTRY)).when(kind.isin(KINDS[1:3]), F.try_variant_get(v, "$.scopes", ENTRY))
    files = F.try_variant_get(v, "$.artifacts", ARTIFACT)
    whole = F.coalesce(text("$.head"), text("$.sha")).isNotNull() & F.when(coverage, files.isNotNull() & flag("$.status.ok").isNotNull()).when(kind == "proof_pack_route", F.lit(True)).otherwise(entries.isNotNull())
    rows = rows.withColumn("kind", F.when(whole, kind)).withColumn("entries", entries).withColumn("files", files)
    kind = F.col("kind")
    rows = rows.withColumn("match", commit_match(F.when(coverage, F.lit(None).cast("string")).otherwise(text("$.base")), F.when(coverage, text("$.sha")).otherwise(text("$.head")), base, head))

    def entry(e: Column, i: Column) -> Column:
        told = execution_status(e["status"], e["exit_code"])
        summary = kind == "proof_run_summary"
        status = F.when(summary & blank_null(e["skip_reason"]).isNotNull() & e["exit_code"].isNull(), "not_executed").otherwise(told)
        required = F.when(summary, e["required"]).when(kind == "proof_run_observation", F.try_variant_get(v, "$.counts.required_planned", "bigint") > 0).otherwise(flag("$.required"))
        got = F.when(status.isin("executed_passed", "executed_failed"), "available").when(status == "dry_run", "skipped").otherwise("missing")
        part = F.when(summary, "#/entries/").otherwise("#/scopes/")
        return F.struct(
            F.when(summary, e["scope"]).otherwise(e["name"]).alias("scope"), e["command"].alias("command"), F.coalesce(required, F.lit(False)).alias("required"), status.alias("status"), got.alias("got"),
            F.concat(F.replace("path", F.lit("\\"), F.lit("/")), part, i.cast("string")).alias("ref"),
        )

    none = F.lit(None).cast("string")
    some = F.coalesce(F.exists("files", lambda x: F.coalesce(x["non_empty"], F.lit(False))), F.lit(False))
    listed = lambda p: F.coalesce(F.size(F.try_variant_get(v, p, "array<string>")), F.lit(0)) > 0
    receipt = F.when(flag("$.status.ok") & some, "available").when(listed("$.status.missing"), "missing").when(listed("$.status.empty") | ~some, "degraded").otherwise("unavailable")
    single = lambda scope, status, got, ref: F.array(F.struct(scope.alias("scope"), none.alias("command"), F.lit(False).alias("required"), status.alias("status"), got.alias("got"), ref.alias("ref")))
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    found = (
        F.when(coverage & kind.isNotNull(), single(text("$.flag"), F.when(flag("$.status.ok"), "executed_passed").otherwise("executed_failed"), receipt, F.concat(path, F.lit("#/artifacts"))))
        .when(kind == "proof_pack_route", single(F.lit("proof_pack_route"), F.lit("planned"), F.lit("available"), F.concat(path, F.lit("#/summary"))))
        .when(kind.isNull(), single(none, F.lit("not_executed"), F.lit("unavailable"), path))
        .otherwise(F.transform("entries", entry))
    )
    repo, run = blank_null(text("$.repo")), blank_null(text("$.github.run_id"))
    url = F.when(coverage & repo.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$") & run.rlike("^[0-9]+$"), F.concat(F.lit("https://github.com/"), repo, F.lit("/actions/runs/"), run))
    rows = rows.withColumn("profile", F.when(kind.isin(KINDS[:3]), text("$.profile"))).withColumn("run_url", url).withColumn("found", found)
    # outer, since for an inner one Spark infers a filter on the array, which it moves below the parse with all of this written out in it
    out = rows.select("path", "kind", "profile", "match", "run_url", F.explode_outer("found").alias("e")).where("e is not null").fillna("malformed", ["kind"])
    known = F.col("kind") != "malformed"
    return out.select(
        F.col("path").alias("source_path"), "kind", "profile", "e.scope", "e.command", "e.required", F.col("e.status").alias("execution_status"), F.when(known, matched(F.col("e.got"), F.col("match"))).otherwise(F.col("e.got")).alias("availability"),
        F.when(known, F.col("match")).otherwise("unknown").alias("commit_match"), "run_url", F.col("e.ref").alias("ref"),
    )


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """(scope, entries, required, six counts by availability, status): status is the availability that comes first in precedence."""
    place = F.array_position(F.array(*map(F.lit, AVAILABILITY)), F.col("availability"))
    out = evidence.groupBy("scope").agg(
        F.count("*").alias("entries"), F.sum(F.col("required").cast("long")).alias("required"), *(F.sum((F.col("availability") == a).cast("long")).alias(a) for a in AVAILABILITY), F.min(place).alias("k")
    )
    return out.select("scope", "entries", "required", *AVAILABILITY, F.element_at(F.array(*map(F.lit, AVAILABILITY)), F.col("k").cast("int")).alias("status"))


def review_map(items: DataFrame, evidence: DataFrame, truth: list[str], contract: str = r"(lib|mod)\.rs$") -> DataFrame:
    """(path, bucket, priority, complexity, lines_changed, status) in the order of review; evidence: (path, availability).

    Buckets: sources of truth (paths that begin so), missing, stale, degraded evidence, complexity from 4, contract
    paths, priority 1, priority 2, available evidence, skipped evidence, the rest; then priority, complexity and lines
    descending, path.
    """
    place = F.array_position(F.array(*map(F.lit, AVAILABILITY)), F.col("availability"))
    flags = evidence.groupBy("path").agg(*(F.bool_or(F.col("availability") == a).alias(a) for a in AVAILABILITY), F.min(F.when(place > 0, place)).alias("k"))
    rows = items.join(flags, "path", "left")
    has = lambda a: F.coalesce(a, F.lit(False))
    begins = F.lit(False)
    for t in truth:
        begins = begins | F.col("path").startswith(t)
    complexity = F.coalesce("complexity", F.lit(0))
    tests = [begins, has("missing"), has("stale"), has("degraded"), complexity >= 4, F.col("path").rlike(contract), F.col("priority") <= 1, F.col("priority") == 2, has("available"), has("skipped")]
    bucket = F.coalesce(*(F.when(t, k) for k, t in enumerate(tests)), F.lit(len(tests)))
    out = rows.select("path", bucket.cast("long").alias("bucket"), "priority", complexity.cast("long").alias("complexity"), F.coalesce("lines_changed", F.lit(0)).cast("long").alias("lines_changed"), F.element_at(F.array(*map(F.lit, AVAILABILITY)), F.col("k").cast("int")).alias("status"))
    return out.orderBy("bucket", "priority", F.desc("complexity"), F.desc("lines_changed"), "path")
