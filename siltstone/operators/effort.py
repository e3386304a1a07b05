"""Effort models, tags and change impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import is_infra_lang, ratio, round_away
from siltstone.operators.inventory import parents, size_basis, totals
from siltstone.sources.ignore_rules import attributed

# What tags a file for effort, in the order in which it is tried.
TAGS = [
    ("generated", r"/(generated|dist|build|target)/|\.min\.js$|\.map$"), ("vendored", r"/(vendor|third_party|node_modules|deps)/"), ("tests", r"/(test|tests)/|__tests__|_test\.|\.test\.|\.spec\."),
    ("docs", r"/docs?/|\.(md|rst|adoc|txt)$"), ("api", r"/api/|openapi|\.proto$"), ("ffi", r"/ffi/|bindings"), ("ui", r"/(ui|components|views)/|\.(css|scss|html|tsx|jsx)$"), ("data", r"/(data|migrations|schema)/|\.(sql|csv)$"), ("build", r"(^|/)(build\.rs|makefile|dockerfile|cmakelists\.txt)$|\.gradle$"),
]
#: (a, b, c, d): effort = a kloc^b, months = c effort^d.
MODELS = {"cocomo81": (2.4, 1.05, 2.5, 0.38), "cocomo2": (2.94, 1.10, 3.67, 0.28)}


def effort_tag(path: Column, lang: Column) -> Column:
    out = None
    for name, pattern in TAGS:
        hit = F.lower(path).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(is_infra_lang(lang), "infra").otherwise("core")


def effort_basis(rows: DataFrame) -> DataFrame:
    return size_basis(parents(rows).withColumn("tag", effort_tag(F.concat(F.lit("/"), F.col("path")), F.col("lang"))))


def effort_models(rows: DataFrame) -> DataFrame:
    """(model, effort_pm, months, staff) of both models and of their mean ("ensemble")."""
    return models(totals(rows))


def models(code: DataFrame) -> DataFrame:
    """effort_models from one row with the lines of code."""
    kloc = F.col("code").cast("double") / 1000.0
    one = code.where("code > 0").select(kloc.alias("k"))
    for name, (a, b, c, d) in MODELS.items():
        one = one.withColumn(f"{name}_e", F.lit(a) * F.pow("k", F.lit(b))).withColumn(f"{name}_m", F.lit(c) * F.pow(f"{name}_e", F.lit(d)))
    mean = lambda x: (F.col(f"cocomo81_{x}") + F.col(f"cocomo2_{x}")) / 2.0
    one = one.withColumn("ensemble_e", mean("e")).withColumn("ensemble_m", mean("m"))
    rows_ = [F.struct(F.lit(n).alias("model"), F.col(f"{n}_e").alias("e"), F.col(f"{n}_m").alias("m")) for n in (*MODELS, "ensemble")]
    out = one.select(F.explode(F.array(*rows_)).alias("r")).select("r.*")
    return out.select("model", round_away("e", 2).alias("effort_pm"), round_away("m", 2).alias("months"), round_away(F.col("e") / F.col("m"), 2).alias("staff"))


def blast_radius(changed: DataFrame, files: DataFrame, hot: DataFrame, coupled: DataFrame) -> DataFrame:
    """Impact of changed paths: modules touched, hotspots and coupled modules among them, and a clamped score."""
    inside = files.join(changed.select("path").distinct(), "path", "left_semi")
    n = inside.agg(F.count("*").alias("files_touched"), F.countDistinct("module").alias("modules_touched"))
    all_modules = files.agg(F.countDistinct("module").alias("all_modules"))
    hits = inside.join(hot.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("hotspots_touched"))
    pairs = coupled.join(inside.select(F.col("module").alias("left_module")).distinct(), "left_module", "left_semi").join(inside.select(F.col("module").alias("right_module")).distinct(), "right_module", "left_semi")
    out = n.crossJoin(F.broadcast(all_modules)).crossJoin(F.broadcast(hits)).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("coupled_pairs"))))  # one row each
    crossed = F.when(F.col("modules_touched") > 1, 1.0).otherwise(0.0)
    share = F.when(F.col("all_modules") > 0, F.col("modules_touched") / F.col("all_modules")).otherwise(0.0)
    score = 15.0 * crossed + 3.0 * share + F.log1p(F.col("files_touched").cast("double")) + 2.0 * F.col("hotspots_touched") + 2.0 * F.col("coupled_pairs")
    return out.select("files_touched", "modules_touched", "hotspots_touched", "coupled_pairs", round_away(F.least(score, F.lit(100.0)), 2).alias("score"))


# File families of assets.
ASSETS = {"archive": "7z bz2 gz tar xz zip", "audio": "flac mp3 ogg wav", "binary": "bin dll dylib exe so", "font": "eot otf ttf woff woff2", "image": "gif ico jpeg jpg png svg webp", "video": "avi mkv mov mp4 webm"}


def assets(files: DataFrame) -> DataFrame:
    """(category, files, bytes, extensions) of (path, bytes)."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = None
    for name, names in ASSETS.items():
        kind = F.when(ext.isin(names.split()), name) if kind is None else kind.when(ext.isin(names.split()), name)
    rows = files.withColumn("ext", ext).withColumn("category", kind).where("category is not null")
    return rows.groupBy("category").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"))


def eco_label(rows: DataFrame) -> DataFrame:
    """A to E by megabytes: 1, 10, 50, 200."""
    mb = F.col("bytes") / (1024.0 * 1024.0)
    label = F.when(mb <= 1, "A").when(mb <= 10, "B").when(mb <= 50, "C").when(mb <= 200, "D").otherwise("E")
    return totals(rows).select(label.alias("label"), "bytes", ratio("bytes", F.lit(1024 * 1024), 2).alias("megabytes"))


def archetype(paths: DataFrame) -> DataFrame:
    """The first kind of repository whose files are there."""
    has = lambda p: F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False))
    flags = paths.agg(
        has(r"^Cargo\.toml$").alias("cargo"), has(r"^crates/").alias("crates"), has(r"(^|/)src/main\.rs$|/src/bin/").alias("cli"), has(r"(^|/)package\.json$").alias("node"), has(r"(^|/)next\.config\.(js|mjs|ts)$").alias("next"),
        has(r"(^|/)Dockerfile$").alias("docker"), has(r"^(k8s|kubernetes)/|(^|/)charts?/").alias("k8s"), has(r"\.tf$|^terraform/").alias("iac"), has(r"(^|/)pyproject\.toml$").alias("python"),
    )
    kind = F.when(F.col("cargo") & F.col("crates") & F.col("cli"), "Rust workspace (CLI)").when(F.col("cargo") & F.col("crates"), "Rust workspace").when(F.col("node") & F.col("next"), "Next.js app")
    kind = kind.when(F.col("docker") & F.col("k8s"), "Containerized service").when(F.col("iac"), "Infrastructure as code")
    return flags.select(kind.when(F.col("python"), "Python package").when(F.col("node"), "Node package").alias("kind")).where("kind is not null")


# Drivers of effort: key, signal, when it counts, and its weight from the signal, with the bounds of the weight.
DRIVERS = [
    ("generated_files", "generated_pct", lambda x: x > 0.30, lambda x: x * 0.8, 0.05, 0.75),
    ("vendored_files", "vendored_pct", lambda x: x > 0.25, lambda x: x * 0.9, 0.05, 0.65),
    ("freshness_staleness", "stale_pct", lambda x: x > 0.30, lambda x: x * 0.95, 0.06, 0.95),
    ("module_coupling", "coupling_links", lambda x: x > 0, lambda x: x / 120.0, 0.1, 0.7),
    ("complexity_hotspots", "max_cyclomatic", lambda x: x > 30, lambda x: (x - 20.0) / 200.0, 0.15, 0.75),
    ("complexity_breadth", "avg_cyclomatic", lambda x: x > 4.0, lambda x: (x - 1.0) / 30.0, 0.08, 0.45),
    ("api_documentation", "public_ratio", lambda x: x < 0.20, lambda x: F.lit(0.35), 0.35, 0.35),
    ("api_documented_ratio", "documented_ratio", lambda x: x < 0.50, lambda x: F.lit(0.20), 0.20, 0.20),
    ("duplication", "wasted_bytes", lambda x: x > 0, lambda x: x / 12_000.0, 0.1, 0.7),
    ("test_density", "test_ratio", lambda x: x < 0.10, lambda x: F.lit(0.55), 0.55, 0.55),
    ("polyglot_spread", "lang_count", lambda x: x > 8, lambda x: x / 20.0, 0.1, 0.45),
    ("classification_fallback", "warnings", lambda x: x > 0, lambda x: F.lit(0.08), 0.08, 0.08),
]
SIGNALS = [name for _, name, *_ in DRIVERS]


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def effort_drivers(signals: DataFrame) -> DataFrame:
    """(key, weight, value) of what raises effort, the heaviest first; signals: one row, a column null or absent where its report is missing."""
    have = [d for d in DRIVERS if d[1] in signals.columns]
    value = lambda name: F.col(name).cast("double")
    found = F.array(*(F.when(test(value(name)), F.struct(F.lit(key).alias("key"), clamped(weight(value(name)), low, high).alias("weight"), value(name).alias("value"))) for key, name, test, weight, low, high in have))
    return signals.select(F.explode(F.array_compact(found)).alias("d")).select("d.*").orderBy(F.desc("weight"), "key")


def effort_confidence(signals: DataFrame) -> DataFrame:
    """(score, level) of what the estimate rests on. signals also has classification (high, medium, low), and may have hotspots, test_lines, delta."""
    col = lambda name: F.col(name).cast("double") if name in signals.columns else F.lit(None).cast("double")
    given = lambda *names: F.coalesce(*(F.when(col(n).isNotNull(), True) for n in names), F.lit(False))
    add = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)
    git, shape = given("stale_pct", "coupling_links"), given("avg_cyclomatic")
    score = (
        F.lit(0.25) + add(F.coalesce(col("warnings"), F.lit(0.0)) == 0, 0.10) + F.when(F.col("classification") == "high", 0.25).when(F.col("classification") == "medium", 0.15).otherwise(0.0)
        + add(git, 0.12) + add(git & (col("stale_pct") > 0), 0.02) + add(git & (col("hotspots") > 0), 0.03) + add(shape, 0.10) + add(shape & (col("avg_cyclomatic") > 0), 0.04) + add(shape & (col("max_cyclomatic") > 30), 0.02)
        + add(given("public_ratio"), 0.08) + add(given("wasted_bytes"), 0.05) + add(col("test_lines") > 0, 0.10) + add(col("delta") > 0, 0.05)
    )
    worn = F.coalesce(col("generated_pct"), F.lit(0.0)) + F.coalesce(col("vendored_pct"), F.lit(0.0))
    out = signals.select(clamped(score - worn * 0.20, 0.0, 1.0).alias("score"))
    return out.withColumn("level", F.when(F.col("score") >= 0.72, "high").when(F.col("score") >= 0.45, "medium").otherwise("low"))


def effort_bands(estimates: DataFrame, confidence: DataFrame, drivers: DataFrame) -> DataFrame:
    """(model, effort_pm, effort_low, effort_p80, months, months_low, months_p80, staff_low, staff_p80): wider the less the estimate rests on."""
    pressure = drivers.agg(clamped(F.coalesce(F.sum(F.greatest("weight", F.lit(0.0))), F.lit(0.0)), 0.0, 0.85).alias("pressure"))
    one = confidence.crossJoin(F.broadcast(pressure))  # one row each
    base = F.when(F.col("level") == "high", 0.10).when(F.col("level") == "medium", 0.22).otherwise(0.35)
    width = clamped(base + F.col("pressure") * 0.06 + clamped(1.0 - F.col("score"), 0.0, 0.8) * 0.45 + clamped(1.0 - F.col("score"), 0.0, 0.6) * 0.35, 0.04, 0.85)
    rows = estimates.crossJoin(F.broadcast(one.select(width.alias("width")))).withColumn("turn", clamped(F.col("width") * 0.62, 0.03, 0.70))  # three models
    e, m, w, t = (F.col(c) for c in ("effort_pm", "months", "width", "turn"))
    low, high, soon, late = e * (1.0 - w), e * (1.0 + w), m * (1.0 - t), m * (1.0 + t)
    return rows.select(
        "model", "effort_pm", round_away(low, 2).alias("effort_low"), round_away(high, 2).alias("effort_p80"), "months", round_away(soon, 2).alias("months_low"), round_away(late, 2).alias("months_p80"),
        round_away(F.when(late > 0, low / late).otherwise(0.0), 2).alias("staff_low"), round_away(F.when(soon > 0, high / soon).otherwise(0.0), 2).alias("staff_p80"),
    )


# What the first lines of a generated file say.
SENTINELS = ["generated by", "do not edit", "auto-generated", "autogenerated"]


def generated_sentinel(text: Column, most_lines: int = 40) -> Column:
    """Whether one of the first lines says that the file is generated."""
    head = F.array_join(F.slice(F.split(F.lower(text), "\n", most_lines + 1), 1, most_lines), "\n")
    return F.coalesce(F.regexp_like(head, F.lit("|".join(SENTINELS))), F.lit(False))


def effort_kinds(contents: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(path, kind) of (path, lang, text): attribute rules first, then what its first lines say, then its path and language."""
    kind = F.when(generated_sentinel(F.col("text")), "generated").otherwise(effort_tag(F.concat(F.lit("/"), F.col("path")), F.col("lang")))
    own = contents.select("path", kind.alias("own"))
    if rules is None:
        return own.select("path", F.col("own").alias("kind"))
    return attributed(own, rules, ["own"]).select("path", F.coalesce("kind", "own").alias("kind"))
