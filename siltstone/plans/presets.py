"""Which reports an analysis runs, and the JSON entry point over them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import complexity, content, effort, history, inventory
from siltstone.sources import bundles, sinks

# The optional sections of each preset; the derived sections always run.
PRESETS = {
    "receipt": ["dup", "git", "complexity", "api_surface"], "estimate": ["dup", "git", "complexity", "api_surface", "churn"], "bun-ub": ["dup", "imports", "git", "complexity", "api_surface", "churn"], "health": ["todo", "complexity", "halstead"],
    "risk": ["git", "complexity", "halstead"], "supply": ["assets"], "architecture": ["imports", "api_surface"], "topics": ["topics"], "security": ["entropy", "license"], "identity": ["git", "archetype", "fingerprint"], "git": ["git", "churn"],
    "deep": ["todo", "dup", "imports", "git", "complexity", "halstead", "api_surface", "churn", "assets", "topics", "entropy", "license", "archetype", "fingerprint"], "fun": ["fun"],
}


@dataclass
class Facts:
    """The fact tables an analysis may use; a section whose tables are missing is left out with a warning."""

    files: DataFrame
    contents: DataFrame | None = None
    commits: DataFrame | None = None
    commit_files: DataFrame | None = None
    links: DataFrame | None = None
    roots: list[str] = field(default_factory=lambda: ["crates", "packages"])

    def touched(self) -> DataFrame:
        tracked = inventory.parents(self.files).select("path", "module", "lines")
        return history.touches(self.commits, self.commit_files, tracked)


DERIVED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "totals": inventory.totals, "doc_density": inventory.doc_density, "whitespace": inventory.whitespace, "verbosity": inventory.verbosity, "max_file": inventory.max_files, "lang_purity": inventory.lang_purity, "nesting": inventory.nesting,
    "test_density": inventory.test_density, "boilerplate": inventory.boilerplate, "polyglot": inventory.polyglot, "distribution": inventory.distribution, "histogram": inventory.size_histogram, "reading_time": inventory.reading_time,
    "context_window": inventory.context_window, "cocomo": inventory.cocomo, "integrity": inventory.integrity,
}
SECTIONS: dict[str, tuple[str, Callable[[Facts], dict[str, DataFrame]]]] = {
    "dup": ("contents", lambda f: {"duplicates": content.duplicate_groups(f.contents), "duplication_density": content.duplication_density(f.contents)}),
    "todo": ("contents", lambda f: {"todo": content.todo_density(f.contents, inventory.totals(f.files))}),
    "imports": ("links", lambda f: {"imports": content.import_edges(f.links)}),
    "git": ("commits", lambda f: {"hotspots": history.hotspots(f.touched()), "bus_factor": history.bus_factor(f.touched()), "freshness": history.freshness(f.touched()), "coupling": history.coupling(f.touched()), "intent": history.commit_intents(f.commits)}),
    "churn": ("commits", lambda f: {"churn": history.churn(f.touched())}),
    "fingerprint": ("commits", lambda f: {"domains": history.author_domains(f.commits)}),
    "complexity": ("contents", lambda f: {"complexity": complexity.file_complexity(f.contents)}),
    "halstead": ("contents", lambda f: {"halstead": complexity.halstead(f.contents)}),
    "api_surface": ("contents", lambda f: {"api_surface": complexity.api_surface(complexity.api_symbols(f.contents), "lang")}),
    "topics": ("files", lambda f: {"topics": content.topic_clouds(f.files, f.roots)}),
    "entropy": ("contents", lambda f: {"entropy": content.entropy_suspects(f.contents)}),
    "license": ("contents", lambda f: {"license": content.license_findings(f.contents)}),
    "assets": ("files", lambda f: {"assets": effort.assets(f.files)}),
    "archetype": ("files", lambda f: {"archetype": effort.archetype(f.files)}),
    "fun": ("files", lambda f: {"eco_label": effort.eco_label(f.files)}),
}


def analyze(facts: Facts, preset: str = "receipt") -> tuple[dict[str, DataFrame], list[str]]:
    """(reports by name, warnings). Reports are lazy: what is not read is not run."""
    reports = {name: make(facts.files) for name, make in DERIVED.items()}
    warnings = []
    for section in PRESETS[preset]:
        needs, make = SECTIONS[section]
        if getattr(facts, needs) is None:
            warnings.append(f"{section}: no {needs}")
        else:
            reports |= make(facts)
    return reports, warnings


def run_json(spark: SparkSession, mode: str, args: str, facts: Facts) -> str:
    """{"ok": true, "data": ...} or {"ok": false, "error": {"code", "message"}} for modes version, lang, module, export, analyze.

    export with `out` has the executors write the rows to that folder and gives its manifest; without, the answer holds them.
    """
    try:
        options = json.loads(args or "{}")
        if not isinstance(options, dict):
            raise ValueError("arguments must be an object")
        if mode == "version":
            data = {"version": "0.1.0", "schema_version": 2}
        elif mode == "lang":
            data = sinks.receipt("lang", options, rows=inventory.lang_report(facts.files, int(options.get("top", 0)), options.get("children", "collapse")))
        elif mode == "module":
            data = sinks.receipt("module", options, rows=inventory.module_report(facts.files, int(options.get("top", 0))))
        elif mode == "export" and options.get("out"):
            written = bundles.write_export(inventory.export_rows(facts.files, int(options.get("min_code", 0)), int(options.get("max_rows", 0))), options["out"], options.get("redact", "none"))
            data = sinks.receipt("export", options, manifest=written)
        elif mode == "export":
            data = sinks.receipt("export", options, rows=sinks.redact(inventory.export_rows(facts.files, int(options.get("min_code", 0)), int(options.get("max_rows", 0))), options.get("redact", "none")))
        elif mode == "analyze":
            reports, warnings = analyze(facts, options.get("preset", "receipt"))
            data = sinks.receipt("analyze", options, **reports) | {"warnings": warnings, "status": "partial" if warnings else "complete"}
        else:
            return json.dumps({"ok": False, "error": {"code": "unknown_mode", "message": f"unknown mode: {mode}"}})
    except json.JSONDecodeError as error:
        return json.dumps({"ok": False, "error": {"code": "invalid_json", "message": str(error)}})
    except (KeyError, ValueError, TypeError) as error:
        return json.dumps({"ok": False, "error": {"code": "invalid_settings", "message": str(error)}})
    return json.dumps({"ok": True, "data": data}, default=str)
