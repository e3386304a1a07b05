"""Writers and renderers of reports. Row-sized output stays distributed; a report's few rows are rendered on the driver."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import redact_path, short_hash

ROW = ["path", "module", "lang", "kind", "code", "comments", "blanks", "lines", "bytes", "tokens"]


def redact(rows: DataFrame, mode: str = "none") -> DataFrame:
    """none; paths: hashed paths that keep a plain extension; all: hashed modules as well."""
    if mode in ("paths", "all"):
        rows = rows.withColumn("path", redact_path("path"))
    return rows.withColumn("module", short_hash("module")) if mode == "all" else rows


def write_csv(rows: DataFrame, path: str, mode: str = "none") -> None:
    redact(rows, mode).select(ROW).write.option("header", True).csv(path)


def jsonl(rows: DataFrame, mode: str = "none") -> DataFrame:
    return redact(rows, mode).select(F.to_json(F.struct(F.lit("row").alias("type"), *ROW)).alias("value"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "none") -> None:
    """A folder of JSON lines; meta() goes beside it."""
    jsonl(rows, mode).write.text(path)


def cyclonedx(rows: DataFrame) -> DataFrame:
    """One CycloneDX component per file row."""
    props = F.array(*(F.struct(F.lit(f"inventory:{c}").alias("name"), F.col(c).cast("string").alias("value")) for c in ("lang", "code", "comments", "blanks", "lines", "bytes", "tokens")))
    name = F.element_at(F.split("path", "/"), -1)
    group = F.when(F.col("module") != "(root)", F.col("module"))
    return rows.select(F.to_json(F.struct(F.lit("file").alias("type"), name.alias("name"), group.alias("group"), F.col("path").alias("bom-ref"), props.alias("properties"))).alias("value"))


def meta(mode: str, **args) -> str:
    return json.dumps({"type": "meta", "schema_version": 2, "mode": mode, "args": args}, sort_keys=True)


def table_rows(report: DataFrame) -> tuple[list[str], list[list]]:
    """A report's rows; reports have a row per language, module or section."""
    return report.columns, [list(r) for r in report.collect()]


def markdown(report: DataFrame, title: str = "") -> str:
    names, rows = table_rows(report)
    number = [t in ("bigint", "int", "double", "float") for _, t in report.dtypes]
    out = [f"# {title}", ""] if title else []
    out += ["|" + "|".join(names) + "|", "|" + "|".join("---:" if n else "---" for n in number) + "|"]
    return "\n".join(out + ["|" + "|".join("" if v is None else str(v).replace("|", "\\|") for v in r) + "|" for r in rows]) + "\n"


def tsv(report: DataFrame) -> str:
    names, rows = table_rows(report)
    return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in [names, *rows]) + "\n"


def receipt(mode: str, args: dict, **reports: DataFrame) -> dict:
    payload = {}
    for name, report in reports.items():
        names, rows = table_rows(report)
        payload[name] = [dict(zip(names, r, strict=True)) for r in rows]
    return {"schema_version": 2, "tool": {"name": "siltstone"}, "mode": mode, "status": "complete", "warnings": [], "args": args} | payload


def badge_svg(label: str, value: str) -> str:
    a, b = (max(60, 7 * len(x) + 20) for x in (label, value))
    label, value = html.escape(label), html.escape(value)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{a + b}" height="24" role="img"><rect width="{a}" height="24" fill="#555"/><rect x="{a}" width="{b}" height="24" fill="#4c9"/><text x="{a // 2}" y="16" text-anchor="middle" fill="#fff">{label}</text><text x="{a + b // 2}" y="16" text-anchor="middle" fill="#fff">{value}</text></svg>\n'


def mermaid(edges: DataFrame, most: int = 200) -> str:
    """An import graph of the first `most` edges (the format's own limit)."""
    name = lambda x: re.sub(r"[^A-Za-z0-9_]", "_", x)
    rows = edges.orderBy(F.desc("count"), "source", "target").limit(most).collect()
    return "graph TD\n" + "".join(f"  {name(r['source'])} -->|{r['count']}| {name(r['target'])}\n" for r in rows)


def tree_text(nodes: DataFrame) -> str:
    """An indented tree of path_tree() rows."""
    rows = nodes.orderBy("node").collect()
    return "".join(f"{'  ' * (r['depth'] - 1)}{r['node'].rsplit('/', 1)[-1]} (lines: {r['lines']}, tokens: {r['tokens']})\n" for r in rows)


def xml(report: DataFrame, root: str = "analysis", item: str = "row") -> str:
    names, rows = table_rows(report)
    body = "".join(f"<{item} " + " ".join(f'{n}="{html.escape("" if v is None else str(v))}"' for n, v in zip(names, r, strict=True)) + "/>" for r in rows)
    return f"<{root}>{body}</{root}>\n"


def jsonld(totals: DataFrame, name: str = "") -> str:
    row = totals.first().asDict()
    return json.dumps({"@context": "https://schema.org", "@type": "SoftwareSourceCode", "name": name, **{k: v for k, v in row.items()}}, sort_keys=True)


def html_report(totals: DataFrame, top: DataFrame, title: str = "Inventory") -> str:
    cards = "".join(f"<div class=card><b>{v}</b> {html.escape(k)}</div>" for k, v in totals.first().asDict().items())
    names, rows = table_rows(top.limit(100))
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows], default=str).replace("</", "<\\/")
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{cards}<table><tr>{head}</tr>{body}</table><script type=application/json id=report>{data}</script>\n"
