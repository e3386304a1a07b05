"""Digests, gates and scan bounds on hand-made rows."""

import hashlib

from siltstone.operators import baseline as base


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_source_digest(spark):
    schema = "repo string, path string, text string"
    rows = [("a", "x.rs", "é"), ("a", "Cargo.lock", "v"), ("a", "target/x.rs", "no"), ("b", "y.rs", None)]
    both = base.source_digest(spark.createDataFrame(rows + rows, schema), ("repo",)).orderBy("repo").collect()
    entry = f"y.rs:0:{sha('')}"
    assert [(r["repo"], r["files"], r["lock_hash"]) for r in both] == [("a", 2, sha("v")), ("b", 1, None)]
    assert both[1]["source_hash"] == sha(sha(sha(entry)))  # a leaf, its node and the root
    none = base.source_digest(spark.createDataFrame([], schema)).collect()
    assert [(r["files"], r["lock_hash"]) for r in none] == [(0, None)]
    moved = base.source_digest(spark.createDataFrame([("b", "z.rs", None)], schema)).first()
    assert moved["source_hash"] != both[1]["source_hash"]


def test_determinism_gate(spark):
    schema = "repo string, source_hash string, lock_hash string"
    old = spark.createDataFrame([("same", "1" * 20, "k"), ("gone", "2" * 20, None), ("lock", "3" * 20, "k"), ("other", "4" * 20, "k"), ("new lock", "5" * 20, None)], schema)
    now = spark.createDataFrame([("same", "1" * 20, "k"), ("lock", "3" * 20, None), ("other", "4" * 20, "j"), ("new lock", "5" * 20, "k"), ("unknown", "6", None)], schema)
    got = {r["repo"]: (r["status"], r["differences"]) for r in base.determinism_gate(old, now, ("repo",)).collect()}
    assert got == {
        "same": ("pass", []),
        "new lock": ("pass", []),
        "gone": ("warn", [f"source hash mismatch: expected {'2' * 16}, got none"]),
        "lock": ("warn", ["lock file missing (was present in baseline)"]),
        "other": ("warn", ["lock hash mismatch: expected k, got j"]),
    }


def test_scan_warnings(spark):
    files = spark.createDataFrame([("a", "Rust", 200_000), ("b", "Python", 10), ("c", "Markdown", 10**9), ("d", "Go", None)], "path string, lang string, bytes long")
    texts = [r["warning"] for r in base.scan_warnings(files).orderBy("ord").collect()]
    assert texts == [
        "complexity scan bounded: 1 of 3 eligible file(s) exceed default max_file_bytes=131072; complexity metrics are partial",
        f"complexity scan bounded: at least {200_000 - 131_072} byte(s) of eligible source were outside the scanned content window",
    ]
    assert base.scan_warnings(files, 10**6, 10**6).count() == 0
    assert [r["ord"] for r in base.scan_warnings(files, 10**6, 100).collect()] == [1]
    assert base.scan_warnings(files.limit(0), 1, 1).count() == 0


def test_supply_chain(spark):
    texts = {
        "high": '{"vulnerabilities": {"list": [{"advisory": {"id": "A", "severity": "HIGH"}, "package": {"name": "p"}}, {"advisory": null}]}}',
        "medium": '{"vulnerabilities": {"list": [{"advisory": {"severity": "medium"}}]}, "database": {"version": "9"}}',
        "unknown": '{"vulnerabilities": {"list": [{"advisory": {}}]}}',
        "empty": "{}",
        "null": '{"vulnerabilities": {"list": null}}',
        "scalar": "5",
        "array": "[]",
        "list": '{"vulnerabilities": {"list": 5}}',
        "cut": '{"vulnerabilities": ',
        "none": None,
    }
    audits = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {r["path"]: (r["status"], r["vulnerabilities"], r["db_version"]) for r in base.supply_chain_gate(audits).collect()}
    pending = dict.fromkeys(("scalar", "array", "list", "cut", "none"), ("pending", 0, None))
    assert got == pending | {"high": ("fail", 1, None), "medium": ("warn", 1, "9"), "unknown": ("pass", 1, None), "empty": ("pass", 0, None), "null": ("pass", 0, None)}
    found = {r["path"]: tuple(r)[1:] for r in base.vulnerabilities(audits).collect()}
    assert found == {"high": ("A", "p", "HIGH", ""), "medium": ("", "", "medium", ""), "unknown": ("", "", "unknown", "")}


def test_schema_gate(spark):
    diffs = [("add", "+++ b\n--- a\n+x"), ("type", '+a\n+b\n-  "type": 1'), ("less", "-a\n-b\n+c"), ("more", "-a\n+b\n+c"), ("empty", " \n"), ("none", None)]
    got = {r["name"]: (r["additions"], r["removals"], r["status"], r["summary"]) for r in base.schema_gate(spark.createDataFrame(diffs, "name string, text string")).collect()}
    assert got == {
        "add": (1, 0, "pass", "schema: 1 line added (additive only)"),
        "type": (2, 1, "fail", "schema: 2 additions, 1 removal (potential breaking change)"),
        "less": (1, 2, "fail", "schema: 1 addition, 2 removals (potential breaking change)"),
        "more": (2, 1, "pass", "schema: 2 additions, 1 removal"),
        "empty": (0, 0, "pass", None),
        "none": (0, 0, "pending", None),
    }
