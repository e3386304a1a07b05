"""Evidence artifacts: states, commit match, malformed input, the order of review."""

import json

import duckdb

from siltstone.operators import evidence as evi
from siltstone.plans.code_queries import QUERIES

HEAD = "abc123"


def states(spark, artifact, head=HEAD):
    text = artifact if isinstance(artifact, str) else json.dumps(artifact)
    rows = evi.normalize(spark.createDataFrame([("p\\e.json", text)], "path string, text string"), "origin/main", head).collect()
    return [(r["kind"], r["scope"], r["required"], r["execution_status"], r["availability"], r["commit_match"]) for r in rows]


def run(**more):
    return {"schema": "x.proof_run_observation.v1", "profile": "fast", "base": "b", "head": HEAD, "counts": {"required_planned": 1}, "scopes": [{"name": "s", "command": "c", "status": "passed", "exit_code": 0}]} | more


def test_five_schemas_and_states(spark):
    assert states(spark, run()) == [("proof_run_observation", "s", True, "executed_passed", "available", "exact")]
    assert states(spark, run(head="HEAD"), "HEAD") == [("proof_run_observation", "s", True, "executed_passed", "degraded", "partial")]
    assert states(spark, run(head="def456"))[0][-2:] == ("stale", "stale")
    entries = [{"scope": "a", "command": "c", "required": True, "status": "odd", "skip_reason": "", "exit_code": 1}, {"scope": "b", "command": "c", "required": False, "status": "passed", "skip_reason": " why", "exit_code": None}]
    assert states(spark, run(schema="x.proof_run_summary.v1", entries=entries)) == [("proof_run_summary", "a", True, "executed_failed", "available", "exact"), ("proof_run_summary", "b", False, "not_executed", "missing", "exact")]
    assert states(spark, run(schema="x.proof_executor_observation.v1", required=False, scopes=[{"name": "s", "command": "c", "status": "dry-run", "exit_code": None}])) == [("proof_executor_observation", "s", False, "dry_run", "skipped", "exact")]
    receipt = {"schema": "x.coverage_receipt.v1", "sha": HEAD, "flag": "f", "repo": "o/r", "github": {"run_id": "12"}, "status": {"ok": True, "missing": [], "empty": []}, "artifacts": [{"non_empty": True}]}
    assert states(spark, receipt) == [("coverage_receipt", "f", False, "executed_passed", "available", "exact")]
    for status, files, want in [({"ok": False, "missing": ["x"], "empty": []}, [{"non_empty": True}], "missing"), ({"ok": False, "missing": [], "empty": ["x"]}, [{"non_empty": True}], "degraded"), ({"ok": True, "missing": [], "empty": []}, [], "degraded"), ({"ok": False, "missing": [], "empty": []}, [{"non_empty": True}], "unavailable")]:
        assert states(spark, receipt | {"status": status, "artifacts": files})[0][4] == want
    assert states(spark, run(schema="x.proof_pack_route.v1")) == [("proof_pack_route", "proof_pack_route", False, "planned", "available", "exact")]


def test_malformed_input_has_a_state(spark):
    bad = ("malformed", None, False, "not_executed", "unavailable", "unknown")
    for text in ("", "{", "[1]", json.dumps(run(schema="x.other.v1")), json.dumps(run(schema=3)), json.dumps(run(scopes="x")), json.dumps({k: v for k, v in run().items() if k != "head"})):
        assert states(spark, text) == [bad], text
    assert evi.normalize(spark.createDataFrame([("p", None)], "path string, text string"), None, None).count() == 1


def test_review_order(spark):
    items = spark.createDataFrame([("a.rs", 3, 1, 5), ("b.rs", 3, 5, 5), ("src/lib.rs", 3, 1, 5), ("docs/x", 3, 1, 5), ("c.rs", 3, 1, 5), ("d.rs", 1, 1, 5), ("e.rs", 2, 1, 5), ("f.rs", 2, 2, 5), ("g.rs", 3, 1, 9), ("h.rs", 3, 1, 5)], "path string, priority long, complexity long, lines_changed long")
    found = spark.createDataFrame([("c.rs", "stale"), ("c.rs", "missing"), ("g.rs", "available"), ("h.rs", "skipped")], "path string, availability string")
    got = [(r["path"], r["bucket"]) for r in evi.review_map(items, found, ["docs/"]).collect()]
    assert got == [("docs/x", 0), ("c.rs", 1), ("b.rs", 4), ("src/lib.rs", 5), ("d.rs", 6), ("f.rs", 7), ("e.rs", 7), ("g.rs", 8), ("h.rs", 9), ("a.rs", 10)]


def test_each_artifact_is_parsed_once(spark):
    rows = evi.normalize(spark.createDataFrame([("p", json.dumps(run()))], "path string, text string"), "b", HEAD)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # a filter inferred for the explode wrote the parse out 3 000 times
    none, one = run(scopes=[]), run(schema="x.proof_run_summary.v1", entries=[None])
    assert states(spark, none) == [] and states(spark, one) == [("proof_run_summary", None, False, "not_executed", "missing", "exact")]


def test_summary_parses_each_artifact_once(spark, tmp_path):
    spark.createDataFrame([(k, k, "F") for k in range(84)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    summary = QUERIES["evidence_summary"][0](spark, str(tmp_path))
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, summary.select(*[d[0] for d in con.execute(QUERIES["evidence_summary"][1]).description]).collect()), key=repr) == sorted(con.fetchall(), key=repr)


def test_review_map_parses_only_what_parts_are_named_for(spark):
    plan = QUERIES["review_map"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "parseJson" in plan[: plan.index("LeftSemi")]  # the semi join stands below the parse
