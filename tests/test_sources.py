"""Readers, sinks, presets and the streaming forms."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from siltstone.operators import content, inventory
from siltstone.plans import presets
from siltstone.sources import adapters, sinks, text
from siltstone.streaming import history as live

DATA = "/root/testdata/sf0.001"


def test_read_tree_and_file_rows(spark, tmp_path):
    (tmp_path / "crates/foo/src").mkdir(parents=True)
    (tmp_path / "crates/foo/src/lib.rs").write_text("// hello\nfn a() {}\n\nfn b() {}\n")
    (tmp_path / "run").write_text("#!/usr/bin/env python3\nprint(1)\n")
    (tmp_path / "blob.py").write_bytes(b"a\0b")
    rows = {r["path"]: r for r in text.file_rows(text.read_tree(spark, str(tmp_path)), ["crates"]).collect()}
    assert set(rows) == {"crates/foo/src/lib.rs", "run"}
    lib = rows["crates/foo/src/lib.rs"]
    assert (lib["module"], lib["code"], lib["comments"], lib["blanks"], lib["lines"], lib["bytes"], lib["tokens"]) == ("crates/foo", 2, 1, 1, 4, 160, 40)
    assert rows["run"]["lang"] == "Python"


def test_checked_inputs_and_exclude(spark):
    rows = spark.createDataFrame([("./a.rs", ""), ("/abs", ""), ("x/../y", ""), ("B.rs", ""), ("b.rs", ""), ("target/z.rs", "")], "path string, text string")
    safe = text.checked_inputs(rows)
    assert {r["path"] for r in safe.collect()} == {"a.rs", "target/z.rs"}
    assert {r["path"] for r in text.exclude(safe, ["target"]).collect()} == {"a.rs"}
    assert {r["path"] for r in text.exclude(safe, ["**/*.rs"]).collect()} == set()


def test_zip(spark):
    def archive(**entries):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in entries.items():
                z.writestr(name.replace("__", "/"), body)
        return data.getvalue()

    rows = spark.createDataFrame([("ok", archive(src__a="x = 1")), ("up", archive(**{"..__b": "x"})), ("bomb", archive(c="0" * 1_000_000)), ("no", b"none")], "path string, content binary")
    got = {r["archive"]: (r["path"], r["error"] is None) for r in text.read_zip(rows).collect()}
    assert got == {"ok": ("src/a", True), "up": (None, False), "bomb": (None, False), "no": (None, False)}


def test_history_numstat_and_diff(spark):
    log = spark.createDataFrame([("r", "20|a@x|ff|fix: a | b\nsrc/a.rs\nsrc/b.rs\n\n10|b@y|ee|init\nsrc/a.rs\n")], "repo string, text string")
    commits, touched = text.parse_history(log)
    assert [(r["ts"], r["subject"]) for r in commits.orderBy("seq").collect()] == [(20, "fix: a | b"), (10, "init")]
    assert touched.count() == 3
    stat = spark.createDataFrame([("3\t1\ta.rs",), ("-\t-\tlogo.png",), ("bad",)], "value string")
    assert sorted(map(tuple, text.parse_numstat(stat).collect())) == [("a.rs", 3, 1), ("logo.png", 0, 0)]
    diff = spark.createDataFrame([("d", "--- a/x\n+++ b/x\n@@ -1 +2,2 @@\n+a\n+b\n@@ -9,1 +9,0 @@\n@@ -9 +20 @@\n+c")], "name string, text string")
    assert sorted(r["line"] for r in text.parse_added_lines(diff).collect()) == [2, 3, 20]


def test_lcov(spark):
    report = "DA:1,1\nSF:a\nDA:1,1\nDA:2,0\nDA:x\nend_of_record\nDA:7,7\nSF:a\nDA:2,4\nSF:b\nDA:3,1"
    got = text.parse_lcov(spark.createDataFrame([("r", report)], "name string, text string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1), ("a", 2, 4), ("b", 3, 1)]


def test_sinks(spark, tmp_path):
    rows = adapters.files(spark, DATA).limit(20)
    sinks.write_jsonl(rows, str(tmp_path / "out"))
    assert text.load_export(spark, str(tmp_path / "out")).count() == 20
    sinks.write_csv(rows, str(tmp_path / "csv"), "all")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == sinks.ROW
    component = json.loads(sinks.cyclonedx(rows).first()["value"])
    assert component["type"] == "file" and {p["name"] for p in component["properties"]} >= {"inventory:code"}
    report = inventory.lang_report(rows)
    assert sinks.markdown(report, "Langs").startswith("# Langs\n\n|lang|") and sinks.tsv(report).startswith("lang\t")
    assert "<row lang=" in sinks.xml(report) and json.loads(sinks.jsonld(inventory.totals(rows)))["files"] == 20
    assert sinks.badge_svg("a", "<b>").count("&lt;b&gt;") == 1 and "largest" not in sinks.html_report(inventory.totals(rows), rows)
    edges = content.import_edges(spark.createDataFrame([("a-b", "/x"), ("a-b", "/x")], "source string, target string"))
    assert sinks.mermaid(edges) == "graph TD\n  a_b -->|2| _x\n"
    assert "(lines:" in sinks.tree_text(inventory.path_tree(rows, 2))


def test_presets_and_json(spark):
    facts = presets.Facts(adapters.files(spark, DATA), adapters.contents(spark, DATA), adapters.commits(spark, DATA), adapters.commit_files(spark, DATA))
    for preset in presets.PRESETS:
        reports, warnings = presets.analyze(facts, preset)
        assert "totals" in reports and (warnings == ["imports: no links"]) == ("imports" in presets.PRESETS[preset])
        for report in reports.values():
            assert report.schema.fields
    ok = json.loads(presets.run_json(spark, "lang", '{"top": 2}', facts))
    assert ok["ok"] and [r["lang"] for r in ok["data"]["rows"]][-1] == "Other" or len(ok["data"]["rows"]) <= 3
    assert json.loads(presets.run_json(spark, "nope", "", facts))["error"]["code"] == "unknown_mode"
    assert json.loads(presets.run_json(spark, "lang", "{", facts))["error"]["code"] == "invalid_json"
    assert json.loads(presets.run_json(spark, "lang", '{"top": "x"}', facts))["error"]["code"] == "invalid_settings"
    assert json.loads(presets.run_json(spark, "version", "", facts))["data"]["schema_version"] == 2


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("module"), "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df in (("weekly", live.weekly_counts(stream)), ("touches", live.touch_counts(stream.withColumnRenamed("module", "path")))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "touches" else "update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert spark.table(name).agg(F.sum("commits")).first()[0] == events.count()
    assert live.sessions(stream).isStreaming
