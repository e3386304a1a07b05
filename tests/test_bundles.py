"""Run folders: what executors wrote is what the manifest says."""

import hashlib
import json

import pytest

from siltstone.operators import inventory
from siltstone.plans import presets
from siltstone.sources import adapters, bundles, sinks
from siltstone.sources import text as source_text

DATA = "/root/testdata/sf0.001"


def test_bundle_and_manifest(spark, tmp_path):
    rows = adapters.files(spark, DATA)
    path = str(tmp_path / "run")
    got = bundles.write_bundle(path, {"lang": inventory.lang_report(rows), "files": rows}, {"top": 3}, most_rows=50).collect()
    for r in got:
        data = (tmp_path / "run" / r["artifact"] / r["part"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["bytes"], r["sha256"])
    assert {r["artifact"] for r in got} == {"lang", "files", "receipt"}
    assert sum(r["artifact"] == "files" for r in got) >= rows.count() // 50
    assert spark.read.text(f"{path}/files").count() == rows.count()
    receipt = json.loads(spark.read.text(f"{path}/receipt").first()["value"])
    assert receipt["args"] == {"top": 3} and receipt["reports"]["files"]["columns"] == rows.columns
    assert bundles.verify_bundle(spark, path).count() == 0
    part = next(r["part"] for r in got if r["artifact"] == "lang")
    (tmp_path / f"run/lang/.{part}.crc").unlink()  # the local store's own check would stop the read before
    (tmp_path / "run/lang" / part).write_text("other")
    (tmp_path / "run/files/extra.txt").write_text("x")
    (tmp_path / "run/files" / next(r["part"] for r in got if r["artifact"] == "files")).unlink()
    assert sorted(r["state"] for r in bundles.verify_bundle(spark, path).collect()) == ["changed", "missing", "unlisted"]
    with pytest.raises(Exception, match="already exists"):
        bundles.write_bundle(path, {"lang": rows})
    with pytest.raises(ValueError, match="other than"):
        bundles.write_bundle(str(tmp_path / "y"), {"manifest": rows})


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    bad = spark.range(100).selectExpr("if(id = 99, raise_error('stop'), id) AS id")
    with pytest.raises(Exception, match="stop"):
        bundles.write_bundle(str(tmp_path / "z"), {"bad": bad})
    assert not (tmp_path / "z/manifest").exists() and not list((tmp_path / "z").glob("bad/part-*"))


def test_lines_are_those_of_the_renderers(spark):
    report = inventory.lang_report(adapters.files(spark, DATA)).orderBy("lang")
    for form, render in (("md", lambda r: sinks.markdown(r, "T")), ("tsv", sinks.tsv)):
        made = [r["value"] for r in bundles.lines(report, form).collect()]
        assert "\n".join([bundles.head(report, form, "T" if form == "md" else ""), *made]) + "\n" == render(report)
    nodes = inventory.path_tree(adapters.files(spark, DATA), 2)
    assert "".join(r["value"] + "\n" for r in bundles.tree_lines(nodes).collect()) == sinks.tree_text(nodes)


def test_export_mode_writes(spark, tmp_path):
    facts = presets.Facts(adapters.files(spark, DATA), None, None, None)
    out = str(tmp_path / "out")
    answer = json.loads(presets.run_json(spark, "export", json.dumps({"out": out, "redact": "paths"}), facts))
    assert answer["ok"] and answer["data"]["manifest"]
    assert source_text.load_export(spark, f"{out}/export").count() == facts.files.count()
