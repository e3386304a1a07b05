"""Ignore rules against git itself, attribute rules, and reports read in segments against one pass."""

import random
import re
import shutil
import subprocess

import pytest

from siltstone.sources import ignore_rules as ign
from siltstone.sources import segments as seg
from siltstone.sources import text as txt

PATTERNS = ["*.log", "!keep.log", "/build", "build/", "a/b", "**/c", "c/**", "a/**/d", "*.[ch]", "!*.h", "x?", "# note", "", "\\#odd", "!\\!bang", "d/*", "!d/keep", "*", "!*/", "!*.md", "foo/", "[!a]z", "b*/", "a\\*"]
NAMES = ["a", "b", "c", "d", "build", "x1", "z.log", "keep.log", "m.c", "m.h", "keep", "#odd", "!bang", "az", "bz", "n.md", "a*"]


def tree(rng):
    paths = set()
    for _ in range(60):
        paths.add("/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 5))))
    return sorted(p for p in paths if not any(q.startswith(p + "/") for q in paths))


@pytest.mark.skipif(shutil.which("git") is None, reason="git is the oracle")
def test_verdicts_are_those_of_git(spark, tmp_path):
    rng = random.Random(11)
    for k in range(3):
        root = tmp_path / str(k)
        paths = tree(rng)
        for p in paths:
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_text("x")
        folders = sorted({"/".join(p.split("/")[:n]) for p in paths for n in range(len(p.split("/")))})
        rules = {f: "\n".join(rng.choices(PATTERNS, k=rng.randrange(1, 5))) + rng.choice(["", "\n", "  \n"]) for f in ["", *rng.sample(folders, min(4, len(folders)))]}
        for f, text in rules.items():
            (root / f / ".gitignore").write_text(text)
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        found = subprocess.run(["git", "-C", str(root), "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True).stdout.splitlines()
        found = {p.strip('"').replace('\\"', '"') for p in found}
        files = spark.createDataFrame([(p, "x") for p in paths] + [((f + "/" if f else "") + ".gitignore", t) for f, t in rules.items()], "path string, text string")
        table = ign.ignore_rules(files)
        got = {r["path"] for r in ign.verdicts(files.where("not endswith(path, '.gitignore')"), table).where("ignored").collect()}
        assert got == found, rules


def test_regexes():
    for pattern, yes, no in [("a/**/d", "a/d a/x/y/d", "b/a/d"), ("**/c", "c x/c", "cc"), ("c/**", "c/x c/y/z", "c"), ("*.[ch]", "m.c x/m.h", "m.d"), ("[!a]z", "bz", "az /z"), ("a\\*", "a* q/a*", "ab"), ("x?", "x1", "x x/"), ("/a.b", "a.b", "a_b x/a.b"), ("v[0-9].*", "v1.x", "va.x")]:
        regex = re.compile(ign.pattern_regex(pattern))
        assert all(regex.search(p) for p in yes.split()), pattern
        assert not any(regex.search(p) for p in no.split()), pattern


def test_listing_and_no_rules(spark):
    files = spark.createDataFrame([("b", "x"), ("a", "x"), ("d/c", "x")], "path string, text string")
    none = ign.ignore_rules(files)
    assert [r["path"] for r in ign.list_files(files, none).collect()] == ["a", "b", "d/c"]
    assert [r["path"] for r in ign.list_files(files, none, 2).collect()] == ["a", "b"]
    assert ign.verdicts(files.limit(0), none).count() == 0


def test_attributes(spark):
    text = spark.createDataFrame([("# c\nsrc/gen/ linguist-generated\n*.min.js linguist-vendored=true text\nvendor linguist-vendored\ndocs/** text\n* linguist-generated\nlone\n",)], "text string")
    files = spark.createDataFrame([("src/gen/a.rs",), ("x/b.MIN.js",), ("third/vendor/l.rs",), ("src/main.rs",)], "path string")
    got = {r["path"]: r["kind"] for r in ign.attributed(files, ign.attribute_rules(text)).collect()}
    assert got == {"src/gen/a.rs": "generated", "x/b.MIN.js": "vendored", "third/vendor/l.rs": "vendored", "src/main.rs": None}


LOG = "stray\n10|a@x|aa|one|two\nf1\nf2\n\n20|b@x|bb|\n\n30|c@x||s\nf1\nf3\nf4\nf1\n"


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_segments_change_nothing(spark, size):
    log = spark.createDataFrame([("r", LOG), ("s", LOG[6:]), ("t", "")], "repo string, text string")
    commits, files = txt.parse_history(seg.cut_lines(log, "repo", chunk_lines=size))
    got = sorted(map(tuple, commits.collect()))
    assert got == [(r, k + 1, *c) for r in "rs" for k, c in enumerate([(10, "a@x", "aa", "one|two"), (20, "b@x", "bb", ""), (30, "c@x", "", "s")])]
    assert sorted(map(tuple, files.where("repo = 'r'").collect())) == [("r", 1, "f1"), ("r", 1, "f2"), ("r", 3, "f1"), ("r", 3, "f3"), ("r", 3, "f4")]
    commits, files = txt.parse_history(seg.cut_lines(log, "repo", chunk_lines=size), 2, 1)
    assert commits.count() == 4 and sorted(map(tuple, files.where("repo = 's'").collect())) == [("s", 1, "f1")]
    cover = spark.createDataFrame([("n", "DA:9,9\nSF:a\nDA:1,1\nDA:1,0\nbad\nend_of_record\nDA:2,2\nSF:b\nDA:3,1"), (None, "SF:c\nDA:4,4")], "name string, text string")
    assert sorted(map(tuple, txt.parse_lcov(seg.cut_lines(cover, "name", chunk_lines=size)).collect())) == [("a", 1, 0), ("b", 3, 1), ("c", 4, 4)]
    diff = spark.createDataFrame([("n", "@@ -1 +9 @@\n+++ b/x\n@@ -0,0 +2,2 @@\n+a\n+b\n@@ -5 +7 @@\n+++ /dev/null\n@@ -1 +1 @@\n")], "name string, text string")
    assert sorted(map(tuple, txt.parse_added_lines(seg.cut_lines(diff, "name", chunk_lines=size)).collect())) == [("x", 2), ("x", 3), ("x", 7)]


def test_files_are_read_in_splits(spark, tmp_path):
    rng = random.Random(5)
    want, lines = [], []
    for k in range(3000):
        names = [f"src/f{rng.randrange(50)}.rs" for _ in range(rng.randrange(4))]
        lines += [f"{k}|a@b|{k:x}|s {k}", *names, ""]
        want.append((k, len(set(names))))
    (tmp_path / "log.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = seg.read_lines(spark, str(tmp_path))
        assert read.select("chunk").distinct().count() > 10
        commits, files = txt.parse_history(read)
        counted = files.groupBy("seq").count()
        got = sorted((r["ts"], r["count"] or 0) for r in commits.join(counted, "seq", "left").select("ts", "count").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want
