"""Functions, scores, imports, lockfiles and ignore rules on hand-made sources."""

import pytest

from siltstone.operators import complexity as cx
from siltstone.operators import functions as fns
from siltstone.operators import imports as imp
from siltstone.operators import lockfiles as locks

CODE = "path string, module string, lang string, text string"


def test_brace_spans_and_names():
    rust = "trait T { fn sig(&self); }\nfn a() {\n  fn inner() {}\n}\n}\npub(crate) async fn b<T>()\nwhere T: X\n{\n}\nfn open() {\n".split("\n")
    # a head without a body takes the next braces, as the rule has it; one that is never closed is none
    assert fns.scored_spans(rust, "rust") == [("a", 1, 3), ("b", 5, 8)]
    assert fns.scored_spans(rust, "rust", nested=True) == [("a", 1, 3), ("inner", 2, 2), ("b", 5, 8)]
    js = "class A {\n  run(x) {\n  }\n}\nconst f = async (a) => {\n};\nfoo(function() {\n});\nx = g(a),\n".split("\n")
    assert fns.scored_spans(js, "javascript") == [("run", 1, 2), ("f", 4, 5), ("foo", 6, 7)]
    java = "int f(int x)\n{\n}\nif (x) {\n}\nvoid g() {\n}".split("\n")
    assert fns.scored_spans(java, "java") == [("unknown", 0, 2), ("unknown", 5, 6)]
    assert fns.scored_spans(["func (t *T) Name() {", "}", "func Free() {", "}"], "go") == [("Free", 2, 3)]
    assert fns.detail_spans(["func (t *T) Name() {", "}"], "go") == [("Name", 0, 1)]
    assert fns.scored_spans([], "rust") == [] and fns.scored_spans(["fn x() {}"], "cobol") == []


def test_indent_spans():
    py = ["@a", "", "@b", "def f(x):", "    # c", "", "  # out", "    if x:", "        y()", "z", "    def g(): pass", "w"]
    assert fns.scored_spans(py, "python") == [("unknown", 0, 8), ("g", 10, 10)]
    assert fns.detail_spans(py, "python") == [("f", 0, 8), ("g", 10, 10)]


def test_counts():
    assert fns.count_functions('fn a() {\n  let s = "}";\n /* } */ // }\n}\nfn b() { if x { } }\n'.split("\n"), "rust") == (2, 4)
    assert fns.count_functions("def a():\n  x\n\ndef b():\n  y\nz\n".split("\n"), "python") == (2, 3)
    assert fns.count_functions("def a\n  if x\n  end\nend\ndef b\nend".split("\n"), "ruby") == (2, 4)
    assert fns.count_functions("void f() {\n}\nwhile (x) {\n}".split("\n"), "c") == (1, 2)


def test_scores(spark):
    rust = 'fn complex(x: i32) -> i32 {\n    if x > 0 {\n        if x > 10 {\n            return f(x)?;\n        }\n    }\n    // if no\n    0\n}\n'
    js = "function f(a) {\n  return a ? b : c;\n  x?.y; // end?\n}\n"
    df = spark.createDataFrame([("a.rs", "m", "Rust", rust), ("b.js", "m", "JavaScript", js), ("c.rs", "m", "Rust", ""), ("d.txt", "m", "Text", "fn x() {}"), ("e.rs", "m", "Rust", None)], CODE)
    scores = {(r["path"], r["name"]): (r["cyclomatic"], r["cognitive"]) for r in cx.function_scores(df).collect()}
    # the inner condition stands at depth 2: the function's own brace counts as one
    assert scores == {("a.rs", "complex"): (4, 5), ("b.js", "f"): (2, 0)}
    files = {r["path"]: r for r in cx.file_complexity(df).collect()}
    assert set(files) == {"a.rs", "b.js", "c.rs"}
    assert files["c.rs"]["cyclomatic"] == 0 and files["c.rs"]["cognitive"] is None and files["c.rs"]["max_nesting"] is None
    detail = {r["path"]: r for r in cx.function_details(df).collect()}
    assert (detail["a.rs"]["param_count"], detail["a.rs"]["length"], detail["a.rs"]["max_nesting"]) == (1, 9, 3)


def test_halstead_strings_and_longest_operators(spark):
    df = spark.createDataFrame([("a.rs", "m", "Rust", 'let a = "x + y && z";\na <<= b..=c; // d + e\n// f + g\n')], CODE)
    tokens = {(r["op"], r["token"]): r["n"] for r in cx.halstead_tokens(df).collect()}
    assert tokens == {(True, "let"): 1, (True, "="): 1, (False, "a"): 2, (False, "<string>"): 1, (True, "<<="): 1, (False, "b"): 1, (True, "..="): 1, (False, "c"): 1, (True, "/"): 2, (False, "d"): 1, (True, "+"): 1, (False, "e"): 1}


def test_masked_rust():
    text = 'fn only(flag: bool) {\n    let n = "if while && ? => { }";\n    let r = r##"if match "# => {"##;\n    let c = \'?\';\n    /* if /* while */ match => */\n    if flag {\n        go(); // else if &&\n    }\n}\nfn b() -> X { y()? }\n'
    assert fns.rust_summary(text) == (3, 2, 2, 9)
    assert fns.rust_summary("") == (0, 0, 0, 0) and fns.rust_summary("fn open() {\n if x\n") == (2, 2, 1, 0)


def test_innermost_is_a_join_by_equal_bins(spark):
    spans = spark.createDataFrame([("p", "outer", 1, 1000), ("p", "mid", 10, 700), ("p", "in", 500, 510), ("q", "one", 5, 5), ("p", "same", 10, 600)], "path string, name string, start_line long, end_line long")
    points = spark.createDataFrame([("p", n, k) for k, n in enumerate((1, 9, 10, 505, 511, 650, 1000, 1001, 505))] + [("q", 5, 9), ("r", 1, 10)], "path string, line long, k int")
    joined = fns.innermost(points, spans)
    got = sorted((r["k"], r["function"]) for r in joined.collect())
    assert got == [(0, "outer"), (1, "outer"), (2, "same"), (3, "in"), (4, "same"), (5, "mid"), (6, "outer"), (7, None), (8, "in"), (9, "one"), (10, None)]
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_imports(spark):
    go = 'import (\n\t"a/b"\n\tx "c.d/e"\n)\nvar s = "no"\nimport "f"\nimport (\n)\n"g"\n'
    rows = [
        ("a.go", "m", "Go", go), ("b.rs", "m", "Rust", "use std::io;\nuse x;\nmod y;\npub use no;\n use z::{a};"), ("c.ts", "m", "TypeScript", "import a from './b';\nimport 'c/d';\nconst e = require(\"f\");\nimport x from y;"),
        ("d.py", "m", "Python", "import os.path\nfrom . import x\nfrom a.b import c\n" + "\n" * 200 + "import late"), ("e.java", "m", "Java", "import no;"), ("f.go", "m", "Go", None),
    ]
    df = spark.createDataFrame(rows, CODE)
    got = sorted((r["path"], r["target"]) for r in imp.imports(df).collect())
    assert got == [("a.go", "a/b"), ("a.go", "c.d/e"), ("a.go", "f"), ("b.rs", "std"), ("b.rs", "x"), ("b.rs", "y"), ("b.rs", "z"), ("c.ts", "./b"), ("c.ts", "c/d"), ("c.ts", "f"), ("d.py", "."), ("d.py", "a.b"), ("d.py", "os.path")]
    edges = {(r["source"], r["target"]): r["count"] for r in imp.import_edges(df).collect()}
    assert edges[("m", "local")] == 2 and edges[("m", "a")] == 2 and edges[("m", "c")] == 2
    with pytest.raises(KeyError):
        imp.import_edges(df, "line")


def test_lockfiles_and_licenses(spark):
    rows = [
        ("x/Cargo.lock", "[[package]]\n[[package]]"), ("package-lock.json", '{"packages": {"": {}, "a": {}, "b": {}}}'), ("y/package-lock.json", '{"dependencies": {"a": 1}}'), ("z/package-lock.json", '{"packages": {'), ("w/package-lock.json", '{"packages": [1]}'),
        ("yarn.lock", "# c:\n\na@1:\n  b:\nversion:\n"), ("go.sum", "a v1 h\na v1/go.mod h\na v1 h\nb\n"), ("Gemfile.lock", "specs:\n    a (1)\n\n    b (2)\nx\n    c (3)\n"), ("pnpm-lock.yaml", None), ("other.lock", "[[package]]"),
    ]
    got = {r["path"]: r["dependencies"] for r in locks.lockfiles(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"x/Cargo.lock": 2, "package-lock.json": 2, "y/package-lock.json": 1, "z/package-lock.json": 0, "w/package-lock.json": 0, "yarn.lock": 1, "go.sum": 1, "Gemfile.lock": 1, "pnpm-lock.yaml": 0}
    files = [("a/LICENSE-MIT", ""), ("Cargo.toml", '[dependencies]\nlicense = "no"\n[package]\nname = "x"\nlicense = "MIT OR Apache-2.0"\n'), ("p/package.json", '{"license": "ISC"}'), ("q/package.json", '{"license": {"type": "BSD"}}'), ("pyproject.toml", '[project]\nlicense = { text = "MPL-2.0" }\n'), ("r/package.json", "{"), ("src/x.rs", "")]
    df = spark.createDataFrame(files, "path string, text string")
    assert {r["path"]: r["kind"] for r in locks.license_candidates(df).collect()} == {"a/LICENSE-MIT": "license", "Cargo.toml": "metadata", "p/package.json": "metadata", "q/package.json": "metadata", "pyproject.toml": "metadata", "r/package.json": "metadata"}
    assert {r["path"]: r["license"] for r in locks.declared_licenses(df).collect()} == {"Cargo.toml": "MIT OR Apache-2.0", "p/package.json": "ISC", "q/package.json": "BSD", "pyproject.toml": "MPL-2.0"}
