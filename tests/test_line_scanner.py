"""The line scanner against a character-by-character restatement and hand-made mixed files."""

import random

import pytest

from siltstone.sources import line_scanner as scan
from siltstone.sources import text as source_text

NESTING = {"Rust", "Swift", "Kotlin"}


def brute(text, nested):
    """Classes of lines of a language with // and /* */ and plain double quotes, one character at a time."""
    state, depth, k, code, out = "code", 0, 0, False, []
    seen = False

    def end():
        out.append("k" if code else "c" if seen else "b")

    while k < len(text):
        two, c = text[k : k + 2], text[k]
        if c == "\n":
            end()
            code = seen = False
            state = "code" if state == "line" else state
            k += 1
            continue
        step = 1
        if state == "code" and two in ("//", "/*"):
            state, depth, step = ("line", 0, 2) if two == "//" else ("block", 1, 2)
            seen = True
        elif state == "block" and (two == "*/" or nested and two == "/*"):
            depth += 1 if two == "/*" else -1
            state, step, seen = ("block" if depth else "code"), 2, True
        else:
            here = state
            if state == "code" and c == '"':
                state = "text"
            elif state == "text" and c == "\\" and k + 1 < len(text):
                # an escaped line end still ends the line
                if text[k + 1] != "\n":
                    step = 2
                else:
                    code = seen = True
                    k += 1
                    end()
                    code = seen = False
                    k += 1
                    continue
            elif state == "text" and c == '"':
                state = "code"
            if text[k : k + step].strip():
                seen = True
                code = code or here in ("code", "text")
        k += step
    if text and text[-1] != "\n":
        end()
    return out


@pytest.mark.parametrize("lang", ["Java", "Rust"])
def test_random_texts(lang):
    rng = random.Random(lang)
    for _ in range(4000):
        text = "".join(rng.choices(["a", " ", "\n", "/", "*", '"', "\\", "/*", "*/", "//"], k=rng.randrange(30)))
        assert "".join(scan.line_kinds(text, lang)) == "".join(brute(text, lang in NESTING)), repr(text)


@pytest.mark.parametrize(
    ("lang", "text", "kinds"),
    [
        ("Rust", 'let a = r#"\n// no\n"#; // yes\n\n/* a /* b */\n c */ d\n', "kkkbck"),
        ("Rust", "let c = '\"'; // x\n// y\n/* open\n\nend", "kccbc"),
        ("Python", 's = """\n# text\n\n"""\n# note\nx = "#"  # y\n', "kkbkck"),
        ("JavaScript", "const t = `\n// in\n${x}`;\n/* a */ b();\n/* c */\n", "kkkkc"),
        ("Go", "x := `\\`\n// a\n", "kc"),
        ("SQL", "-- a\nSELECT '--'; /* b\nc */\n", "ckc"),
        ("Shell", "#!/bin/sh\necho '#'\n", "ck"),
        ("JSON", '{"a": "//"}\n', "k"),
        ("Nothing", "// c\nx\n", "ck"),
        ("Rust", "", ""),
        ("Rust", "\n\n", "bb"),
        ("Rust", "a\r\n// b\r\n\r\n", "kcb"),
        ("Rust", "a\0b // \0\n", "k"),
    ],
)
def test_kinds(lang, text, kinds):
    assert "".join(scan.line_kinds(text, lang)) == kinds


def test_doc_strings_on_demand():
    text = 'def f():\n    """Doc\n    more"""\n    x = """text"""\n'
    assert "".join(scan.line_kinds(text, "Python")) == "kkkk"
    assert "".join(scan.line_kinds(text, "Python", True)) == "kcck"


def test_embedded_languages():
    page = "<html>\n<!-- <script>\nno();\n</script> -->\n<style>\n/* c */\n\np{}\n</style>\n<script>a(); // x\n// y\n</script>\n<SCRIPT type='application/json'>\n{}\n</SCRIPT>\n</html>\n"
    assert scan.scan_text(page, "HTML") == [("HTML", "parent", 10, 5, 1), ("CSS", "child", 1, 1, 1), ("JavaScript", "child", 1, 1, 0), ("JSON", "child", 1, 0, 0)]
    note = "# Title\n\n```rust\nfn main() {}\n// c\n\n```\ntext\n~~~js\nx();\n~~~\n```unknown\nz\n```\n"
    assert scan.scan_text(note, "Markdown") == [("Markdown", "parent", 2, 10, 2), ("Rust", "child", 1, 1, 1), ("JavaScript", "child", 1, 0, 0)]


def test_rows(spark):
    given = [("a.md", "m", "Markdown", "é\n```py\nx = 1\n```\n", 1), ("b.py", "m", "Python", None, 1), ("c.py", None, "Python", "", 1), ("d.rs", "m", "Rust", "a\n" * 200_000 + "/*", 1)]
    df = spark.createDataFrame(given, "path string, module string, lang string, text string, lines int")
    rows = {(r["path"], r["lang"]): tuple(r)[3:] for r in scan.scan_rows(df).collect()}
    assert rows == {("a.md", "Markdown"): ("parent", 1, 3, 0, 4, 19, 4), ("a.md", "Python"): ("child", 1, 0, 0, 1, 0, 0), ("c.py", "Python"): ("parent", 0, 0, 0, 0, 0, 0), ("d.rs", "Rust"): ("parent", 200_000, 1, 0, 200_001, 400_002, 100_000)}
    assert scan.scan_rows(df, "parents-only").count() == 3 and scan.scan_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan.scan_rows(df, "other")


def test_file_rows_come_from_the_scanner(spark):
    files = spark.createDataFrame([("crates/a/x.rs", "/* a\n b */\nfn x() {}\n"), ("crates/a/n.md", "t\n```js\nx()\n```\n"), ("unknown.zzz", "x")], "path string, text string")
    rows = {(r["path"], r["lang"]): (r["module"], r["kind"], r["code"], r["comments"], r["bytes"]) for r in source_text.file_rows(files, ["crates"], children="separate").collect()}
    assert rows == {("crates/a/x.rs", "Rust"): ("crates/a", "parent", 1, 2, 120), ("crates/a/n.md", "Markdown"): ("crates/a", "parent", 1, 3, 160), ("crates/a/n.md", "JavaScript"): ("crates/a", "child", 1, 0, 0)}


def test_counts_by_pieces_are_those_of_whole_files(spark):
    pick = random.Random(5)
    parts = ["code 12;", "", "  ", "// c 3", "# h", "/* open", "*/", "/* a */ x", "/* /* n */", "still */ */", '"s', 's"', '"a" + "b" // t', "'", "'c'", "it's", '"""', "'''doc'''", '"""d"""', "r#\"raw", "\"#", "r\"x\"", "`t", "x`", "\\", '"\\', "'\\", "-- sql", "=begin", "=end", "<!-- h", "-->", "x \0 y", "é // ü", "\t/* t", "br##\"", "\"##", "a\r"]
    for lang in [*scan.GRAMMARS, "Unknown"]:
        for doc_strings in (False, True):
            pieces = scan.Pieces(lang, doc_strings)
            for _ in range(150):
                text = "\n".join(pick.choice(parts) for _ in range(pick.choice([0, 1, 3, 8, 40]))) + pick.choice(["", "\n", "\n\n"])
                if lang != "Markdown":
                    assert scan.file_counts(text, pieces) == scan.counts(scan.line_kinds(text, lang, doc_strings)), (lang, text)
    long = "x\n/* a\n" + "b\n" * 40 + "*/ y\n"
    rows = spark.createDataFrame([("a", "m", "Go", long), ("b", "m", "Markdown", "t\n```go\n" + long + "```\n"), ("c", "m", "Go", "")], "path string, module string, lang string, text string")
    got = {(r["path"], r["lang"]): (r["code"], r["comments"], r["blanks"]) for r in scan.scan_rows(rows).collect()}
    assert got == {("a", "Go"): (2, 41, 0), ("b", "Markdown"): (2, 44, 0), ("b", "Go"): (2, 41, 0), ("c", "Go"): (0, 0, 0)}


def test_a_line_is_read_once_whatever_its_digits(monkeypatch):
    calls, read = [], scan.line_kinds
    monkeypatch.setattr(scan, "line_kinds", lambda *a: calls.append(a) or read(*a))
    pieces = scan.Pieces("Go", False)
    assert scan.file_counts("".join(f"x := {k % 10}\n/* {k % 10}\n*/\n" for k in range(500)), pieces) == (500, 1000, 0)
    assert len(calls) == 2
