"""Functions of source files as intervals of lines: braces matched with a stack, indentation blocks, heads by language.

A file is read once and gives its intervals; everything that is counted within them is a column expression over slices
of the file's lines (operators/complexity.py).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.line_scanner import masked

# Lines that begin a function, by language; the first line of a scored function matches one of its patterns.
RUST_HEAD = r'^\s*(pub(\([^)]+\))?\s+)?((async|unsafe|const|extern\s+"[^"]*")\s+)*fn\s+(?:r#)?(?:_|[^\W\d])\w*'
JS_HEADS = [
    r"^\s*(export\s+)?(async\s+)?function\s+\w+",
    r"^\s*(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\([^)]*\)\s*=>",
    r"^\s*(async\s+)?\w+\s*\([^)]*\)\s*\{",
]
SCORED_HEADS = {
    "rust": [RUST_HEAD],
    "python": [r"^\s*(async\s+)?def\s+\w+"],
    "go": [r"^\s*func\s+\w+"],
    "javascript": JS_HEADS,
    "typescript": JS_HEADS,
}
# Beginnings of trimmed lines that are control structures or functions.
CONTROL = ("if ", "if(", "while ", "while(", "for ", "for(", "switch ", "switch(")
CATCH = ("catch ", "catch(")
JS_CONTROL = ("if ", "while ", "for ", "switch ")
JS_FUNCTIONS = ("function ", "async function ")
JS_EXPORTS = ("export function ", "export async function ")
RUBY_OPENERS = ("do", "class ", "module ", "begin", "if ", "unless ", "case ", "while ", "until ", "for ")
C_STYLE = ("c", "c++", "java", "c#")
RUST_QUALIFIED = re.compile(r'(?:(?:pub\([^)]*\)|pub|async|unsafe|const|extern\s*(?:"[^"]*")?)\s*)*fn ')

Head = Callable[[int], bool]
End = Callable[[int], int | None]


def lines_in(text: str) -> list[str]:
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
        lines = [x.removesuffix("\r") for x in lines]
    elif len(lines) > 1:
        lines = [*(x.removesuffix("\r") for x in lines[:-1]), lines[-1]]
    return lines


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def brace_ends(lines: list[str]) -> End:
    """For a line, the line on which the first brace opened at or after it is closed; one stack over the whole file."""
    opened: list[int] = []
    closed: list[int | None] = []
    stack: list[int] = []
    for i, line in enumerate(lines):
        for c in re.findall("[{}]", line):
            if c == "{":
                stack.append(len(opened))
                opened.append(i)
                closed.append(None)
            elif stack:
                closed[stack.pop()] = i

    def end(i: int) -> int | None:
        k = bisect_left(opened, i)
        return closed[k] if k < len(opened) else None

    return end


def indent_ends(lines: list[str]) -> End:
    """For a line, the last line of content that is indented deeper, before one that is not."""

    def end(i: int) -> int:
        base, last = indent(lines[i]), i
        for j in range(i + 1, len(lines)):
            body = lines[j].strip()
            if not body or body[0] == "#":
                continue
            if indent(lines[j]) <= base:
                break
            last = j
        return last

    return end


def decorated(lines: list[str], i: int, comments: bool) -> int:
    """The first of the decorators above a line, at its indentation; blank lines (and comments) between them do not part them."""
    start, base = i, indent(lines[i])
    for k in range(i - 1, -1, -1):
        body = lines[k].strip()
        if not body or comments and body[0] == "#":
            continue
        if indent(lines[k]) != base or body[0] != "@":
            break
        start = k
    return start


def intervals(lines: list[str], head: Head, end: End, nested: bool = False) -> Iterator[tuple[int, int]]:
    """(first, last) of each head whose end is found; one within an earlier interval only if nested."""
    free = 0
    for i in range(len(lines)):
        if (nested or i >= free) and head(i) and (last := end(i)) is not None:
            yield i, last
            free = last + 1


def word_after(line: str, mark: str, extra: str = "") -> str | None:
    """The identifier behind a mark: the first letter or underscore on, up to what is none."""
    at = line.find(mark)
    if at < 0:
        return None
    found = re.search(rf"[^\W\d][\w{extra}]*", line[at + len(mark) :])
    return found[0] if found else "unknown"


def scored_name(line: str, lang: str) -> str:
    marks = {"rust": ["fn "], "python": ["def "], "go": ["func "], "javascript": ["function ", "const ", "let "], "typescript": ["function ", "const ", "let "]}.get(lang, [])
    for mark in marks:
        if (name := word_after(line, mark)) is not None:
            return name
    if lang in ("javascript", "typescript") and "(" in line:
        words = line.strip().split("(")[0].split()
        if words:
            return words[-1]
    return "unknown"


def c_head(lines: list[str], i: int, excluded: tuple[str, ...], brace_begins: bool) -> bool:
    """A line that ends in `) {`, or in `)` before a line that begins with (or is) a brace."""
    body = lines[i].strip()
    if body.startswith(excluded):
        return False
    if body.endswith(") {"):
        return True
    after = lines[i + 1].strip() if i + 1 < len(lines) else ""
    return body.endswith(")") and (after.startswith("{") if brace_begins else after == "{")


def scored_spans(lines: list[str], lang: str, nested: bool = False) -> list[tuple[str, int, int]]:
    """(name, first, last) of the functions that cognitive scores count; cyclomatic ones count them but for the C family."""
    if lang in C_STYLE:
        return [("unknown", a, b) for a, b in intervals(lines, lambda i: c_head(lines, i, CONTROL + CATCH, True), brace_ends(lines), nested)]
    if lang not in SCORED_HEADS:
        return []
    patterns = [re.compile(p) for p in SCORED_HEADS[lang]]
    script = lang in ("javascript", "typescript")

    def head(i: int) -> bool:
        if not any(p.match(lines[i]) for p in patterns):
            return False
        body = lines[i].strip()
        return not (script and (body.startswith(("//", "/*", "*")) or body.endswith((",", ";"))))

    if lang == "python":
        found = [(decorated(lines, a, False), b) for a, b in intervals(lines, head, indent_ends(lines), nested)]
    else:
        found = list(intervals(lines, head, brace_ends(lines), nested))
    return [(scored_name(lines[a], lang), a, b) for a, b in found]


def detail_spans(lines: list[str], lang: str) -> list[tuple[str, int, int]]:
    """(name, first, last) of the functions that details are given of."""
    bodies = [x.strip() for x in lines]
    before_paren = lambda body, extra: (re.search(rf"[\w{extra}]+$", body.split("(")[0].strip()) or [None])[0] if "(" in body else None
    after = lambda body, mark, extra="": (re.match(rf"[\w{extra}]+", body[body.index(mark) + len(mark) :]) or [None])[0] if mark in body else None
    if lang == "rust":
        head, name = lambda i: RUST_QUALIFIED.match(bodies[i]) is not None, lambda i: after(bodies[i], "fn ") or "<unknown>"
    elif lang in ("javascript", "typescript"):
        head = lambda i: (bodies[i].startswith(JS_FUNCTIONS + JS_EXPORTS) or "=> {" in bodies[i]) and not bodies[i].startswith("//")
        name = lambda i: after(bodies[i], "function ", "$") or before_paren(bodies[i], "$") or "<anonymous>"
    elif lang == "python":
        head, name = lambda i: bodies[i].startswith(("def ", "async def ")), lambda i: after(bodies[i], "def ") or "<unknown>"
    elif lang == "go":
        head = lambda i: bodies[i].startswith("func ")
        name = lambda i: (re.match(r"func (?:\([^)]*\)\s*)?(\w+)", bodies[i]) or [None, None])[1] or "<unknown>"
    elif lang in (*C_STYLE, "php"):
        head = lambda i: bodies[i].endswith((") {", "){")) and not bodies[i].startswith(("if ", "if(", "while ", "for ", "switch ", "//", "#"))
        name = lambda i: before_paren(bodies[i], "") or "<unknown>"
    else:
        return []
    if lang == "python":
        return [(name(a), decorated(lines, a, True), b) for a, b in intervals(lines, head, indent_ends(lines))]
    return [(name(a), a, b) for a, b in intervals(lines, head, brace_ends(lines))]


# --- how many functions, and the longest --------------------------------------------------------------------------


def by_braces(lines: list[str], head: Head) -> tuple[int, int]:
    """Braces are counted line by line; a function ends on a line with a closing brace after which none is open."""
    count = most = depth = 0
    start = None
    for i, line in enumerate(lines):
        if start is None and head(i):
            count, start, depth = count + 1, i, 0
        if start is not None:
            depth = max(depth + line.count("{") - line.count("}"), 0)
            if depth == 0 and "}" in line:
                most, start = max(most, i - start + 1), None
    return count, most


def count_rust(lines: list[str]) -> tuple[int, int]:
    """As by_braces, by character: braces in strings and comments do not count, `//` ends a line even in a string."""
    count = most = depth = 0
    start, quoted, block = None, False, False
    for i, line in enumerate(lines):
        if start is None and RUST_QUALIFIED.match(line.strip()):
            count, start, depth = count + 1, i, 0
        at = 0
        while start is not None:
            if block:
                found = line.find("*/", at)
                if found < 0:
                    break
                block, at = False, found + 2
                continue
            mark = re.compile(r'//|/\*|"|[{}]').search(line, at)
            if mark is None or mark[0] == "//":
                break
            at = mark.end()
            if mark[0] == "/*":
                block = True
            elif mark[0] == '"':
                quoted ^= mark.start() == 0 or line[mark.start() - 1] != "\\"
            elif not quoted:
                depth += 1 if mark[0] == "{" else -1
                if mark[0] == "}" and depth == 0:
                    most, start = max(most, i - start + 1), None
    return count, most


def count_python(lines: list[str]) -> tuple[int, int]:
    count = most = base = 0
    start = None
    for i, line in enumerate(lines):
        body = line.strip()
        if body.startswith(("def ", "async def ")):
            most = max(most, i - start) if start is not None else most
            count, start, base = count + 1, i, indent(line)
        elif start is not None and body and body[0] != "#" and indent(line) <= base:
            most, start = max(most, i - start), None
    return count, max(most, len(lines) - start) if start is not None else most


def count_ruby(lines: list[str]) -> tuple[int, int]:
    count = most = depth = 0
    start = None
    for i, line in enumerate(lines):
        body = line.strip()
        if body.startswith("def "):
            if start is None:
                count, start, depth = count + 1, i, 0
            depth += 1
        elif start is not None:
            depth += body.startswith(RUBY_OPENERS)
            if body == "end" or body.startswith("end "):
                depth -= 1
                if depth == 0:
                    most, start = max(most, i - start + 1), None
    return count, most


def count_functions(lines: list[str], lang: str) -> tuple[int, int]:
    """(functions, lines of the longest)."""
    bodies = [x.strip() for x in lines]
    if lang == "rust":
        return count_rust(lines)
    if lang == "python":
        return count_python(lines)
    if lang == "ruby":
        return count_ruby(lines)
    if lang == "go":
        return by_braces(lines, lambda i: bodies[i].startswith("func "))
    if lang in ("javascript", "typescript"):
        return by_braces(lines, lambda i: bodies[i].startswith(JS_FUNCTIONS) or "=> {" in bodies[i] or ("(" in bodies[i] and ") {" in bodies[i] and not bodies[i].startswith(JS_CONTROL)))
    if lang in (*C_STYLE, "php"):
        return by_braces(lines, lambda i: c_head(lines, i, CONTROL, False))
    return 0, 0


# --- as tables -----------------------------------------------------------------------------------------------------

SPAN = "name:string,first:int,last:int"


def function_facts(contents: DataFrame, parts: tuple[str, ...] = ("scored",)) -> DataFrame:
    """contents (path, module, lang, text) with lang in lower case, function_count, max_function_length, and the asked arrays of intervals.

    scored and nested hold (name, first, last) with lines from 0, nested also functions within others; details have
    the scored intervals of their own text beside them. One pass over whole files, no shuffle.
    """
    span = pa.struct([("name", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
    types = {"scored": pa.list_(span), "nested": pa.list_(span), "details": pa.list_(pa.struct([("name", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("inner", pa.list_(span))]))}
    schema = {"scored": f"array<struct<{SPAN}>>", "nested": f"array<struct<{SPAN}>>", "details": f"array<struct<{SPAN},inner:array<struct<{SPAN}>>>>"}
    row = lambda s: dict(zip(("name", "first", "last"), s, strict=True))

    def found(lines: list[str], lang: str, part: str) -> list[dict]:
        if part == "details":
            return [row(s) | {"inner": [row(x) for x in scored_spans(lines[s[1] : s[2] + 1], lang)]} for s in detail_spans(lines, lang)]
        return [row(s) for s in scored_spans(lines, lang, part == "nested")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(lines_in(text), lang) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            counts = [count_functions(*t) for t in texts]
            arrays = [pa.array([found(*t, part) for t in texts], types[part]) for part in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in counts], pa.int64()), pa.array([m for _, m in counts], pa.int64()), *arrays], ["path", "module", "lang", "text", "function_count", "max_function_length", *parts])

    given = contents.where("text is not null").select("path", "module", F.lower("lang").alias("lang"), "text")
    return given.mapInArrow(run, "path string, module string, lang string, text string, function_count long, max_function_length long, " + ", ".join(f"{part} {schema[part]}" for part in parts))


def function_spans(facts: DataFrame, which: str = "scored") -> DataFrame:
    """(path, lang, name, start_line, end_line) from 1, one row a function."""
    s = F.col("s")
    return facts.select("path", "lang", F.explode(which).alias("s")).select("path", "lang", s["name"].alias("name"), (s["first"] + 1).cast("long").alias("start_line"), (s["last"] + 1).cast("long").alias("end_line"))


def innermost(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """points (path, line, ...) with the innermost of the spans (path, name, start_line, end_line) around each; outer.

    A range join by bins of lines: a span stands in every bin that it reaches into, a point in one, so rows meet by
    equal (path, bin) only. Of the spans that hold a point the one that starts last is innermost; of equal ones the
    shorter, then the greater name. Points keep all their columns and are not merged.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))).alias("bin")
    s = spans.where("start_line <= end_line").select(F.col("path").alias("span_path"), "name", "start_line", "end_line", bins)
    order = F.struct(F.col("start_line"), -F.col("end_line"), F.col("name"))  # the greatest is innermost
    p = points.select("path", "line").distinct().withColumn("bin", F.floor(F.col("line") / width))
    met = p.join(s, (F.col("path") == F.col("span_path")) & (p["bin"] == s["bin"]) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    best = met.groupBy("path", "line").agg(F.max_by(F.struct("name", "start_line", "end_line"), order).alias("best"))
    out = points.join(best, ["path", "line"], "left")
    return out.select(*points.columns, F.col("best.name").alias("function"), F.col("best.start_line").alias("start_line"), F.col("best.end_line").alias("end_line"))


# --- Rust functions of masked source, as the review gate counts them ---------------------------------------------

# What counts as a decision of a masked line.
MASKED_POINTS = ["if ", "while ", "for ", "loop ", "match ", "&&", "||", "?", "=>"]


def rust_summary(text: str) -> tuple[int, int, int, int]:
    """(total, largest, functions, lines of the longest): strings and comments count for nothing, a function's last line neither."""
    total = largest = count = longest = depth = base = points = 0
    start = None
    for i, line in enumerate(masked(text, "Rust").split("\n")):
        body = line.strip()
        if not body:
            continue
        if start is None and RUST_QUALIFIED.match(body):
            start, base, points = i, depth, 1
        for c in re.findall("[{}]", line):
            depth += 1 if c == "{" else -1
            if c == "}" and start is not None and depth == base:
                total, largest, count, longest, start = total + points, max(largest, points), count + 1, max(longest, i - start + 1), None
        if start is not None:
            points += sum(body.count(w) for w in MASKED_POINTS)
    if start is not None:
        total, largest, count = total + points, max(largest, points), count + 1
    return total, largest, count, longest


def rust_complexity(contents: DataFrame) -> DataFrame:
    """(path, total_cyclomatic, cyclomatic, function_count, max_function_length) of Rust sources that are no tests or fuzz targets; cyclomatic is the largest function's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rust_summary(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(4))], ["path", "total_cyclomatic", "cyclomatic", "function_count", "max_function_length"])

    name = F.lower("path")
    relevant = name.endswith(".rs") & ~name.rlike(r"(^|/)(tests|fuzz)/|_tests?\.rs$")
    return contents.where(relevant & F.col("text").isNotNull()).select("path", "text").mapInArrow(run, "path string, total_cyclomatic long, cyclomatic long, function_count long, max_function_length long")
