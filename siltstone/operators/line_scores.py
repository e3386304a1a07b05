"""What each line of a source file adds to its scores, found once for lines that differ in digits only; whole files from that.

The same values as the column expressions of operators/complexity.py, in one pass and without a fold over columns (tested).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

from siltstone.operators.functions import C_STYLE, CATCH, CONTROL, JS_CONTROL, JS_EXPORTS, JS_FUNCTIONS, RUST_QUALIFIED, SCORED_HEADS, count_ruby, indent, lines_in
from siltstone.sources.line_scanner import same_digits

# Characters that are alphabetic but none of Python's word characters (marks that are part of words), in hexadecimal.
MARKS = """
345 5b0-5bd 5bf 5c1-5c2 5c4-5c5 5c7 610-61a 64b-657 659-65f 670 6d6-6dc 6e1-6e4 6e7-6e8 6ed 711 730-73f 7a6-7b0 816-817 81b-823 825-827 829-82c 8d4-8df 8e3-8e9 8f0-903 93a-93b 93e-94c 94e-94f 955-957 962-963 981-983
9be-9c4 9c7-9c8 9cb-9cc 9d7 9e2-9e3 a01-a03 a3e-a42 a47-a48 a4b-a4c a51 a70-a71 a75 a81-a83 abe-ac5 ac7-ac9 acb-acc ae2-ae3 afa-afc b01-b03 b3e-b44 b47-b48 b4b-b4c b56-b57 b62-b63 b82 bbe-bc2 bc6-bc8 bca-bcc bd7 c00-c03
c3e-c44 c46-c48 c4a-c4c c55-c56 c62-c63 c81-c83 cbe-cc4 cc6-cc8 cca-ccc cd5-cd6 ce2-ce3 d00-d03 d3e-d44 d46-d48 d4a-d4c d57 d62-d63 d81-d83 dcf-dd4 dd6 dd8-ddf df2-df3 e31 e34-e3a e4d eb1 eb4-eb9 ebb-ebc ecd f71-f81
f8d-f97 f99-fbc 102b-1036 1038 103b-103e 1056-1059 105e-1060 1062-1064 1067-106d 1071-1074 1082-108d 108f 109a-109d 1712-1713 1732-1733 1752-1753 1772-1773 17b6-17c8 1885-1886 18a9 1920-192b 1930-1938 1a17-1a1b 1a55-1a5e
1a61-1a74 1abf-1ac0 1b00-1b04 1b35-1b43 1b80-1b82 1ba1-1ba9 1bac-1bad 1be7-1bf1 1c24-1c36 1de7-1df4 24b6-24e9 2de0-2dff a674-a67b a69e-a69f a802 a80b a823-a827 a880-a881 a8b4-a8c3 a8c5 a8ff a926-a92a a947-a952 a980-a983
a9b4-a9bf a9e5 aa29-aa36 aa43 aa4c-aa4d aa7b-aa7d aab0 aab2-aab4 aab7-aab8 aabe aaeb-aaef aaf5 abe3-abea fb1e 10376-1037a 10a01-10a03 10a05-10a06 10a0c-10a0f 10d24-10d27 10eab-10eac 11000-11002 11038-11045 11082
110b0-110b8 11100-11102 11127-11132 11145-11146 11180-11182 111b3-111bf 111ce-111cf 1122c-11234 11237 1123e 112df-112e8 11300-11303 1133e-11344 11347-11348 1134b-1134c 11357 11362-11363 11435-11441 11443-11445
114b0-114c1 115af-115b5 115b8-115be 115dc-115dd 11630-1163e 11640 116ab-116b5 1171d-1172a 1182c-11838 11930-11935 11937-11938 1193b-1193c 11940 11942 119d1-119d7 119da-119df 119e4 11a01-11a0a 11a35-11a39 11a3b-11a3e
11a51-11a5b 11a8a-11a97 11c2f-11c36 11c38-11c3e 11c92-11ca7 11ca9-11cb6 11d31-11d36 11d3a 11d3c-11d3d 11d3f-11d41 11d43 11d47 11d8a-11d8e 11d90-11d91 11d93-11d96 11ef3-11ef6 16f4f 16f51-16f87 16f8f-16f92 16ff0-16ff1
1bc9e 1e000-1e006 1e008-1e018 1e01b-1e021 1e023-1e024 1e026-1e02a 1e947 1f130-1f149 1f150-1f169 1f170-1f189
"""
WORD = r"\w" + "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in MARKS.split())
SPACE = " \t\r\n\x0b\x0c"
#: Lines held by a worker.
MANY = 100_000
RUST_MARKS = re.compile(r'//|/\*|"|[{}]')


def any_of(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


class Rules:
    """The patterns of a language."""

    def __init__(self, lang: str) -> None:
        from siltstone.operators import complexity as cx  # which imports this module

        self.lang = lang
        self.points = [re.compile(rf"(?<![{WORD}])(?:{any_of(cx.KEYWORD_POINTS[lang])})"), re.compile(any_of(cx.OPERATOR_POINTS[lang]))] if lang in cx.KEYWORD_POINTS else None
        if lang == "rust":
            self.points.append(re.compile(r"(?<![:#])\?(?=[;)}, ]|\Z)"))
        elif lang in ("javascript", "typescript"):
            self.points.append(re.compile(r"\?(?![.;)]|\Z)(?=[^\n]*:)"))
        self.nesting = re.compile(rf"(?<![{WORD}])(?:{any_of(cx.NESTING[lang])})") if lang in cx.NESTING else None
        self.decisions = cx.DECISIONS[lang]
        self.heads = [re.compile(p) for p in SCORED_HEADS.get(lang, [])]


def rust_braces(line: str, block: bool, quoted: bool) -> tuple[list[int], bool, bool]:
    """Braces that count, as 1 and -1, and whether a comment or a string is open behind the line."""
    out, at = [], 0
    while True:
        if block:
            found = line.find("*/", at)
            if found < 0:
                return out, True, quoted
            block, at = False, found + 2
            continue
        mark = RUST_MARKS.search(line, at)
        if mark is None or mark[0] == "//":
            return out, False, quoted
        at = mark.end()
        if mark[0] == "/*":
            block = True
        elif mark[0] == '"':
            quoted ^= mark.start() == 0 or line[mark.start() - 1] != "\\"
        elif not quoted:
            out.append(1 if mark[0] == "{" else -1)


class Lines(dict):
    """line -> (score, nest, braces, counted, scored, decisions, content) in one language.

    score: (points, structures, logical, jumps, what it opens less what it closes), None for comments. nest: braces opened
    and closed, None for comments; Python: (width, tab, whether it is content). braces: those of the line. counted,
    scored: whether it begins a function that is counted, or scored (2: if the next line begins a block). decisions:
    those of whole files. content: Python: (indentation, first character or ""); C family: whether it begins with, is "{".
    """

    def __init__(self, lang: str) -> None:
        super().__init__()
        self.rules, self.states = Rules(lang), {}

    def __missing__(self, line: str) -> tuple:
        if len(self) >= MANY:
            self.clear()
        found = self[line] = self.measured(line)
        return found

    def rust(self, line: str, block: bool, quoted: bool) -> tuple[list[int], bool, bool]:
        key = line, block, quoted
        if (found := self.states.get(key)) is None:
            if len(self.states) >= MANY:
                self.states.clear()
            found = self.states[key] = rust_braces(*key)
        return found

    def measured(self, line: str) -> tuple:
        rules, lang = self.rules, self.rules.lang
        python = lang == "python"
        body, stripped = line.strip(SPACE), line.strip()
        comment = body.startswith("#") if python else body.startswith(("//", "/*", "*"))
        braces = [c for c in line if c in "{}"]
        opens, closes = line.count("{"), line.count("}")
        score = None
        if not comment:
            points = sum(len(p.findall(body)) for p in rules.points) if rules.points else 0
            structures = len(rules.nesting.findall(body)) if rules.nesting else 0
            if lang == "rust":
                structures += body.count("else if ") or body.count("if ")
            logical = "&&" in body or "||" in body or " and " in body or " or " in body
            jumps = ("break '" in body) + ("continue '" in body) if lang == "rust" else 0
            has = lambda *words: any(w in body for w in words)
            net = has("if ", "elif ") + has("for ", "while ") + has("try:", "except ", "except:") + has("with ") if python else body.count("{") - body.count("}")
            score = points, structures, logical, jumps, net
        width = len(line) - len(line.lstrip(SPACE))
        nest = (width, line.startswith("\t"), body != "" and body[0] != "#") if python else None if comment or not braces else (opens, closes)
        counted = scored = 0
        content = None
        if lang == "rust":
            counted = RUST_QUALIFIED.match(stripped) is not None
        elif python:
            counted = stripped.startswith(("def ", "async def "))
            content = indent(line), stripped[:1]
        elif lang == "go":
            counted = stripped.startswith("func ")
        elif lang in ("javascript", "typescript"):
            counted = stripped.startswith(JS_FUNCTIONS) or "=> {" in stripped or ("(" in stripped and ") {" in stripped and not stripped.startswith(JS_CONTROL))
        elif lang in (*C_STYLE, "php"):
            ends = 1 if stripped.endswith(") {") else 2 if stripped.endswith(")") else 0
            counted = 0 if stripped.startswith(CONTROL) else ends
            scored = 0 if lang == "php" or stripped.startswith(CONTROL + CATCH) else ends
            content = stripped.startswith("{"), stripped == "{"
        if rules.heads:
            script = lang in ("javascript", "typescript")
            scored = any(p.match(line) for p in rules.heads) and not (script and (stripped.startswith(("//", "/*", "*")) or stripped.endswith((",", ";"))))
        lower = line.lower()
        return score, nest, braces, counted, scored, sum(lower.count(w) for w in rules.decisions), content


def counted(lines: list[str], found: list[tuple], memo: Lines) -> tuple[int, int]:
    """(functions, lines of the longest), as functions.count_functions."""
    lang = memo.rules.lang
    count = most = depth = 0
    start = None
    if lang == "rust":
        quoted = block = False
        for i, f in enumerate(found):
            if start is None:
                if not f[3]:
                    continue
                count, start, depth = count + 1, i, 0
            steps, after_block, after_quoted = memo.rust(lines[i], block, quoted)
            for step in steps:
                depth += step
                if step < 0 and depth == 0:
                    most, start, block, quoted = max(most, i - start + 1), None, False, False
                    break
            else:
                block, quoted = after_block, after_quoted
        return count, most
    if lang == "python":
        base = 0
        for i, f in enumerate(found):
            if f[3]:
                most = max(most, i - start) if start is not None else most
                count, start, base = count + 1, i, f[6][0]
            elif start is not None and f[6][1] not in ("", "#") and f[6][0] <= base:
                most, start = max(most, i - start), None
        return count, max(most, len(found) - start) if start is not None else most
    if lang == "ruby":
        return count_ruby(lines)
    last = len(found) - 1
    for i, f in enumerate(found):
        if start is None:
            if not f[3] or f[3] == 2 and not (i < last and found[i + 1][6][1]):
                continue
            count, start, depth = count + 1, i, 0
        if f[2]:
            closes = f[2].count("}")
            depth = max(depth + len(f[2]) - 2 * closes, 0)
            if depth == 0 and closes:
                most, start = max(most, i - start + 1), None
    return count, most


def spans(found: list[tuple], lang: str) -> list[tuple[int, int]]:
    """(first, last) of scored functions, as functions.scored_spans."""
    last = len(found) - 1
    heads = [i for i, f in enumerate(found) if f[4] and (f[4] != 2 or i < last and found[i + 1][6][0])]
    if not heads:
        return []
    out, free = [], 0
    if lang == "python":
        for i in heads:
            if i < free:
                continue
            base, end, start = found[i][6][0], i, i
            for j in range(i + 1, last + 1):
                width, first = found[j][6]
                if first in ("", "#"):
                    continue
                if width <= base:
                    break
                end = j
            for k in range(i - 1, -1, -1):
                width, first = found[k][6]
                if not first:
                    continue
                if width != base or first != "@":
                    break
                start = k
            out.append((start, end))
            free = end + 1
        return out
    opened: list[int] = []
    closed: list[int | None] = []
    stack: list[int] = []
    for i, f in enumerate(found):
        for c in f[2]:
            if c == "{":
                stack.append(len(opened))
                opened.append(i)
                closed.append(None)
            elif stack:
                closed[stack.pop()] = i
    for i in heads:
        if i >= free and (k := bisect_left(opened, i)) < len(opened) and closed[k] is not None:
            out.append((i, closed[k]))
            free = closed[k] + 1
    return out


def cognitive(found: list[tuple]) -> int:
    score = depth = 0
    before = False
    for f in found:
        if f[0] is not None:
            _, structures, logical, jumps, net = f[0]
            score += structures * (depth + 1) + (logical and not before) + jumps
            before = logical
            depth = max(depth + net, 0)
    return score


def deepest(found: list[tuple], lang: str) -> int | None:
    """Greatest depth of braces, or of indentation in units of the first one; None where nothing nests."""
    if lang == "python":
        unit = next((1 if tab else width for width, tab, _ in (f[1] for f in found) if tab or 0 < width <= 8), 4)
        return max((f[1][0] for f in found if f[1][2]), default=0) // unit or None
    depth = most = 0
    for f in found:
        if f[1] is not None:
            opens, closes = f[1]
            most = max(most, depth + opens)
            depth = max(depth + opens - closes, 0)
    return most or None


def file_scores(text: str, memo: Lines) -> tuple:
    """(function_count, max_function_length, cyclomatic, max_function_cyclomatic, cognitive, max_nesting) of a file."""
    lang = memo.rules.lang
    lines = lines_in(same_digits(text))
    found = list(map(memo.__getitem__, lines))
    count, longest = counted(lines, found, memo)
    parts = [found[a : b + 1] for a, b in spans(found, lang)]
    if parts and memo.rules.points:
        points = [1 + sum(f[0][0] for f in part if f[0] is not None) for part in parts]
        cyclomatic, most = sum(points), max(points)
    else:
        cyclomatic = most = 1 + sum(f[5] for f in found) if count > 0 else 0
    return count, longest, cyclomatic, most, sum(map(cognitive, parts)) if parts else None, deepest(found, lang)


# --- tokens of Halstead's measures ---------------------------------------------------------------------------------


@cache
def token_pattern(lang: str) -> re.Pattern:
    from siltstone.operators import complexity as cx

    symbols = sorted((w for w in cx.OPERATORS[lang] if not w[0].isalpha()), key=lambda w: (-len(w), w))
    quoted = r'"(?:\\[^\n]|[^"\\\n])*(?:"|\\?\Z)|' + r"'(?:\\[^\n]|[^'\\\n])*(?:'|\\?\Z)"
    return re.compile(rf"{quoted}|[{WORD}]+|{any_of(symbols)}")


def token_counts(lines: Counter, lang: str) -> Counter:
    """How often each operator or operand stands in trimmed lines that are counted; a string is `<string>`."""
    pattern, out = token_pattern(lang), Counter()
    for line, n in lines.items():
        if line and not line.startswith(("//", "#", "/*", "*")):
            for token in pattern.findall(line):
                out["<string>" if token[0] in "\"'" else token] += n
    return out


def counted_tokens(files: Iterator[tuple[str, str]], most: int = MANY) -> Iterator[tuple[str, Counter]]:
    """(lang, tokens) of (lang, text): equal lines are counted first and cut into tokens once."""
    held: dict[str, Counter] = {}
    for lang, text in files:
        lines = held.setdefault(lang, Counter())
        lines.update([x.strip(SPACE) for x in lines_in(text)])
        if len(lines) >= most:
            yield lang, token_counts(held.pop(lang), lang)
    for lang, lines in held.items():
        yield lang, token_counts(lines, lang)
