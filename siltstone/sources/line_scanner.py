"""Lines of code, comments and blanks of whole files, by a scanner that carries its state over lines, with embedded languages.

A line is blank if it is white space only, wherever it stands; a comment if all its other characters lie in comments;
else code. Strings, raw strings and nested block comments are read as their language has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.adapters import FILE_COLUMNS

# what is left open, by a single backslash too, ends with the text
DOUBLE, SINGLE = r'"(?:\\.|[^"\\])*(?:"|\\?\Z)', r"'(?:\\.|[^'\\\n])*(?:'|$|\\?\Z)"
TEMPLATE, RAW_GO = r"`(?:\\.|[^`\\])*(?:`|\\?\Z)", r"`[^`]*(?:`|\Z)"
TRIPLE = r'(?:"""(?:\\.|[^\\])*?(?:"""|\\?\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\\?\Z))"
ONE_LINE = r'"(?:\\.|[^"\\\n])*(?:"|$|\\?\Z)'
RAW_RUST, CHAR_RUST = r'\bb?r(?P<hashes>#*)".*?(?:"(?P=hashes)|\Z)', r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"


class Grammar(NamedTuple):
    """How comments begin (to the end of the line, or in pairs), whether pairs nest, and strings as patterns."""

    line: tuple[str, ...]
    block: tuple[tuple[str, str], ...]
    nested: bool
    strings: tuple[str, ...]


# Comment marks and string forms of languages.
C_FAMILY = Grammar(("//",), (("/*", "*/"),), False, (DOUBLE, SINGLE))
HASH = Grammar(("#",), (), False, (DOUBLE, SINGLE))
GRAMMARS = {
    "Rust": Grammar(("//",), (("/*", "*/"),), True, (RAW_RUST, CHAR_RUST, DOUBLE)), "Python": Grammar(("#",), (), False, (TRIPLE, ONE_LINE, SINGLE)), "Go": Grammar(("//",), (("/*", "*/"),), False, (DOUBLE, RAW_GO, SINGLE)),
    "JavaScript": Grammar(("//",), (("/*", "*/"),), False, (DOUBLE, SINGLE, TEMPLATE)), "TypeScript": Grammar(("//",), (("/*", "*/"),), False, (DOUBLE, SINGLE, TEMPLATE)),
    "C": C_FAMILY, "C++": C_FAMILY, "C#": C_FAMILY, "Java": C_FAMILY, "PHP": Grammar(("//", "#"), (("/*", "*/"),), False, (DOUBLE, SINGLE)), "Kotlin": Grammar(("//",), (("/*", "*/"),), True, (TRIPLE, DOUBLE, SINGLE)),
    "Swift": Grammar(("//",), (("/*", "*/"),), True, (TRIPLE, DOUBLE)), "CSS": Grammar((), (("/*", "*/"),), False, (DOUBLE, SINGLE)), "SQL": Grammar(("--",), (("/*", "*/"),), False, (SINGLE,)),
    "Ruby": Grammar(("#",), (("=begin", "=end"),), False, (DOUBLE, SINGLE)), "Shell": HASH, "YAML": HASH, "TOML": Grammar(("#",), (), False, (TRIPLE, ONE_LINE, SINGLE)), "Makefile": HASH, "Dockerfile": HASH, "CMake": HASH,
    "HTML": Grammar((), (("<!--", "-->"),), False, ()), "XML": Grammar((), (("<!--", "-->"),), False, ()), "Markdown": Grammar((), (("<!--", "-->"),), False, ()), "JSON": Grammar((), (), False, (DOUBLE,)), "Text": Grammar((), (), False, ()),
}
# Languages named by fences and by the type of a script.
FENCES = {"rust": "Rust", "rs": "Rust", "python": "Python", "py": "Python", "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript", "go": "Go", "java": "Java", "c": "C", "cpp": "C++", "sh": "Shell", "bash": "Shell", "sql": "SQL", "toml": "TOML", "yaml": "YAML", "json": "JSON", "html": "HTML", "css": "CSS"}
SCRIPT_TYPES = {"application/json": "JSON", "application/ld+json": "JSON", "text/typescript": "TypeScript", "text/plain": "Text"}
EMBEDDING = {
    "HTML": re.compile(r"<!--.*?(?:-->|\Z)|<(?P<tag>script|style)\b(?P<info>[^>]*)>(?P<body>.*?)</(?P=tag)\s*>", re.DOTALL | re.IGNORECASE),
    "Markdown": re.compile(r"<!--.*?(?:-->|\Z)|^ {0,3}(?P<tag>`{3,}|~{3,})(?P<info>[^\n`]*)(?P<body>\n(?:.*?\n)?) {0,3}(?P=tag)[`~]*[ \t]*$", re.DOTALL | re.MULTILINE),
}


@cache
def tokens_of(lang: str) -> re.Pattern:
    grammar = GRAMMARS.get(lang, C_FAMILY)
    line = "|".join(re.escape(x) + r"[^\n]*" for x in grammar.line)
    block = "|".join(re.escape(a) for a, _ in grammar.block)
    parts = [f"(?P<line>{line})"] * bool(line) + [f"(?P<block>{block})"] * bool(block) + [f"(?:{s})" for s in grammar.strings]
    return re.compile("|".join(parts) or r"(?!)", re.DOTALL | re.MULTILINE)


def comments_in(text: str, lang: str, doc_strings: bool = False) -> Iterator[tuple[int, int]]:
    """Places of comments; doc_strings counts a triple-quoted string that begins a line as one."""
    grammar, pattern, at = GRAMMARS.get(lang, C_FAMILY), tokens_of(lang), 0
    while (found := pattern.search(text, at)) is not None:
        at = found.end()
        if at == found.start():
            at += 1
            continue
        groups = found.groupdict()
        if groups.get("line") is not None:
            yield found.span()
        elif (opened := groups.get("block")) is not None:
            closed = dict(grammar.block)[opened]
            if grammar.nested:
                depth, marks = 1, re.compile(f"{re.escape(opened)}|{re.escape(closed)}")
                while depth and (mark := marks.search(text, at)) is not None:
                    depth, at = depth + (1 if mark[0] == opened else -1), mark.end()
                at = len(text) if depth else at
            else:
                end = text.find(closed, at)
                at = len(text) if end < 0 else end + len(closed)
            yield found.start(), at
        elif doc_strings and found[0][:3] in ('"""', "'''") and not text[text.rfind("\n", 0, found.start()) + 1 : found.start()].strip():
            yield found.span()


def line_kinds(text: str, lang: str, doc_strings: bool = False) -> list[str]:
    """For each line b (blank), c (comment) or k (code)."""
    text = text.replace("\0", "x")  # stands for what is in comments from here on
    out, at = [], 0
    for start, end in comments_in(text, lang, doc_strings):
        out += [text[at:start], re.sub(r"\S", "\0", text[start:end])]
        at = end
    masked = "".join([*out, text[at:]])
    lines = masked.split("\n")
    if lines[-1] == "":
        lines.pop()
    if lang == "Markdown":  # prose is commentary
        return ["c" if line.strip() else "b" for line in lines]
    return ["b" if not (rest := line.strip()) else "k" if rest.replace("\0", "").strip() else "c" for line in lines]


def embedded(text: str, lang: str) -> Iterator[tuple[str, int, int]]:
    """(language, start, end) of what other languages hold in a file."""
    for found in EMBEDDING[lang].finditer(text) if lang in EMBEDDING else ():
        if found["tag"] is None:
            continue
        info = (found["info"] or "").strip()
        if lang == "Markdown":
            child = FENCES.get(re.split(r"[\s,{]", info.lower() + " ")[0])
        elif found["tag"].lower() == "style":
            child = "CSS"
        else:
            kind = re.search(r"type\s*=\s*[\"']?([^\"'\s>]+)", info, re.IGNORECASE)
            child = SCRIPT_TYPES.get(kind[1].lower(), "JavaScript") if kind else "JavaScript"
        if child is not None and found["body"].strip():
            yield child, *found.span("body")


def scan_text(text: str, lang: str, doc_strings: bool = False) -> list[tuple[str, str, int, int, int]]:
    """(language, kind, code, comments, blanks): the file with all its lines, then each embedded language's.

    A line that lies wholly in an embedded part counts in the file's row as its language has it; one that it shares
    with its tags, as the file's language has it, and in the part's row beside that.
    """
    own = line_kinds(text, lang, doc_strings)
    starts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"] if lang in EMBEDDING else []
    parts: dict[str, list[str]] = {}
    for child, start, end in embedded(text, lang):
        lines = line_kinds(text[start:end], child, doc_strings)
        pieces = text[start:end].split("\n")
        first = text.count("\n", 0, start)
        for k, kind in enumerate(lines):
            edge = k == 0 and start != starts[first] or k == len(pieces) - 1
            if edge and kind == "b":
                continue
            parts.setdefault(child, []).append(kind)
            if not edge:
                own[first + k] = kind
    return [(lang, "parent", *counts(own))] + [(child, "child", *counts(kinds)) for child, kinds in parts.items()]


#: No rule looks at which digit stands where, so lines are looked up with all digits alike.
DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
#: Lines held by a worker and language; lines of a comment or string that is looked up in one piece.
MANY, LONGEST = 100_000, 16


def same_digits(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(DIGITS).decode("utf-8", "surrogatepass")


class Pieces(dict):
    """Lines (or several, joined) -> (code, comments, blanks), or None if what they begin goes on behind them."""

    def __init__(self, lang: str, doc_strings: bool) -> None:
        super().__init__()
        self.lang, self.doc_strings = lang, doc_strings

    def __missing__(self, piece: str) -> tuple[int, int, int] | None:
        if len(self) >= MANY:
            self.clear()
        found = self[piece] = counts(line_kinds(piece + "\n", self.lang, self.doc_strings)) if self.whole(piece) else None
        return found

    def whole(self, piece: str) -> bool:
        """Whether no comment and no string of it takes in any of what stands behind it."""
        text, size = piece.replace("\0", "x") + "\nx", len(piece)
        places = [*comments_in(text, self.lang, self.doc_strings), *strings_in(text, self.lang)]
        return all(end <= size or start > size for start, end in places)


def counts(kinds: list[str]) -> tuple[int, int, int]:
    return kinds.count("k"), kinds.count("c"), kinds.count("b")


def file_counts(text: str, pieces: Pieces) -> tuple[int, int, int]:
    """(code, comments, blanks) of a file in a language that holds no others, as line_kinds; each different line is read once."""
    same = same_digits(text)
    lines = same.split("\n")
    ended = lines[-1] == ""
    if ended:
        lines.pop()
    code = comments = blanks = at = 0
    while at < len(lines):
        piece, end = lines[at], at + 1
        found = pieces[piece]
        while found is None and end < len(lines) and end - at < LONGEST:
            piece, end = piece + "\n" + lines[end], end + 1
            found = pieces[piece]
        if found is None:  # long, or open to the end
            return counts(line_kinds(same, pieces.lang, pieces.doc_strings))
        k, c, b = found
        code, comments, blanks, at = code + k, comments + c, blanks + b, end
    return code, comments, blanks


def scan_rows(contents: DataFrame, children: str = "separate", doc_strings: bool = False) -> DataFrame:
    """File rows of (path, module, lang, text), children: separate or parents-only. Null texts are left out.

    A parent's bytes are those of its text and its tokens a quarter of them; a child has neither. One pass, no shuffle.
    """
    if children not in ("separate", "parents-only"):
        raise ValueError("children is separate or parents-only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Pieces] = {}
        for batch in batches:
            rows = []
            for path, module, lang, text, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang in EMBEDDING:
                    found = scan_text(text, lang, doc_strings)
                else:
                    if lang not in known:
                        known[lang] = Pieces(lang, doc_strings)
                    found = [(lang, "parent", *file_counts(text, known[lang]))]
                for name, kind, code, comments, blanks in found:
                    if kind == "parent" or children == "separate":
                        n = size if kind == "parent" else 0
                        rows.append((path, module, name, kind, code, comments, blanks, code + comments + blanks, n, n // 4))
            types = [pa.string()] * 4 + [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], FILE_COLUMNS)

    given = contents.where("text is not null").select("path", "module", "lang", "text", F.octet_length("text").cast("long").alias("size"))
    return given.mapInArrow(run, "path string, module string, lang string, kind string, code long, comments long, blanks long, lines long, bytes long, tokens long")


def masked(text: str, lang: str) -> str:
    """The text without comments and strings; line ends within them stay."""
    out, at = [], 0
    places = sorted({*comments_in(text, lang), *strings_in(text, lang)})
    for start, end in places:
        out += [text[at:start], "\n" * text.count("\n", start, end)]
        at = end
    return "".join([*out, text[at:]])


def strings_in(text: str, lang: str) -> Iterator[tuple[int, int]]:
    """Places of strings that are not in comments."""
    pattern, at = tokens_of(lang), 0
    inside = list(comments_in(text, lang))
    k = 0
    while (found := pattern.search(text, at)) is not None:
        while k < len(inside) and inside[k][1] <= found.start():
            k += 1
        if k < len(inside) and inside[k][0] <= found.start():
            at = max(inside[k][1], found.start() + 1)
            continue
        at = max(found.end(), found.start() + 1)
        if found.end() > found.start():
            yield found.span()
