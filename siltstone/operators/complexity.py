"""Code-quality operators over contents (path, module, lang, text): functions are intervals of lines, scores are column expressions over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import col, ratio, round_away
from siltstone.operators.functions import function_facts
from siltstone.operators.line_scores import Lines, counted_tokens, file_scores

# Substrings that count as decision points in whole files, by language.
C_LIKE = ["if ", "case ", "while ", "for ", "?", "&&", "||", "catch "]
DECISIONS = {
    "rust": ["if ", "match ", "while ", "for ", "loop ", "?", "&&", "||"], "javascript": C_LIKE, "typescript": C_LIKE, "c": C_LIKE, "c++": C_LIKE, "java": C_LIKE, "c#": C_LIKE, "php": C_LIKE,
    "python": ["if ", "elif ", "while ", "for ", "except ", " and ", " or "], "go": ["if ", "case ", "for ", "select ", "&&", "||"],
    "ruby": ["if ", "elsif ", "unless ", "while ", "until ", "for ", "when ", "rescue ", " and ", " or "],
}
LANGS = list(DECISIONS)
# Keywords that are decision points of a function, by language, where they begin a word; and operators.
KEYWORD_POINTS = {
    "rust": ["if ", "match ", "for ", "while ", "loop "],
    "python": ["if ", "elif ", "for ", "while ", "except ", "except:"],
    "javascript": ["if ", "if(", "switch ", "switch(", "for ", "for(", "while ", "while(", "catch ", "catch(", "case "],
    "go": ["if ", "switch ", "select ", "for ", "case "],
}
KEYWORD_POINTS["typescript"] = KEYWORD_POINTS["javascript"]
OPERATOR_POINTS = {"rust": ["&&", "||", "=>"], "python": [" and ", " or "], "javascript": ["&&", "||"], "typescript": ["&&", "||"], "go": ["&&", "||"]}
# Keywords that nest, by language.
C_NESTING = ["if ", "if(", "switch ", "switch(", "for ", "for(", "while ", "while(", "catch ", "catch("]
NESTING = {
    "rust": ["match ", "for ", "while ", "loop "],
    "python": ["if ", "elif ", "for ", "while ", "except ", "except:"],
    "javascript": C_NESTING, "typescript": C_NESTING, "c": C_NESTING, "c++": C_NESTING, "java": C_NESTING, "c#": C_NESTING,
    "go": ["if ", "switch ", "select ", "for "],
}
#: A question mark that ends a fallible call (Rust), and one of a conditional expression (JavaScript).
TRY = r"(?md)(?<![:#])\?(?=[;)}, ]|$)"
TERNARY = r"(?md)\?(?![.;)]|$)(?=[^\n]*:)"
# Operators of Halstead's measures, by language.
OPERATORS = {
    "rust": """fn let mut if else match while for loop return break continue struct enum impl trait pub use mod async await move ref self Self where type const static unsafe extern crate super as in
        -> => :: = == != < > <= >= + - * / % & | ^ ! && || << >> += -= *= /= %= &= |= ^= <<= >>= .. ..= ?""".split(),
    "javascript": """function var let const if else switch case while for do return break continue class new this super import export default try catch finally throw async await yield typeof instanceof in of delete void
        => = == === != !== < > <= >= + - * / % & | ^ ! && || ~ << >> >>> += -= *= /= %= &= |= ^= <<= >>= >>>= ** **= ?. ?? ??= ++ -- ...""".split(),
    "python": """def class if elif else while for return break continue import from as try except finally raise with yield lambda pass del global nonlocal assert async await and or not is in
        = == != < > <= >= + - * / // % ** & | ^ ~ << >> += -= *= /= //= %= **= &= |= ^= <<= >>= :=""".split(),
    "go": """func var const type struct interface if else switch case for range return break continue goto defer go select chan map package import fallthrough
        := = == != < > <= >= + - * / % & | ^ ! && || << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= ++ -- <-""".split(),
    "java": """if else switch case while for do return break continue class struct new delete try catch throw finally void static const public private protected virtual override abstract interface extends implements import include using namespace typedef template
        = == != < > <= >= + - * / % & | ^ ! && || ~ << >> += -= *= /= %= &= |= ^= <<= >>= ++ -- -> :: sizeof typeof""".split(),
    "ruby": """def class module if elsif else unless while until for do return break next begin rescue ensure raise yield require include extend attr_reader attr_writer attr_accessor self super end and or not
        = == != < > <= >= + - * / % & | ^ ! && || ~ << >> += -= *= /= %= &= |= ^= <<= >>= ** **= <=> =~ !~ .. ...""".split(),
}
OPERATORS |= {"typescript": OPERATORS["javascript"]} | {x: OPERATORS["java"] for x in ("c", "c++", "c#", "php")}

SPACE = " \t\r\n\x0b\x0c"


def by_lang(lang: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    return otherwise if out is None else out.otherwise(otherwise)


def occurrences(text: Column, word: str) -> Column:
    return F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def escaped(words: list[str]) -> str:
    return "|".join("".join(c if c.isalnum() or c in " _" else "\\" + c for c in w) for w in words)


def keywords(text: Column, words: list[str]) -> Column:
    """How often one of the words begins where no letter, digit or underscore is before it."""
    return F.regexp_count(text, F.lit(rf"(?<![\p{{IsAlphabetic}}\p{{N}}_])(?:{escaped(words)})")).cast("long")


def estimate_cyclomatic(lang: Column | str, text: Column | str) -> Column:
    """1 + substring counts in the lower-cased text; a longer keyword that holds a shorter one counts for both."""
    lower = F.lower(col(text))
    one = F.lit(1).cast("long")
    return by_lang(F.lower(col(lang)), {k: sum((occurrences(lower, w) for w in words), one) for k, words in DECISIONS.items()}, one)


def lines_of(text: Column | str) -> Column:
    """Lines without their ends; an end of line at the end of the text begins no line."""
    whole = F.regexp_replace(col(text), r"\r?\n\z", "")
    return F.when(col(text) == "", F.array().cast("array<string>")).otherwise(F.split(whole, r"\r?\n", -1))


def trim(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def is_comment(body: Column, lang: Column) -> Column:
    """Whether a trimmed line begins like a comment."""
    return F.when(lang == "python", body.startswith("#")).otherwise(body.startswith("//") | body.startswith("/*") | body.startswith("*"))


def bodies(lines: Column, lang: Column) -> Column:
    """Trimmed lines that are no comments."""
    return F.filter(F.transform(lines, trim), lambda x: ~is_comment(x, lang))


def function_cyclomatic(lines: Column, lang: Column) -> Column:
    """1 + decision points in the lines of a function."""
    text = F.array_join(bodies(lines, lang), "\n")

    def points(name: str) -> Column:
        found = keywords(text, KEYWORD_POINTS[name]) + F.regexp_count(text, F.lit(escaped(OPERATOR_POINTS[name]))).cast("long")
        extra = {"rust": TRY, "javascript": TERNARY, "typescript": TERNARY}.get(name)
        return found + F.regexp_count(text, F.lit(extra)).cast("long") if extra else found

    return F.lit(1).cast("long") + by_lang(lang, {k: points(k) for k in KEYWORD_POINTS}, F.lit(0).cast("long"))


def function_cognitive(lines: Column, lang: Column) -> Column:
    """Structures at one more than their depth, runs of lines with logical operators, labelled jumps (Rust).

    A fold over the lines: depth is what earlier lines opened and did not close (in Python nothing closes), at least 0.
    """
    has = lambda x, *words: F.lit(False) if not words else _any(x.contains(w) for w in words)

    def structures(x: Column, name: str) -> Column:
        found = keywords(x, NESTING[name])
        return found + F.when(x.contains("else if "), occurrences(x, "else if ")).otherwise(occurrences(x, "if ")) if name == "rust" else found

    def opened(x: Column) -> Column:
        flags = [has(x, "if ", "elif "), has(x, "for ", "while "), has(x, "try:", "except ", "except:"), has(x, "with ")]
        return F.when(lang == "python", sum((f.cast("long") for f in flags), F.lit(0).cast("long"))).otherwise(occurrences(x, "{"))

    def line(x: Column) -> Column:
        jumps = F.when(lang == "rust", x.contains("break '").cast("long") + x.contains("continue '").cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(
            by_lang(lang, {k: structures(x, k) for k in NESTING}, F.lit(0).cast("long")).alias("structures"), has(x, "&&", "||", " and ", " or ").alias("logical"), jumps.alias("jumps"),
            opened(x).alias("opened"), F.when(lang == "python", F.lit(0).cast("long")).otherwise(occurrences(x, "}")).alias("closed"),
        )

    def step(s: Column, x: Column) -> Column:
        score = s["score"] + x["structures"] * (s["depth"] + 1) + (x["logical"] & ~s["logical"]).cast("long") + x["jumps"]
        return F.struct(F.greatest(s["depth"] + x["opened"] - x["closed"], F.lit(0).cast("long")).alias("depth"), x["logical"].alias("logical"), score.alias("score"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.transform(bodies(lines, lang), line), F.struct(zero.alias("depth"), F.lit(False).alias("logical"), zero.alias("score")), step, lambda s: s["score"])


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def brace_depth(lines: Column, lang: Column) -> Column:
    """Greatest depth of braces, counted line by line; closing more than is open stays at 0. Comment lines are skipped."""
    kept = F.filter(lines, lambda x: ~is_comment(trim(x), lang))
    step = lambda s, x: F.struct(
        F.greatest(s["depth"] + occurrences(x, "{") - occurrences(x, "}"), F.lit(0).cast("long")).alias("depth"), F.greatest(s["most"], s["depth"] + occurrences(x, "{")).alias("most")
    )
    zero = F.lit(0).cast("long")
    return F.aggregate(kept, F.struct(zero.alias("depth"), zero.alias("most")), step, lambda s: s["most"])


def indent_depth(lines: Column) -> Column:
    """Greatest indentation in units; the unit is the first indentation of 1 to 8, a tab, or 4. Blank and comment lines are skipped."""
    width = lambda x: F.char_length(x) - F.char_length(F.ltrim(x, F.lit(SPACE)))
    first = F.filter(lines, lambda x: x.startswith("\t") | ((width(x) > 0) & (width(x) <= 8)))
    unit = F.coalesce(F.get(F.transform(F.slice(first, 1, 1), lambda x: F.when(x.startswith("\t"), 1).otherwise(width(x))), F.lit(0)), F.lit(4))
    deepest = F.array_max(F.transform(F.filter(lines, lambda x: (trim(x) != "") & ~trim(x).startswith("#")), width))
    return F.coalesce(F.floor(deepest / unit).cast("long"), F.lit(0).cast("long"))


def nesting(lines: Column, lang: Column) -> Column:
    """Greatest depth, null where nothing nests."""
    depth = F.when(lang == "python", indent_depth(lines)).otherwise(brace_depth(lines, lang))
    return F.get(F.filter(F.array(depth), lambda d: d > 0), F.lit(0))  # the depth stands once, so that it is computed once


def risk_class(functions: Column, longest: Column, cyclomatic: Column, cognitive: Column, nesting: Column) -> Column:
    """low, moderate, high or critical by a score over five banded measures; a null measure scores 0."""

    def band(x: Column, *steps: tuple[int, int]) -> Column:
        out = F.when(x > steps[0][0], steps[0][1])
        for least, score in steps[1:]:
            out = out.when(x > least, score)
        return out.otherwise(0)

    score = (
        band(functions, (50, 2), (20, 1)) + band(longest, (100, 3), (50, 2), (25, 1)) + band(cyclomatic, (50, 3), (20, 2), (10, 1)) + band(cognitive, (100, 3), (50, 2), (25, 1)) + band(nesting, (8, 3), (5, 2), (4, 1))
    )
    return F.when(score <= 1, "low").when(score <= 4, "moderate").when(score <= 7, "high").otherwise("critical")


def within(lines: Column, span: Column) -> Column:
    return F.slice(lines, span["first"] + 1, span["last"] - span["first"] + 1)


def source_facts(contents: DataFrame, *parts: str) -> DataFrame:
    """function_facts of files in languages that are scored, with their lines."""
    known = contents.where(F.lower("lang").isin(LANGS))
    return function_facts(known, parts or ("scored",)).withColumn("lines", lines_of("text"))


def function_scores(contents: DataFrame) -> DataFrame:
    """(path, module, lang, name, line, cyclomatic, cognitive) of every function; cyclomatic is null in the C family."""
    lang, s = F.col("lang"), F.col("s")
    rows = source_facts(contents).select("path", "module", "lang", "lines", F.explode("scored").alias("s"))
    own = within(F.col("lines"), s)
    return rows.select(
        "path", "module", "lang", s["name"].alias("name"), (s["first"] + 1).cast("long").alias("line"),
        F.when(lang.isin(list(KEYWORD_POINTS)), function_cyclomatic(own, lang)).alias("cyclomatic"), function_cognitive(own, lang).alias("cognitive"),
    )


def function_details(contents: DataFrame) -> DataFrame:
    """(path, module, lang, name, line_start, line_end, length, cyclomatic, cognitive, max_nesting, param_count); 0 parameters are null."""
    s, lang = F.col("s"), F.col("lang")
    rows = source_facts(contents, "details").select("path", "module", "lang", "lines", F.explode("details").alias("s")).withColumn("own", within(F.col("lines"), s))
    head = F.element_at("own", 1)
    opened, closed = F.instr(head, "("), F.instr(head, ")")
    params = F.trim(F.substr(head, opened + 1, closed - opened - 1), F.lit(SPACE))
    count = F.when((opened > 0) & (closed > opened) & (params != ""), F.size(F.split(params, ",", -1)).cast("long"))
    inner = F.aggregate("s.inner", F.lit(0).cast("long"), lambda total, x: total + function_cognitive(within(F.col("own"), x), lang))
    return rows.select(
        "path", "module", "lang", s["name"].alias("name"), (s["first"] + 1).cast("long").alias("line_start"), (s["last"] + 1).cast("long").alias("line_end"), (s["last"] - s["first"] + 1).cast("long").alias("length"),
        estimate_cyclomatic(lang, F.array_join("own", "\n")).alias("cyclomatic"), inner.alias("cognitive"), nesting(F.col("own"), lang).alias("max_nesting"), count.alias("param_count"),
    )


def file_complexity(contents: DataFrame) -> DataFrame:
    """(path, module, lang, function_count, max_function_length, cyclomatic, max_function_cyclomatic, cognitive, max_nesting, risk).

    Files in languages that are not scored are left out. cyclomatic is the sum over functions; a file whose functions
    are not found by interval, but counted, has that of the whole file, one without any has 0. cognitive and
    max_nesting are null where there is nothing to score. One pass over whole files, no shuffle.
    """
    names = ["function_count", "max_function_length", "cyclomatic", "max_function_cyclomatic", "cognitive", "max_nesting"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: dict[str, Lines] = {}
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in memos:
                    memos[lang] = Lines(lang)
                rows.append(file_scores(text, memos[lang]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names)))], ["path", "module", "lang", *names])

    known = contents.where(F.lower("lang").isin(LANGS) & F.col("text").isNotNull()).select("path", "module", F.lower("lang").alias("lang"), "text")
    out = known.mapInArrow(run, "path string, module string, lang string, " + ", ".join(f"{n} long" for n in names))
    return out.withColumn("risk", risk_class(F.col("function_count"), F.col("max_function_length"), F.col("max_function_cyclomatic"), F.col("cognitive"), F.col("max_nesting")))


def complexity_summary(files: DataFrame) -> DataFrame:
    """Totals over files: the mean function length is that of the files' longest, the mean cyclomatic a function's."""
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    out = files.agg(
        F.count("*").alias("files"), zero(F.sum("function_count")).alias("total_functions"), zero(F.sum("max_function_length")).alias("l"), zero(F.max("max_function_length")).alias("max_function_length"),
        zero(F.sum(F.when(F.col("function_count") > 0, F.col("cyclomatic")))).alias("c"), zero(F.max("max_function_cyclomatic")).alias("max_cyclomatic"),
        F.sum("cognitive").alias("g"), F.count("cognitive").alias("gn"), F.max("cognitive").alias("max_cognitive"), F.sum("max_nesting").alias("d"), F.count("max_nesting").alias("dn"), F.max("max_nesting").alias("max_nesting_depth"),
        zero(F.sum(F.col("risk").isin("high", "critical").cast("long"))).alias("high_risk_files"),
    )
    length = F.when(F.col("total_functions") > 0, ratio("l", "files", 2)).otherwise(0.0)
    return out.select(
        "files", "total_functions", length.alias("avg_function_length"), "max_function_length", ratio("c", "total_functions", 2).alias("avg_cyclomatic"), "max_cyclomatic",
        F.when(F.col("gn") > 0, ratio("g", "gn", 2)).alias("avg_cognitive"), "max_cognitive", F.when(F.col("dn") > 0, ratio("d", "dn", 2)).alias("avg_nesting_depth"), "max_nesting_depth", "high_risk_files",
    )


def complexity_histogram(files: DataFrame, width: int = 5, buckets: int = 7) -> DataFrame:
    """(bucket, low, files) by a file's largest function: the last bucket is open; every bucket stands."""
    spark = files.sparkSession
    counts = files.groupBy(F.least(F.floor(F.col("max_function_cyclomatic") / width), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    names = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), (F.col("id") * width).alias("low"))
    return names.join(counts, "bucket", "left").select("bucket", "low", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def debt_ratio(files: DataFrame, code_lines: DataFrame) -> DataFrame:
    """Cyclomatic and cognitive points per 1 000 lines of code and their level; no row without code or files."""
    points = files.agg(F.sum(F.col("cyclomatic") + F.coalesce("cognitive", F.lit(0))).cast("long").alias("complexity_points")).where("complexity_points is not null")
    out = points.crossJoin(F.broadcast(code_lines.select("code"))).where("code > 0")  # one row each
    value = ratio(F.col("complexity_points") * 1000, "code", 2)
    out = out.select(value.alias("ratio"), "complexity_points", ratio("code", F.lit(1000)).alias("code_kloc"))
    return out.withColumn("level", F.when(F.col("ratio") < 30, "low").when(F.col("ratio") < 60, "moderate").when(F.col("ratio") < 100, "high").otherwise("critical"))


def halstead_tokens(contents: DataFrame) -> DataFrame:
    """(op, token, n): operators and operands of all files, found by the longest operator at each place.

    Comment lines are skipped. A string is one operand `<string>`, whatever it holds; it ends with its line at the latest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (f for batch in batches for f in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True))
        for lang, tokens in counted_tokens(files):
            words = set(OPERATORS[lang])
            yield pa.RecordBatch.from_arrays([pa.array([t in words for t in tokens], pa.bool_()), pa.array(list(tokens), pa.string()), pa.array(list(tokens.values()), pa.int64())], ["op", "token", "n"])

    known = contents.where(F.lower("lang").isin(list(OPERATORS)) & F.col("text").isNotNull()).select(F.lower("lang").alias("lang"), "text")
    return known.mapInArrow(run, "op boolean, token string, n long").groupBy("op", "token").agg(F.sum("n").alias("n"))  # each distinct token once before the global sums


def halstead(contents: DataFrame) -> DataFrame:
    """One row: distinct and total operators and operands of all files, and the measures derived from them."""
    one = halstead_tokens(contents).agg(
        F.coalesce(F.sum(F.col("op").cast("long")), F.lit(0)).cast("long").alias("distinct_operators"), F.coalesce(F.sum((~F.col("op")).cast("long")), F.lit(0)).cast("long").alias("distinct_operands"),
        F.coalesce(F.sum(F.when(F.col("op"), F.col("n"))), F.lit(0)).cast("long").alias("total_operators"), F.coalesce(F.sum(F.when(~F.col("op"), F.col("n"))), F.lit(0)).cast("long").alias("total_operands"),
    )
    v, n = F.col("vocabulary").cast("double"), F.col("length").cast("double")
    one = one.withColumn("vocabulary", F.col("distinct_operators") + F.col("distinct_operands")).withColumn("length", F.col("total_operators") + F.col("total_operands"))
    one = one.withColumn("v", F.when(v > 0, n * F.log2(v)).otherwise(0.0)).withColumn("d", F.when(F.col("distinct_operands") > 0, F.col("distinct_operators") / 2 * (F.col("total_operands") / F.col("distinct_operands"))).otherwise(0.0))
    return one.select(
        "distinct_operators", "distinct_operands", "total_operators", "total_operands", "vocabulary", "length", round_away("v", 2).alias("volume"), round_away("d", 2).alias("difficulty"),
        round_away(F.col("d") * F.col("v"), 2).alias("effort"), round_away(F.col("d") * F.col("v") / 18, 2).alias("time_seconds"), round_away(F.col("v") / 3000, 4).alias("estimated_bugs"),
    )


def maintainability(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    """171 - 5.2 ln V - 0.23 CC - 16.2 ln LOC (without V where it is not above 0), at least 0, 2 digits."""
    v = F.when(volume > 0, F.log(volume)).otherwise(0.0)
    return round_away(F.greatest(F.lit(171.0) - 5.2 * v - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(loc, F.lit(1.0))), F.lit(0.0)), 2)


def maintainability_index(files: DataFrame, volume: Column | None = None) -> DataFrame:
    """(path, index, grade) of files with cyclomatic and code columns; A from 85, B from 65."""
    v = volume if volume is not None else F.lit(0.0)
    out = files.where("code > 0").select("path", maintainability(v.cast("double"), F.col("cyclomatic").cast("double"), F.col("code").cast("double")).alias("index"))
    return out.withColumn("grade", F.when(F.col("index") >= 85, "A").when(F.col("index") >= 65, "B").otherwise("C"))


def maintainability_report(files: DataFrame, code_lines: DataFrame, volume: DataFrame | None = None) -> DataFrame:
    """One row (score, avg_cyclomatic, avg_loc, avg_halstead_volume, grade) from the averages of all files.

    files: file_complexity; code_lines: (code, files) of all parents; volume: (volume), which counts if it is above 0.
    No row without files or code.
    """
    averages = complexity_summary(files).where("files > 0").select("avg_cyclomatic")
    loc = code_lines.where("files > 0 and code > 0").select(ratio("code", "files", 2).alias("avg_loc"))
    one = averages.crossJoin(F.broadcast(loc))  # one row each
    one = one.crossJoin(F.broadcast(volume.select("volume"))) if volume is not None else one.withColumn("volume", F.lit(None).cast("double"))
    used = F.when(F.col("volume") > 0, F.col("volume"))
    raw = F.lit(171.0) - F.when(used.isNotNull(), 5.2 * F.log(used)).otherwise(0.0) - 0.23 * F.col("avg_cyclomatic") - 16.2 * F.log("avg_loc")
    out = one.select(round_away(F.greatest(raw, F.lit(0.0)), 2).alias("score"), "avg_cyclomatic", "avg_loc", used.alias("avg_halstead_volume"))
    return out.withColumn("grade", F.when(F.col("score") >= 85, "A").when(F.col("score") >= 65, "B").otherwise("C"))


# Lines that declare a symbol, and what makes one public, by language.
SYMBOL_LINES = {
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|type|static|mod)\s+(\w+)", r"^\s*pub\s", r"^\s*(///|#\[doc|/\*\*)"),
    "python": (r"^(async\s+def|def|class)\s+(\w+)", r"^(async\s+def|def|class)\s+[^_]", r'^\s*("""|#)'),
    "go": (r"^(func|type|var|const)\s+(?:\([^)]*\)\s*)?(\w+)", r"^(func|type|var|const)\s+(\([^)]*\)\s*)?[A-Z]", r"^\s*//"),
    "javascript": (r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?(function|class|const|let|interface|type)\s+(\w+)", r"^\s*export\s", r"^\s*(/\*\*|\*/|//)"),
    "java": (r"^\s*(?:public|protected|private)?\s*(?:static\s+|final\s+|abstract\s+)*(class|interface|enum)\s+(\w+)", r"^\s*public\s", r"^\s*(/\*\*|\*/|//)"),
}


def api_symbols(contents: DataFrame) -> DataFrame:
    """(path, module, lang, line, kind, name, is_public, documented): a symbol is documented by the line before it (Python: after it)."""
    lang = F.lower("lang")
    lines = contents.where(lang.isin(list(SYMBOL_LINES))).select("path", "module", lang.alias("lang"), F.posexplode(F.transform(F.arrays_zip(
        lines_of("text").alias("here"), F.array_prepend(lines_of("text"), F.lit("")).alias("before"), F.array_append(F.slice(lines_of("text"), 2, F.greatest(F.size(lines_of("text")) - 1, F.lit(0))), F.lit("")).alias("after")), lambda z: z)).alias("line", "z"))
    pick = lambda f: by_lang(F.col("lang"), {k: f(k, *p) for k, p in SYMBOL_LINES.items()}, F.lit(None))
    here = F.col("z.here")
    out = lines.select(
        "path", "module", "lang", (F.col("line") + 1).cast("long").alias("line"), pick(lambda k, p, u, d: F.regexp_extract(here, p, 1)).alias("kind"), pick(lambda k, p, u, d: F.regexp_extract(here, p, 2)).alias("name"),
        pick(lambda k, p, u, d: here.rlike(u)).alias("is_public"), pick(lambda k, p, u, d: F.coalesce(F.col("z.after" if k == "python" else "z.before"), F.lit("")).rlike(d)).alias("documented"),
    )
    return out.where("name <> ''")


def api_surface(symbols: DataFrame, key: str) -> DataFrame:
    """(key, symbols, public_symbols, public_ratio, documented_ratio) by language or module."""
    public = F.col("is_public")
    out = symbols.groupBy(key).agg(F.count("*").alias("symbols"), F.sum(public.cast("long")).alias("public_symbols"), F.sum((public & F.col("documented")).cast("long")).alias("d"))
    return out.select(key, "symbols", "public_symbols", ratio("public_symbols", "symbols").alias("public_ratio"), ratio("d", "public_symbols").alias("documented_ratio"))
