"""Code-like files rendered from orders and their line items: one file an order, in six languages, one function an item."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scalars import module_key
from siltstone.sources.adapters import table

#: Placeholders: $o order, $p part, $n line number, $q quantity. A line given as (condition, text) stands only then.
CONDITIONS = {"even": "l_partkey % 2 = 0", "third": "cast(l_quantity as bigint) % 3 = 0", "returned": "l_returnflag = 'R'"}

RUST = (
    ["//! Order $o", "use std::fmt;", "use crate::part::{Part, Line};", "use super::order$o;", ""],
    [
        ("even", "/* block $p"), ("even", ""), ("even", "   still /* nested */ comment */"), "/// Doc of $p", "pub fn item_$n(x: i32) -> i32 {", '    let s = "if { && } no"; // tail', "    if x > $q && x < 90 {",
        ("third", "        for i in 0..$n {"), ("third", "            work(i)?;"), ("third", "        }"), "    } else if x == $p || x == 1 {", ("returned", "        break 'outer;"), ("even", "        let y = x.get($n).unwrap();"),
        "    }", "    match x {", "        1 => $q,", "        _ => x,", "    }", "}", "",
    ],
)
PYTHON = (
    ["# Order $o", "import os, sys", "from part.line import item", "import order$o as o", ""],
    [
        ("even", "@cached"), "def item_$n(x, y):", ("third", '    """Doc $p: if # no comment'), ("third", ""), ("third", '    still doc"""'), "    # comment", "    if x > $q and y < 3:", "        for i in range($n):",
        ("returned", "            while x:"), ("returned", "                x -= 1"), "    elif x == $p or y:", "        return '#no'", "    try:", "        x //= 2", "    except ValueError:", ("even", "        raise KeyError($n)"), "        pass", "    return x", "",
    ],
)
JAVASCRIPT = (
    ["// Order $o", "import part from './part$o';", "const fs = require('fs');", ""],
    [
        "export function item$n(x) {", "  const t = `a // {x} b`;", "  if (x > $q && x < 9) {", ("third", "    for (let i = 0; i < $n; i++) { work(i); }"), "  } else if (x === $p) {", "    return x ? 1 : 2;", "  }", "  /* c */ switch (x) {",
        ("returned", "    case 1: return x?.y;"), ("even", "    default: throw new Error('$n');"), "  }", "  return x;", "}", "", "const arrow$n = (a) => {", "  return a || $q;", "};", "",
    ],
)
TYPESCRIPT = (
    ["/* Order", " * $o", " */", 'import { Part } from "@scope/part/line";', 'export * from "../order$o";', ""],
    ["class Item$n {", "  run(x) {", "    if (x > $q) { return $n; } // tail", ("third", "    while (x) { x--; }"), "    return x;", "  }", "}", ""],
)
GO = (
    ["package part", "", "import (", '\t"fmt"', "\t// skipped", '\talias "os/order$o"', '\t_ "embed"', ")", "", 'import "strings"', ""],
    [
        "// Item$n does.", "func Item$n(x int) int {", "\ts := `raw // $q`", "\tif x > $q && x < 3 {", ("third", "\t\tfor i := 0; i < $n; i++ {"), ("third", "\t\t}"), "\t} else if x == $p {", "\t\treturn 1", "\t}", "\tswitch x {", "\tcase 1:",
        ("even", '\t\tpanic("$p")'), "\t}", "\treturn x", "}", "",
    ],
)
JAVA = (
    ["package order$o;", "import part.Line;", ""],
    ["/** Doc $p */", "public int item$n(int x) {", "    if (x > $q) {", ("third", "        while (x > 1) { x--; }"), "    }", ("returned", "    try { work(); } catch (Exception e) {"), ("returned", "    }"), "    return x; /* end", "    of item */", "}", ""],
)
#: By o_orderkey modulo 6: language, extension, lines of the head and of each item.
FILES = [("Rust", "rs", *RUST), ("Python", "py", *PYTHON), ("JavaScript", "js", *JAVASCRIPT), ("TypeScript", "ts", *TYPESCRIPT), ("Go", "go", *GO), ("Java", "java", *JAVA)]
NAMES = {"o": "o_orderkey", "p": "l_partkey", "n": "l_linenumber", "q": "cast(l_quantity as bigint)"}


def pieces(line: str) -> list[tuple[bool, str]]:
    """(whether it is a placeholder, text)."""
    return [(k % 2 == 1, x) for k, x in enumerate(re.split(r"\$([opnq])(?![A-Za-z])", line))]


def line_column(line: str | tuple[str, str]) -> Column:
    if isinstance(line, tuple):
        return F.when(F.expr(CONDITIONS[line[0]]), line_column(line[1]))
    return F.concat(*(F.expr(NAMES[x]).cast("string") if named else F.lit(x) for named, x in pieces(line)))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key into as many parts as there are cores: what is rendered from few bytes is much work."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def dealt(spark: SparkSession, sf_dir: str, orders: list[str], items: list[str]) -> tuple[DataFrame, DataFrame]:
    """Orders and items, both dealt by order."""
    return spread(table(spark, sf_dir, "orders").select(orders), "o_orderkey"), spread(table(spark, sf_dir, "lineitem").select(items), "l_orderkey")


#: Placeholders stand as these characters in whole templates, which are filled by replacement.
MARKS = {name: chr(k) for k, name in enumerate(NAMES, 1)}


def template(lines: list[str | tuple[str, str]], holds: set[str], missing: str) -> str:
    """The lines that stand when the conditions in `holds` hold and the values in `missing` are null, joined, with marks."""
    out = []
    for line in lines:
        if isinstance(line, tuple):
            if line[0] not in holds:
                continue
            line = line[1]
        parts = pieces(line)
        if not any(named and x in missing for named, x in parts):
            out.append("".join(MARKS[x] if named else x for named, x in parts))
    return "\n".join(out)


def filled(key: str, kinds: list[list], names: str, conditions: list[str]) -> Column:
    """The text of the kind that a key modulo their number has: as joining each line's column, but by few operations.

    A template for every kind, set of conditions and set of null values is chosen by its number, so the code that
    Spark generates stays small enough to be compiled. Other keys (negative ones) have none.
    """
    texts = [
        template(lines, {c for k, c in enumerate(conditions) if held >> k & 1}, "".join(n for k, n in enumerate(names) if null >> k & 1))
        for lines in kinds for held in range(1 << len(conditions)) for null in range(1 << len(names))
    ]
    place = F.col(key) % len(kinds)
    for c in conditions:
        place = place * 2
    for k, c in enumerate(conditions):
        place = place + F.when(F.expr(CONDITIONS[c]), 1 << k).otherwise(0)
    for _ in names:
        place = place * 2
    for k, n in enumerate(names):
        place = place + F.when(F.expr(NAMES[n]).isNull(), 1 << k).otherwise(0)
    text = F.get(F.split(F.lit("\0".join(texts)), "\0"), F.when(F.col(key) % len(kinds) >= 0, place).cast("int"))
    for n in names:
        text = F.replace(text, F.lit(MARKS[n]), F.coalesce(F.expr(NAMES[n]).cast("string"), F.lit("")))
    return text


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, module, lang, text."""
    orders, items = dealt(spark, sf_dir, ["o_orderkey"], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"])
    body = filled("l_orderkey", [lines for _, _, _, lines in FILES], "pnq", list(CONDITIONS))
    parts = items.select("l_orderkey", F.struct("l_linenumber", body.alias("body")).alias("part")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    kind = F.col("o_orderkey") % len(FILES)
    pick = lambda f: F.coalesce(*(F.when(kind == k, f(*x)) for k, x in enumerate(FILES)))
    head = filled("o_orderkey", [lines for _, _, lines, _ in FILES], "o", [])
    whole = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.concat(head, F.lit("\n"), F.coalesce(F.array_join(F.transform("parts", lambda x: x["body"]), "\n"), F.lit("")))
    path = F.concat(F.lit("src/"), pick(lambda lang, *_: F.lit(lang.lower())), F.lit("/"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"), F.lit("."), pick(lambda _, ext, *__: F.lit(ext)))
    made = whole.select(path.alias("path"), pick(lambda lang, *_: F.lit(lang)).alias("lang"), text.alias("text"))
    return made.select("path", module_key("path", ["src"], 2).alias("module"), "lang", "text")

# --- lockfiles: one an order, of six kinds, one dependency an item -------------------------------------------------

#: By o_orderkey modulo 6: file name, text before, text of an item, what joins items, text behind. A customer's key odd: the end is missing.
LOCKFILES = [
    ("Cargo.lock", "version = 4\n", '[[package]]\nname = "p$p"\nversion = "$n.0"\n', "\n", ""),
    ("package-lock.json", '{"name": "o$o", "packages": {"": {"name": "root"}, ', '"node_modules/p$p-$n": {"version": "$q"}', ", ", "}}"),
    ("pnpm-lock.yaml", "packages:\n", "  /p$p@$n:\n    resolution: {integrity: s$q}", "\n", "\nx/y: 1\n"),
    ("yarn.lock", "# lock\n\n", 'p$p@^$n:\n  version "$n.0"\n  dependencies:\n', "\n", "\n"),
    ("go.sum", "", "example.com/p$p v1.$n.0 h1:x=\nexample.com/p$p v1.$n.0/go.mod h1:y=\nexample.com/p$p v1.$n.0 h1:x=", "\n", "\nlone\n"),
    ("Gemfile.lock", "GEM\n  specs:\n", "    p$p ($n.0)\n      q$q (>= 1)\n    bare", "\n", "\n\nPLATFORMS\n    no (1)\n"),
]


def lock_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text."""
    orders, items = dealt(spark, sf_dir, ["o_orderkey", "o_custkey"], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    pick = lambda key, values: F.coalesce(*(F.when(F.col(key) % len(LOCKFILES) == k, v) for k, v in enumerate(values)))
    parts = items.select("l_orderkey", pick("l_orderkey", [line_column(x[2]) for x in LOCKFILES]).alias("part")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    whole = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.coalesce(pick("o_orderkey", [F.array_join("parts", x[3]) for x in LOCKFILES]), F.lit(""))
    end = F.when(F.col("o_custkey") % 2 == 0, pick("o_orderkey", [F.lit(x[4]) for x in LOCKFILES])).otherwise(F.lit(""))
    path = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit("/"), pick("o_orderkey", [F.lit(x[0]) for x in LOCKFILES]))
    return whole.select(path.alias("path"), F.concat(pick("o_orderkey", [line_column(x[1]) for x in LOCKFILES]), body, end).alias("text"))
