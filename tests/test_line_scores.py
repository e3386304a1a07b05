"""File scores and tokens in one pass: equal to the column expressions over the same lines, on random files."""

import random

from pyspark.sql import functions as F

from siltstone.operators import complexity as cx

PIECES = (
    "fn a1(x: i32) {|pub fn b() -> i32 {|pub(crate) async fn r#c() {|def f(x):|async def g():|    def h(y):|@cached|    @x|func G(x int) {|export function q2(x) {|const arrow = (a) => {|run(x) {|public int m(int x) {|int k(int y)|{|}|}}|{ {|    }|"
    "if x && y || z {|} else if a || b {|if (x) {|  while (i < 3) { i--; }|for i in 0..3 {|match x {|  1 => 2,|case 1: break;|switch (x) {|catch (E e) {|try:|except ValueError:|elif a and b or c:|  with open(x) as f:|\ttab if x|        deep = 1|"
    "break 'outer;|continue 'l;|x?.y ? 1 : 2;|f(x)?;|a?|# comment if|// if { comment|/* { open|still */ }|* star {|\"if { && } \\\" \" // t|'c'|/// doc||   |x = 'it''s' + \"a\\\\\"|return x // y|́if x|éif x |ाif x|Ⓐif (x)|_if x|9if x|KK If x|café for x| if x|"
    "a\tb\x0bif |unless x|end|do|def z|while x do|s := `raw`|func (r T) M() {|).map(x => {|foo(bar)|İf x|x\rif y"
).split("|")
LANGS = ["Rust", "Python", "JavaScript", "TypeScript", "Go", "Java", "C", "PHP", "Ruby", "C#"]


def files(spark):
    pick = random.Random(4)
    ends = ["\n", "\n", "\n", "\r\n"]
    rows = [(f"f{k}", "m", LANGS[k % len(LANGS)], "".join(pick.choice(PIECES) + pick.choice(ends) for _ in range(pick.randrange(40))) + pick.choice(["", "x", "}"])) for k in range(1500)]
    return spark.createDataFrame([*rows, ("null", "m", "Rust", None), ("other", "m", "Text", "if x"), ("empty", "m", "Go", "")], "path string, module string, lang string, text string")


def test_file_scores_are_those_of_the_column_expressions(spark):
    lang, lines = F.col("lang"), F.col("lines")
    longs = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    scored = F.transform("scored", lambda s: F.struct(F.when(lang.isin(list(cx.KEYWORD_POINTS)), cx.function_cyclomatic(cx.within(lines, s), lang)).alias("cyclomatic"), cx.function_cognitive(cx.within(lines, s), lang).alias("cognitive")))
    df = files(spark)
    rows = cx.source_facts(df).withColumn("scores", scored)
    points = F.filter(F.col("scores.cyclomatic"), lambda x: x.isNotNull())
    whole = F.when(F.col("function_count") > 0, cx.estimate_cyclomatic(lang, F.col("text"))).otherwise(0)
    expected = rows.select(
        "path", "lang", "function_count", "max_function_length", F.when(F.size(points) > 0, longs(points)).otherwise(whole), F.when(F.size(points) > 0, F.array_max(points)).otherwise(whole),
        F.when(F.size("scores") > 0, longs(F.col("scores.cognitive"))), cx.nesting(lines, lang),
    )
    got = cx.file_complexity(df).drop("module", "risk")
    assert got.columns == ["path", "lang", "function_count", "max_function_length", "cyclomatic", "max_function_cyclomatic", "cognitive", "max_nesting"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_tokens_are_those_of_one_pattern_over_the_text(spark):
    df = files(spark).where("text is not null").withColumn("lang", F.lower("lang")).where(F.col("lang").isin(list(cx.OPERATORS)))
    kept = F.filter(F.transform(cx.lines_of("text"), cx.trim), lambda x: (x != "") & ~(x.startswith("//") | x.startswith("#") | x.startswith("/*") | x.startswith("*")))
    quoted = r'"(?:\\[^\n]|[^"\\\n])*(?:"|\\?$)|' + r"'(?:\\[^\n]|[^'\\\n])*(?:'|\\?$)"

    def pattern(name):
        return F.lit(rf"(?md)({quoted}|[\p{{IsAlphabetic}}\p{{N}}_]+|{cx.escaped(sorted((w for w in cx.OPERATORS[name] if not w[0].isalpha()), key=lambda w: (-len(w), w)))})")

    found = cx.by_lang(F.col("lang"), {k: F.regexp_extract_all(F.array_join(kept, "\n"), pattern(k), F.lit(1)) for k in cx.OPERATORS}, F.array().cast("array<string>"))
    op = cx.by_lang(F.col("lang"), {k: F.col("token").isin(words) for k, words in cx.OPERATORS.items()}, F.lit(False))
    tokens = df.select("lang", F.explode_outer(found).alias("token")).where("token is not null").select(op.alias("op"), F.when(F.substring("token", 1, 1).isin('"', "'"), "<string>").otherwise(F.col("token")).alias("token"))
    assert sorted(map(tuple, cx.halstead_tokens(files(spark)).collect())) == sorted(map(tuple, tokens.groupBy("op", "token").count().collect()))
