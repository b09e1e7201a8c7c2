"""Security patterns of single languages over the lines of files, and the checks that need a file's or a block's context.

Input: files with doc_id, path and text. Lines are cut at line feeds. A null text has one empty line, which nothing hits.
Every pattern that hits a line is a finding, so a line may have several, also equal ones. Repeated files give repeated findings.
A text or line without the words that some pattern needs is passed over before the patterns are tried.
Whatever a check needs of other lines is worked out on the file's own array of lines, so nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import partial, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.security_patterns import BY_LANGUAGE
from talus.functions.text import lines

#: Words of a path that mark test code, lines that are exempt, and words that show checked input.
TEST_PATHS = {
    "javascript": ("test",),
    "rust": ("test",),
    "ruby": ("test", "spec", "mock", "fake", "stub", "fixture"),
    "csharp": ("test", "mock", "fake", "stub", "spec"),
}
EXEMPT = {
    "javascript": ("// nosec", "/* nosec */", "security-exception", "textContent"),
    "java": ("// nosec", "/* nosec */", "@SuppressWarnings", "security-exception"),
    "ruby": ("# nosec", "# rubocop:disable Security", "# noqa"),
    "csharp": ("// nosec", "/* nosec */", "security-exception", "#pragma warning disable SECURITY_WARNINGS"),
}
JAVA_VALID = ("@Valid", "@Validated", "@NotNull", "@Pattern", "@Size")
JAVA_SANITIZED = ("SecurityContext", "Authentication", "PermissionEvaluator", "encode(", "matches(", "HtmlUtils.htmlEscape", "StringEscapeUtils", "sanitize")
JAVA_TEST_CALLS = ("assertEquals", "assertThat", "mock", "when", "verify", "given", "willReturn")
JAVA_NEAR = ("validate", "sanitize", "escape")
JAVA_SURE = ("SQL Injection", "Command Injection", "XML External Entity (XXE)")
RUBY_ACTIONS = ("def create", "def update", "def new")
RUBY_CHECKS = ("validates", "valid?", "presence", "if", "unless", "permit")
CONNECTION = r"""(?is)(?:connectionString|ConnectionString).*?=\s*["'].*?(?:User ID|uid|Password|pwd).*?["']|["'].*?(?:Server|Data Source).*?(?:User ID|uid).*?(?:Password|pwd).*?["']"""


def java_form(pattern: str) -> str:
    """The pattern for Java: bare literal braces escaped, and repeats that backtrack without end made plain.

    (?:(?!x)[^\\)]*){n,} takes the same texts as (?!x)[^\\)]*: n - 1 of its rounds may be empty, all at its start.
    """
    pattern = re.sub(r"\(\?:(\(\?!.*?\))\[\^\\\)\]\*\)\{\d+,\}", lambda m: m[1] + r"[^\)]*", pattern)
    piece = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{\d+(?:,\d*)?\}|[{}]|.", re.S)
    return "".join("\\" + p if p in "{}" else p for p in piece.findall(pattern))


def _needed(parts) -> list[frozenset[str]]:
    """Sets of lower-case words of a parsed pattern: whatever it matches holds one word of each set, in lower case."""
    sets, run = [], ""
    for op, av in [*parts, (None, None)]:
        op = str(op)
        if op == "LITERAL" and av < 128:
            run += chr(av).lower()
            continue
        sets += [frozenset([run])] if run else []
        run = ""
        if op == "SUBPATTERN":
            sets += _needed(av[-1])
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and av[0] > 0:
            sets += _needed(av[-1])
        elif op == "BRANCH":
            each = [max(_needed(x), key=lambda w: min(map(len, w)), default=None) for x in av[1]]
            sets += [] if None in each else [frozenset().union(*each)]
    return sets


def may_hit(text: Column, language: str) -> Column:
    """Whether a text holds, in any case, the words without which none of the language's patterns hits a line of it."""
    tests = set()
    for _, _, p in BY_LANGUAGE[language]:
        sets = {w: None for w in _needed(re._parser.parse(p)) if len(w) <= 24}
        # rare words first: the longest of the shortest
        tests.add(tuple(sorted(sets, key=lambda w: (-min(map(len, w)), len(w), sorted(w)))))
    every = lambda low, sets: reduce(and_, (has(low, sorted(w)) for w in sets), F.lit(True))
    ordered = sorted(tests, key=lambda t: [sorted(w) for w in t])
    # bound in a lambda, the text is put in lower case once and not for each word
    return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, map(partial(every, low), ordered), F.lit(False)))


def has(text: Column, words) -> Column:
    return reduce(or_, (text.contains(w) for w in words), F.lit(False))


def _hits(language: str) -> Column:
    """All findings of a line as an array of (type, severity)."""

    def hit(kind, severity, pattern):
        return F.when(F.col("line").rlike(java_form(pattern)), F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))

    return F.filter(F.array(*(hit(*p) for p in BY_LANGUAGE[language])), lambda x: x.isNotNull())


def _exploded(files: DataFrame, **context: Column) -> DataFrame:
    """A row per line, with the columns of context, which may use _l, the file's lines."""
    table = files.select("doc_id", F.lower(F.coalesce("path", F.lit(""))).alias("path"), lines(F.col("text")).alias("_l"))
    table = table.select("*", *(c.alias(n) for n, c in context.items()))
    return table.select("*", F.posexplode("_l").alias("_i", "line")).withColumn("line_no", F.col("_i") + 1)


def _found(table: DataFrame, language: str) -> DataFrame:
    table = table.where(~has(F.col("line"), EXEMPT.get(language, ())) & (F.col("line") != "") & may_hit(F.col("line"), language))
    return table.select("*", F.explode(_hits(language)).alias("_f")).select("*", "_f.type", "_f.severity")


def _out(table: DataFrame, confidence: Column) -> DataFrame:
    return table.select("doc_id", "line_no", "type", "severity", confidence.alias("confidence"))


def scan(files: DataFrame, language: str) -> DataFrame:
    """doc_id, line_no, type, severity, confidence of every pattern of the language that hits a line."""
    # a look for words is far cheaper than the patterns, and few texts have them
    files = files.where(may_hit(F.col("text"), language))
    if language == "java":
        return _java(files)
    if language == "ruby":
        return _ruby(files)
    table = _found(_exploded(files), language)
    if language == "javascript":
        table = table.where(~(F.col("line").contains("innerHTML") & F.col("line").contains("DOMPurify.sanitize")))
    return _out(table, F.when(has(F.col("path"), TEST_PATHS.get(language, ())), "low").otherwise("medium"))


def _ruby(files: DataFrame) -> DataFrame:
    controller = F.exists("_l", lambda x: F.ltrim(x).startswith("class") & x.contains("Controller"))
    table = _found(_exploded(files, controller=controller), "ruby")
    line, kind = F.col("line"), F.col("type")
    table = table.where(~((kind == "SQL Injection") & line.contains(".where(") & line.contains(":")) & ~((kind == "Mass Assignment") & line.contains(".permit")))
    sure = F.col("controller") & (kind == "Mass Assignment")
    return _out(table, F.when(sure, "high").when(has(F.col("path"), TEST_PATHS["ruby"]), "low").otherwise("medium"))


def _java(files: DataFrame) -> DataFrame:
    near = F.transform("_l", lambda x: has(F.lower(x), JAVA_NEAR) | has(x, ("StringUtils", "prepareStatement")))
    table = _exploded(
        files,
        test_class=F.exists("_l", lambda x: x.contains("class") & has(x, ("Test", "MockMvc"))),
        test_method=F.exists("_l", lambda x: has(x, ("@Test", "public void test"))),
        valid=F.exists("_l", lambda x: has(x, JAVA_VALID)),
        sanitized=F.exists("_l", lambda x: has(x, JAVA_SANITIZED)),
        near=near,
    )
    line, i = F.col("line"), F.col("_i")
    exempt = (line.contains("expected") & line.contains("Exception")) | (line.contains("createQuery") & has(line, ("em.", "entityManager.", "session.")))
    bound = line.contains("prepareStatement") & line.contains("?") & F.array_join(F.slice("_l", i + 1, 5), "").contains(".set")
    test_call = (F.col("test_class") | F.col("test_method")) & has(line, JAVA_TEST_CALLS)
    table = _found(table.where(~exempt & ~(line.contains(".findBy") & F.col("valid")) & ~bound & ~test_call), "java")
    test_file = F.col("test_class") | has(F.col("path"), ("test", "mock"))
    table = table.where(~((F.col("type") == "Hardcoded Secret") & test_file))
    first = F.greatest(i - 3, F.lit(0))
    by_near = F.exists(F.slice("near", first + 1, i + 4 - first), lambda x: x)
    sure = F.col("type").isin(*JAVA_SURE) & ~F.col("sanitized")
    confidence = F.when(by_near | F.col("test_class") | F.col("path").contains("test"), "low").when(sure, "high").otherwise("medium")
    got = table.withColumn("confidence", confidence)
    doubt = (F.col("confidence") == "low") & (F.col("test_method") | has(F.col("line"), ("mock", "test", "assert", "example")))
    return _out(got.where(~doubt), F.col("confidence"))


def rails_unvalidated(files: DataFrame) -> DataFrame:
    """Actions (create, update, new) of a Rails controller without a word of validation: doc_id, line_no, confidence."""
    table = files.select("doc_id", F.lower(F.coalesce("path", F.lit(""))).alias("path"), lines(F.col("text")).alias("_l"))
    table = table.where(F.exists("_l", lambda x: F.ltrim(x).startswith("class") & x.contains("Controller")))
    starts = F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(r"^\s*def\s+\w+"), i)), lambda x: x.isNotNull())
    table = table.withColumn("_s", starts).select("*", F.posexplode("_s").alias("_k", "_i"))
    until = F.coalesce(F.get("_s", F.col("_k") + 1), F.size("_l"))
    table = table.withColumn("_m", F.array_join(F.slice("_l", F.col("_i") + 1, until - F.col("_i")), "\n"))
    table = table.where(has(F.col("_m"), RUBY_ACTIONS) & ~has(F.col("_m"), RUBY_CHECKS))
    return table.select("doc_id", (F.col("_i") + 1).alias("line_no"), F.when(has(F.col("path"), TEST_PATHS["ruby"]), "low").otherwise("medium").alias("confidence"))


def connection_strings(files: DataFrame) -> DataFrame:
    """Connection strings with a login, also over several lines: doc_id and the line_no where each begins.

    What lies before a match is the pieces between the matches and the earlier matches; its line feeds give the line.
    """
    text = F.coalesce("text", F.lit(""))
    table = files.select("doc_id", text.alias("_t")).where(F.col("_t").rlike(CONNECTION))
    feeds = lambda x: F.size(F.split(x, "\n", -1)) - 1
    table = table.select("doc_id", F.split("_t", CONNECTION, -1).alias("_p"), F.regexp_extract_all("_t", F.lit(CONNECTION), F.lit(0)).alias("_m"))
    pairs = F.zip_with(F.slice("_p", F.lit(1), F.size("_m")), "_m", lambda p, m: F.struct(feeds(p).alias("p"), feeds(m).alias("m")))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a.at + x.p + x.m).alias("at"), F.concat(a.out, F.array(a.at + x.p)).alias("out"))
    return table.select("doc_id", F.explode(F.aggregate(pairs, zero, step)["out"]).alias("line_no"))
