"""Personal data by weak supervision (DataFrame functions only).

Base spans come from four patterns with checks (addresses of mail and network,
card and phone numbers). Further candidates, tokens that mix digits with other
characters, get votes from labelers of three sorts: regex (shapes of keys,
identity and account numbers), gazetteer (words that announce a secret) and
context (assignment, quotes, surrounding path or address). Expectation
maximisation over the counts of vote patterns, at most 3^L rows, estimates each
labeler's reliability; its posteriors train the final span classifier, naive
Bayes over span features, whose tables are aggregated before they leave the
executors. Candidates that it accepts are added as spans of kind 'secret'.

Positions are code points, the end exclusive. Patterns are possessive and
guarded by a look-behind, so they run in linear time and without recursion over
very long texts, with the matches that the plain patterns give.

Candidates of the second sort are the quoted values that follow a word of the
gazetteer and an assignment, whatever their characters.

Defined cases: a null text counts as empty and has no spans; repeated rows are
judged each; without candidates, or in an empty table, nothing is added; a text
of any length is searched whole, its spans in one array. Input columns pass
through; base_spans and all_spans are replaced, and columns named _text, _c or
_m must be kept aside by the caller.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_TOKEN = r"[A-Za-z0-9._%+-]"
#: The contract's patterns; \G lets a match begin where the last one ended inside a run.
PATTERN = {
    "email": rf"(?:(?<!{_TOKEN})|\G){_TOKEN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold a match, so the pattern isn't run.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"
AROUND = 32
SPAN = "struct<start:int,end:int,kind:string,value:string>"
_STEP = 64

#: Words that announce a secret.
GAZETTEER = ("token", "secret", "password", "passwd", "pwd", "passphrase", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "ssn", "iban", "passport")


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches as an array of spans, in order.

    The gaps between matches and the matches give the positions as running
    lengths; the running is done in blocks, so that the copying of arrays stays
    small for texts with very many matches.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(values, F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("v"), F.char_length(g).alias("g"), F.char_length(v).alias("n")))
    parts = F.filter(parts, lambda p: p["v"].isNotNull())
    none = F.array().cast(f"array<{SPAN}>")

    def one(acc, p):
        start = acc["at"] + p["g"]
        return F.struct((start + p["n"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + p["n"]).alias("end"), F.lit(kind).alias("kind"), p["v"].alias("value"))).alias("out"))

    def run(ps):
        blocks = F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / _STEP).cast("int"))

        def block(acc, b):
            got = F.aggregate(F.slice(ps, b * _STEP + 1, F.lit(_STEP)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return F.struct(got["at"].alias("at"), F.concat(acc["out"], got["out"]).alias("out"))

        return F.when(F.size(ps) > 0, F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda a: a["out"])).otherwise(none)

    # a let-binding, so that the patterns run once
    return F.element_at(F.transform(F.array(parts), run), 1)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    back = F.reverse(_digits(v))
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, digit(i)).when(digit(i) < 5, digit(i) * 2).otherwise(digit(i) * 2 - 9)
    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LENGTH = {"card": (12, 19), "phone": (9, 15)}


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    n = F.length(_digits(v))
    fits = n.between(*_LENGTH[kind])
    return F.when(fits, luhn(v)).otherwise(False) if kind == "card" else fits


def base_spans(text: Column, kind: str) -> Column:
    found = matches(text, kind, PATTERN[kind])
    if kind != "email":
        found = F.filter(found, lambda s: _valid(kind, s["value"]))
    may = text.contains(GATE[kind]) if kind == "email" else text.rlike(GATE[kind])
    return F.when(may, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _candidates(text: Column) -> Column:
    """Spans with what stands before and after them: tokens, then assigned values that overlap none of them."""
    none = F.array().cast(f"array<{SPAN}>")
    tokens = F.filter(matches(text, "secret", CANDIDATE), lambda s: s["value"].rlike("[A-Za-z]") | s["value"].rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
    tokens = F.when(text.rlike("[0-9]"), tokens).otherwise(none)
    value = lambda s: F.regexp_extract(s["value"], ASSIGNED, 1)
    assigned = F.transform(matches(text, "secret", ASSIGNED), lambda s: F.struct((s["end"] - F.char_length(value(s))).alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), value(s).alias("value")))
    assigned = F.when(text.rlike(ASSIGNED), assigned).otherwise(none)
    found = F.concat(tokens, F.filter(assigned, lambda a: ~F.exists(tokens, lambda t: (t["start"] < a["end"]) & (a["start"] < t["end"]))))
    return F.transform(
        found,
        lambda s: s.withField("before", F.substring(text, F.greatest(s["start"] - AROUND, F.lit(0)) + 1, F.least(s["start"], F.lit(AROUND)))).withField("after", F.substring(text, s["end"] + 1, F.lit(1))),
    )


ASSIGNED = r"(?i)(?<![A-Za-z])(?:" + "|".join(GAZETTEER) + r")[\"']?[\x20\t]{0,2}[:=][\x20\t]{0,2}[\"'`]([^\s\"'`]{4,}+)"
_KEYWORD = r"(?i)(?<![A-Za-z])(?:" + "|".join(GAZETTEER) + r")\b[^\n]{0,16}$"
_OPENED = r"[\"'`]$"


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def votes(c: Column) -> dict[str, Column]:
    """1: personal, -1: not, 0: no opinion."""
    v, before, after = c["value"], c["before"], c["after"]
    n = F.length(v)
    digits = F.length(_digits(v))
    return {
        "regex_hex": _vote(v.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), n < 12),
        "regex_mixed": _vote((n >= 20) & v.rlike("[A-Za-z]") & (digits >= 4) & (n - digits >= 4), v.rlike(r"^[A-Za-z]+[-_]?[0-9]+$")),
        "regex_number": _vote(v.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$")),
        "gazetteer": _vote(before.rlike(_KEYWORD), ~before.rlike(r"[=:]\s*[\"'`]?$")),
        "context_assigned": _vote(before.rlike(r"[=:]\s*[\"'`]?$"), before.rlike(r"[./@&?#]$")),
        "context_quoted": _vote(before.rlike(_OPENED) & after.rlike(_OPENED), after.rlike(r"[./@%]")),
    }


def span_features(c: Column) -> dict[str, Column]:
    """Few values each, so the classifier's tables are small whatever the input."""
    v, before, after = c["value"], c["before"], c["after"]
    n = F.length(v)
    return {
        "length": F.least(F.floor(F.log2(n.cast("double"))), F.lit(8)).cast("int"),
        "digits": F.floor(F.length(_digits(v)) * 4 / n).cast("int"),
        "shape": F.when(v.rlike("^[0-9a-f]+$"), 0).when(v.rlike("^[0-9A-F]+$"), 1).when(v.rlike("^[0-9-]+$"), 2).when(v.rlike("^[A-Z0-9]+$"), 3).when(v.rlike("^[a-z0-9]+$"), 4).when(v.rlike("^[A-Za-z0-9]+$"), 5).otherwise(6),
        "left": F.when(before.rlike(_OPENED), 0).when(before.rlike(r"[=:]\s*$"), 1).when(before.rlike(r"\s$"), 2).when(before == "", 3).otherwise(4),
        "right": F.when(after.rlike(_OPENED), 0).when(after.rlike(r"\s"), 1).when(after == "", 2).otherwise(3),
        "announced": before.rlike(_KEYWORD).cast("int"),
    }


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers, and log-odds of the classifier by feature and value."""

    reliability: dict[str, dict[int, tuple[float, float]]]
    prior: float
    odds: dict[str, dict[int, float]]
    #: For a value that training never saw: never in favour.
    unseen: float = 0.0

    def logit(self, c: Column) -> Column:
        total = F.lit(self.prior)
        for name, value in span_features(c).items():
            table = self.odds.get(name, {})
            cell = F.lit(self.unseen)
            for k, x in sorted(table.items()):
                cell = F.when(value == k, F.lit(x)).otherwise(cell)
            total = total + cell
        return total


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 30):
    """EM for a two-class model with independent labelers, over counts of vote patterns.

    A labeler starts out, and is held by some pseudo-counts, as right more often than wrong.
    """
    held = 4.0
    start = {1: (0.6, 0.1), 0: (0.3, 0.3), -1: (0.1, 0.6)}
    table, share = {n: dict(start) for n in names}, 0.5
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for p, _n in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for n, v in zip(names, p, strict=True):
                yes, no = yes + math.log(table[n][v][0]), no + math.log(table[n][v][1])
            post.append(1 / (1 + math.exp(min(max(no - yes, -50), 50))))
        y = sum(q * k for q, (_, k) in zip(post, patterns, strict=True))
        all_ = sum(k for _, k in patterns)
        share = (y + 1) / (all_ + 2)
        for i, n in enumerate(names):
            for v in (1, 0, -1):
                a = sum(q * k for q, (p, k) in zip(post, patterns, strict=True) if p[i] == v)
                b = sum((1 - q) * k for q, (p, k) in zip(post, patterns, strict=True) if p[i] == v)
                table[n][v] = ((a + held * start[v][0]) / (y + held), (b + held * start[v][1]) / (all_ - y + held))
    return table, post


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Counts of vote patterns and feature values over all documents; what reaches the driver has a fixed bound."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    c = docs.select(text.alias("t")).where(F.col("t").rlike("[0-9]") | F.col("t").rlike(ASSIGNED)).select(F.explode(_candidates(F.col("t"))).alias("c"))
    named, features = votes(F.col("c")), span_features(F.col("c"))
    names = list(named)
    by = c.select(F.struct(*(named[n].alias(n) for n in names)).alias("p"), F.struct(*(x.alias(n) for n, x in features.items())).alias("f"))
    # one aggregation over both: at most 3^6 patterns with the cells of features that occur with them
    cells = by.select("p", F.explode(F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("value")), *(F.struct(F.lit(n).alias("name"), F.col(f"f.{n}").alias("value")) for n in features))).alias("cell"))
    rows = cells.groupBy("p", "cell.name", "cell.value").count().collect()
    patterns = sorted((tuple(r.p), r["count"]) for r in rows if r.name == "")
    if not patterns:
        return SpanModel({}, -20.0, {})
    table, post = estimate(patterns, names)
    soft = {p: q for (p, _), q in zip(patterns, post, strict=True)}
    yes = sum(soft[p] * n for p, n in patterns)
    no = sum((1 - soft[p]) * n for p, n in patterns)
    odds: dict[str, dict[int, float]] = {}
    for name in features:
        a: dict[int, list[float]] = {}
        for r in rows:
            if r.name == name:
                cell = a.setdefault(r.value, [0.0, 0.0])
                cell[0] += soft[tuple(r.p)] * r["count"]
                cell[1] += (1 - soft[tuple(r.p)]) * r["count"]
        odds[name] = {k: math.log((x + 0.5) / (yes + 0.5 * len(a))) - math.log((y + 0.5) / (no + 0.5 * len(a))) for k, (x, y) in a.items()}
    return SpanModel(table, math.log((yes + 0.5) / (no + 0.5)), odds, min(0.0, math.log((no + 0.5) / (yes + 0.5))))


def find_spans(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with base_spans and all_spans, arrays of (start, end, kind, value) by start, then kind as listed."""
    rank = F.array(*(F.lit(k) for k in KINDS))
    order = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s.alias("s")))), lambda x: x["s"])
    docs = docs.drop("base_spans", "all_spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_text", text)
    out = out.withColumn("base_spans", order(F.concat(*(base_spans(F.col("_text"), k) for k in BASE)))).withColumn("_c", _candidates(F.col("_text")))
    good = F.filter("_c", lambda c: (model.logit(c) >= 0) & ~F.exists("base_spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    more = F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value")))
    return out.withColumn("all_spans", F.when(F.size("_c") == 0, F.col("base_spans")).otherwise(order(F.concat("base_spans", more)))).drop("_text", "_c")


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one. A null text stays null."""
    found = find_spans(docs, model, text_col)
    piece = "array<struct<start:int,end:int,kind:string>>"

    def merge(acc, s):
        last = F.element_at(acc, -1)
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        return F.when(F.size(acc) == 0, F.array(one)).when(s["start"] < last["end"], joined).otherwise(F.array_append(acc, one))

    merged = F.aggregate("all_spans", F.array().cast(piece), merge)
    found = found.withColumn("_m", merged)
    text = F.col(text_col)
    before = lambda m, i: F.when(i == 0, 0).otherwise(F.element_at(F.col("_m"), F.when(i == 0, 1).otherwise(i))["end"])
    parts = F.transform("_m", lambda m, i: F.concat(F.substring(text, before(m, i) + 1, m["start"] - before(m, i)), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    tail = F.substring(text, F.element_at("_m", -1)["end"] + 1, F.char_length(text))
    return found.withColumn(text_col, F.when(F.size("_m") == 0, text).otherwise(F.concat(F.array_join(parts, ""), tail))).select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs, train(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(shown(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), shown(F.col("all_spans")).alias("spans"))
