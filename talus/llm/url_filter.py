"""URL filtering with redirect equivalence (DataFrame functions only).

Prefix rules over host and path judge each URL; the longest fitting rule wins.
URLs tied together by redirects (meta refresh) or canonical links form
components; a component with a blocked URL blocks those of its URLs that no
rule judges. A URL's own rule, allow above all, always stands.

Defined cases: a null URL, or one without '://', has empty host and path, fits
no rule and is allowed; a null html has no links; of several links in a page
all count, those in comments and scripts don't; repeated URLs share one node,
as do those that differ in the case of scheme and host, in character references
of a link, in . and .. steps, or in the fragment; links to the page itself, to
fragments, scripts or mail addresses are no edges; rules of equal length that
fit the same URL can't differ in name. A html of any length is searched whole.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

_LOW = "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _LOW.upper(), _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def judged(df: DataFrame, rules=RULES) -> DataFrame:
    """df with host and path, plus rule and rule_verdict (null if no rule fits)."""
    out = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # later ones, being longer, win
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, r.name).otherwise(out[0]), F.when(fits, r.verdict).otherwise(out[1])
    return df.withColumns({"rule": out[0], "rule_verdict": out[1]})


def _let(value: Column, make) -> Column:
    """make(value) with the value worked out once, however often make names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _absolute(url: Column, link: Column) -> Column:
    """link as seen from url; both are columns or bound."""
    scheme, host = F.regexp_extract(url, r"^((?s:.*?)://)", 1), F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/(?:[^?#]*/)?)?", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), link))
        .when((link == "") | link.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))
        .when(link.startswith("/"), F.concat(scheme, host, link))
        .otherwise(_let(folder, lambda f: F.concat(scheme, host, F.when(f == "", "/").otherwise(f), link)))
    )


def _unescaped(c: Column) -> Column:
    """c with its character references decoded, numbers and the named ones that URLs hold; & last."""
    for name, sign in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("sol", "/"), ("colon", ":"), ("quest", "?"), ("equals", "="), ("period", "."), ("num", "#")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    # each piece after '&#' starts with a number and a semicolon, or stays as it is
    code = lambda p: F.when(p.rlike("^[xX][0-9a-fA-F]{1,6};"), F.conv(F.regexp_extract(p, "^[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("int")).when(p.rlike("^[0-9]{1,7};"), F.regexp_extract(p, "^([0-9]+)", 1).cast("int"))
    # beyond ASCII a reference stays: the same sign in a page's own URL is written as it is or in percents
    sign = lambda p: _let(code(p), lambda k: F.when(k.between(1, 126), F.concat(F.char(k), F.regexp_replace(p, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), p)))
    c = _let(F.split(c, "&#", -1), lambda x: F.concat(F.element_at(x, 1), F.array_join(F.transform(F.slice(x, 2, F.size(x)), sign), "")))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def _stepped(path: Column) -> Column:
    """A bound path with . and .. steps resolved; one that ends in such a step ends with a slash."""
    fold = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x))
    # the first step is the empty text before the first slash
    folded = lambda s: F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.element_at(s, 1)), fold)
    done = lambda s: F.array_join(F.concat(folded(s), F.when(F.element_at(s, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
    return F.when(path.rlike(r"/\.\.?(/|$)"), _let(F.split(path, "/", -1), done)).otherwise(path)


def node_of(url: Column) -> Column:
    """url as a node: scheme and host in lower case (A-Z), . and .. steps of the path resolved, no fragment."""
    part = lambda b: F.struct(F.regexp_extract(b, r"^((?s:.*?)://[^/?]*)", 1).alias("start"), F.regexp_extract(b, r"^(?s:.*?)://[^/?]*([^?]*)", 1).alias("path"), F.regexp_extract(b, r"^(?s:.*?)://[^?]*((?s:.*))$", 1).alias("query"))
    whole = lambda b: F.when(b.contains("://"), _let(part(b), lambda p: F.concat(F.translate(p["start"], _LOW.upper(), _LOW), _let(p["path"], _stepped), p["query"]))).otherwise(b)
    return _let(F.regexp_replace(url, "#(?s:.*)$", ""), whole)


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of redirects and canonical links, as nodes. Each step is a column of its own, so that none is written into the next one many times."""
    tag = r"(?is)<(?:link|meta)\b(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    hidden = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|noscript)\b.*?(?:</\1\b[^>]*>|\z)"
    bare = lambda c: F.trim(F.regexp_replace(c, "^[\"']|[\"']$", ""))
    value = lambda name: bare(F.regexp_extract("t", rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1))
    some = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = some.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", hidden, " "), F.lit(tag), 0)).alias("t"))
    tags = tags.withColumn("kind", F.when(F.lower(value("rel")).rlike(r"(^|\s)canonical(\s|$)"), "link").when(F.lower(value("http-equiv")) == "refresh", "refresh")).where("kind is not null")
    tags = tags.select("url", F.when(F.col("kind") == "link", value("href")).otherwise(bare(F.regexp_extract(value("content"), r"(?is)url\s*=\s*(.*)$", 1))).alias("to"))
    ends = tags.select("url", _let(_unescaped(F.col("to")), lambda x: _absolute(F.col("url"), x)).alias("dst")).where("dst is not null")
    return ends.select(node_of(F.col("url")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src <> dst").distinct()


def filter_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) with host, path, rule and verdict; edges (src, dst): more redirects, by full URL.

    Only URLs with an edge are shuffled to find components; the verdicts of
    blocked aliases come back through a join on the URL.
    """
    found = link_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    found, path = stored(found, "url-edges")
    out = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = judged(out, rules)
    if found.isEmpty():  # no alias: the rules alone decide
        discard(path)
        return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    node, component_path = components(found, "url-cc", native=True)
    every = node.unionByName(node.select(F.col("component").alias("node"), "component")).distinct()
    by = judged(every.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    bad = by.where("rule_verdict = 'block'").select("component").distinct()
    blocked, _ = stored(every.join(bad, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_alias_blocked")), "url-blocked")
    discard(path, component_path)
    out = out.withColumn("_node", node_of(F.col("url"))).join(blocked, "_node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("_alias_blocked"), "block"), F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
