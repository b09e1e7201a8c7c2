"""Main text of web pages with a site style tree.

Pages of a host are merged into one tree: an element's place is its path of
tags, with class and id. At each place, pages choose a presentation (the
sequence of child elements) and leaves hold contents. The entropy of these
choices over the host's distinct pages says how important a place is: what is
alike on all pages of a host is noise. A branch is removed from each page if
its combined importance, presentation and content, is low and no content in it
is important by itself; so are branches that their tag, role, class or id names
as navigation, head, foot, aside, notice, advert, form or reader comments. On
hosts without a tree (too few pages), article or else main elements are read
alone if they hold at least half of the text that is left.

Counts per host, place and choice are aggregated before they move, so a host
with a third of all pages is no hot task; pages get the removed places of their
host through a join.

Defined cases: a null or empty html, or one without text, gives the empty
string; unclosed and stray tags are closed as far as their parents end; a null
URL belongs to a host without a name; hosts with fewer than MIN_PAGES distinct
pages remove nothing by importance; repeated pages count once in the tree and
each have their row; a place where contents are equally frequent is as important
as its entropy says, whatever their order; a page of any length or depth is held
whole by its task, places deeper than 24 levels counting as their ancestor's; a
form around a title or a story is no form; an empty table gives no rows. Input
columns other than page_id, url and html are left out, so none can clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .words import parts

MIN_PAGES = 5
LEAST_IMPORTANCE = 0.2
#: The weight of an element's own presentation against what is below it.
OWN = 0.1

#: Elements without an end tag, inline ones, and those whose text is never shown or never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template svg math canvas object iframe noembed noframes audio video map nav header footer aside form button select textarea menu dialog input option datalist".split())
#: Words of a class, id or role that mark what is no article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus consent cookie cookies dialog discussion footer "
    "gdpr header infobar masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup popover promo promoted promotion recommended related replies reply "
    "respond share sharing sidebar sidenav skip social sponsor sponsored subscribe subscription tags toolbar toc topbar warning widget widgets alert complementary contentinfo search signup login overlay".split()
)
#: What follows a word of NOISE in the name of a box; other words after it make another name, as in tags-explained.
BOXES = frozenset("area bar block body bottom box button buttons card col column container content cookie first form group header head heading holder icon inner item items last left link links list menu message nav outer panel region right row section slot text title toggle top unit widget widgets wrap wrapper zone".split())
#: With these, a name tells of the page around: no-sidebar, has-comments.
ABSENT = frozenset("no non has with without".split())
#: A start tag of the first kind ends an open element of the second.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}}

_TAG = re.compile(r"<!--(?:.*?--!?>|>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Za-z]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _is_noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NEVER:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    for token in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))]
        if not words or ABSENT & set(words):
            continue
        if tag in ("article", "main"):  # names of the whole story may tell of its comments or tags; only a plain one says what it is
            if len(words) == 1 and words[0] in NOISE:
                return True
        elif words[-1] in NOISE or (words[0] in NOISE and BOXES.issuperset(words[1:])):
            return True
    return False


class Node:
    __slots__ = ("tag", "place", "noise", "parts", "children")

    def __init__(self, tag: str, place: str, noise: bool):
        self.tag, self.place, self.noise = tag, place, noise
        self.parts: list = []  # text and child nodes, in order
        self.children: list[str] = []


def parse(page: str) -> Node:
    """A tolerant tree of the page. Depth is bounded only by the page: nothing here recurses."""
    root = Node("", "", False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray end of an inline element ends no block
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        for k in range(len(stack) - 1, 0, -1) if tag in SIBLINGS else ():
            if stack[k].tag in BOUNDS[tag]:
                break
            if stack[k].tag in SIBLINGS[tag]:
                del stack[k:]
                break
        a = _attributes(m[3])
        name = tag + "".join(f"{s}{' '.join(sorted(a[k].split()))}" for k, s in (("class", "."), ("id", "#")) if a.get(k))
        up = stack[-1]
        noise = _is_noise(tag, a)
        if tag == "header" and noise and any(x.tag in ("article", "main") for x in stack):
            noise = _is_noise("div", a)  # the head of a story holds its title
        if tag in ("article", "main", "h1"):
            for x in stack:
                if x.tag == "form":  # it wraps a page, and asks for nothing
                    x.noise = False
        node = Node(tag, f"{up.place}>{re.sub('[0-9]+', '0', name)}" if len(stack) <= 24 else up.place, noise)
        up.parts.append(node)
        up.children.append(name if tag not in INLINE else "")
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in ("p", "div", "span", "a"):
            if tag not in VOID:
                stack.append(node)
    return root


def walk(root: Node):
    """(node, None) as each element starts, (node, text) for its texts, (None, node) as it ends."""
    todo: list = [iter([("open", root)])]
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            continue
        kind, x = step
        if kind == "open":
            yield x, None
            todo.append(iter([*(("open", p) if isinstance(p, Node) else ("text", (x, p)) for p in x.parts), ("close", x)]))
        elif kind == "text":
            yield x
        else:
            yield None, x


def choices(root: Node):
    """(place, kind, choice): p, the sequence of child elements; c, the text of an element, inline parts included."""
    texts: dict[int, list[str]] = {}
    owner: list[Node] = []
    for node, x in walk(root):
        if node is not None and x is None:
            if node.tag not in INLINE or not owner:
                owner.append(node)
                texts[id(node)] = []
        elif node is None:
            if owner and owner[-1] is x:
                owner.pop()
                text = " ".join("".join(texts.pop(id(x))).split())
                if text:
                    yield x.place, "c", text
                if x.children:
                    yield x.place, "p", " ".join(c for c in x.children if c)
        elif owner:
            texts[id(owner[-1])].append(x)


def main_text(root: Node, removed: frozenset[str] | None = None) -> str:
    """Blocks of the page without noise and without branches at removed places; None: the host has no style tree."""
    gone = removed or frozenset()
    blocks, now = [], []
    skip, inside = 0, {"article": 0, "main": 0}

    def end_block():
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            blocks.append((text, {tag for tag, k in inside.items() if k}))
        now.clear()

    for node, x in walk(root):
        if node is not None and x is None:
            if node.tag not in INLINE:
                end_block()
            skip += node.noise or node.place in gone
            if node.tag in inside:
                inside[node.tag] += 1
        elif node is None:
            if x.tag not in INLINE:
                end_block()
            skip -= x.noise or x.place in gone
            if x.tag in inside:
                inside[x.tag] -= 1
        elif not skip:
            now.append(x)
    end_block()
    if removed is None:
        for tag in inside:
            part = [text for text, within in blocks if tag in within]
            if part and 2 * sum(map(len, part)) >= sum(len(text) for text, _ in blocks):
                return " ".join(part)
    return " ".join(text for text, _ in blocks)


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _choice_rows(batches):
    import xxhash

    digest = lambda s: xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)
    for b in parts(batches, 100):
        out: list[tuple] = []
        for h, page in zip(b.column("host"), b.column("html"), strict=True):
            h, page = h.as_py(), page.as_py()
            if page:
                of = digest(page)
                found = {(place, kind, digest(c)) for place, kind, c in choices(parse(page))}
                times = Counter(x[:2] for x in found)
                out += [(h, *x, of, 1 / times[x[:2]]) for x in found]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["host", "place", "kind", "choice", "page", "share"])


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, place, pages, importance: 0 if all pages of the host agree there, towards 1 if all differ; peak, that of the most important content in the branch.

    A place's importance is that of its own presentation, with weight OWN, and
    of the contents at it and below, weighted by how often they occur. A page
    may make many choices at one place, as in a list of links; so a choice is
    measured by the pages that share it against the pages that have the place,
    which for one choice a page is the entropy.
    """
    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_choice_rows, "host string, place string, kind string, choice long, page long, share double").distinct()
    per = rows.groupBy("host", "place", "kind", "choice").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    alike = F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")
    per = per.groupBy("host", "place", "kind").agg(F.sum("n").alias("m"), F.round(F.sum("share")).alias("pages"), alike.alias("alike")).where(F.col("pages") >= min_pages)
    per = per.withColumn("i", F.least(F.greatest(1 - F.col("alike") / F.log("pages"), F.lit(0.0)), F.lit(1.0)))
    steps = F.split(F.substring("place", 2, 1 << 20), ">")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(F.lit(">"), F.array_join(F.slice(steps, F.lit(1), k), ">")))
    below = per.where("kind = 'c' and place <> ''").select("host", F.explode(above).alias("place"), "m", "pages", "i").groupBy("host", "place").agg(F.max("pages").cast("long").alias("pages"), (F.sum(F.col("i") * F.col("m")) / F.sum("m")).alias("content"), F.max("i").alias("peak"))
    own = per.where("kind = 'p'").select("host", "place", F.col("i").alias("own"))
    return below.join(own, ["host", "place"], "left").select("host", "place", "pages", F.coalesce(OWN * F.col("own") + (1 - OWN) * F.col("content"), F.col("content")).alias("importance"), "peak")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # the page as a whole is never noise, however alike a host's pages are
    low = (F.col("importance") < least) & (F.col("peak") < least) & ~F.col("place").rlike(r"^(>html[^>]*)?(>body[^>]*)?$")
    removed, _ = stored(style_tree(pages, min_pages).groupBy("host").agg(F.collect_set(F.when(low, F.col("place"))).alias("removed")), "style-tree")
    d = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(removed, "host", "left").select("page_id", "url", "html", "removed")

    def run(batches):
        for b in parts(batches, 100):
            texts = [main_text(parse(page.as_py()), frozenset(gone.as_py()) if gone.is_valid else None) if page.is_valid else "" for page, gone in zip(b.column("html"), b.column("removed"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return d.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
