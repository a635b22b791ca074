"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is the chain of block
elements (tag and class) from the root.  Three things are measured for each node
over the m pages of the host that have it:

* content: each distinct text of the node that stands on k pages has entropy
  log_m k; the node's content importance is 1 minus their mean, so text that
  differs from page to page counts and text repeated all over the site does not;
* presentation: the entropy (base m) of the node's presentations, which are the
  sequences of its child elements (runs by their magnitude) and the magnitudes of its
  texts' lengths; it is high where pages differ in shape;
* the composite importance: (1 - GAMMA^l) * presentation + GAMMA^l * the mean of the
  node's content and its children's composite importance, where l is the number of
  its presentations.  Menus, adverts and footers have few presentations and fall by
  that, although their words differ from page to page; an article's paragraphs differ.

All are measured over pages of distinct main text, so that copied pages do not
count as repetition.  What lies in a node or a branch (a node with all below it) whose
content importance is under THRESHOLD is removed, inside the article too.  Outside it,
the topmost branch goes of which no node reaches SHAPED in composite importance;
below a node that reaches it, shape removes nothing, nor does it remove headings, nor
anything on a site where no node reaches it, nor all that a page has.  html, body,
article and main are no branches.  Then the article is taken if there is one (else
the body), without elements that say what they are: nav, aside, form, footer, or a
class such as "ad", "sidebar-box", "adSlot".  Such a name counts as a whole
("has-sidebar" and "share-price" are none), never on html, body, article and main or
around the page's only article, and as an id not on headings, sections and
paragraphs, where ids are anchors.  Reader comments are known by any name of theirs in a
class or id ("user-comments", "disqus_thread"; not "no-comments"), on articles and
sections too, by their item type, and as articles inside an article that has text
besides them.

Null and empty pages give an empty text.  Pages without a host form one site.
Hosts with fewer than LEAST_PAGES pages have no usable entropy and rely on the
elements' own names.  Elements more than DEEPEST levels down share a node.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

THRESHOLD = 0.35
LEAST_PAGES = 5
#: Of the composite importance: the share that is left to content at each presentation, and the least of a meaningful node.
GAMMA, SHAPED = 0.3, 0.33
DEEPEST = 48
#: Rows of removed nodes up to which all sites' are sent to each task (16 bytes each); beyond, each page is joined with those of its site.
BROADCAST_ROWS = 200_000
SALTS = 32

# Element names and class words by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
DROPPED = {"head", "nav", "aside", "footer", "form", "button", "select", "dialog", "svg", "canvas", "object", "audio", "video"}
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation navi menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchbox form comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations pagination pager toolbar skip copyright disclaimer hidden".split()
)
#: Words that may stand beside those in a name without changing its role ("promo-box", but not "share-price").
FRAME_WORDS = set("area bar block bottom box button buttons center container footer group header holder inner item items left link links list outer panel right row section slot top unit wrap wrapper".split())
#: Words that make any class or id one of reader comments, unless one of NEGATED stands beside them.
COMMENT_WORDS = set("comment comments commentlist commenters disqus replies respond".split())
NEGATED = set("no not non has have with without hide allow count counter number link links icon form toggle enabled disabled open closed off on js".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that class words never remove, and those whose ids are anchors.
WHOLE = {"html", "body", "article", "main"}
ANCHORED = HEADINGS | {"section", "p", "span", "a"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "html", "nav", "aside", "footer", "header", "form", "td", "th"}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>|<[!?][^>]*>", re.DOTALL)
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.DOTALL)
#: Tags whose quotes are never closed, after which quotes no longer hide the ends of tags.
UNCLOSED = 16
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    __slots__ = ("tag", "dropped", "around", "named", "article", "path", "children", "head", "depth", "nested")

    def __init__(self, tag: str, dropped: bool, around: bool, named: bool, article: bool, path: str, head: bool, depth: int, nested: int):
        self.tag, self.dropped, self.article, self.path, self.head = tag, dropped, article, path, head
        self.around, self.named = around, named  # named as boilerplate outside the article; inside it or without one
        self.depth, self.nested = depth, nested  # steps of the path; articles around, itself included
        self.children: list[str] = []


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(name)}


def boilerplate_name(name: str) -> bool:
    """Whether a whole class or id says boilerplate: all its words do, or frame them."""
    words = name_words(name)
    return bool(words & DROPPED_WORDS) and words <= DROPPED_WORDS | FRAME_WORDS | {w for w in words if w.isdigit()}


def comment_name(name: str) -> bool:
    """Whether a class or id is one of reader comments, whatever else it says."""
    words = name_words(name)
    return bool(words & COMMENT_WORDS) and not words & NEGATED


def magnitude(n: int) -> int:
    return (n + 1).bit_length() - 1


def presentation(children: list[str]) -> str:
    """A sequence of child elements, runs of one kind by the magnitude of their length."""
    out, at = [], 0
    while at < len(children):
        end = at
        while end < len(children) and children[end] == children[at]:
            end += 1
        out.append(f"{children[at]}*{magnitude(end - at)}")
        at = end
    return "|".join(out)


def blocks(page: str | None) -> Iterator[tuple[str, str, bool, bool, str]]:
    """(path, text, in article, named as boilerplate, shape) of each block in page order;
    shape is that of the block's element, filled for its first block only."""
    yield from outline(page)[0]


def outline(page: str | None) -> tuple[list[tuple[str, str, bool, bool, str]], set[tuple[str, str]]]:
    """The blocks of a page, and (path, presentation) of its elements with children."""
    page = page or ""
    stack = [Element("", False, False, False, False, "", False, 0, 0)]
    parts: list[str] = []
    out = []
    done: list[Element] = []
    open_: Counter[str] = Counter()  # elements on the stack by tag: no search for what is not there

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            top = stack[-1]
            out.append((top, text))

    def pop(n: int) -> None:
        while len(stack) > n:
            last = stack.pop()
            open_[last.tag] -= 1
            done.append(last)

    at = 0
    tags = Tags(page)
    while m := tags.after(at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "br" or tag == "p" and not open_["p"]:
                parts.append(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if open_[tag] else 0
            if depth:
                if tag in BLOCK or any(e.tag in BLOCK for e in stack[depth:]):
                    if tag not in BLOCK:
                        continue  # an inline end tag does not close blocks
                    flush()
                pop(depth)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1) if open_["p"] else ():
                if stack[i].tag == "p":
                    pop(i)
                if i >= len(stack) or stack[i].tag in SCOPE:
                    break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES.get(tag, ()):
                    pop(i)
                elif stack[i].tag in SCOPE:
                    break
        up = stack[-1]
        host = next((e for e in reversed(stack) if e.tag in BLOCK), stack[0]) if tag in BLOCK and up.tag not in BLOCK else up
        attrs = {a.lower(): (x or y or z) for a, x, y, z in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
        label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        own = () if tag in WHOLE else attrs.get("class", "").split() if tag in ANCHORED else label.split()
        talk = tag not in ("html", "body", "main") and any(map(comment_name, own if tag in ANCHORED and tag != "section" else label.split()))
        talk = talk or attrs.get("itemprop", "").lower() == "comment" or attrs.get("itemtype", "").lower().endswith("/comment") or attrs.get("role", "").lower() == "comment"
        named = any(map(boilerplate_name, own))
        is_article = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        dropped = (
            up.dropped
            or talk
            or tag in DROPPED
            or tag in ("header", "menu") and not up.article
            or attrs.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
            or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        )
        if tag in BLOCK:
            step = f"{tag}.{'.'.join(sorted(label.lower().split()))}" if label.strip() else tag
            host.children.append(step)
            path, depth = (f"{up.path}>{step}", up.depth + 1) if up.depth < DEEPEST else (up.path, up.depth)
        else:
            path, depth = up.path, up.depth
        if is_article and not up.article:
            around, named = up.named, False
        else:
            around, named = up.around, up.named or named
        open_[tag] += 1
        stack.append(Element(tag, dropped, around, named, (up.article or is_article) and not dropped, path, up.head or tag == "header", depth, up.nested + (tag == "article")))
    parts.append(page[at:])
    flush()
    done += stack
    shapes = {(e.path, presentation(e.children)) for e in done if e.children}
    # articles in an article with text of its own are what readers say to it
    plain = any(e.article and not e.dropped and e.nested == 1 and e.tag not in HEADINGS for e, _ in out)
    # an article in an element of such a name counts only if the page has no other one
    other = any(e.article and not e.dropped and not e.around and not e.named for e, _ in out)
    shown: set[int] = set()
    found = []
    for e, text in out:
        shape = "" if id(e) in shown else presentation(e.children)
        shown.add(id(e))
        lost = e.dropped or e.named or e.around and other or e.nested > 1 and plain or e.article and e.head and not re.search(r">h[1-6](\.|$)", e.path.rpartition(">")[0] + ">" + e.path.rpartition(">")[2])
        found.append((e.path, text, e.article, lost, shape))
    return found, shapes


class Tags:
    """Tags and comments of a page from left to right.  A page of many unclosed quotes
    is read in time that grows with its length all the same."""

    def __init__(self, page: str):
        self.page, self.last, self.failed = page, page.rfind(">"), 0

    def after(self, at: int) -> re.Match | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if at < self.last or page.startswith("<!--", at):
                m = (_TAG if self.failed < UNCLOSED else _PLAIN_TAG).match(page, at)
                if m:
                    return m
                self.failed += page[at + 1 : at + 2].isalpha()
            at += 1
        return None


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _short(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _above(path: str) -> list[str]:
    """The branches that a block of this path lies in, as node names."""
    steps = path.split(">")
    return [">".join(steps[: i + 1]) + ">*" for i in range(1, len(steps)) if steps[i].partition(".")[0] not in WHOLE]


def _main(found: list[tuple[str, str, bool, bool, str]]) -> list[str]:
    """The texts of the blocks that are in the article if there is one, and not lost."""
    inside = any(a and not lost for _, _, a, lost, _ in found)
    return [t for _, t, a, lost, _ in found if not lost and (a or not inside)]


#: What a node is, in the value of its row of kind 0.
_WHOLE, _HEADING = 1, 2


def _measured(pages: DataFrame) -> DataFrame:
    """(host, path, above, flags, pages, content, spread, shapes): what is counted of each
    node, by the numbers of its path and of those above it; branches have no `above`.

    Rows are pre-aggregated by Spark on the map side before each of the shuffles."""
    small_batches(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("content", pa.int64()), ("path", pa.int64()), ("kind", pa.int8()), ("value", pa.int64()), ("above", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parsed, shapes = outline(page)
                host, content, found, nodes = host_of(url), _short("\n".join(_main(parsed))), set(), set()
                for path, text, *_ in parsed:
                    p, value = _short(path), _short(text)
                    found.add((host, content, p, 1, value, None))
                    found.add((host, content, p, 2, magnitude(len(text.split())), None))
                    for branch in _above(path):
                        b = _short(branch)
                        found.add((host, content, b, 0, 0, None))
                        found.add((host, content, b, 1, value, None))
                    steps = path.split(">")
                    nodes.update(tuple(steps[: i + 1]) for i in range(1, len(steps)))
                numbers = {n: _short(">".join(n)) for n in nodes}
                for n, p in numbers.items():
                    tag = n[-1].partition(".")[0]
                    flags = _WHOLE * (tag in WHOLE) | _HEADING * (tag in HEADINGS)
                    found.add((host, content, p, 0, flags, tuple(numbers[n[: i + 1]] for i in range(1, len(n) - 1))))
                known = set(numbers.values())
                found |= {(host, content, p, 2, _short(shape), None) for path, shape in shapes if (p := _short(path)) in known}
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    seen = pages.select("url", "html").mapInArrow(run, "host string, content bigint, path bigint, kind tinyint, value bigint, above array<bigint>").distinct()
    counted = seen.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("k"), F.max("above").alias("above"))
    is_ = lambda kind, x: F.when(F.col("kind") == kind, x)
    node = counted.groupBy("host", "path").agg(
        F.max("above").alias("above"),
        F.max(is_(0, F.col("value"))).alias("flags"),
        F.max(is_(0, F.col("k"))).alias("pages"),
        F.avg(is_(1, F.log("k"))).alias("repeated"),
        F.count(is_(2, F.lit(1))).alias("shapes"),
        F.sum(is_(2, F.col("k"))).alias("shown"),
        F.sum(is_(2, F.col("k") * F.log("k"))).alias("shown_log"),
    )
    base = F.log(F.greatest(F.col("pages"), F.lit(2)))
    content = F.when(F.col("repeated").isNotNull(), 1 - F.least(F.lit(1.0), F.col("repeated") / base))
    spread = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log("shown") - F.col("shown_log") / F.col("shown")) / base))
    return node.select("host", "path", "above", "flags", "pages", content.alias("content"), F.coalesce(spread, F.lit(0.0)).alias("spread"), "shapes")


def style_tree(pages: DataFrame, branches: bool = False) -> DataFrame:
    """(host, path, pages, importance) of each node of each site that has text of its
    own, by content, and of the branches if asked for."""
    rows = _measured(pages).where(F.col("content").isNotNull())
    return (rows if branches else rows.where(F.col("above").isNotNull())).select("host", "path", "pages", F.col("content").alias("importance"))


def composite(nodes: DataFrame) -> DataFrame:
    """(host, path, chain, composite) of the nodes of _measured.

    A node's composite importance is a sum over its subtree: each node below gives its own
    part times the factors of those between.  So it takes no rounds: nodes explode to
    those above, at most DEEPEST, and meet their factors there."""
    nodes = nodes.where(F.col("above").isNotNull()).withColumn("chain", F.concat("above", F.array("path")))
    parents = nodes.where(F.size("above") > 0).groupBy("host", F.element_at("above", -1).alias("path")).agg(F.count(F.lit(1)).alias("children"))
    n = F.coalesce("children", F.lit(0)) + F.col("content").isNotNull().cast("int")
    left = F.pow(F.lit(GAMMA), F.col("shapes"))
    parted = nodes.join(parents, ["host", "path"], "left").select("host", "path", "chain", (left / n).alias("factor"), ((1 - left) * F.col("spread") + F.coalesce(left / n * F.col("content"), F.lit(0.0))).alias("own"))
    met = parted.select("host", "path", "own", F.posexplode("chain").alias("at", "over")).join(parted.select("host", F.col("path").alias("over"), "factor"), ["host", "over"])
    # the factors of a node's chain: what it gives to place i is own * the product from i to its parent
    below = met.groupBy("host", "path", "own").agg(F.array_sort(F.collect_list(F.struct("at", "over", "factor"))).alias("up"))
    upto = F.transform("up", lambda u, i: F.struct(u["over"].alias("over"), F.aggregate(F.slice("up", i + 1, F.size("up") - 1 - i), F.col("own"), lambda acc, x: acc * x["factor"]).alias("part")))
    given = below.select("host", F.explode(upto).alias("g")).groupBy("host", F.col("g.over").alias("path")).agg(F.sum("g.part").alias("composite"))
    return parted.select("host", "path", "chain").join(given, ["host", "path"])


def removed_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, shape): nodes and branches that go by their content (shape false), and
    nodes with text that go by shape, outside an article (shape true)."""
    measured = materialize(_measured(pages).where(F.col("pages") >= LEAST_PAGES), "style-nodes")
    low = measured.where(F.col("content") < THRESHOLD).select("host", "path", F.lit(False).alias("shape"))
    found = materialize(composite(measured), "style-composite")
    peak = found.select("host", F.explode("chain").alias("path"), "composite").groupBy("host", "path").agg(F.max("composite").alias("peak"))
    shaped = found.where(F.col("composite") >= SHAPED).select("host").distinct()
    flags = measured.where(F.col("above").isNotNull()).select("host", "path", "flags")
    state = found.select("host", "path", "composite").join(peak, ["host", "path"]).join(flags, ["host", "path"]).join(shaped, "host", "left_semi")
    # what each node on the way down says: 1 stop here, all below is kept; 2 all below goes; 0 look further
    whole, heading = (F.col("flags").bitwiseAND(x) > 0 for x in (_WHOLE, _HEADING))
    says = F.when(whole, 0).when(F.col("composite") >= SHAPED, 1).when((F.col("peak") < SHAPED) & ~heading, 2).otherwise(0)
    verdict = state.select("host", F.col("path").alias("over"), says.alias("says")).where("says > 0")
    text = measured.where(F.col("above").isNotNull() & F.col("content").isNotNull()).select("host", "path", F.posexplode(F.concat("above", F.array("path"))).alias("at", "over"))
    first = text.join(verdict, ["host", "over"]).groupBy("host", "path").agg(F.min(F.struct("at", "says")).alias("first"))
    gone = first.where("first.says = 2").select("host", "path", F.lit(True).alias("shape"))
    return materialize(low.union(gone), "style-tree")


def main_text(pages: DataFrame, rules: bool = True, tree: bool = True) -> DataFrame:
    """(page_id, url, text) of every row of (page_id, url, html).

    rules=False takes the style tree alone (no article, no names of elements), tree=False
    the elements alone; both are there to measure what each does."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))).alias("host"))
    none = F.lit(None).cast("array<struct<path:bigint,shape:boolean>>").alias("gone")
    sent = None
    if not tree:
        ready = rows.select("*", none)
    else:
        removed = removed_nodes(pages)
        if removed.count() <= BROADCAST_ROWS:
            sites: dict[str, tuple[set, set]] = {}
            for r in removed.toLocalIterator():
                sites.setdefault(r["host"], (set(), set()))[r["shape"]].add(r["path"])
            sent = spark.sparkContext.broadcast(sites)
            ready = rows.select("*", none)
        else:
            per_host = removed.groupBy("host").agg(F.collect_set(F.struct("path", "shape")).alias("gone"))
            salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            ready = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    nothing: tuple[set, set] = (set(), set())

    def run(batches):
        for batch in batches:
            texts = []
            for page, host, listed in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                low, gone = sent.value.get(host, nothing) if sent else ({r["path"] for r in listed or () if not r["shape"]}, {r["path"] for r in listed or () if r["shape"]})
                found = outline(page)[0]
                if not rules:
                    found = [(path, text, False, False, shape) for path, text, _, _, shape in found]
                if low or gone:
                    paths = {b[0] for b in found}
                    low_ = {path for path in paths if low and any(_short(n) in low for n in (path, *_above(path)))}
                    gone_ = {path for path in paths if gone and _short(path) in gone}
                    # an article that is removed whole stays the article
                    inside = any(a and not lost for _, _, a, lost, _ in found)
                    found = [b for b in found if b[0] not in low_ and (b[2] or not inside)]
                    shaped = [b for b in found if b[2] or b[0] not in gone_]
                    found = shaped if any(not b[3] for b in shaped) else found
                texts.append("\n".join(_main(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    return ready.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "host", "gone").mapInArrow(run, "page_id bigint, url string, text string")
