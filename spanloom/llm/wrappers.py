"""Main text of web pages by wrappers: union-free regular expressions over same-host pages.

A page's token stream (block tags and text between them) is a nested sequence.  Aligning two
sequences keeps what they share; a mismatch becomes an optional group, neighbours of one
shape become a repeated group, and differing texts become a slot.  Wrappers are aligned with
wrappers in the same way, so a host's pages are folded where they lie and then merged."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, text_of, written

#: Elements by their role in HTML.
BLOCKS = set(
    """html body article main section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
    table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset hgroup details summary
    title head dialog menu""".split()
)
HIDDEN = "script style noscript template iframe svg object select option button textarea title head canvas".split()
ASIDE = set("nav header footer aside form menu dialog".split())
#: Hidden elements whose content is no markup, and their end.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style iframe textarea title".split()}
#: What a head may hold; the first other tag or text ends it.
HEAD_KEEPS = set("base basefont bgsound link meta title noscript noframes script style template head".split())
CENTRE = ("article", "main")
#: A tag that ends these open ones, up to the next container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
PARAGRAPH_ENDS = BLOCKS - {"html", "body", "head", "title"}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverts?|sponsor\w*|banner|promo\w*|side-?bar|menu|nav\w*|breadcrumbs?|cookies?|"
    r"consent|notices?|alert|pop-?up|modal|newsletter|subscribe|share|sharing|social|related|recommended|comments?|"
    r"replies|discussion|disqus|footer|masthead|site-?header|pagination|login|signup|search)(?:$|[\s_-])",
    re.I,
)
# the attributes end before the next "<"; where they do not, the third group is missing and
# ``Tags`` finds the end (possessive, so that no part of a page is read again and again)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<\?[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?>[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>)?",
    re.S | re.I,
)
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")  # a tag that closes itself; not the end of an unquoted value
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})\b", re.I)
SPACE = re.compile(r"\s+")
LEAST_PAGES = 5  # that a text must be the same in to count as the template's
MOST_SIBLINGS = 48
LONGEST_GROUP = 3
OPEN_HOSTS = 2000
#: Blocks nested deeper lie in their ancestor of this depth; their texts stay texts of their own.
DEEPEST = 150


class Node:
    """An element: its tag, class words, and children (elements or texts)."""

    __slots__ = ("tag", "sig", "marks", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.tag, self.kids = tag, []
        self.marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
        self.sig = tag + "." + re.sub(r"[0-9]+", "", ".".join(sorted(found.get("class", "").split())))


class Tags:
    """Where tags end that hold a "<" or an odd quote.  A quote that never closes is a plain
    character; once quotes leave a tag no end at all, it and the later ones of the page end at
    their first ">".  Every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.lone, self.plain = page, set(), False
        self.last = page.rfind(">")

    def end(self, at: int) -> int:
        """Behind the ">" of a tag whose attributes start at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        seek = at
        while not self.plain:
            m = QUOTE_OR_END.search(self.page, seek)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.end()
            else:
                close = -1 if m[0] in self.lone else self.page.find(m[0], m.end())
                if close < 0:
                    self.lone.add(m[0])
                seek = max(close + 1, m.end())
        return self.page.find(">", at) + 1


def parse(page: str) -> Node:
    """The page as a tree of block elements; inline markup dissolves into the text.

    Hidden elements leave no node, and the text around one stays whole.  One that has no end
    tag of its own ends with its parent, and its blocks then belong to the parent."""
    root = Node("#root")
    stack, text, outer = [root], [], []
    absent: set[str] = set()  # raw elements that have no end tag in the rest of the page
    open_: Counter = Counter()  # tags on the stack
    tags = Tags(page)

    def boundary() -> None:
        if text:
            stack[-1].kids.append("".join(text))
            text.clear()

    def close(own: bool = False) -> None:
        boundary()
        node = stack.pop()
        open_[node.tag] -= 1
        if node.tag in HIDDEN:
            if node.tag != "head":
                text[:] = outer.pop()
            first = next((i for i, k in enumerate(node.kids) if not isinstance(k, str)), None)
            if not own and first is not None:
                boundary()
                stack[-1].kids += node.kids[first:]

    def pop(tags: set[str], stop: set[str], own: bool = False) -> None:
        if not any(open_[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i + 1:
                    close()
                close(own)
                return
            if stack[i].tag in stop:
                return

    def raw_end(tag: str, at: int) -> int:
        """Where a raw element that starts before ``at`` ends.  Without an end tag it ends
        before the next block tag, a script or style before the end tag of an open element
        or the start of the body or its centre."""
        end = None if tag in absent else RAW[tag].search(page, at)
        if end and tag == "title" and (head := HEAD_END.search(page, at, end.start())):
            return head.start()
        if end:
            return end.end()
        absent.add(tag)
        stop = BLOCK_TAG
        if tag in ("script", "style"):
            ends = "|".join(sorted({n.tag for n in stack[1:]}))
            stop = re.compile((rf"</(?:{ends})\b|" if ends else "") + r"<(?:body|article|main)\b", re.I)
        found = stop.search(page, at)
        return found.start() if found else len(page)

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            between = page[at : m.start()]
            if stack[-1].tag == "head" and not between.isspace():
                close()
            text.append(between)
        at, attributes = m.end(), m[3]
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if attributes is None:
            end = tags.end(at)
            if end < 0:  # no tag
                text.append(m[0])
                continue
            attributes, at = page[at : end - 1], end
        if not m[1] and stack[-1].tag == "head" and tag not in HEAD_KEEPS:
            close()
        empty = attributes.endswith("/") and bool(EMPTY.search(attributes)) and (tag == "svg" or open_["svg"] > 0)
        if tag in RAW:
            if not m[1] and not empty:
                at = raw_end(tag, at)
            continue
        if tag in HIDDEN and tag != "head":
            if m[1]:
                pop({tag}, CENTRE_STOP, True)
            elif not empty:
                if tag == "option" and stack[-1].tag == "option":
                    close()
                stack.append(Node(tag))
                open_[tag] += 1
                outer.append(text[:])
                text.clear()
            continue
        if tag not in BLOCKS:
            if tag in ("br", "hr", "img"):
                text.append(" ")
            continue
        if tag == "head" and not m[1] and any(n.tag != "html" for n in stack[1:]):
            continue  # only the first place of a page has a head
        if tag == "body" and not m[1]:
            pop({"head"}, set())
        boundary()
        if m[1]:
            pop({tag}, CENTRE_STOP if tag not in CENTRE else set(), True)
        else:
            if tag in CLOSES:
                pop(CLOSES[tag], CONTAINERS | SOFT)
            if tag in PARAGRAPH_ENDS and stack[-1].tag == "p":
                close()
            node = Node(tag, attributes)
            if len(stack) < DEEPEST:
                stack[-1].kids.append(node)
            elif not dropped(node):
                node.kids = stack[-1].kids
            if not empty:
                stack.append(node)
                open_[tag] += 1
    if stack[-1].tag == "head" and page[at:].strip():
        close()
    text.append(page[at:])
    while len(stack) > 1:
        close()
    boundary()
    return root


HEAD_END = re.compile(r"</head\s*>", re.I)
SOFT = set(HIDDEN) - set(RAW) - {"head"}
CONTAINERS = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "blockquote"}
CENTRE_STOP = set(CENTRE)
PROSE = set("h1 h2 h3 h4 h5 h6 p pre blockquote".split())


def clean(raw: str) -> str:
    return SPACE.sub(" ", html.unescape(raw)).strip()


def dropped(node: Node) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms and comments."""
    return node.tag in ASIDE or node.tag in HIDDEN or bool(node.marks and BOILERPLATE.search(node.marks))


# --- wrappers: [sig, quantifier, kids] or ["#", quantifier, text or null, characters] ----

ONCE, MAYBE, MANY, ANY = "1", "?", "+", "*"
_LOOSER = {(ONCE, ONCE): ONCE, (ONCE, MAYBE): MAYBE, (MAYBE, MAYBE): MAYBE, (ONCE, MANY): MANY, (MANY, MANY): MANY}


def looser(a: str, b: str) -> str:
    return _LOOSER.get((a, b)) or _LOOSER.get((b, a)) or ANY


def merged(a: list, b: list, quantifier: str | None = None) -> list:
    """Two items of one shape as one."""
    q = quantifier or looser(a[1], b[1])
    if a[0] == "#":
        return ["#", q, a[2] if a[2] == b[2] else None, a[3] + b[3]]
    return [a[0], q, aligned(a[2], b[2])]


def optional(item: list) -> list:
    return [item[0], looser(item[1], MAYBE) if item[1] in (ONCE, MAYBE) else ANY, *item[2:]]


def shape(item: list) -> str:
    return item[0] if item[0] != "()" else "(" + " ".join(shape(x) for x in item[2]) + ")"


def folded(items: list) -> list:
    """Neighbouring groups of one shape, up to three items long, become a repeated group."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list = []
        i = 0
        names = [shape(x) for x in items]
        while i < len(items):
            group, width = items[i : i + size], 1
            while len(group) == size and names[i + width * size : i + (width + 1) * size] == names[i : i + size]:
                nxt = items[i + width * size : i + (width + 1) * size]
                group = [merged(x, y) for x, y in zip(group, nxt)]
                width += 1
            if width > 1 and size == 1:
                x = group[0]
                out.append([x[0], MANY if x[1] in (ONCE, MANY) else ANY, *x[2:]])
            elif width > 1:
                out.append(["()", MANY, group])
            else:
                out.append(items[i])
            i += width * size if width > 1 else 1
        items = out
    return items


def aligned(a: list, b: list) -> list:
    """One sequence that both match: their longest common subsequence of shapes merged, the
    rest optional in its place."""
    if not a or not b:
        return [optional(x) for x in a or b]
    x, y = [shape(i) for i in a], [shape(i) for i in b]
    if x == y:
        return folded([merged(i, j) for i, j in zip(a, b)])
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    out = folded(out)
    if len(out) > MOST_SIBLINGS:  # one repeated group of optional parts, each shape once
        parts: dict[str, list] = {}
        for item in (y for x in out for y in (x[2] if x[0] == "()" else [x])):
            key = shape(item)
            parts[key] = optional(merged(parts[key], item) if key in parts else item)
        out = [["()", ANY, list(parts.values())]] if len(parts) > 1 else list(parts.values())
    return out


def wrapper_of(node: Node) -> list:
    """The wrapper of one page below ``node``: each text is still a constant."""
    items = []
    for k in node.kids:
        if isinstance(k, str):
            if t := clean(k):
                items.append(["#", ONCE, t, len(t)])
        elif not dropped(k):
            items.append([k.sig, ONCE, wrapper_of(k)])
    return folded(items)


def marked(items: list, path: tuple = ()) -> list[tuple]:
    """Paths of the wrapper's outermost ``article`` and ``main`` elements."""
    found = []
    for x in items:
        if x[0] == "#":
            continue
        below = path if x[0] == "()" else (*path, x[0])
        found += [below] if x[0].split(".")[0] in CENTRE else marked(x[2], below)
    return found


def rules(wrapper: list, pages: int) -> dict:
    """Which fields of a host's wrapper are main text.

    ``centres``: the paths of its article and main elements, or else the one path below which
    most of the text in slots lies.  ``fixed`` lists texts (path and text) that are the same in
    every page and belong to the template: those in a main beside its article, and without
    such elements all, if the slots hold most of the text.  A host with few pages has no
    template, and its centre is the whole page."""
    fixed, mass = [], {}

    def walk(items: list, path: tuple, sure: bool) -> tuple[int, int]:
        slot = constant = 0
        for x in items:
            if x[0] == "#":
                if x[2] is None:
                    slot += x[3]
                else:
                    constant += x[3]
                    if sure and x[1] == ONCE:
                        fixed.append(["/".join(path), x[2]])
            else:
                below = path if x[0] == "()" else (*path, x[0])
                s, c = walk(x[2], below, sure and x[1] == ONCE)
                slot, constant = slot + s, constant + c
                if x[0] != "()":
                    mass[below] = mass.get(below, 0) + s
        return slot, constant

    slot, constant = walk(wrapper, (), True)
    if found := marked(wrapper):
        centres = sorted({"/".join(p) for p in found})
        beside = [f for f in fixed if any(t.split(".")[0] == "main" for t in f[0].split("/")) and not any(t.split(".")[0] == "article" for t in f[0].split("/"))]
        return {"centres": centres, "fixed": beside if pages >= LEAST_PAGES else []}
    path: tuple = ()
    while pages >= LEAST_PAGES:
        kids = [p for p in mass if len(p) == len(path) + 1 and p[: len(path)] == path]
        top = max(kids, key=lambda p: (mass[p], p), default=None)
        leaf = top is None or top[-1].split(".")[0] not in CONTAINERS | {"html", "body"}
        # a title or paragraph beside, or a second container of some weight, is main text too
        beside = any(mass[p] and p[-1].split(".")[0] in PROSE for p in kids)
        if leaf or beside or mass[top] * 5 <= (mass.get(path, 0) if path else slot) * 4:
            break
        path = top
    enough = pages >= LEAST_PAGES and slot >= 4 * constant
    return {"centres": ["/".join(path)], "fixed": fixed if enough else []}


def fields(root: Node, rule: dict) -> list[str]:
    """The texts of a page that lie in the wrapper's main fields, in page order."""
    fixed = {(p, t) for p, t in rule["fixed"]}
    centres = set(rule["centres"])
    blocks: list[str] = []

    def walk(node: Node, path: str, inside: bool) -> None:
        inside = inside or path in centres
        for k in node.kids:
            if isinstance(k, str):
                if inside and (t := clean(k)) and (path, t) not in fixed:
                    blocks.append(t)
            elif not dropped(k):
                walk(k, f"{path}/{k.sig}" if path else k.sig, inside)

    walk(root, "", False)
    return blocks


def main_text(page: str, rule: dict | None = None) -> str:
    """The blocks of the article, two line ends between them.  A page that has none of its
    host's fields is read by its own wrapper."""
    root = parse(page)
    blocks = fields(root, rule) if rule else []
    return "\n\n".join(blocks or fields(root, rules(wrapper_of(root), 1)))


def infer(pages: DataFrame) -> DataFrame:
    """``host``, ``rule``: a wrapper's findings per host, from all its pages (``host``,
    ``__h``).

    A task folds the pages of each host into one wrapper as they come, and hands on wrappers;
    these are merged by host and a salt, then by host, so a host with any share of the pages
    costs a few small rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        salt, open_ = TaskContext.get().partitionId() % 64, {}
        out = lambda: pd.DataFrame(
            [(h, salt, json.dumps(w), n) for h, (w, n) in open_.items()], columns=["host", "salt", "wrapper", "pages"]
        )
        for b in batches:
            for host, page in zip(b["host"], b["__h"]):
                new = wrapper_of(parse(page))
                old = open_.get(host)
                open_[host] = (aligned(old[0], new), old[1] + 1) if old else (new, 1)
                if len(open_) > OPEN_HOSTS:
                    yield out()
                    open_ = {}
        yield out()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        w = None
        for x in sorted(group["wrapper"]):
            w = json.loads(x) if w is None else aligned(w, json.loads(x))
        first = group.iloc[:1]
        return first.assign(wrapper=json.dumps(w), pages=int(group["pages"].sum()))

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        one = merge(group).iloc[0]
        rule = rules(json.loads(one["wrapper"]), one["pages"])
        return pd.DataFrame([(one["host"], json.dumps(rule))], columns=["host", "rule"])

    shape_ = "host string, salt long, wrapper string, pages long"
    parts = pages.select("host", "__h").mapInPandas(fold, shape_)
    parts = parts.groupBy("host", "salt").applyInPandas(merge, shape_)
    return parts.groupBy("host").applyInPandas(judge, "host string, rule string")


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """All columns of ``pages`` but the HTML, plus ``text``: the main text, blocks parted by two
    line ends, empty if there is none.

    A page's texts are matched with the fields of its host's wrapper: those in its outermost
    ``article`` and ``main`` elements, or else where most of its slot text lies.  Out go menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles, comments, and texts that the wrapper has fixed in
    every page.  A null page counts as empty, a null url as a host of its own; hosts with fewer
    than five pages have no template; blocks nested over 150 deep count as blocks of their
    ancestor there; a tag without an end is text; repeated rows stay; whole pages are read; an empty table
    gives an empty one."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    kept = [c for c in pages.columns if c not in (page, "text")]
    rows = pages.select(*kept, host.alias("__host"), text_of(page).alias("__h"))
    found = written(infer(rows.select(F.col("__host").alias("host"), "__h")), "wrappers")
    found = found.select(F.col("host").alias("__host"), F.col("rule").alias("__rule"))

    def start():
        known: dict[str, dict | None] = {}

        def make(htmls: list[str], rules_: list[str]) -> tuple:
            nonlocal known
            texts = []
            for p, r in zip(htmls, rules_):
                if r not in known:
                    known = {**known, r: json.loads(r)} if len(known) < 256 else {r: json.loads(r)}
                texts.append(main_text(p, known[r]))
            return (texts,)

        return make

    joined = rows.join(found, "__host", "left").withColumn("__rule", F.coalesce("__rule", F.lit("null")))
    return appended(joined, kept, ["__h", "__rule"], {"text": ("string", pa.string())}, start)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    rows = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
