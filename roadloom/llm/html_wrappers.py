"""Main text of web pages by wrapper inference: union-free regular expressions over the pages of a host.

A page is read as a stream of tags and texts; block elements nest, inline ones only continue a text. The wrapper of a host is
such a stream in which groups may be optional or repeated and texts may be slots. It begins as its first page; each further
page is aligned with it, child by child, along the longest run of children that both have in one order: what only one side
has becomes optional, a child that returns makes the stretch up to its return a repeated group, and a text that differs
becomes a slot. So in each list of children a kind (tag, names, and for generic containers what sort of children they hold) stands once, and lists
of any length align exactly in n log n. Aligning is the same for page and wrapper, so each task makes one wrapper a host of
what it reads, and wrappers of tasks are aligned in turn, some dozens at a time: a host with a third of all pages comes to its
wrapper in as few rows as there are tasks. Each part counts the characters it holds over all pages, and those in links.

The wrapper says where the article of a host's pages is: from the root, into the part that holds two thirds of the text in slots
outside links, until the text is spread over several parts or over a repeated one. A page whose article is short has it in
the same place. Tags and names are hints: those of menus, footers, adverts and the like make a part's text count for nothing,
those of an article make it count ARTICLE times. A page that lacks the place, or a host of one page, goes by its own
structure. Within an article only elements that are marked as menus, asides, forms, adverts, notices or comments, by tag, role
or a whole class name, are left out; where the place is not marked as an article, so are its parts that consist of links or
repeat on all pages word by word. Character references are decoded, white space in a block becomes one space, and blocks
are joined by line feeds in page order.

Defined results: a null or empty html, or a page of template only, gives an empty text. A cut tag or comment at the end
is dropped. Elements nested more than DEPTH deep stand beside each other. Pages without a host share one. Repeated rows are
extracted each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, map_groups, sized, written

PAGES = 3  # of a host, before texts that are the same on all of them count as template
AT_ONCE = 64
HELD = 20_000
DEPTH = 200
ARTICLE = 8

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg object canvas".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
NOT_TEXT = set("head nav footer aside form button select textarea menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert".split())
#: Whole class names or ids that mark what is not the article's text inside it.
MARKED = set("ad ads advert adverts advertisement sponsored nav navbar navigation menu sidebar breadcrumb breadcrumbs pagination notice cookie-notice cookie-banner newsletter comment comments comment-list reader-comments".split())
GENERIC = set("div section center td fieldset details dialog figure".split())
#: What the shape of a generic container tells apart among its children.
SHAPES = {**dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), "h"), **dict.fromkeys("p blockquote pre".split(), "p"), **dict.fromkeys("ul ol dl menu".split(), "l"), "form": "f", "table": "t"}
#: Words in class or id that name what is not the article.
NAMED = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar aside comment comments commentlist reply replies respond disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar masthead footer copyright legal skip outbrain taboola".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element: its tag, the words of class and id, whole class names, role, its children (elements and texts) in
    order, and how many characters of its own texts are in links."""

    __slots__ = ("tag", "names", "tokens", "kids", "role", "linked")

    def __init__(self, tag: str, names: frozenset = frozenset(), role: str = "", tokens: frozenset = frozenset()):
        self.tag, self.names, self.role, self.tokens, self.kids, self.linked = tag, names, role, tokens, [], 0

    def kind(self) -> str:
        return self.tag + "".join(f".{n}" for n in sorted(self.names))

    def key(self) -> str:
        """Kind, and of a generic container also its shape: with headings, with paragraphs, of text, of lists, of blocks."""
        if self.tag not in GENERIC:
            return self.kind()
        sorts = {"#" if isinstance(k, str) else SHAPES.get(k.tag, "b") for k in self.kids}
        return f"{self.kind()}~{next((x for x in 'hp' if x in sorts), None) or (sorts.pop() if len(sorts) == 1 else 'b')}"


_BARE: frozenset = frozenset()


def parse(html: str) -> Node:
    root = Node("html")
    stack, held, too_deep = [root], [], Counter()
    at, lower, in_link, linked = 0, None, False, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1].kids.append(text)
                stack[-1].linked += min(linked, len(text))
            linked = 0

    def close(tag: str, within: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in within:
                return

    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            held.append(html[at : m.start()])
            linked += m.start() - at if in_link else 0
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not rest.endswith("/") or tag in ("script", "style"):
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at)
                end = len(html) if end < 0 else html.find(">", end) + 1 or len(html)
                at = end
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE or tag in ("html",):
            in_link = not closing if tag == "a" else in_link
            continue
        flush()
        if closing:
            if too_deep[tag]:
                too_deep[tag] -= 1
            else:
                close(tag, set())
            continue
        if tag in CLOSES_P:
            close("p", {"td", "th", "table", "button", "caption"})
        if tag == "li":
            close("li", {"ul", "ol", "menu", "dir"})
        elif tag in ("dt", "dd"):
            close("dt", {"dl"})
            close("dd", {"dl"})
        elif tag in ("td", "th", "tr"):
            close("td", {"table"})
            close("th", {"table"})
            if tag == "tr":
                close("tr", {"table"})
        elif tag == "body":
            close("head", set())
        elif tag == "option":
            close("option", {"select"})
        elif stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base"):
            stack.pop()
        names, role, tokens = _BARE, "", _BARE
        if rest and "=" in rest:
            found = [(k.lower(), v.strip("\"'").lower()) for k, v in _ATTRIBUTE.findall(rest)]
            if found:
                names = frozenset(w for k, v in found if k != "role" for w in _NAME.findall(v))
                tokens = frozenset(w for k, v in found if k != "role" for w in v.split())
                role = next((v for k, v in found if k == "role"), "")
        node = Node(tag, names, role, tokens)
        stack[-1].kids.append(node)
        if tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
        elif tag not in VOID:
            too_deep[tag] += 1
    if at < len(html):
        held.append(html[at:])
    flush()
    return root


# A wrapper's part is [key, optional, repeated, fixed text or None, children, characters, characters in links, whether hints
# take it out, whether they mark an article]; the key of a text is "#", of a repeated group "()". In a list of parts, groups
# included, a key stands once.
KEY, OPTIONAL, REPEATED, FIXED, KIDS, CHARS, LINKS, OUT, MAIN = range(9)


def _fixed(text: str) -> str:
    return text if len(text) <= 200 else f"{text[:100]}\0{len(text)}\0{text[-100:]}\0{hash_of(text)}"


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def wrapper_of(node: Node, inside: bool = False) -> list:
    out, main = (_left_out_inside if inside else _left_out)(node), _is_main(node)
    texts = sum(len(k) for k in node.kids if isinstance(k, str))
    share = node.linked / texts if texts else 0
    kids = [["#", False, False, _fixed(k), [], len(k), share * len(k), False, False] if isinstance(k, str) else wrapper_of(k, inside or main) for k in node.kids]
    return [node.key(), False, False, None, folded([(k, 0) for k in kids]), sum(k[CHARS] for k in kids), sum(k[LINKS] for k in kids), out, main]


def folded(parts: list[tuple[list, int]]) -> list:
    """Parts, each with the number of the group it was in (0: none), as a list in which a key stands once: neighbours of one
    key become one repeated part, and a stretch from a key to its return, or that a group spans, one repeated group."""
    row: list[tuple[list, int]] = []
    for part, group in parts:
        if row and row[-1][0][KEY] == part[KEY]:
            both = merged(row[-1][0], part)
            both[REPEATED] = True
            row[-1] = (both, row[-1][1] or group)
        else:
            row.append((part, group))
    last: dict = {}
    for k, (part, group) in enumerate(row):
        last[part[KEY]] = k
        if group:
            last[group] = k
    out, k = [], 0
    while k < len(row):
        end, at = k, k
        while at <= end:  # as far as any key or group of the stretch returns
            end = max(end, last[row[at][0][KEY]], last.get(row[at][1], 0))
            at += 1
        if end == k and not row[k][1]:
            out.append(row[k][0])
        else:
            members: dict = {}
            for part, _ in row[k : end + 1]:
                members[part[KEY]] = merged(members[part[KEY]], part) if part[KEY] in members else part
            in_turn = [p[KEY] for p, _ in row[k : end + 1]] == [*members] * ((end + 1 - k) // len(members))
            out.append(["()", False, True, None, [[m[KEY], m[OPTIONAL] or not in_turn, *m[REPEATED:]] for m in members.values()], 0, 0, False, False])
        k = end + 1
    return out


def merged(a: list, b: list) -> list:
    """The least wrapper part that stands for both; their keys are equal."""
    fixed = a[FIXED] if a[FIXED] == b[FIXED] else None
    return [a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], fixed, aligned(a[KIDS], b[KIDS]), a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[OUT] and b[OUT], a[MAIN] or b[MAIN]]


def _single(parts: list, sign: int) -> list[tuple[list, int]]:
    return [(q, sign * n if p[KEY] == "()" else 0) for n, p in enumerate(parts, 1) for q in (p[KIDS] if p[KEY] == "()" else (p,))]


def aligned(a: list, b: list) -> list:
    """One list for both, along their longest common run; keys that change places, and what stands between, become a group."""
    lone = lambda p: [p[KEY], True, *p[REPEATED:]]
    one, two = _single(a, 1), _single(b, -1)
    at = {p[KEY]: k for k, (p, _) in enumerate(two)}
    pairs = rising([(k, at[p[KEY]]) for k, (p, _) in enumerate(one) if p[KEY] in at])
    again = {p[KEY] for p, _ in one} & set(at)
    out, i, j = [], 0, 0
    tied: dict = {}  # groups of both sides that share a part are one
    for x, y in pairs:
        if one[x][1] and two[y][1]:
            tied[two[y][1]] = tied.get(two[y][1], one[x][1])
    for x, y in [*pairs, (len(one), len(two))]:
        out += [(p if p[KEY] in again else lone(p), tied.get(g, g)) for p, g in [*one[i:x], *two[j:y]]]
        if x < len(one):
            out.append((merged(one[x][0], two[y][0]), one[x][1] or tied.get(two[y][1], two[y][1])))
        i, j = x + 1, y + 1
    return folded(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, which ascend in the first place, that ascends in the second too."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(ends, y)
        before.append(at[n - 1] if n else -1)
        ends[n : n + 1], at[n : n + 1] = [y], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def expression(part: list) -> str:
    """A wrapper as text, for people: slots are #, fixed texts quoted, ? optional, + repeated, * both."""
    key, optional, repeated, fixed, kids = part[:CHARS]
    mark = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
    if key == "#":
        return ("#" if fixed is None else json.dumps(fixed, ensure_ascii=False)) + mark
    inner = " ".join(map(expression, kids))
    return (f"({inner})" if key == "()" else f"<{key.split('~')[0]}>{inner}</>") + mark


def _parts(part: list) -> dict:
    return {q[KEY]: q for q, _ in _single(part[KIDS], 1)}


class Plan:
    """Where a wrapper has the article: the parts on the way from the root to it."""

    def __init__(self, wrapper: list, pages: int):
        self.pages, self.whole = pages, pages == 1
        if not self._mass(wrapper):
            self.whole = True  # all pages alike: nothing is told apart as template
        self.way = [wrapper]
        while True:
            here = self.way[-1]
            kids = [p for p in _parts(here).values() if p[KEY] != "#" and not p[OUT]]
            weigh = lambda p: ARTICLE * self._mass(p) + 1 if p[MAIN] else self._mass(p)
            best = max(kids, key=weigh, default=None)
            own = sum(self._mass(p) for p in here[KIDS] if p[KEY] == "#")
            if best is None or best[REPEATED] or not any(p[KEY] != "#" for p in best[KIDS]) and not best[MAIN] or not 3 * weigh(best) > 2 * (own + sum(map(weigh, kids))):
                return
            self.way.append(best)

    def _mass(self, part: list) -> float:
        """Characters in slots, outside links and whatever hints take out."""
        if part[OUT]:
            return 0
        if part[KEY] == "#":
            return part[CHARS] - part[LINKS] if part[FIXED] is None or self.whole else 0
        return sum(map(self._mass, part[KIDS]))


def extract(page: Node, plan: Plan) -> str | None:
    """The page's article, block by block; None if the page has no such place."""
    at = page
    for before, part in zip(plan.way, plan.way[1:], strict=False):
        kids = [k for k in at.kids if not isinstance(k, str)]
        found = [k for k in kids if k.key() == part[KEY]]
        if not found:  # of another shape than on most pages, but nothing else that the wrapper knows
            others = _parts(before)
            found = [k for k in kids if k.kind() == part[KEY].split("~")[0] and k.key() not in others and not _left_out(k)]
        if len(found) != 1:
            return None
        at = found[0]
    part = plan.way[-1]
    marked = _is_main(at)
    articles = [] if marked else [k for k in at.kids if not isinstance(k, str) and _is_main(k) and not _left_out(k)]
    parts = _parts(part)
    out: list[str] = []

    def walk(node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                out.append(kid)
            elif not _left_out_inside(kid):
                walk(kid)

    def template(kid: Node | str) -> bool:
        known = parts.get("#" if isinstance(kid, str) else kid.key())
        if known is None:
            return False
        if 2 * known[LINKS] > known[CHARS]:
            return True
        return not plan.whole and plan.pages >= PAGES and not known[REPEATED] and not known[OPTIONAL] and _all_fixed(known)

    for kid in articles or at.kids:
        if marked:
            if isinstance(kid, str):
                out.append(kid)
            elif not _left_out_inside(kid):
                walk(kid)
        elif not template(kid) or kid in articles:
            if isinstance(kid, str):
                out.append(kid)
            elif not _left_out(kid):
                walk(kid)
    return "\n".join(out)


def _all_fixed(part: list) -> bool:
    return part[FIXED] is not None if part[KEY] == "#" else all(map(_all_fixed, part[KIDS]))


def _left_out(node: Node) -> bool:
    """Whether tag, role or names hint at anything but the article."""
    if node.tag in NOT_TEXT or node.tag == "header" or node.role in ROLES:
        return True
    return node.tag not in ("html", "body", "main") and not NAMED.isdisjoint(node.names) and not (node.tag == "article" and NAMED.isdisjoint(node.names - {"share", "related", "comments"}))


def _left_out_inside(node: Node) -> bool:
    return node.tag in NOT_TEXT or node.role in ROLES or not MARKED.isdisjoint(node.tokens)


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role == "main"


def main_text(page: Node, plan: Plan | None) -> str:
    """By the host's wrapper, or where the page does not fit it, by the page's own."""
    found = extract(page, plan) if plan else None
    return extract(page, Plan(wrapper_of(page), 1)) or "" if found is None else found


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _held(by_host: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(by_host)), pa.array([TaskContext.get().partitionId()] * len(by_host), pa.int64()), pa.array([n for _, n in by_host.values()], pa.int64()), pa.array([json.dumps(w) for w, _ in by_host.values()])], names=["host", "part", "pages", "wrapper"])


_WRAPPERS = "host string, part long, pages long, wrapper string"


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper (as JSON): one row a host, written."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict = {}
        for batch in batches:
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = wrapper_of(parse(html.as_py()))
                if name in by_host:
                    before, n = by_host[name]
                    by_host[name] = (merged(before, own), n + 1)
                else:
                    by_host[name] = (own, 1)
                if len(by_host) >= HELD:
                    yield _held(by_host)
                    by_host = {}
        if by_host:
            yield _held(by_host)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in rows.sort_values(["part", "wrapper"]).wrapper:
            whole = json.loads(text) if whole is None else merged(whole, json.loads(text))
        return pd.DataFrame({"host": [rows.host.iloc[0]], "part": [rows.part.min() // AT_ONCE], "pages": [rows.pages.sum()], "wrapper": [json.dumps(whole)]})

    rows = written(map_arrow(pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")), infer, _WRAPPERS), "wrappers")
    while True:
        last = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if last <= 1:
            return rows.select("host", "pages", "wrapper")
        rows = written(map_groups(rows.withColumn("_deal", F.floor(F.col("part") / AT_ONCE)), ["host", "_deal"], lambda pdf: join(pdf.drop(columns="_deal")), _WRAPPERS), "wrappers")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row."""
    found = sized(wrappers(pages))
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host")).join(found, "host", "left").select("page_id", "url", "html", "pages", "wrapper")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(256)(lambda text, n: Plan(json.loads(text), n) if text else None)
        for batch in batches:
            texts = [main_text(parse(html.as_py()), read(w.as_py(), n or 0)) for html, n, w in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return map_arrow(rows, take, "page_id long, url string, text string")


def op6_main_text(pages: DataFrame) -> DataFrame:
    return main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
