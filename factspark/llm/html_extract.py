"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored; the best one's generalised path (tags with their classes, digits cut) is a vote of the
page. Spark counts the votes by host, and the page is extracted again from the elements on its host's winning path; a page
without such an element uses its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are left out, by tag, role, class or id. A header is left out wherever it stands, that of an article with its headline too. A name
counts by its leading part or as a whole, never by a part inside unless it tells of comments (user-comments), and an id says nothing of headings and
paragraphs. Work is linear in a page's elements. No element is left out by name, and no form, that holds the page's article or main, or, if none is outside, most of the page's unlinked
text; only readers' comments, adverts and consent texts are, however long, if they hold no article.

Null html is empty and gives empty text; a null url, or one without a host, belongs to the host ''. Repeated rows vote and
return once each; an empty table gives no row. Broken markup is read as browsers do in outline: unknown end tags are ignored,
open elements end with their parent, raw text elements end at their end tag.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.I)
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body".split())
SKIPPED_TAGS = RAW | frozenset("head nav header footer aside form button select label menu dialog input".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Parts of class and id names of what is not the article: alone or with other such parts, numbers and parts that tell the place.
OTHERS = frozenset("comment comments commentlist disqus respond replies reply ad ads adv advert adverts advertisement advertising cookie cookies consent gdpr".split())
SKIPPED_NAMES = OTHERS | frozenset("banner breadcrumb breadcrumbs notice notices notification alert popup modal overlay footer header masthead menu nav navbar navigation newsletter subscribe subscription signup login promo promoted related recommended share sharing social sidebar side skip sponsor sponsored toolbar widget widgets pagination pager".split())
PLACES = frozenset("area articles bar block bottom box btn button buttons center col column container entry form global google group holder icon icons inner item items left link links list lower main middle outer page panel post posts primary region right row secondary section site slot sticky stories tertiary title to top unit upper wrap wrapper zone".split())
#: Skipped names that also begin names of article parts (side-by-side, social-impact), so that their leading part tells nothing.
COMMON = frozenset("alert notice notices related share sharing side skip social".split())
#: Parts that tell a state of the page, so a name that holds one names no region (comments-open, has-sidebar).
STATES = frozenset("active closed collapsed disabled enabled expanded has hidden is no none not off on open opened visible with without".split())
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
BODIES = frozenset("article main".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
#: An opening tag ends these open ones first, as far as the given tags.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
CLOSES |= {tag: (CLOSES.get(tag, (set(),))[0] | {"p"}, CLOSES.get(tag, (set(), set()))[1] | {"button", "td", "th", "table", "article", "section", "div", "main", "body"}) for tag in BLOCKS - {"br", "option", "legend", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"}}
WHITE = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    names: str = ""
    skipped: bool = False
    parent: int = -1
    named: frozenset = frozenset()  # the skipped names, if nothing else leaves it out
    parts: list = field(default_factory=list)  # texts, and numbers of child elements, in page order


def is_comments(part: str) -> bool:
    """comment, comments, and names that end in them (readercomments) but not after a state (nocomments)."""
    stem = part.removesuffix("s").removesuffix("comment")
    return len(stem) < len(part.removesuffix("s")) and stem not in STATES


def skipped_names(tag: str, classes: str, id_: str) -> frozenset:
    """The skipped names that leave an element out: those of whole classes or ids, of the leading parts of classes but those of an
    article or main, and of comments in any part."""
    found: set = set()
    for is_id, token in [(False, x) for x in classes.split()] + [(True, x) for x in id_.split() if tag not in ANCHORS]:
        parts = [x for x in re.split(r"[-_]+", CAMEL.sub("-", token).lower()) if x]
        told = SKIPPED_NAMES.intersection(parts) if STATES.isdisjoint(parts) else None
        if STATES.isdisjoint(parts) and any(is_comments(x) for x in parts):
            found.add("comments")
        if told and (all(x in SKIPPED_NAMES or x in PLACES or x.isdigit() for x in parts) or not is_id and tag not in BODIES and parts[0] in SKIPPED_NAMES - COMMON):
            found |= told
    return frozenset(found)


def spare(tree: list[Element]) -> None:
    """Keeps elements left out by name that hold an article or main, unless one outside has over twice its unlinked text, and those
    that hold most of the page's unlinked text if no article or main is outside."""
    n = len(tree)
    out, plain, inside, last = [False] * n, [0] * n, [0] * n, list(range(n))
    for i, e in enumerate(tree[1:], 1):
        out[i] = out[e.parent] or e.skipped and not e.named
    bodies = []
    for i in range(n - 1, -1, -1):
        e = tree[i]
        if out[i] or e.tag == "a":
            plain[i] = 0
        else:
            plain[i] += sum(len(x.strip()) for x in e.parts if isinstance(x, str))
        held = inside[i]
        if e.tag in BODIES and not out[i] and not e.skipped and plain[i]:
            bodies.append(i)
            held = max(held, plain[i])
        if e.parent >= 0:
            plain[e.parent] += plain[i]
            inside[e.parent] = max(inside[e.parent], held)
            last[e.parent] = max(last[e.parent], last[i])
    ended = sorted(bodies, key=last.__getitem__)
    ends, before = [last[i] for i in ended], list(accumulate((plain[i] for i in ended), max, initial=0))
    starts, after = [-i for i in bodies], list(accumulate((plain[i] for i in bodies), max, initial=0))
    for i, e in enumerate(tree):
        if e.named:
            outside = max(before[bisect_left(ends, i)], after[bisect_left(starts, -last[i])])
            if inside[i] and 2 * inside[i] >= outside or not outside and 2 * plain[i] > plain[0] and not e.named & OTHERS:
                e.skipped = False


def parse(page: str) -> list[Element]:
    """The elements of a page; element 0 is the root."""
    tree, open_ = [Element("")], [0]
    at, low = 0, None
    where: dict[str, list[int]] = defaultdict(list)  # places in open_ of each tag, the innermost last

    def text(to: int) -> None:
        if to > at:
            tree[open_[-1]].parts.append(page[at:to])

    def end_from(i: int) -> None:
        """Ends the open elements from the i-th."""
        for x in open_[i:]:
            where[tree[x].tag].pop()
        del open_[i:]

    def innermost(tags) -> int:
        return max((where[x][-1] for x in tags if where[x]), default=0)

    while m := TOKEN.search(page, at):
        text(m.start())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if where[tag]:
                end_from(where[tag][-1])
            continue
        if tag in CLOSES and (ended := innermost(CLOSES[tag][0])) and ended >= innermost(CLOSES[tag][1]):
            end_from(ended)
        names, skipped, named = "", tag in SKIPPED_TAGS, frozenset()
        if (attributes := m[3] or m[6]) and TELLING.search(attributes):
            given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            names = f"{given.get('class', '')} {given.get('id', '')}".strip()
            skipped = skipped or given.get("role", "").lower() in SKIPPED_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
            if names and not skipped and tag not in ("html", "body"):
                named = skipped_names(tag, given.get("class", ""), given.get("id", ""))
                skipped = bool(named)
        if tag == "form" and not named:  # some systems wrap the whole page in a form
            named = frozenset({"form"})
        tree[open_[-1]].parts.append(len(tree))
        tree.append(Element(tag, names, skipped, open_[-1], named))
        if tag in RAW:
            low = low if low is not None else page.lower()
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            if end >= 0:
                close = page.find(">", end)
                at = len(page) if close < 0 else close + 1
        elif tag not in VOID:
            where[tag].append(len(open_))
            open_.append(len(tree) - 1)
    text(len(page))
    if any(e.named for e in tree):
        spare(tree)
    return tree


def step(e: Element) -> str:
    """A tag with its classes, without digits and so alike for pages of one design."""
    names = ".".join(sorted(set(re.sub(r"\d+", "", e.names).split())))
    return e.tag + ("." + names if names else "")


def path(tree: list[Element], i: int) -> str:
    """The steps from the root."""
    steps = []
    while i > 0:
        steps.append(step(tree[i]))
        i = tree[i].parent
    return ">".join(reversed(steps))


def on_path(tree: list[Element], winner: str) -> list[int]:
    """The outermost usable elements whose path is the winner. Each element only goes on from the place that its parent reached in it."""
    kept, roots = usable(tree), []
    reached = [-1] * len(tree)
    reached[0] = 0
    for i, e in enumerate(tree[1:], 1):
        at = reached[e.parent]
        if at >= 0 and kept[i] and winner.startswith(own := step(e), at):
            at += len(own)
            if at == len(winner):
                roots.append(i)
            elif winner[at] == ">":
                reached[i] = at + 1
    return roots


def usable(tree: list[Element]) -> list[bool]:
    """Whether each element and all around it may hold article text."""
    out = [True]
    for e in tree[1:]:
        out.append(out[e.parent] and not e.skipped)
    return out


def best(tree: list[Element]) -> int:
    """The container with the highest score: its text less that of links, more for article, main and telling names; of nested
    ones an inner one wins if it loses little."""
    kept = usable(tree)
    size, linked = [0] * len(tree), [0] * len(tree)
    for i in range(len(tree) - 1, -1, -1):
        e = tree[i]
        if kept[i]:
            n = sum(len(x.strip()) for x in e.parts if isinstance(x, str))
            size[i] += n
            if e.tag == "a":
                linked[i] = size[i]
            if e.parent >= 0:
                size[e.parent] += size[i]
                linked[e.parent] += linked[i]
    top, value = 0, 0.3 * size[0]
    depth = [0] * len(tree)
    for i, e in enumerate(tree[1:], 1):
        depth[i] = depth[e.parent] + 1
        if kept[i] and e.tag in CONTAINERS and size[i]:
            bonus = 1.0 + 1.5 * (e.tag in ("article", "main")) + 0.5 * bool(GOOD_NAMES.search(e.names)) - 0.2 * (e.tag == "body")
            score = (size[i] - linked[i]) * bonus * (1 + 0.02 * min(depth[i], 10))
            if score > value:
                top, value = i, score
    return top


def block_texts(tree: list[Element], roots: list[int]) -> list[str]:
    """The text of each block below these elements, in page order; elements that are left out do not part blocks unless they
    are blocks themselves."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        if current:
            got = WHITE.sub(" ", entities.unescape("".join(current))).strip()
            if got:
                out.append(got)
            current.clear()

    for root in roots:
        flush()
        stack: list = [iter(tree[root].parts)]
        tags = [tree[root].tag]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                if tags.pop() in BLOCKS:
                    flush()
            elif isinstance(x, str):
                current.append(x)
            else:
                e = tree[x]
                if e.tag in BLOCKS:
                    flush()
                if not e.skipped:
                    stack.append(iter(e.parts))
                    tags.append(e.tag)
        flush()
    return out


def extract(page: str, winner: str | None = None) -> str:
    """The main text, from the elements on the winning path, or else from the page's own best container."""
    tree = parse(page)
    got = block_texts(tree, on_path(tree, winner)) if winner else []
    return " ".join(got or block_texts(tree, [best(tree)]))


def host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host, winner: the path with most votes of the host's pages; of equally many the first in order."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page in b.column("html"):
                tree = parse(page.as_py() or "")
                out.append(path(tree, best(tree)))
            yield pa.record_batch([b.column("host"), pa.array(out, pa.string())], ["host", "winner"])

    votes = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(C.tidied(vote), "host string, winner string")
    counted = votes.where("winner <> ''").groupBy("host", "winner").count()
    first = W.partitionBy("host").orderBy(F.desc("count"), "winner")
    return counted.withColumn("place", F.row_number().over(first)).where("place = 1").select("host", "winner")


def extract_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. The winning paths, a row for each host, are written to folder; Spark joins
    them by broadcast if their files are below its threshold, else by a sorted join that splits hot hosts."""
    winners = C.staged(winning_paths(pages, html_col, url_col), folder, "winners")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "html"):
            text = [extract(page.as_py() or "", w) for page, w in zip(b.column("html"), b.column("winner").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winner").mapInArrow(C.tidied(run), f"page_id {kinds[id_col]}, url string, text string, n_chars long")
