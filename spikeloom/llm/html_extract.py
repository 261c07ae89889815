"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template. Every page is read as tokens: tags with their role (the path of
elements above them), and whole text blocks with theirs. A token's occurrence vector is how often it
occurs on each page of the host; it is never materialised: two sums of hashes of (page, count) stand
for it, so that vectors combine on the map side and a host of any size needs only one row a token.
Tokens of a host with the same vector are an equivalence class. Classes that are large (at least
`CLASS_TOKENS`) and frequent (at least `SUPPORT_PAGES` pages and half of the host's) make up the
host's template; on a page, its tags in the order and nesting they are met in bound the slots.

What remains between them are slots with data. Blocks that the template itself holds are left out, in
an article too. Then the elements are a check: data outside an article (or main) element goes where
there is one that holds at least a third of the page's data, and an article that the template would
take more than half of (copies of one article on a host) stays whole. On other pages all slots with
data are joined in page order, but for those that consist of links mostly and hold no block of a role
that the others have. Menus, page headers, footers, sidebars, forms, scripts and styles are left out by
their elements. Names of containers tell adverts, notices, side matter and reader comments: plain ones
(`comments`, `ad`, `cookie-notice`) everywhere, in an article as whole names alone; longer ones there
(`menu-planning`) and those that an article may use for its own parts (`side`, `related`, `share`)
only outside an article, or in it where the template holds the container.
Names of headings, paragraphs and other text elements say nothing. A page of template blocks alone
keeps them.

Defined results: null or empty html gives an empty text; a null url is a host of its own; unclosed
elements end where their parent or, for paragraphs and list items, their successor begins; pages are
taken whole; repeated rows count as pages of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import cut, keyed
from spikeloom.llm.url_filter import host_and_path

SUPPORT_PAGES = 3
CLASS_TOKENS = 3
#: Hosts' templates are broadcast up to so many tokens in all (16 MB); beyond, pages are joined to them in salted parts.
BROADCAST_TOKENS = 2_000_000
SALTS = 32

RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object")
VOID = {"br", "hr", "img", "input", "link", "meta", "source", "wbr", "area", "base", "col", "embed", "track"}
INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "small", "sub", "sup", "code", "mark", "abbr", "cite", "q", "font", "big", "tt", "kbd", "var", "samp", "time", "label", "del", "ins", "bdi", "bdo", "dfn", "data", "wbr"}
LEFT_OUT = {"head", "title", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "canvas", "audio", "video", *RAW}
MAIN = {"article", "main"}
#: Left open, these end where an article begins; others that are left out, if the page doesn't close them all.
OPEN_ENDED = ("head", "nav", "header", "form", "menu")
#: Elements that hold text and each other alone: any other element but inline ones ends them.
PHRASES = ("button", "select", "option")
#: An open one of these ends where its like, or any of the listed elements, begins.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements of running text: their class names say nothing about what they hold.
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption", "caption", "article", "main", "body", "html", *INLINE}
#: Class names and ids of what isn't the article: alone, or first or last in a name with hyphens.
PLAIN = r"ads?|advert\w*|sponsor\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|comments?|replies|disqus|newsletter|subscribe|signup|login|footer|masthead|toolbar|pagination|pager"
OTHER = re.compile(rf"(?:^|\s)(?:(?:{PLAIN})(?:[_-]\S*)?|\S*[_-](?:{PLAIN}))(?:$|\s)", re.I)
#: The same in an article, where a longer name may be that of its subject: the whole name only.
OTHER_WHOLE = re.compile(rf"(?:^|\s)(?:{PLAIN})(?:$|\s)", re.I)
#: Names that an article may give to its own parts: alone only.
MAYBE = re.compile(r"(?:^|\s)(?:side|banner|promo\w*|notices?|alert|popup|modal|overlay|share|sharing|social|related|recommended|widget\w*)(?:$|\s)", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:site-?header|page-?header|header|topbar)(?:$|[\s_-])", re.I)

#: Comments, raw elements with their content, declarations, tags; possessive, so that broken markup
#: costs no more than intact one. Quoted values may hold < and >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^<>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*+>"
    r"|</(?P<close>[a-zA-Z][^\s<>/]*+)[^<>]*+>"
    r"|<(?P<open>[a-zA-Z][^\s<>/]*+)(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Block:
    """A text block: its role, whether it is left out, in an article, and nothing but links; `maybe` has
    the tags above it, in an article, whose names may say that it is none of the article."""

    __slots__ = ("role", "out", "main", "maybe", "linked", "text", "at")

    def __init__(self, role: int, out: bool, main: bool, maybe: tuple[int, ...], linked: bool, text: str, at: int):
        self.role, self.out, self.main, self.maybe, self.linked, self.text, self.at = role, out, main, maybe, linked, text, at


def _hash(role: int, token: str) -> int:
    """A token of 63 bits; the role is the hash of the path of elements above it."""
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"), seed=role) >> 1


def read(page: str | None) -> tuple[list[int], list[Block]]:
    """The tags with their roles, and the text blocks; a block's `at` is how many tags come before."""
    tags: list[int] = []
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool, bool, bool, tuple[int, ...]]] = [("", 0, False, False, False, ())]  # element, role, left out, in an article, in a link, maybe
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are
    solid: list[int] = []  # where in the stack are elements that aren't inline
    pending: list[str] = []
    linked = True  # so far, all of the pending text

    def add(text: str) -> None:
        nonlocal linked
        pending.append(entities.unescape(text))
        linked = linked and (stack[-1][4] or text.isspace())

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            _, role, out, main, _, maybe = stack[-1]
            blocks.append(Block(role, out, main, maybe, linked, text, len(tags)))
        linked = True

    def shut(until: int) -> None:
        if solid and solid[-1] >= until:
            flush()
        while solid and solid[-1] >= until:
            solid.pop()
        for name, *_ in stack[until:]:
            places[name].pop()
        del stack[until:]

    source, end = page or "", 0

    @lru_cache(maxsize=None)
    def unclosed(name: str) -> bool:
        """Whether the page opens more of these elements than it closes."""
        return len(re.findall(rf"<{name}\b", source, re.I)) > len(re.findall(rf"</{name}\b", source, re.I))

    for m in TOKEN.finditer(source):
        if m.start() > end:
            add(source[end : m.start()])
        end = m.end()
        if name := m["close"]:
            name = name.lower()
            if places[name]:
                shut(places[name][-1])
                tags.append(_hash(stack[-1][1], f"/{name}"))
            if name not in INLINE:
                flush()
        elif name := m["open"]:
            name = name.lower()
            if name == "br":
                pending.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name not in INLINE:
                flush()
                for phrase in PHRASES:  # these hold no other element
                    if places[phrase] and name not in PHRASES:
                        shut(places[phrase][0])
                if solid and ((above := stack[solid[-1]][0]) == "p" or name in CLOSED_BY.get(above, ())):  # what this element ends
                    shut(solid[-1])
                if name in MAIN:  # a menu or form left open doesn't swallow the article
                    still = [places[x][0] for x in OPEN_ENDED if places[x]] + [places[x][0] for x in LEFT_OUT if places[x] and unclosed(x)]
                    if still:
                        shut(min(still))
            _, role, out, main, link, maybe = stack[-1]
            named = " ".join(a or b or c for _, a, b, c in NAMES.findall(m["attributes"] or "")) if m["attributes"] else ""
            role = _hash(role, f"{name} {named}")
            main = main or name in MAIN
            out = out or name in LEFT_OUT or not main and name == "header"
            if named and name not in TEXT:
                if main:
                    out = out or bool(OTHER_WHOLE.search(named))
                    if MAYBE.search(named) or OTHER.search(named):
                        maybe = (*maybe, role)
                else:
                    out = out or bool(OTHER.search(named) or HEADER.search(named) or MAYBE.search(named))
            tags.append(role)
            places[name].append(len(stack))
            if name not in INLINE:
                solid.append(len(stack))
            stack.append((name, role, out, main, link or name == "a", maybe))
    if end < len(source):
        add(source[end:])
    flush()
    return tags, blocks


def block_token(block: Block) -> int:
    return _hash(block.role, f"= {block.text}")


def main_text(page: str | None, template: set[int]) -> str:
    """The main text of a page whose host has this template."""
    tags, blocks = read(page)
    free = [b for b in blocks if not b.out and template.isdisjoint(b.maybe)]
    data = [b for b in free if block_token(b) not in template] or free
    inside, article = [b for b in data if b.main], [b for b in free if b.main]
    weigh = lambda some: sum(len(b.text) for b in some)
    if 2 * weigh(inside) < weigh(article):
        inside = article  # copies of one article look like a template
    if weigh(b for b in data if not b.main and not b.linked) > 2 * weigh(inside):
        inside = []  # the element holds something else: a teaser, say
    if not inside:  # slots lie between tags of the template
        bounds, slot = [], 0
        for t in tags:
            bounds.append(slot)
            slot += t in template
        bounds.append(slot)
        weight: Counter[int] = Counter()
        for b in data:
            weight[bounds[b.at]] += -len(b.text) if b.linked else len(b.text)
        roles = {b.role for b in data if weight[bounds[b.at]] > 0}
        inside = [b for b in data if weight[bounds[b.at]] > 0 or b.role in roles] or data
    return " ".join(b.text for b in inside)


def page_tokens(pages: pd.Series) -> pd.Series:
    """How often each token occurs on the page; token -1 stands for the page itself."""
    out = []
    for page in pages:
        tags, blocks = read(page)
        counts = Counter(tags)
        counts.update(map(block_token, blocks))
        out.append([(-1, 1), *counts.items()])
    return pd.Series(out)


def templates(pages: DataFrame) -> DataFrame:
    """host and template (an array of tokens); needs host, page_id and html."""
    rows = pages.select("host", "page_id", F.inline(F.pandas_udf(page_tokens, "array<struct<token:long,n:int>>")("html")))
    vector = F.xxhash64("page_id", "n")
    half = F.lit((1 << 30) - 1)
    vectors = rows.groupBy("host", "token").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("total"),
        F.sum(vector.bitwiseAND(half)).alias("v1"),
        F.sum(F.shiftrightunsigned(vector, 30).bitwiseAND(half)).alias("v2"),
    )
    frequent = vectors.filter((F.col("pages") >= SUPPORT_PAGES) | (F.col("token") == -1))
    frequent = cut(frequent)
    sizes = frequent.filter("token = -1").select("host", F.col("pages").alias("host_pages"))
    joined = frequent.filter("token <> -1").join(sizes, "host").filter("2 * pages >= host_pages")
    classes = joined.groupBy("host", "pages", "total", "v1", "v2").agg(F.collect_list("token").alias("tokens")).filter(F.size("tokens") >= CLASS_TOKENS)
    return classes.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("template"))


def extracted(pages: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([main_text(p, set() if t is None else set(t)) for p, t in zip(pages, known)], dtype=object)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = keyed(pages, page_id=page_id, url=url, html=html).withColumn("host", host_and_path(F.col("url"))[0])
    known = cut(templates(rows))
    if (known.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_TOKENS:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        parts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(parts, ["host", "salt"], "left")
    found = joined.select("page_id", "url", F.pandas_udf(extracted, "string")("html", "template").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
