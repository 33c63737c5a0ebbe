"""Main text of web pages by composite text density.

Each page is parsed into a tree; menus, notices, forms, comments and the like go by tag
and by name. Every remaining node has a density: characters per tag, adjusted for the
characters and tags of its links. The densities of a node's children are summed, and the
node with the largest sum holds the article. Other parts of the page belong to it if
they are at least as dense as the sparsest node on the way from there up to the body.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Element names of the HTML standard by their role.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript textarea title".split())
HIDDEN = set(
    "script style head title noscript noframes noembed template iframe object embed svg math canvas audio video map "
    "nav footer aside form button select option optgroup textarea input label fieldset dialog menu datalist".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Reader comments are often articles themselves; their holders stay noise.
LISTED = re.compile(r"comment|repl(?:y|ies)|respon|discuss|disqus|feedback|related|recommend|similar|teaser|promo|sponsor|\bads?\b|advert|hidden|none")
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag ends an open element of these names, unless one of the second set is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Names in class, id or role that mark parts beside the article.
NOISE = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adverts?|advertis\w*|adsense|adslot|banner|sponsor\w*|promo\w*|commercial|teaser|"
    r"nav|navbar|navigation|menu\w*|breadcrumbs?|crumbs|pager|pagination|toc|masthead|topbar|toolbar|"
    r"siteheader|footer|sitefooter|colophon|copyright|legal|sidebar\w*|side|aside|rail|widget\w*|"
    r"cookies?|consent|gdpr|notice|notices|alert|disclaimer|popup|modal|overlay|paywall|"
    r"comments?|commentlist|replies|reply|responses|discussion|disqus|respond|feedback|"
    r"share|sharing|social|follow|related|recommend\w*|recirc|similar|popular|trending|"
    r"newsletter|subscribe|subscription|signup|login|search|form|contentinfo|complementary|tags?|skip|hidden)"
    r"(?:$|[\s_\-])"
)
#: ``header`` marks the site's head unless the name says whose head it is; "has-sidebar" is said of a whole layout.
SITE_HEAD = re.compile(r"(?:^|[\s_\-])header(?:$|[\s_\-])")
OWN_HEAD = re.compile(r"article|post|entry|story|content|section|title|headline")
LAYOUT = re.compile(r"(?:has|with|no|without)[_\-]\w+|\w+[_\-](?:layout|wrapper|page|template|enabled|on|open|closed)(?=$|\s)")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

PIECE = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""(?:^|\s|["'])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "name", "up", "parts", "noise", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, up: "Node | None", noise: bool = False, name: str = ""):
        self.tag, self.up, self.noise, self.name = tag, up, noise, name
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0

    def nodes(self):
        return [p for p in self.parts if type(p) is Node]


def is_noise(tag: str, attrs: str) -> bool:
    if tag in HIDDEN:
        return True
    if tag in ("html", "body", "main", "article") or not attrs:
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            return True
        if name in ("class", "id", "role"):
            value = LAYOUT.sub(" ", CAMEL.sub("-", value).lower())
            if NOISE.search(value) or (SITE_HEAD.search(value) and tag not in HEADINGS and not OWN_HEAD.search(value)):
                return True
    return False


def parse(source: str) -> Node:
    """The tree of a page; end tags may be missing, crossed or too many, the end cut off."""
    root = Node("#root", None)
    at, stack = root, {"#root": 1}
    pos, size, lower = 0, len(source), None

    def leave(node: Node) -> Node:
        stack[node.tag] -= 1
        return node.up

    while pos < size:
        m = PIECE.search(source, pos)
        text = source[pos : m.start()] if m else source[pos:]
        if text:
            at.parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        tag = name.lower()
        if m["end"] or m["end2"]:
            if stack.get(tag):
                while at.tag != tag:
                    at = leave(at)
                at = leave(at)
            elif tag == "p":
                at.parts.append(" ")
            continue
        if tag in CLOSES_P and stack.get("p") and not blocked(at, "p"):
            while at.tag != "p":
                at = leave(at)
            at = leave(at)
        if tag in ENDS:
            names, stop = ENDS[tag]
            while (found := nearest(at, names, stop)) is not None:
                while at is not found:
                    at = leave(at)
                at = leave(at)
        elif tag in HEADINGS and at.tag in HEADINGS:
            at = leave(at)
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag == "html" or (tag == "body" and stack.get("body")):
            continue
        noise = is_noise(tag, attrs)
        node = Node(tag, at, noise, attrs.lower() if noise else "")
        at.parts.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            lower = lower or source.lower()
            end = lower.find("</" + tag, pos) if len(lower) == size else -1
            if end < 0:
                found = re.compile("</" + tag, re.I).search(source, pos)
                end = found.start() if found else size
            stop = source.find(">", end)
            pos = size if stop < 0 else stop + 1
            continue
        at = node
        stack[tag] = stack.get(tag, 0) + 1
    return root


def nearest(at: Node, names: set[str], stop: set[str]) -> Node | None:
    while at is not None and at.tag not in stop:
        if at.tag in names:
            return at
        at = at.up
    return None


def blocked(at: Node, tag: str) -> bool:
    """Whether a table cell or the like lies between here and the open ``tag``."""
    while at is not None and at.tag != tag:
        if at.tag in ("td", "th", "table", "caption", "button", "object"):
            return True
        at = at.up
    return at is None


def order(root: Node) -> list[Node]:
    """Nodes from parents to children, without what is noise."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.noise:
            out.append(node)
            todo.extend(reversed(node.nodes()))
    return out


def mark_headers(nodes: list[Node]) -> None:
    """A header outside articles is the site's; inside one, its headings are the article's."""
    for node in nodes:
        if node.tag == "header":
            up = node.up
            while up is not None and up.tag not in ("article", "main"):
                up = up.up
            if up is None:
                node.noise = True
                continue
            for child in node.nodes():
                child.noise = child.noise or not (child.tag in HEADINGS or any(n.tag in HEADINGS for n in order(child)))


def keep_holders(root: Node) -> None:
    """What holds the page's ``main`` or its articles is no noise, whatever its name."""
    todo = [root]
    while todo:
        node = todo.pop()
        todo.extend(node.nodes())
        if node.tag in ("article", "main") and not node.noise:
            up, way = node.up, []
            while up is not None and not (up.noise and (up.tag in HIDDEN or LISTED.search(up.name))):
                way.append(up)
                up = up.up
            if up is None:
                for n in way:
                    n.noise = False


def drop_menus(nodes: list[Node]) -> None:
    """Lists and boxes that consist of three links or more are menus, whatever their name."""
    for node in nodes:
        if node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.link_tags >= 3 and node.link_chars >= 0.9 * node.chars:
            node.noise = True


def density(node: Node, body_link: float) -> float:
    """Characters per tag, adjusted for links; ``body_link`` is the share of link characters in the page."""
    c, t = node.chars, max(1, node.tags)
    lc, lt = node.link_chars, node.link_tags
    if lc >= c:
        return 0.0
    # links count against a node: the logarithm's base grows with their share, its argument falls
    base = math.log(c / max(1, c - lc) * lc + body_link * c + math.e)
    return c / t * math.log(c / max(1, lc) * t / max(1, lt) + 1) / math.log(base + 1)


def add_up(node: Node) -> None:
    """Counts of a node from those of its parts."""
    node.chars = node.tags = node.link_chars = node.link_tags = 0
    for part in node.parts:
        if type(part) is Node:
            if part.noise:
                continue
            node.chars += part.chars
            node.tags += part.tags + 1
            node.link_chars += part.link_chars
            node.link_tags += part.link_tags + (part.tag == "a")
        else:
            node.chars += len("".join(part.split()))
    if node.tag == "a":
        node.link_chars, node.link_tags = node.chars, node.tags + 1


def measure(nodes: list[Node]) -> None:
    """Densities and their sums, from the leaves up."""
    for node in reversed(nodes):
        add_up(node)
    body = nodes[0]
    body_link = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars:
            node.density = density(node, body_link)
    for node in nodes:
        node.sum = sum(child.density for child in node.nodes() if not child.noise and child.tag not in INLINE)


def article(root: Node) -> list[Node]:
    """The subtrees that make up the article, in page order."""
    keep_holders(root)
    mark_headers(order(root))
    nodes = order(root)
    measure(nodes)
    drop_menus(nodes)
    nodes = order(root)
    measure(nodes)
    best = max(nodes, key=lambda n: n.sum)
    if best.sum <= 0:
        return [root]
    up, named = best, None
    while up is not None:
        if up.tag in ("article", "main"):  # what the page itself calls its article
            named = named or up
            if up.tag == "main" or not alone(up):
                named = up if up.tag == "main" else named
        up = up.up
    if named is None:  # the densest box may also hold more than the article
        inside = [n for n in order(best) if n.tag in ("article", "main") and 5 * n.chars >= 2 * best.chars]
        named = inside[0] if inside else None
    if named is not None:
        return siblings(named)
    way, up = [], best
    while up is not None and up.tag not in ("#root", "html"):
        way.append(up)
        up = up.up
    least = min((n.density for n in way), default=0.0)
    top = best
    while top.up is not None and top.up.tag not in ("body", "html", "#root"):
        if any(n is not top and not n.noise and n.chars and 2 * n.link_chars >= n.chars for n in top.up.nodes()):
            break  # a box with menus beside the article is the page's layout
        top = top.up
    if top.up is None or top.tag in ("body", "html"):
        return [top]
    # a run of bare text has no box whose size adds to its density: as many characters per link as per tag on the way will do
    plain = min((n.chars / max(1, n.tags) for n in way), default=0.0)
    return [n for n in blocks(top, nodes[0]) if n is top or (not n.noise and n.chars and (
        n.tag in HEADINGS or n.density >= least or (n.tag == RUN and n.chars / max(1, n.link_tags) >= plain)) and 2 * n.link_chars < n.chars)]


#: The tag of a run of bare text and inline elements between the blocks of a box.
RUN = "#run"


def blocks(top: Node, body: Node) -> list[Node]:
    """``top`` and what is beside it in page order, each run of bare text and inline elements as a node of its own."""
    out: list[Node] = []
    for part in top.up.parts:
        if type(part) is Node and (part is top or any(n.tag not in INLINE and n.tag not in ("br", "wbr", "img") for n in order(part))):
            out.append(part)
            continue
        if not out or out[-1].tag != RUN:
            out.append(Node(RUN, top.up))
        out[-1].parts.append(part)
    for node in out:
        if node.tag == RUN:
            add_up(node)
            node.density = density(node, body.link_chars / max(1, body.chars))
    return out


def alone(node: Node) -> bool:
    """Whether no article stands beside this one."""
    return not any(n is not node and n.tag == node.tag and not n.noise for n in node.up.nodes())


def siblings(node: Node) -> list[Node]:
    """The article; several beside each other in one box belong together."""
    if node.tag == "main" or node.up is None:
        return [node]
    return [n for n in node.up.nodes() if n.tag == "article" and not n.noise and n.chars] or [node]


def text_of(tops: list[Node]) -> str:
    """Blocks in page order, white space inside them and between them one space."""
    out: list[str] = []
    todo: list[Node | str | None] = list(reversed(tops))
    while todo:
        part = todo.pop()
        if part is None:
            out.append(" ")
        elif type(part) is str:
            out.append(part)
        elif not part.noise:
            block = part.tag not in INLINE
            if block:
                out.append(" ")
                todo.append(None)
            todo.extend(reversed(part.parts))
    return " ".join("".join(out).split())


def main_text(source: str | None) -> str:
    """The article of one page; empty for a page that is NULL or has none."""
    if not source:
        return ""
    return text_of(article(parse(source)))


@F.pandas_udf(StringType())
def main_text_udf(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """``keep`` columns with text and n_chars (code points), one row per page row.

    NULL and empty pages give an empty text; pages without markup are taken as one text;
    repeated rows stay; columns not in ``keep`` are left out, so none can clash.
    """
    rows = pages.select(*[F.col(f"`{k}`") for k in keep], main_text_udf(F.coalesce(F.col(f"`{html}`"), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
