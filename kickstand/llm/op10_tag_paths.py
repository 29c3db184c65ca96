"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block tags and their class names. Per path, text
outside links and punctuation are summed and divided by the number of blocks that bear the path. Both ratios are
smoothed over neighbouring blocks in page order and fused with the share of text outside links to a score; a
path counts as content when its best block reaches a share of the page's highest score. The element that holds most of
the text of these paths, as far down as one does, is the article's container: its blocks are the main text, but for
those made of links. So a heading or a short closing line comes with the paragraphs it stands among.

Elements that are no article by their meaning (navigation, page footers and headers, asides, forms) never compete. All
other marks are one factor of a block's score: `article` and `main` raise it (MARKED), a class, id or role that tells
of a menu, sidebar, notice, advert or reader comments lowers it (NAMED), for the element and what it holds; a part of the
container that is lowered against the container is left out. Names that tell of a layout (`with-sidebar`, `has-header`) or of an
article's own header lower nothing.

Null or empty html gives an empty text. Unclosed tags close as browsers close them; a page that is cut off
ends there; markup that never ends is dropped. Work is linear in the page, however deep elements nest. A page is one
row and independent of all others; repeated rows give repeated rows; extra columns are ignored.
"""

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa

OUT = "page_id long, url string, text string, n_chars long"
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CLASS = re.compile(r"""class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Element names by their part in a page.
_BLOCKS = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary center hr menu dialog "
    "search template hgroup legend option select".split()
)
_RAW = frozenset("script style noscript template iframe textarea title svg select button noembed".split())
_NEVER = frozenset("nav footer aside form head menu dialog search".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adsense banner sponsor sponsored promo promotion nav navigation "
    "navbar menu menus sidebar sidebars aside footer header masthead breadcrumb breadcrumbs comment comments commentlist disqus "
    "reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget toolbar pagination pager copyright legal "
    "disclaimer complementary contentinfo".split()
)
_ARTICLE = frozenset(["article", "main"])
#: Words that make of a cue a property of the whole, and words that make of a header the article's own.
_LAYOUT = frozenset("has with no without".split())
_OF_ARTICLE = frozenset("article entry post story content title".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre caption figcaption".split())
_TABLE_CELLS = frozenset(["td", "th"])
#: An opening tag on the left ends an open element of the right, up to the nearest container.
_ENDS = {
    **dict.fromkeys(_BLOCKS - {"option", "legend", "summary"}, ("p",)),
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "option": ("option",),
}
_HOLDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}
_MARKS = re.compile(r"[.,;:!?…。，、！？;:।؟،]")
SMOOTHING = (0.25, 0.5, 0.25)
THRESHOLD = 0.35
LINKED = 0.9
#: Factors of marks and names, and the share of the content's text that an element holds to be its container.
MARKED, NAMED, CONTAINER = 4.0, 0.05, 0.6


class Node:
    """An open block element: its place among the page's elements, its path, and what its marks make of it."""

    __slots__ = ("place", "parent", "tag", "path", "around", "barred", "marked", "weight")

    def __init__(self, place, parent, tag, path, around, barred, marked, weight):
        self.place, self.parent, self.tag, self.path, self.around = place, parent, tag, path, around
        self.barred, self.marked, self.weight = barred, marked, weight


class Block:
    """A text, how much of it stands in links, its marks, and the innermost element around it."""

    __slots__ = ("node", "text", "linked", "marks")

    def __init__(self, node, text, linked):
        self.node, self.text, self.linked = node, text, linked
        self.marks = len(_MARKS.findall(text))


def _words(attrs):
    """The words of each class, id or role."""
    if "=" not in attrs:
        return []
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).split()
    return [set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) for name in names]


def _heads_article(words):
    return any("header" in held and not _OF_ARTICLE.isdisjoint(held) for held in words)


def _named_by(tag, words, marked):
    """Whether a class, id or role tells that an element is no article."""
    if tag in ("html", "body", "article", "main") and not (tag == "article" and marked):
        return False
    for held in words:
        cues = held & _CUES if _LAYOUT.isdisjoint(held) else set()
        if cues - {"header"} or cues and not marked and _OF_ARTICLE.isdisjoint(held):
            return True
    return False


def _step(tag, attrs):
    """An element's step in a path: its tag and its class names."""
    found = _CLASS.search(attrs) if "=" in attrs else None
    return tag, " ".join(sorted((found[1] or found[2] or found[3] or "").split())) if found else ""


def blocks_of(page):
    """Blocks of a page in order, and its elements, parents first; a block is the text between two block-level tags."""
    root = Node(0, None, "", 0, None, False, False, 1.0)
    out, nodes, stack, open_ = [], [root], [root], Counter()
    paths = {}
    held, linked, links = [], 0, 0
    at, end = 0, len(page)

    def flush():
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(stack[-1], text, min(linked, len(text))))
        held.clear()
        linked = 0

    def say(raw):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        held.append(text)
        if links:
            linked += len(text.strip())

    def cut(i):
        open_.subtract(node.tag for node in stack[i:])
        del stack[i:]

    def close(tag):
        if open_[tag] > 0:
            cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))

    def begin(tag, attrs):
        up = stack[-1]
        words = _words(attrs)
        barred = up.barred or tag in _NEVER or tag == "header" and not up.marked and not _heads_article(words)
        weight = up.weight
        if tag in _ARTICLE and not up.marked:
            weight *= MARKED
        if _named_by(tag, words, up.marked):
            weight *= NAMED
        # a wrapper of the article's own header is no step of the path: its title stands beside the paragraphs
        path = up.path if tag in ("div", "header") and _heads_article(words) else paths.setdefault((up.path, _step(tag, attrs)), len(paths) + 1)
        stack.append(Node(len(nodes), up, tag, path, up.path, barred, up.marked or tag in _ARTICLE, weight))
        nodes.append(stack[-1])
        open_[tag] += 1

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        if token.start() > at:
            say(page[at : token.start()])
        at = token.end()
        tag = token["open"]
        if tag is not None:
            tag = tag.lower()
            attrs = token["attrs"]
            if tag in _RAW:
                if tag in _BLOCKS or tag == "title":
                    flush()
                if not attrs.endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                    at = stop.end() if stop else end
            elif tag == "br":
                held.append(" ")
            elif tag in _BLOCKS:
                flush()
                links = 0
                holders, ends = _HOLDS.get(tag, ()), _ENDS.get(tag, ())
                if any(open_[e] > 0 for e in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in holders or stack[i].tag in _TABLE_CELLS and tag not in ("td", "th", "tr"):
                            break
                        if stack[i].tag in ends:
                            cut(i)
                            if not any(open_[e] > 0 for e in ends):
                                break
                if tag not in _VOID:
                    begin(tag, attrs)
            elif tag == "a":
                links = 1
        elif token["close"] is not None:
            tag = token["close"].lower()
            if tag in _BLOCKS:
                flush()
                links = 0
                close(tag)
            elif tag == "a":
                links = 0
    flush()
    return out, nodes


def _smooth(values):
    out = []
    for i in range(len(values)):
        near = [(values[j], w) for j, w in zip(range(i - 1, i + 2), SMOOTHING, strict=True) if 0 <= j < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def path_scores(blocks):
    """Score of each path: its ratios of text and punctuation, smoothed and fused, its share of text outside links, and
    the weight of its marks."""
    sums = defaultdict(lambda: [0, 0, 0, 0])
    for b in blocks:
        s = sums[b.node.path]
        s[0] += len(b.text) - b.linked
        s[1] += b.marks
        s[2] += 1
        s[3] += len(b.text)
    text = _smooth([sums[b.node.path][0] / sums[b.node.path][2] for b in blocks])
    marks = _smooth([sums[b.node.path][1] / sums[b.node.path][2] for b in blocks])
    scores = defaultdict(float)
    for b, t, m in zip(blocks, text, marks, strict=True):
        s = sums[b.node.path]
        # a path's own ratio counts as much as its neighbours': smoothing lends a short path no more than half
        own = s[0] / s[2]
        scores[b.node.path] = max(scores[b.node.path], math.sqrt(own * t) * (1 + math.log1p(m)) * s[0] / s[3] * b.node.weight)
    return scores


def _container(blocks, nodes, scores, least):
    """The innermost element that holds most of the text of the paths that reach the score `least`."""
    mass = [0.0] * len(nodes)
    for b in blocks:
        if scores[b.node.path] >= least:
            mass[b.node.place] += (len(b.text) - b.linked) * b.node.weight
    for node in reversed(nodes):
        if node.parent:
            mass[node.parent.place] += mass[node.place]
    wanted, best = CONTAINER * mass[0], nodes[0]
    # parents come first: the last element in line that holds enough is the innermost
    for node in nodes[1:]:
        if node.parent is best and mass[node.place] >= wanted:
            best = node
    # a paragraph is no container
    while best.tag in _LEAVES:
        best = best.parent
    return best


def content_blocks(blocks, nodes):
    """Those of a page's blocks that are its main text."""
    blocks = [b for b in blocks if not b.node.barred]
    scores = path_scores(blocks)
    top = max(scores.values(), default=0.0)
    if not top:
        return []
    best = _container(blocks, nodes, scores, THRESHOLD * top)
    inside = [False] * len(nodes)
    for node in nodes:
        inside[node.place] = node is best or node.parent is not None and inside[node.parent.place]
    good = {path for path, score in scores.items() if score >= THRESHOLD * top}
    # what stands beside a content path has the same path around it
    around = {b.node.around for b in blocks if b.node.path in good}
    out = []
    for b in blocks:
        if not inside[b.node.place] or b.node.weight < best.weight or b.linked > LINKED * len(b.text) and b.node.path not in good:
            continue
        # the page as a whole is no article: there a path has to be content or stand beside it
        if best.tag in ("", "html", "body") and b.node.path not in good and b.node.around not in around:
            continue
        out.append(b)
    return out


def main_text(page):
    return "\n\n".join(b.text for b in content_blocks(*blocks_of(page or "")))


def extract(pages):
    """page_id, url, text and n_chars of every page (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"].cast(pa.int64()), batch["url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, OUT)
