"""Main text of web pages by composite text density.

A page is parsed into its element tree in one pass. Every element gets a composite density: characters per tag, adjusted
by the share of characters and tags in links, against that share in the whole body. What an element calls itself (by
tag, class, id or role) and what a short block says are features: they lower the density of the element and of all
within it by a factor, and do nothing else. The element with the largest sum of its children's densities is the centre
of the article. The smallest density on the path from there up to the body is the threshold:

* In the centre, what is named, worded or linked like boilerplate stays only if its density, lowered as it is, reaches the
  geometric mean of the threshold and the centre's density, as that of a long paragraph does; all other text stays,
  however short.
* Beside the path, subtrees have to reach the threshold, and with their sum of densities a share of the centre's. In an
  article or main element that holds the centre, the share isn't asked for. Headings pass if they aren't links.

A wrapper that is named like boilerplate lowers all densities in it alike, and so changes nothing between them.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm.batches import bounded

_NAME = re.compile(r"</?([a-zA-Z][^\s/><]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\s(hidden)(?=[\s/>])""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split())
#: A start tag closes these open elements, up to the nearest of the second group.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
_SCOPE = frozenset("html body table td th caption button object article section div main".split())
#: Contents are not markup; they run up to the element's own end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Without visible text of the page.
_NEVER = frozenset("script style noscript template textarea title head button select option input iframe svg math canvas object xmp noembed noframes audio video".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags, names and roles that are hardly ever the article's, and others that can be.
_STRONG_TAGS = frozenset("nav footer aside form dialog menu".split())
_STRONG = frozenset("""ad ads adv advert adverts advertisement advertising adslot adsense breadcrumb breadcrumbs captcha comment comments
 cookie cookies consent disqus footer gdpr masthead menu menus nav navbar navigation navi newsletter pagination pager pingback
 reply replies respond sidebar signin signup login sponsor sponsored subscribe subscription toc toolbar topbar trackback
 alertdialog contentinfo form menubar""".split())
_WEAK = frozenset("""alert banner banners complementary copyright disclaimer dialog header hidden modal notice notices notification overlay
 popup promo promotion recommended related search share sharing skip social tags teaser widget widgets""".split())
FACTORS = {"strong": 0.05, "weak": 0.2, "worded": 0.2}
#: The centre's sum of densities, of which what stands beside its path needs this share.
SHARE = 0.15
#: First parts of a class that tell of a page's state or layout, and last parts that say nothing of the contents.
_STATES = frozenset("has have is with without no not show hide shows hides can js".split())
_PLAIN = frozenset("area block bottom box container group inner item items left links list outer placeholder posts right section slot top unit wrap wrapper x".split())
#: Wordings of notices and adverts, fixed; they count in blocks of at most so many characters that aren't set like the others.
_WORDED = re.compile(r"\b(?:cookies?|privacy|consent|newsletter|subscribe|sign up|log in|advertis\w*|sponsored|all rights reserved|accept all|click here|buy now|special offer)\b", re.I)
_SHORT = 400


class _Tree:
    """Elements in page order, as parallel lists; ``pieces`` are (node, text, block) in page order."""

    __slots__ = ("tag", "parent", "factor", "hidden", "pieces", "body")

    def __init__(self) -> None:
        self.tag, self.parent, self.factor, self.hidden = ["#page"], [-1], [1.0], [False]
        self.pieces: list[tuple[int, str, int]] = []
        self.body = 0


def _name_of(token: str) -> str:
    """What a class or an id calls the element itself: the whole of it, or the last part that says something."""
    if token.lower() in _STRONG or token.lower() in _WEAK:
        return token.lower()
    parts = [p.lower() for p in _PART.findall(token)]
    if any(p in _STATES for p in parts):
        return ""
    while len(parts) > 1 and (parts[-1] in _PLAIN or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] if parts and parts[-1] != "hidden" else ""


def _factor(tag: str, source: str, in_article: bool) -> float:
    """By how much the density of an element counts: 0 if it is hidden, less than 1 if it is named like boilerplate."""
    if tag in ("html", "body", "article", "main"):
        return 1.0
    names = {"header"} if tag == "header" and not in_article else set()
    strong = tag in _STRONG_TAGS
    if len(source) > len(tag) + 3:
        for name, a, b, c, hidden in _ATTRIBUTE.findall(source):
            value, name = a or b or c, name.lower()
            if hidden or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return 0.0
            if name == "role":
                names.add(value.lower())
            elif name in ("class", "id"):
                names |= {_name_of(token) for token in value.split()}
    if in_article:
        names.discard("header")
    if strong or names & _STRONG or tag == "header" and "header" in names:
        return FACTORS["strong"]
    return FACTORS["weak"] if names & _WEAK else 1.0


class _Scanner:
    """Finds the end of tags. Every part of a page is read a bounded number of times, whatever the quotes."""

    def __init__(self, page: str):
        self.page, self.last, self.doomed = page, page.rfind(">"), set()
        self.quote = {q: page.rfind(q) for q in "\"'"}

    def end(self, start: int) -> int:
        """Behind the ``>`` of the tag that begins at ``start``, quoted ones aside if that leaves one."""
        at, seen = start + 1, []
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.end()
            if m.start() in self.doomed or self.quote[m[0]] <= m.start():
                break
            seen.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
        self.doomed.update(seen)  # from here on no scan ends
        return self.page.find(">", start) + 1


def parse(page: str) -> _Tree:
    tree, scanner = _Tree(), _Scanner(page)
    stack, blocks, skip = [0], 0, 0  # skip: depth of the stack at the element without visible text
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    scopes: list[int] = []
    in_article = 0

    def close(depth: int) -> None:
        nonlocal skip, in_article
        while len(stack) > depth:
            gone = tree.tag[stack.pop()]
            depths[gone].pop()
            if gone in _SCOPE:
                scopes.pop()
            in_article -= gone in ("article", "main")
        if skip and len(stack) <= skip:
            skip = 0

    def nearest(tag: str) -> int:
        return depths[tag][-1] if depths[tag] else 0

    pos, end = 0, len(page)
    while pos < end:
        at = page.find("<", pos)
        at = end if at < 0 else at
        if at > pos:
            if not skip:
                tree.pieces.append((stack[-1], page[pos:at], blocks))
            pos = at
            continue
        if page.startswith("<!--", pos):
            stop = page.find("-->", pos + 4)
            pos = end if stop < 0 else stop + 3
            continue
        if pos > scanner.last:  # no tag ends any more
            if not skip:
                tree.pieces.append((stack[-1], page[pos:], blocks))
            break
        named = _NAME.match(page, pos)
        stop = scanner.end(pos) if named else page.find(">", pos) + 1 if page[pos + 1 : pos + 2] in ("!", "?") else -1
        if stop < 0:
            if not skip:
                tree.pieces.append((stack[-1], "<", blocks))
            pos += 1
            continue
        source, start, pos = page[pos:stop], pos, stop
        if named is None:
            continue
        tag = named[1].lower()
        if tag not in _INLINE:
            blocks += 1
        if source[1] == "/":
            depth = nearest(tag)
            if depth and not (tag in _INLINE and scopes and scopes[-1] > depth):
                close(depth)
            continue
        if tag == "br":
            if not skip:
                tree.pieces.append((stack[-1], " ", blocks))
            continue
        if tag in _CLOSES_P and nearest("p") > (scopes[-1] if scopes else 0):
            close(nearest("p"))
        if tag in _CLOSES:
            closed, stops = _CLOSES[tag]
            limit = max(map(nearest, stops))
            open_ = [d[i] for d in (depths[c] for c in closed) if (i := bisect_right(d, limit)) < len(d)]
            if open_:
                close(min(open_) if tag == "tr" else max(map(nearest, closed)))
        if tag in _VOID or source.endswith("/>") and tag not in _RAW:
            if tag not in _INLINE:
                blocks += 1
            continue
        if tag in _RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            pos = (page.find(">", found.end()) + 1 or end) if found else end
            continue
        if not skip and tag in _NEVER:
            skip = len(stack)
        tree.tag.append(tag)
        tree.parent.append(stack[-1])
        tree.hidden.append(bool(skip))
        tree.factor.append(1.0 if skip else _factor(tag, source, bool(in_article)))
        depths[tag].append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        in_article += tag in ("article", "main")
        stack.append(len(tree.tag) - 1)
        if tag == "body" and not skip:
            tree.body = len(tree.tag) - 1
    return tree


def composite(chars: int, tags: int, links: int, link_tags: int, share: float) -> float:
    """Characters per tag, the less the more of both are in links, against the ``share`` of the body's characters in links."""
    if not chars:
        return 0.0
    base = log(chars * links / max(chars - links, 1) + share * chars + e)
    return chars / max(tags, 1) * log(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1) + 1) / log(base + 1)


class Densities:
    """Densities of all elements of a page, and their sums over children. ``pieces`` are decoded."""

    def __init__(self, tree: _Tree):
        self.tree = tree
        n, tag, parent = len(tree.tag), tree.tag, tree.parent
        self.pieces = [(node, entities.unescape(text) if "&" in text else text, block) for node, text, block in tree.pieces]
        self.chars, self.links, self.tags, self.link_tags, self.own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
        for node, text, _ in self.pieces:
            size = sum(map(len, text.split()))
            self.chars[node] += size
            self.own[node] += size
            self.links[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            if not tree.hidden[i]:
                p = parent[i]
                self.chars[p] += self.chars[i]
                self.links[p] += self.links[i]
                self.tags[p] += self.tags[i] + 1
                self.link_tags[p] += self.link_tags[i] + (tag[i] == "a")
        self.body = tree.body if self.chars[tree.body] else 0
        share = self.links[self.body] / max(self.chars[self.body], 1)
        self.factor = list(tree.factor)
        self._word()
        inherited = list(self.factor)
        for i in range(1, n):
            inherited[i] *= inherited[parent[i]]
        self.density = [f * composite(c, t, lc, lt, share) for f, c, t, lc, lt in zip(inherited, self.chars, self.tags, self.links, self.link_tags, strict=True)]
        self.sums = [0.0] * n
        for i in range(n - 1, 0, -1):
            self.sums[parent[i]] += self.density[i]
        for i in range(n):  # text of its own counts as a child of one tag
            if self.own[i] and tag[i] not in _INLINE:
                self.sums[i] += min(self.density[i], inherited[i] * composite(self.own[i], 1, 0, 0, share))

    def _word(self) -> None:
        """Lower the factor of short blocks that are worded like notices and aren't set like most of the text."""
        tree = self.tree
        block_of = [0] * len(tree.tag)
        set_as: dict[str, int] = defaultdict(int)
        said: dict[int, list[str]] = defaultdict(list)
        for i in range(1, len(tree.tag)):
            block_of[i] = block_of[tree.parent[i]] if tree.tag[i] in _INLINE else i
        for node, text, _ in self.pieces:
            if not text.isspace():
                set_as[tree.tag[block_of[node]]] += len(text)
                said[block_of[node]].append(text)
        usual = max(set_as, key=lambda t: (set_as[t], t), default="")
        for i, texts in said.items():
            if i and tree.tag[i] != usual and tree.tag[i] not in _HEADINGS and self.chars[i] <= _SHORT and _WORDED.search(" ".join(texts)):
                self.factor[i] = min(self.factor[i], FACTORS["worded"])


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines; '' for NULL, empty pages and pages without text.

    Of equal sums the element that comes first in the page is the centre.
    """
    if not page:
        return ""
    tree = parse(page)
    d = Densities(tree)
    n, tag, parent, body = len(tree.tag), tree.tag, tree.parent, d.body
    if not d.chars[0]:
        return ""
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parent[i]]
    best = max((i for i in range(n) if inside[i] and not tree.hidden[i] and tag[i] not in _INLINE), key=lambda i: (d.sums[i], -i))
    path = [best]
    while path[-1] != body:
        path.append(parent[path[-1]])
    threshold, on_path = min(d.density[p] for p in path), set(path)
    strict = (threshold * d.density[best]) ** 0.5
    marked = [p for p in path if tag[p] in ("article", "main")]
    top = next((p for p in marked if tag[p] == "article"), marked[-1] if marked else best)
    relaxed = [False] * n  # in the centre, or in the article that holds it
    relaxed[best] = relaxed[top] = True

    def suspect(i: int) -> bool:
        return d.factor[i] < 1 or 2 * d.links[i] > d.chars[i] and tag[i] not in _INLINE

    chosen = [False] * n
    chosen[best] = chosen[top] = True
    loose: dict[int, float] = defaultdict(float)  # sums of the single blocks right below each element of the path
    leaf = [True] * n
    for i in range(1, n):
        if tag[i] not in _INLINE:
            leaf[parent[i]] = False
    for i in range(body + 1, n):
        if parent[i] in on_path and leaf[i] and not suspect(i):
            loose[parent[i]] += d.density[i]
    for p in path:
        if d.own[p]:
            loose[p] += d.sums[p] if leaf[p] else 0.0
    for i in range(body + 1, n):
        p = parent[i]
        if not inside[i] or tree.hidden[i] or not d.factor[i]:
            continue
        relaxed[i] = relaxed[i] or relaxed[p]
        if chosen[i]:
            continue
        if i in on_path:
            chosen[i] = relaxed[i]
        elif chosen[p]:
            chosen[i] = d.density[i] >= strict or not suspect(i)
        elif p in on_path:
            weight = loose[p] if leaf[i] and not suspect(i) else d.sums[i]
            heading = tag[i] in _HEADINGS and not suspect(i)
            chosen[i] = heading or d.density[i] >= threshold and weight >= SHARE * d.sums[best]
    lines, block, parts = [], None, []
    for node, text, number in d.pieces:
        if not chosen[node] and not (node in on_path and d.own[node] and d.density[node] >= threshold and d.own[node] * 2 > d.chars[best]):
            continue
        if number != block and parts:
            lines.append(" ".join("".join(parts).split()))
            parts = []
        block = number
        parts.append(text)
    lines.append(" ".join("".join(parts).split()))
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` with ``text`` and ``n_chars``, a row per page.

    NULL and empty pages have the empty text. Pages are independent: repeated rows stay, each with its text, NULL ids and
    addresses are carried like others, and an empty table gives an empty result. Other columns aren't read.
    """
    bounded(pages.sparkSession)
    schema = T.StructType([*(pages.schema[c] for c in carry), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = [main_text(x.as_py()) for x in part.column(html)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(found, pa.string())], names=[*carry, "text"])

    return pages.select(*carry, html).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
