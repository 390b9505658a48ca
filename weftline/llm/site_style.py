"""HTML extraction with a site style tree.

Pages of one host are merged into a style tree: a node is a path of block elements (tag and class or
id words without digits), named by a hash of its parent's name and its own style; elements below level
DEEP belong to their ancestor there.  What tells how important a node is:

presentation  how much its sequences of child styles differ between the pages that have it
content       how much its texts differ: a text that many of the pages repeat has an entropy near 1
              (in logarithms to the number of pages) and counts little, a text of one page 0
links         what share of the characters in its branch are link texts: a menu whose entries vary
              from page to page is still all links

A node's importance is ((1 - gamma) * presentation + gamma * the mean of (1 - entropy) over the texts in
its branch) * (1 - link share).  How few pages have a node says how little that importance is worth: it is drawn
towards what the node's name suggests, (pages * importance + weight * belief) / (pages + weight), and branches
under ``threshold`` are removed, unless they hold ``main_share`` or more of the host's characters, each text's
weighted by (1 - entropy); a page that would lose all its text keeps it.  So one more page moves a score by
little, and nothing changes at a fixed number of pages.

PRIORS are the beliefs and weights, by level: no name at all; a hint; a name of menus, headers, footers, sidebars or
notices; a ``header`` outside articles.  A word in a class, id or role is a name where it stands outside ``article`` and
``main``; inside it is only a hint, unless it is the whole of a class or id and not a WEAK word, as text has
social histories, banner years and menus.  Words that only suggest such parts (HINTS) are hints, but names where
they are all of a class or id outside articles.  An importance of 0.9 saves a node with any of these names from three
pages on.  Some parts the tree cannot tell from an article, as they differ from page to page too: reader comments and
adverts (VARIED, where a word is a whole class or id), and elements that HTML itself has for menus, footers, asides
and forms (NOISE_TAGS); these decide at any number of pages.  None of them removes a node with more than half of its page's text.  Ids of headings
and paragraphs name their text and are not read.  Where ``article`` or ``main``
hold the larger share of what the tree and the names leave of a page (ARTICLE characters in advance), only
what is inside them stays (their own ``header`` too), even within an element named as noise if no other
article is there; else all that is left stays.

Both entropies come from sums by (host, node, text) and (host, node, style), combined before the
shuffle, so a host with any share of the pages is summed in parts.  The verdicts of all hosts are
broadcast if they are under ``broadcast_bytes``; beyond, each page's nodes are joined with them and go
back to their page.

Pages are read by one scan from left to right, in time linear in their length, however deep or broken.
A tag ends at the first ``>`` outside quotes; where there is none up to the end of the page, from there on at
the first ``>``, and a ``<`` without either is text.  Scripts, styles and titles end at their end tag, or without one at the
end of the article or page; pictures, frames and players are left out up to their end tag in the same article, and
without one only their tag is.  Character references are decoded, white space within a
block becomes one space, blocks are joined by one space in page order.  Null html counts as empty and
gives an empty text; a null url is the host ''.  Repeated pages count each.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .units import in_slices
from .url_filter import host_path

#: How HTML elements are shown, and words by which pages name what is not the text.
RAW = frozenset("script style title textarea".split())
HIDDEN = frozenset("noscript template iframe svg canvas audio video select".split())
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button label".split()
)
BREAKS = frozenset(("br", "hr", "img", "input", "wbr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset(("ul", "ol", "dl", "table", "menu", "select", "body", "html"))
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: How many characters less than the rest of the page an article may have: a few tell nothing.
ARTICLE = 25
DEEP = 64
SAYS = frozenset("with without has have no not is show hide".split())
NOISE_TAGS = frozenset("nav footer aside menu form head button fieldset dialog label option legend".split())
VARIED = frozenset("comments commentlist readercomments replies respond disqus ad ads advert adverts advertisement advertising sponsored".split())
WEAK = frozenset("comment menu banner social promo header rail trending login signup consent nav widget modal".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer sidebar aside rail trending widget cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login sharing social comment comments disqus replies respond toolbar contentinfo complementary sharebar sharebuttons sharelinks relatedposts relatedarticles searchform searchbox feedbackform skiplink skiplinks sitenotice followus".split()
)
HINTS = frozenset("related recommended notice notices notification alert share follow form search discussion feedback skip".split())
#: Of each level of a name (none, hint, name, element): what importance it suggests, and how many pages outweigh it.
PRIORS = ((1.0, 2), (0.6, 2), (0.15, 4), (0.0, 4))
SURE = 4
ROOT = 0
TAG_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9-]*)")
QUOTE_OR_END = re.compile(r"[>\"']")


ARTICLE_END = re.compile(r"</(?:article|main|body)\b", re.IGNORECASE)


@lru_cache(maxsize=64)
def _ends(tag: str) -> tuple[re.Pattern, re.Pattern]:
    """An end tag; all that begins or ends such an element, or ends an article."""
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE), re.compile(rf"<(/?)(?:{tag})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(/?)>|</(?:article|main|body)\b", re.IGNORECASE)


class _Hidden:
    """Where the elements end whose content is left out; each kind is looked for once a page."""

    def __init__(self, html: str):
        self.html, self.ends, self.gone = html, {}, set()

    def raw(self, tag: str, at: int) -> int:
        closed = None if tag in self.gone else _ends(tag)[0].search(self.html, at)
        if closed:
            return closed.end()
        self.gone.add(tag)
        article = ARTICLE_END.search(self.html, at)
        return article.start() if article else len(self.html)

    def element(self, tag: str, start: int, at: int) -> int:
        """The end of the element that begins at start, or of its tag if it has none there."""
        if tag not in self.ends:
            found, begun = {}, []
            for m in _ends(tag)[1].finditer(self.html):
                if m[1] is None:  # elements do not go on after their article
                    begun.clear()
                elif m[1]:
                    if begun:
                        found[begun.pop()] = m.end()
                elif not m[2]:
                    begun.append(m.start())
            self.ends[tag] = found
        return max(at, self.ends[tag].get(start, at))


def tags_and_texts(html: str) -> Iterator[tuple[str, str, str]]:
    """('', text, '') for text, (name, '', attributes) for a start tag, ('/name', '', '') for an end tag."""
    at, last, plain, next_end, hidden = 0, html.rfind(">"), False, -1, _Hidden(html)
    start = html.find("<")
    while 0 <= start < last:
        mark, after = start, -1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            after, tag = (end + 3 if end >= 0 else len(html)), None
        elif html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            after, tag = end + 1, None
        elif tag := TAG_NAME.match(html, start + 1):
            end = -1
            if not plain:
                i = tag.end()
                while m := QUOTE_OR_END.search(html, i):
                    if m[0] == ">":
                        end = m.start()
                        break
                    i = html.find(m[0], m.end()) + 1
                    if not i:
                        break
                plain = end < 0
            if end < 0:
                if next_end < start:
                    next_end = html.find(">", start)
                other = html.find("<", tag.end())
                end = next_end if other < 0 or next_end < other else -1
            if end >= 0:
                after = end + 1
        if after < 0:  # the sign itself
            start = html.find("<", start + 1)
            continue
        if mark > at:
            yield "", html[at:mark], ""
        at = after
        if tag:
            name = tag[2].lower()
            if tag[1]:
                yield "/" + name, "", ""
            elif name in RAW:
                at = hidden.raw(name, at)
            elif name in HIDDEN:
                at = hidden.element(name, mark, at)
            else:
                yield name, "", html[tag.end() : at - 1]
        start = html.find("<", at)
    # an open comment or raw element goes on to the end
    rest = html.find("<!--", at)
    if at < len(html):
        yield "", html[at : rest if rest >= 0 else len(html)], ""


class Page:
    """The blocks of a page in order, (node, text), and its nodes, each after its parent: ``key``,
    ``parent``, ``style``, whether it is in an article or main, and the text in it (own, and linked).
    Node 0 is the page itself."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[int, str]] = []
        self.key, self.parent, self.depth, self.style = [ROOT], [0], [0], [""]
        self.article, self.within = [False], [False]
        self.own, self.linked = [0], [0]
        self.children: list[list[str]] = [[]]
        self.number: dict[tuple[int, str], int] = {}
        if html:
            self._parse(html)

    def _child(self, node: int, tag: str, style: str) -> int:
        self.children[node].append(style)
        if self.depth[node] == DEEP:
            return node
        got = self.number.setdefault((node, style), len(self.key))
        if got == len(self.key):
            self.key.append(child_key(self.key[node], style))
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.style.append(style)
            self.article.append(tag in ("article", "main"))
            self.within.append(self.within[node] or self.article[node])
            self.own.append(0)
            self.linked.append(0)
            self.children.append([])
        return got

    def _parse(self, html: str) -> None:
        open_tags: list[str] = []
        nodes: list[int] = []
        places: dict[str, list[int]] = defaultdict(list)  # where each tag is open
        holds = [-1]
        buffer: list[str] = []
        linked, in_link, node = 0, False, 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(html_lib.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.blocks.append((node, text))
                    self.own[node] += len(text)
                    self.linked[node] += min(linked, len(text))
            linked = 0

        def pop(n: int) -> None:
            nonlocal node
            while len(open_tags) > n:
                tag = open_tags.pop()
                nodes.pop()
                places[tag].pop()
                if tag in HOLDS:
                    holds.pop()
            node = nodes[-1] if nodes else 0

        for tag, text, attributes in tags_and_texts(html):
            if not tag:
                buffer.append(text)
                if in_link:
                    linked += len(text.strip())
                continue
            if tag in ("a", "/a"):
                in_link = tag == "a" and "href" in attributes.lower()
                continue
            if tag in BREAKS:
                buffer.append(" ")
                continue
            name = tag.lstrip("/")
            if name not in BLOCKS or name in VOID:
                continue
            flush()
            if tag[0] == "/":
                in_link = False
                if places[name]:
                    pop(places[name][-1])
                continue
            if open_tags and open_tags[-1] == "p":
                pop(len(open_tags) - 1)
            before = max((places[c][-1] for c in CLOSES.get(tag, ()) if places[c]), default=-1)
            if before > holds[-1]:
                pop(before)
            node = self._child(node, tag, style_of(tag, attributes))
            places[tag].append(len(open_tags))
            if tag in HOLDS:
                holds.append(len(open_tags))
            open_tags.append(tag)
            nodes.append(node)
        flush()

    def branches(self, own: list[int]) -> list[int]:
        """Of each node, the sum over its branch."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


@lru_cache(maxsize=65536)
def style_of(tag: str, attributes: str) -> str:
    return ".".join((tag, *dict.fromkeys(_words(attributes, tag not in TITLED)))) if attributes else tag


@lru_cache(maxsize=65536)
def child_key(parent: int, style: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{style}") - (1 << 63)


def path_key(path: str) -> int:
    """The name of the node with these styles, from the page down."""
    key = ROOT
    for style in path.split("/"):
        key = child_key(key, style)
    return key


def _words(attributes: str, ids: bool = True) -> list[str]:
    """The words of class, id and role, but for names that say what an element has or lacks."""
    out = []
    for kind, *x in NAMES.findall(attributes):
        if kind.lower() == "id" and not ids:
            continue
        for name in "".join(x).split():
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if words and words[0] not in SAYS:
                out += [*words, "".join(words)]  # side-bar is a sidebar
    return out


def _whole(words: list[str], of: frozenset[str]) -> bool:
    """Whether one of the words is all of a class or id: related, but not related-work."""
    return any(w in of and not any(w in x and x != w for x in words) for w in words)


@lru_cache(maxsize=65536)
def named(style: str, within: bool) -> int:
    """What an element says of itself: SURE that it isn't text, else the level of its name (see PRIORS).  within: in an
    article or main."""
    tag, *words = style.split(".")
    if tag in ("", "html", "body"):
        return 0
    if tag in NOISE_TAGS or _whole(words, VARIED):
        return SURE
    if tag == "header" and not within:
        return 3
    noisy = not NOISE_NAMES.isdisjoint(words) and not (tag in ("article", "main", "header") and words == ["header"])
    if noisy and (not within or _whole(words, NOISE_NAMES - WEAK)):
        return 2
    if not within and _whole(words, HINTS):
        return 2
    return int(noisy or not HINTS.isdisjoint(words))


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


OBSERVED = "host string, node bigint, kind int, feature bigint, pages bigint, times bigint, clnc double, chars bigint, linked bigint, named int, path binary"


def _observed(hosts: list[str], htmls: list[str | None]) -> dict[tuple, list]:
    """What some pages add: (host, node, kind, feature) -> pages, times, sum of c ln c, characters, linked
    characters, name, and the names of the node and those above it."""
    seen: dict[tuple, list] = {}
    for host, html in zip(hosts, htmls, strict=True):
        page = Page(html)
        held = page.branches(page.own)
        texts = Counter(page.blocks)
        rows = [((page.key[i], 1, _key(t)), c, len(t) * c, 0, 0, None) for (i, t), c in texts.items()]
        paths = [b""]
        for i in range(1, len(page.key)):
            path = paths[page.parent[i]] + page.key[i].to_bytes(8, "little", signed=True)
            paths.append(path)
            if held[i]:
                rows.append(((page.key[i], 2, 0), 1, page.own[i], page.linked[i], named(page.style[i], page.within[i]), path))
            if page.children[i]:
                rows.append(((page.key[i], 0, _key(*page.children[i])), 1, 0, 0, 0, None))
        if page.own[0]:
            rows.append(((ROOT, 2, 0), 1, page.own[0], page.linked[0], 0, b""))
        for feature, c, chars, linked, name, path in rows:
            had = seen.setdefault((host, *feature), [0, 0, 0.0, 0, 0, 0, path])
            had[0] += 1
            had[1] += c
            had[2] += c * np.log(c) if c > 1 else 0.0
            had[3] += chars
            had[4] += linked
            had[5] = max(had[5], name)
    return seen


def style_tree(pages: DataFrame, url: str = "url", html: str = "html", gamma: float = 0.9) -> DataFrame:
    """(host, node, pages, chars, new_chars, importance, named) of every node that has text in its branch."""
    slim = pages.select(host_path(F.col(url))[0].alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kinds = [(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[f.split()[1]]) for f in OBSERVED.split(", ")]

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, htmls = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in in_slices(htmls):
                seen = _observed(hosts[lo:hi], htmls[lo:hi])
                cols = list(zip(*((*k, *v) for k, v in seen.items()), strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    seen = slim.mapInArrow(observe, OBSERVED).groupBy("host", "node", "kind", "feature")
    seen = written(seen.agg(*(F.sum(c).alias(c) for c in ("pages", "times", "clnc", "chars", "linked")), F.max("named").alias("named"), F.max("path").alias("path")))
    nodes = seen.where("kind = 2").select("host", "node", F.col("pages").alias("m"), "linked", "named", "path")
    ln = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    # The entropy of a text with T times and S = sum of c ln c is (ln T - S / T) / ln m, that of a node's
    # styles (ln m - sum of c ln c / m) / ln m: both are sums first, and only sums meet the node's m.
    times = F.col("times").cast("double")
    text = seen.where("kind = 1").groupBy("host", "node").agg(F.sum("times").alias("times"), F.sum("chars").alias("chars"), F.sum(times * F.log(times) - F.col("clnc")).alias("spread"), F.sum(F.col("chars") * (F.log(times) - F.col("clnc") / times)).alias("old_chars"))
    text = text.join(nodes, ["host", "node"]).withColumns({"new": F.col("times") - F.col("spread") / ln, "new_chars": F.col("chars") - F.col("old_chars") / ln})
    # a node's text counts for it and for all above it, DEEP at most
    above = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.length("path") / 8 - 1, F.lit(0)).cast("int")), lambda k: F.substring("path", k * 8 + 1, F.lit(8))))
    sums = ("new", "times", "chars", "new_chars", "linked")
    content = text.select("host", above.alias("id"), *sums).groupBy("host", "id").agg(*(F.sum(c).alias(c) for c in sums))
    pages_ = F.col("pages").cast("double")
    style = seen.where("kind = 0").groupBy("host", "node").agg(F.sum("pages").alias("c"), F.sum(pages_ * F.log(pages_)).alias("clnc"))
    own = nodes.select("host", "node", "m", "named", F.substring("path", F.greatest(F.length("path") - 7, F.lit(1)), F.lit(8)).alias("id"))
    out = content.join(own, ["host", "id"]).join(style, ["host", "node"], "left")
    presentation = (F.col("c") * F.log(F.col("m").cast("double")) - F.col("clnc")) / F.col("m") / ln
    varied = F.when(F.col("m") == 1, 1.0).otherwise(F.coalesce(presentation, F.lit(0.0)))
    text_share = 1 - F.col("linked") / F.col("chars")
    return out.select("host", "node", F.col("m").alias("pages"), "chars", (F.col("new_chars") * text_share).alias("new_chars"), (((1 - gamma) * varied + gamma * F.col("new") / F.col("times")) * text_share).alias("importance"), "named")


def verdicts(tree: DataFrame, threshold: float = 0.35, min_pages: int = 1, main_share: float = 0.2, priors: tuple[tuple[float, int], ...] = PRIORS) -> DataFrame:
    """(host, node, low): the branches to remove, and (low false) those that stay although they have names.
    min_pages: how many pages a branch must have to be judged at all."""
    known = tree.where((F.col("pages") >= min_pages) & (F.col("named") < SURE))
    whole = tree.groupBy("host").agg(F.max("new_chars").alias("all"))
    belief, weight = (F.element_at(F.array(*(F.lit(float(p[i])) for p in priors)), F.col("named").cast("int") + 1) for i in (0, 1))
    under = (F.col("pages") * F.col("importance") + weight * belief) / (F.col("pages") + weight) < threshold
    judged = known.join(whole, "host").withColumns({"low": under & (F.col("new_chars") < main_share * F.col("all")), "high": (F.col("named") > 0) & ~under})
    return judged.where("low or high").select("host", "node", "low")


def main_text(html: str | None, low: frozenset[int] = frozenset(), kept: frozenset[int] = frozenset()) -> str:
    page = Page(html)
    return _kept_text(page, low, kept) or (_kept_text(page, frozenset(), kept) if low else "")


def _kept_text(page: Page, low: frozenset[int], kept: frozenset[int]) -> str:
    n, parent, own = len(page.key), page.parent, page.own
    held, linked = page.branches(own), page.branches(page.linked)
    total = held[0]
    noise = [False] * n  # by its own name
    for i in range(1, n):
        says = named(page.style[i], page.within[i])
        sure = says > 1 or says == 1 and 2 * linked[i] >= held[i] > 0
        noise[i] = sure and 2 * held[i] <= total and (page.key[i] not in kept or says == SURE)

    def down(start: list[bool]) -> list[bool]:
        """Whether a node or one above it is so."""
        out = list(start)
        for i in range(1, n):
            out[i] = out[i] or out[parent[i]]
        return out

    removed, hidden = down([k in low for k in page.key]), down(noise)
    articles = [a and not x for a, x in zip(page.article, noise, strict=True)]
    plain = [a and not h for a, h in zip(articles, hidden, strict=True)]
    some = [i for i in range(n) if own[i]]
    shown = [False] * n
    if not any(plain):  # articles that only elements named as noise hold are what the page has
        for i in range(n - 1, 0, -1):
            shown[i] = shown[i] or articles[i]
            shown[parent[i]] = shown[parent[i]] or shown[i]
    bad = down([x and not s for x, s in zip(noise, shown, strict=True)])
    keep = {i for i in some if not bad[i] and not removed[i]}
    inner = down(plain if any(plain) else articles)
    inside = {i for i in keep if inner[i]}
    if inside and 2 * sum(own[i] for i in inside) + ARTICLE >= sum(own[i] for i in keep):
        keep = inside
    elif any(shown):
        keep = {i for i in some if not hidden[i] and not removed[i]}
    return " ".join(text for i, text in page.blocks if i in keep)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", gamma: float = 0.9, broadcast_bytes: int = 8 << 20, **low) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = written(verdicts(style_tree(pages, url, html, gamma), **low))
    host = host_path(F.col(url))[0]
    slim = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    size = found.agg(F.sum(F.length("host") + 17)).first()[0] or 0
    if size <= broadcast_bytes:
        by_host: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for h, node, is_low in found.toLocalIterator():
            by_host[h][0 if is_low else 1].add(node)
        held = pages.sparkSession.sparkContext.broadcast(dict(by_host))
        joined, nothing = slim.withColumns({"low": F.lit(None).cast("array<bigint>"), "kept": F.lit(None).cast("array<bigint>")}), (frozenset(), frozenset())
        choose = lambda h, low, kept: held.value.get(h, nothing)
    else:
        joined = _with_verdicts(slim, found)
        choose = lambda h, low, kept: (frozenset(low or ()), frozenset(kept or ()))
    kinds = f"page_id {pages.schema[id].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, htmls, low, kept = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
            for lo, hi in in_slices(htmls):
                out = [main_text(htmls[i], *choose(hosts[i], low[i], kept[i])) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "low", "kept").mapInArrow(run, kinds)


def _with_verdicts(slim: DataFrame, found: DataFrame) -> DataFrame:
    """slim with what is said of each page's own nodes: as many at most as the page has.  Pages of equal
    host and html are judged once."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            htmls = b.column(3).to_pylist()
            for lo, hi in in_slices(htmls):
                keys = [Page(h).key for h in htmls[lo:hi]]
                at = pa.array(np.repeat(np.arange(lo, hi), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array([k for ks in keys for k in ks], pa.int64())], ["p", "q", "host", "node"])

    keyed = slim.withColumns({"p": F.xxhash64("host", "html"), "q": F.crc32(F.col("html").cast("binary"))})
    have = keyed.select("p", "q", "host", "html").dropDuplicates(["p", "q"]).mapInArrow(nodes, "p bigint, q bigint, host string, node bigint")
    lists = (F.collect_list(F.when(F.col("low") == x, F.col("node"))).alias(a) for x, a in ((True, "low"), (False, "kept")))
    said = written(written(have).join(found, ["host", "node"]).groupBy("p", "q").agg(*lists))
    return keyed.join(said, ["p", "q"], "left")
