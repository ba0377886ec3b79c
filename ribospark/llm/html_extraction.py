"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once, tag by tag, into blocks (the text between two block-level tags). Each
block gets two costs from a classifier: of counting as content and of counting as boilerplate.
They are the capacities of its edges to the two terminals of a graph; smoothness edges link a
block with the one before it (weaker, the longer the way between them in the tree) and with
the latest block of the same parent and of the same grandparent. The cheapest labelling is a
minimum cut, found by maximum flow; where several are cheapest, the one with most content is
taken. Blocks whose own costs outweigh all their edges keep their side in every minimum cut;
they are settled before the flow, which then runs over the rest.

The classifier adds two logits: what the nearest telling element around a block says (fixed
values below: semantic tags, roles, words of class and id) and naive Bayes over layout features
(link density, length, sentence end, tag, separators). The latter is learned from the pages
themselves: blocks inside <article> or <main> against blocks inside <nav>, <footer> and the
like, counted over a bounded sample of pages.

Defined results: null or empty html and pages without content give the empty text; repeated
pages each give a row; a null id or url stays null; of a page cut off inside a tag the rest of
the tag is dropped; only the asked columns are read, so no other column can clash. Pages of
any length are read whole, in linear time. Ties of the cut count as content.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import hash_limit, map_batches

# Element names of HTML and the words that page authors use for parts of a page.
BLOCK_TAGS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements whose content is no text of the page; the first four run to the end of the page if nothing closes them.
DROPPED_TAGS = set("script style textarea title noscript template svg select button iframe object canvas audio video".split())
TO_THE_END = {"script", "style", "textarea", "title"}
CONTENT_TAGS = {"article", "main"}
BOILERPLATE_TAGS = {"nav", "aside", "footer", "dialog", "menu", "search"}
CONTENT_ROLES = {"main", "article"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
COMMENT_WORDS = set("comment comments commentlist disqus respond reply replies discussion".split())
BOILERPLATE_WORDS = set("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay share sharing social related recommended recommendations teaser newsletter subscribe subscription signup login search form pagination pager copyright legal skip outbrain taboola".split())
CONTENT_WORDS = set("article content entry story main post body text".split())
NEGATIONS = {"no", "has", "with", "without"}
#: What the nearest telling element says, from certainly boilerplate to certainly content.
CERTAIN_NOT, LIKELY_NOT, UNKNOWN, LIKELY, CERTAIN = -2, -1, 0, 1, 2
CUE_LOGITS = {CERTAIN_NOT: -6.0, LIKELY_NOT: -4.0, UNKNOWN: 0.0, LIKELY: 2.5, CERTAIN: 5.0}
#: The layout features' logit is held within this.
LAYOUT_LIMIT = 2.0
#: Weights of the smoothness edges: adjacency (over the way in the tree), same parent, same grandparent.
ADJACENT, SIBLING, COUSIN = 1.2, 0.3, 0.15
#: Capacities are whole numbers of this fraction.
UNIT = 1000
#: Pages of the sample that the layout features are learned from.
SAMPLE_PAGES = 2000

_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z].*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TELLING = re.compile(r"class|id\s*=|role|hidden|style", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE_END = tuple(".!?…。！？:;\"'”’»")
_SEPARATORS = re.compile("[©|·•»›]")


@dataclass
class Block:
    """A run of text: its words' white space is single blanks."""

    text: str
    linked: int  # characters inside links
    tag: str
    cue: int
    way: int  # steps in the tree from the block before
    parent: int
    grandparent: int


def cue_of(tag: str, attributes: str, around: int) -> int:
    """What an element says about the blocks in it, given what is known ``around`` it."""
    if around == CERTAIN_NOT:
        return CERTAIN_NOT
    own = CERTAIN if tag in CONTENT_TAGS else CERTAIN_NOT if tag in BOILERPLATE_TAGS else LIKELY_NOT if tag == "form" else UNKNOWN
    if tag == "header" and around <= UNKNOWN:  # an article's own header holds its title
        own = CERTAIN_NOT
    if attributes and tag not in ("html", "body") and _TELLING.search(attributes):
        values = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        role = values.get("role", "").lower()
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(values.get("style", "")) or role in BOILERPLATE_ROLES:
            return CERTAIN_NOT
        words, before = set(), ""
        for word in _WORDS.findall(f"{values.get('class', '')} {values.get('id', '')}"):
            word = word.lower()
            if before not in NEGATIONS:
                words.add(word)
            before = word
        if words & COMMENT_WORDS:
            return CERTAIN_NOT
        told = words & BOILERPLATE_WORDS
        if told and not (told == {"header"} and (around > UNKNOWN or words & CONTENT_WORDS)):
            own = min(own, LIKELY_NOT)
        elif own == UNKNOWN and (role in CONTENT_ROLES or words & CONTENT_WORDS):
            own = CERTAIN if role in CONTENT_ROLES else LIKELY
    if own == UNKNOWN or (own == LIKELY and around != UNKNOWN):
        return around
    return own


def page_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in their order, read in one pass over its tags."""
    if not page:
        return []
    blocks: list[Block] = []
    names, nodes, cues = ["#page"], [0], [UNKNOWN]  # the open elements
    places: dict[str, list[int]] = {}  # of the open elements, by name
    made, lowest, before, in_link = 0, 0, 0, False
    texts: list[str] = []
    linked = 0
    never_closed: set[str] = set()

    def flush() -> None:
        nonlocal lowest, before, linked
        text = " ".join("".join(texts).split())
        texts.clear()
        if text:
            depth = len(names)
            way = before + depth - 2 * min(lowest, depth)
            blocks.append(Block(text, min(linked, len(text)), names[-1], cues[-1], max(way, 1), nodes[-1], nodes[-2] if depth > 1 else -1))
            lowest = before = depth
        linked = 0

    def close(at: int) -> None:
        """The element at a place of the stack and all inside it end here."""
        nonlocal lowest
        for name in names[at:]:
            places[name].pop()
        del names[at:], nodes[at:], cues[at:]
        lowest = min(lowest, at)

    def last(*wanted: str) -> int:
        return max((places[n][-1] for n in wanted if places.get(n)), default=-1)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            texts.append(piece)
            if in_link:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            if places.get(tag):
                flush()
                close(places[tag][-1])
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag in DROPPED_TAGS:
            if tag not in never_closed:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = len(page)
                else:
                    never_closed.add(tag)
            continue
        if tag == "br":
            texts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            in_link = in_link and tag not in ("li", "p", "div", "article", "section")  # a link that was left open ends
            if places.get("p"):
                close(places["p"][-1])
            if tag == "li" and last("li") > last("ul", "ol", "menu", "dir"):
                close(last("li"))
            elif tag in ("dd", "dt") and last("dd", "dt") > last("dl"):
                close(last("dd", "dt"))
            elif tag in ("td", "th") and last("td", "th") > last("tr", "table"):
                close(last("td", "th"))
            elif tag == "tr" and last("tr") > last("table"):
                close(last("tr"))
            elif tag == "body" and places.get("head"):
                close(places["head"][-1])
            if tag == "hr":
                continue
            made += 1
            places.setdefault(tag, []).append(len(names))
            cues.append(cue_of(tag, m[3], cues[-1]))
            names.append(tag)
            nodes.append(made)
        else:
            if tag == "a":
                in_link = True
            if m[3] and not m[3].endswith("/") and tag not in ("img", "input", "link", "meta", "source", "wbr", "area", "base", "col", "embed", "track") and _TELLING.search(m[3]):
                cue = cue_of(tag, m[3], cues[-1])
                if cue < min(cues[-1], UNKNOWN):  # an inline advert or notice is a block of its own
                    flush()
                    made += 1
                    places.setdefault(tag, []).append(len(names))
                    cues.append(cue)
                    names.append(tag)
                    nodes.append(made)
    flush()
    return blocks


def layout_features(block: Block) -> tuple[tuple[int, int], ...]:
    """(feature, bin) of a block, whatever stands around it."""
    words = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    kind = 0 if block.tag in ("p", "blockquote", "pre") else 1 if block.tag[0] == "h" and len(block.tag) == 2 else 2 if block.tag in ("li", "dd", "dt", "td", "th") else 3
    return (
        (0, 0 if share == 0 else 1 if share <= 1 / 3 else 2 if share <= 2 / 3 else 3),
        (1, 0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3 if words < 60 else 4),
        (2, int(block.text.endswith(_SENTENCE_END))),
        (3, kind),
        (4, int(_SEPARATORS.search(block.text) is not None)),
    )


@dataclass
class Layout:
    """Log odds of content by (feature, bin); unseen ones say nothing."""

    odds: dict[tuple[int, int], float] = field(default_factory=dict)

    @classmethod
    def of_counts(cls, counts: dict[tuple[int, int, bool], int]) -> Layout:
        total = Counter()
        for (f, _, content), n in counts.items():
            total[f, content] += n
        bins = {(f, b) for f, b, _ in counts}
        kinds = Counter(f for f, _ in bins)
        share = lambda f, b, content: (counts.get((f, b, content), 0) + 1) / (total[f, content] + kinds[f])
        return cls({(f, b): math.log(share(f, b, True) / share(f, b, False)) for f, b in bins})

    def logit(self, block: Block) -> float:
        own = sum(self.odds.get(x, 0.0) for x in layout_features(block))
        return CUE_LOGITS[block.cue] + max(-LAYOUT_LIMIT, min(LAYOUT_LIMIT, own))


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity) of the edges between blocks."""
    edges, parents, grandparents = [], {}, {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(UNIT * ADJACENT / b.way)))
        for weight, latest, key in ((SIBLING, parents, b.parent), (COUSIN, grandparents, b.grandparent)):
            if latest.get(key, i - 1) != i - 1:
                edges.append((latest[key], i, round(UNIT * weight)))
            latest[key] = i
    return edges


def minimum_cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The largest content side of a minimum cut.

    A node's terminal is its capacity from the content terminal minus that to the boilerplate
    terminal (what both share flows straight through). Nodes that outweigh their edges are
    settled first; each turns its edges into terminal capacity of its neighbours.
    """
    own, around = list(terminals), [{} for _ in terminals]
    for a, b, w in edges:
        if a != b and w:
            around[a][b] = around[a].get(b, 0) + w
            around[b][a] = around[b].get(a, 0) + w
    weight = [sum(x.values()) for x in around]
    side: list[bool | None] = [None] * len(own)
    queue = deque(range(len(own)))
    while queue:
        v = queue.popleft()
        if side[v] is None and (own[v] >= weight[v] or -own[v] > weight[v]):
            side[v] = own[v] >= weight[v]
            for u, w in around[v].items():
                if side[u] is None:
                    own[u] += w if side[v] else -w
                    weight[u] -= w
                    del around[u][v]
                    queue.append(u)
    rest = [v for v in range(len(own)) if side[v] is None]
    if rest:
        content = _flow(rest, own, around, side)
        for v in rest:
            side[v] = v in content
    return side


def _flow(rest: list[int], own: list[int], around: list[dict[int, int]], side: list[bool | None]) -> set[int]:
    """Maximum flow by shortest augmenting levels over the nodes ``rest``; those that can't reach the boilerplate terminal."""
    residual = {v: {u: w for u, w in around[v].items() if side[u] is None} for v in rest}
    source, sink = {v: own[v] for v in rest if own[v] > 0}, {v: -own[v] for v in rest if own[v] < 0}
    while True:
        level = dict.fromkeys((v for v, c in source.items() if c), 0)
        queue, reached = deque(level), False
        while queue:
            v = queue.popleft()
            reached = reached or sink.get(v, 0) > 0
            for u, w in residual[v].items():
                if w and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if not reached:
            break
        arcs = {v: iter(list(residual[v])) for v in level}
        for start in [v for v in level if level[v] == 0]:
            path = [start]
            while path and source[start]:
                v = path[-1]
                if sink.get(v, 0):
                    flow = min(source[start], sink[v], *(residual[a][b] for a, b in zip(path, path[1:])))
                    source[start] -= flow
                    sink[v] -= flow
                    keep = len(path)
                    for k in range(len(path) - 1, 0, -1):
                        a, b = path[k - 1], path[k]
                        residual[a][b] -= flow
                        residual[b][a] += flow
                        if not residual[a][b]:
                            keep = k
                    if keep < len(path):
                        arcs[path[keep - 1]] = iter([path[keep], *arcs[path[keep - 1]]])  # look at the full edge again, then go on
                        del path[keep:]
                    continue
                for u in arcs[v]:
                    if residual[v][u] and level.get(u, -1) == level[v] + 1:
                        path.append(u)
                        break
                else:
                    path.pop()
    back = deque(v for v, c in sink.items() if c)
    boilerplate = set(back)
    while back:
        v = back.popleft()
        for u in residual[v]:
            if u not in boilerplate and residual[u][v]:
                boilerplate.add(u)
                back.append(u)
    return set(rest) - boilerplate


def main_text(page: str | None, layout: Layout) -> str:
    """The content blocks of a page, joined by single blanks."""
    blocks = page_blocks(page)
    sides = minimum_cut([round(UNIT * layout.logit(b)) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, content in zip(blocks, sides) if content)


def learn_layout(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Layout:
    """Layout features of blocks in certain surroundings, counted over about ``sample_pages`` pages.

    Pages are drawn by a hash of their html; a row for each feature and bin reaches the driver.
    """
    page = F.col(html_col).cast("string")
    rows = pages.select(page.alias("page")).filter("page is not null")
    picked = rows.filter(F.xxhash64("page") <= hash_limit(sample_pages / max(1, rows.count())))

    def count(batches: Iterator[dict]):
        found = Counter()
        for b in batches:
            for text in b["page"]:
                for block in page_blocks(text.as_py()):
                    if abs(block.cue) == CERTAIN:
                        found.update((f, k, block.cue > 0) for f, k in layout_features(block))
        if found:
            yield {"feature": [x[0] for x in found], "bin": [x[1] for x in found], "content": [x[2] for x in found], "n": list(found.values())}

    counted = map_batches(picked, count, "feature int, bin int, content boolean, n long").groupBy("feature", "bin", "content").agg(F.sum("n").alias("n"))
    return Layout.of_counts({(r["feature"], r["bin"], r["content"]): r["n"] for r in counted.collect()})


def extract_text(pages: DataFrame, layout: Layout, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def rows(batches: Iterator[dict]):
        for b in batches:
            for at in range(0, len(b["id"]), 500):
                texts = [main_text(x.as_py(), layout) for x in b["page"][at : at + 500]]
                yield {id_col: b["id"][at : at + 500], url_col: b["link"][at : at + 500], "text": texts, "n_chars": [len(t) for t in texts]}

    asked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("link"), F.col(html_col).cast("string").alias("page"))
    return map_batches(asked, rows, f"{id_col} long, {url_col} string, text string, n_chars long")
