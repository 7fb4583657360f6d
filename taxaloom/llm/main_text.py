"""Main text of web pages by consensus paths of their hosts."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import storage

#: Bytes of winning paths that may be broadcast; beyond it pages and paths meet in a shuffle.
BROADCAST_BYTES = 16 << 20
CONTAINERS = frozenset("body div section article main td".split())
SKIPPED = frozenset("head nav footer aside form button select textarea noscript template svg iframe object menu dialog fieldset header".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BREAKS = frozenset("p br hr h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr th td table caption blockquote pre address figure figcaption details summary thead tbody tfoot".split()) | CONTAINERS | SKIPPED
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no containers, but may be boilerplate by their names.
NAMED = HEADINGS | frozenset("p li blockquote figure figcaption dd dt pre address summary".split())
#: A class or id names boilerplate if it is made of such words, and perhaps of words that say nothing ("site-footer", but not "has-footer").
BOILERPLATE = re.compile(
    "ads?|advert.*|sponsor.*|promo.*|banner.*|cookie.*|consent|gdpr|notices?|alerts?|menus?|nav.*|breadcrumbs?|side|sidebar.*|foot|footer.*|masthead|topbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|reactions?|shar(?:e|ing)|social|related|recommend.*|newsletter|subscri.*|signup|login|popup|modal|overlay|widgets?|toolbar|pagination|pager|skip.*|search|hidden"
    "|discussions?|responses?|conversations?|talkback|feedback|bio|paywall.*|regwall|dfp|taboola|outbrain|popular|trending|donat.*|survey|poll"
)
#: Names that are boilerplate as a whole, however their parts are written.
BOILERPLATE_NAMES = re.compile("(most|also|further|read|up)(read|viewed|shared|popular|discussed|more|next|reading|on)|(you|people)(may|might|also).*|alsolike.*|morefrom.*|morestories|morenews|sponsoredcontent|partnercontent|authorbox|aboutauthor|abouttheauthor")
HEADER = re.compile("header|head|top")
PLAIN = re.compile("site|page|main|global|primary|secondary|left|right|bottom|list|lists|section|box|area|wrap|wrapper|container|block|bar|inner|outer|item|items|links?|buttons?|slot|unit|posts?|articles?|news|stories|form|thread|panel|column|col|sm|md|lg|[0-9]*"
    "|story|readers?|users?|visitors?|guests?|all|latest|recent|new|authors?|e?mail|google|native|inline|sticky|floating|fixed|mobile|desktop|holder|placeholder|zone|space|module|component|region|row|grid|cards?|feed|strip|the|of|to|our|your|us|js|ui|c|m|u")
CONTENT = re.compile("article|content|post|entry|story|text|main|body")
#: What a header is named that is an article's and not the site's.
OF_ARTICLE = re.compile("article|content|post|entry|story|headline|title")
PARTS = re.compile("[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: How much of a container's worth its parent has, and what a heading right in it adds.
DECAY, HEADING = 0.9, 0.3

#: Share of a page's text outside links and boilerplate from which a container that also names content is no boilerplate.
MOST = 0.5


class Page:
    """A page's containers as a tree, and its blocks: stretches of text between breaks.

    Of a container: its parent, the hash of its path (tags with classes, digits
    dropped), its tag, whether it names content, and what speaks against it (0 nothing,
    1 a word among its classes, 2 surely no article). Of a block: its container, text,
    characters in links, and whether it is its page's first heading. Work is linear in
    the source.
    """

    def __init__(self, source: str) -> None:
        self.parent, self.path, self.tag, self.content, self.against = [-1], [0], [""], [False], [0]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._parse(source)
        text = [0.0] * len(self.parent)  # characters outside links, of a container and all in it
        for node, words, linked, _ in self.blocks:
            text[node] += max(0, len(words) - linked)
        for k in range(len(self.parent) - 1, 0, -1):
            text[self.parent[k]] += text[k]
        junk = [a == 1 and not c for a, c in zip(self.against, self.content, strict=True)]
        most = text[0]
        for k in range(1, len(self.parent)):
            if junk[k] and not junk[self.parent[k]]:
                most -= text[k]
            junk[k] |= junk[self.parent[k]]
        for k in range(1, len(self.parent)):
            junk[k] |= junk[self.parent[k]] or self.against[k] == 1 and text[k] < MOST * most
        self.blocks = [b for b in self.blocks if not junk[b[0]]]

    def _judge(self, tag: str, attributes: str, parent: int, inside_main: bool) -> tuple[int, str, list[list[str]]]:
        """What speaks against an element (see Page), its classes, and the words of its names."""
        names = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        labels = [[w.lower() for w in PARTS.split(label) if w] for label in f"{names.get('class', '')} {names.get('id', '')}".split()]
        its_own = tag == "header" and (inside_main or self.content[parent] or any(OF_ARTICLE.fullmatch(w) for words in labels for w in words))
        sure = tag in SKIPPED and not its_own or names.get("role", "").lower() in ROLES or "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
        bad = lambda w: BOILERPLATE.fullmatch(w) or not inside_main and tag in CONTAINERS and HEADER.fullmatch(w)
        named = tag not in ("body", "article", "main") and any(any(map(bad, words)) and all(bad(w) or PLAIN.fullmatch(w) for w in words) or BOILERPLATE_NAMES.fullmatch("".join(words)) for words in labels)
        return 2 if sure else int(named), names.get("class", ""), labels

    def _open(self, tag: str, attributes: str, parent: int, inside_main: bool) -> int:
        against, classes, labels = self._judge(tag, attributes, parent, inside_main)
        kinds = sorted({re.sub(r"[0-9]+", "", c) for c in classes.lower().split()} - {""})
        self.parent.append(parent)
        self.path.append(xxhash.xxh64_intdigest(".".join([tag, *kinds]), self.path[parent]))
        self.tag.append(tag)
        self.content.append(any(CONTENT.fullmatch(w) for words in labels for w in words))
        self.against.append(against)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, surely no article, inside the main part
        scopes: list[Counter] = [Counter()]  # open tags, anew in each table cell
        words: list[str] = []
        linked, in_link, heading, at, seen_heading = 0, False, False, 0, False
        dropped = False  # inside a paragraph or heading that is boilerplate by its names, up to the next break

        def flush() -> None:
            nonlocal linked, seen_heading
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked, heading and not seen_heading))
                    seen_heading |= heading
                words.clear()
            linked = 0

        def pop() -> None:
            scopes[-1][stack[-1][0]] -= 1
            if stack.pop()[0] == "td":
                scopes.pop()
                scopes[-1]["td"] -= 1

        n = len(source)
        while at < n:
            lt = source.find("<", at)
            stop = n if lt < 0 else lt
            if stop > at and not stack[-1][2] and not dropped:
                text = source[at:stop]
                text = entities.unescape(text) if "&" in text else text
                words.append(text)
                linked += len(text) if in_link else 0
            if lt < 0:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            m = TAG.match(source, lt)
            if not m:
                if source[lt + 1 : lt + 2] in ("!", "?"):
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    if not stack[-1][2] and not dropped:
                        words.append("<")
                    at = lt + 1
                continue
            at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
            if not closing and tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"(?i)</{tag}\s*>").search(source, at)
                at = end.end() if end else n
                continue
            if tag == "a":
                in_link = not closing
                continue
            if tag not in BREAKS:
                continue
            flush()
            dropped = False
            if tag in HEADINGS:
                heading = not closing
            if not stack[-1][2] and tag in NAMED and not closing and attributes and self._judge(tag, attributes, stack[-1][1], stack[-1][3])[0]:
                if tag == "p" or tag in HEADINGS:
                    dropped = True
                elif not attributes.endswith("/"):
                    scopes[-1][tag] += 1
                    stack.append((tag, stack[-1][1], True, stack[-1][3]))
                continue
            if tag in NAMED and scopes[-1][tag] > 0 and stack[-1][0] == tag and (closing or tag == "li"):
                pop()  # the end of such an element, or a list item behind it
                continue
            if tag in CONTAINERS or tag in SKIPPED or tag in ("ul", "ol", "table", "dl", "details"):
                if closing:
                    if tag == "table":
                        inner = next((k for k in range(len(scopes) - 1, -1, -1) if scopes[k]["table"] > 0), -1)
                    else:
                        inner = len(scopes) - (1 if scopes[-1][tag] > 0 else 2 if tag == "td" and len(scopes) > 1 else len(scopes) + 1)
                    if inner >= 0:
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                elif not attributes.endswith("/"):
                    if tag == "td" and stack[-1][0] == "td":
                        pop()
                    _, above, lost, inside = stack[-1]
                    node = above if lost else self._open(tag, attributes, above, inside)
                    scopes[-1][tag] += 1
                    stack.append((tag, node, lost or self.against[node] == 2, inside or tag in ("article", "main")))
                    if tag == "td":
                        scopes.append(Counter({"td": 1}))
        flush()

    def scores(self) -> dict[int, float]:
        """The worth of each path: text in its containers outside links, less with each level above it."""
        worth, leads = [0.0] * len(self.parent), set()
        for node, text, linked, heading in self.blocks:
            worth[node] += len(text) - 1.5 * min(linked, len(text))
            if heading:
                leads.add(node)
        out: dict[int, float] = {}
        for k in range(len(self.parent) - 1, 0, -1):
            worth[self.parent[k]] += DECAY * worth[k]
        for k in range(1, len(self.parent)):
            if worth[k]:
                tag = self.tag[k]
                factor = 3 if tag == "article" else 2.5 if tag == "main" else 1.3 if self.content[k] else 0.5 if tag in ("ul", "ol", "table", "dl", "td") else 1
                out[self.path[k]] = out.get(self.path[k], 0.0) + worth[k] * factor * (1 + HEADING * (k in leads))
        return out

    def text_at(self, path: int | None) -> str:
        """The text of all containers with the path; of the page's own best where it has none."""
        taken = self._inside(path) if path is not None else []
        if not taken and (own := self.scores()):
            taken = self._inside(min(own, key=lambda p: (-own[p], p)))
        return " ".join(b[1] for b in (taken or self.blocks))

    def _inside(self, path: int) -> list[tuple[int, str, int, bool]]:
        """The blocks in containers with the path, and in headers right beside one."""
        within, beside = [False], set()
        for k in range(1, len(self.parent)):
            within.append(within[self.parent[k]] or self.path[k] == path)
            if self.path[k] == path:
                beside.add(self.parent[k])
        for k in range(1, len(self.parent)):
            within[k] |= within[self.parent[k]] or self.tag[k] == "header" and self.parent[k] in beside
        return [b for b in self.blocks if within[b[0]]]


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page: the article without menus, notices, adverts, forms, comments and other parts around it.

    Each page's containers are scored by their text; the scores of generalised paths
    (tags with classes, digits dropped; told apart by 64-bit hashes, so that a vote
    has one size however deep the page) are votes, summed for each host in Spark; the
    text is then taken again from the containers on the host's winning path. A page
    without them, or without a host, falls back to its own best container.

    A null or empty html gives an empty text, a null id or url stays null, repeated
    rows repeat, an empty table gives no rows. Only the three columns are read.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    X.texts(rows, "page_id", "html")  # bounds the batches

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, int], float] = {}
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if host := host_of(url):
                    for path, worth in Page(source or "").scores().items():
                        votes[host, path] = votes.get((host, path), 0.0) + worth
            paths = np.array([p for _, p in votes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array(paths), pa.array(votes.values(), pa.float64())], ["host", "path", "worth"])
        X.settle()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [Page(source or "").text_at(None if path is None else path % (1 << 64)) for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])
        X.settle()

    votes = rows.select("url", "html").mapInArrow(vote, "host string, path long, worth double").groupBy("host", "path").agg(F.round(F.sum("worth"), 3).alias("worth"))
    winners = storage.stored(votes.groupBy("host").agg(F.max_by("path", F.struct("worth", "path")).alias("path")))
    size = winners.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    host = F.lower(F.regexp_extract("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    keyed = rows.withColumn("host", F.coalesce(host, F.lit("")))
    placed = keyed.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left")
    return placed.select("page_id", "url", "html", "path").mapInArrow(take, "page_id long, url string, text string")
