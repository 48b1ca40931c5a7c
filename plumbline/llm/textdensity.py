"""Main text of web pages by composite text density (operator 2).

For every node of the page's tree the characters per tag are counted, adjusted for the share of link characters and
link tags (composite text density). A node's density sum adds up its children's densities. The node with the largest
sum under the body is found, the smallest density on its path to the body is the threshold, and in every subtree that
starts with a density of at least the threshold the node with the largest sum is taken as content. So that short
paragraphs and headings are kept, the choice is widened to the lowest node below the body that holds all chosen ones,
to an article or main element around it, and to headings beside it.

Scripts, styles, forms and menus are no text and are left out before counting; everything else counts. What stands
apart by its element (header, footer, aside) or by a word of its class, id or role (adverts, notices, reader comments and
the like) can have the density of an article, so it is not chosen, and is left out of what is chosen; an element that
holds an article or main element is not set apart by its name. A page on which everything is set apart has an empty text.

A null or empty page gives an empty text; broken mark-up is read leniently and in time proportional to the page, however
deep or long; repeated rows repeat; extra columns are ignored, those that clash with a result column give way to it. An
empty table gives an empty result. Memory is bounded by one page and one slice of an Arrow batch.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship, table

NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("article aside body blockquote div footer form header html li main nav section table td th".split())
#: No text: scripts, styles, forms and menus.
LEFT_OUT = frozenset("button canvas form head iframe input menu nav noscript object script select style svg template textarea title".split())
#: Set apart by element and by name.
APART = frozenset("aside dialog footer header".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus replies respond discussion share sharing social related recommended widget widgets pagination pager search skip".split()
)
BATCH_PAGES = 500
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes an open element of these kinds first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}


BARRIERS = ("table", "td", "article", "main")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"=\s*([\"'])")


class Markup:
    """The tags of a page in order, each found once however the page is broken."""

    def __init__(self, source: str):
        self.source = source
        self.none_from: dict[str, int] = {}  # where a search for a string that is not there began

    def find(self, what: str, at: int) -> int:
        if at >= self.none_from.get(what, len(self.source) + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.none_from[what] = at
        return found

    def end_of_tag(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at `at`; quoted values may hold others. -1 if there is none."""
        end = self.find(">", at)
        while end >= 0:
            quote = QUOTED.search(self.source, at, end)
            if not quote:
                return end
            close = self.find(quote[1], quote.end())
            if close < 0:
                return end
            at = close + 1
            if at > end:
                end = self.find(">", at)
        return end

    def tokens(self):
        """(text before, closing, tag, attributes); tag is empty for comments and at the end. After a raw element's opening
        tag, send() the place where reading goes on."""
        source, at, n = self.source, 0, len(self.source)
        text_from = 0
        while (lt := self.find("<", at)) >= 0:
            nxt = source[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                comment = source.startswith("<!--", lt)
                end = self.find("-->", lt + 4) if comment else self.find(">", lt)
                if end < 0 and not comment:
                    at = lt + 1
                    continue
                yield source[text_from:lt], False, "", ""
                at = text_from = n if end < 0 else end + (3 if comment else 1)
                continue
            closing = nxt == "/"
            name = TAG_NAME.match(source, lt + 1 + closing)
            end = self.end_of_tag(name.end()) if name else -1
            if end < 0:
                at = lt + 1
                continue
            to = yield source[text_from:lt], closing, name[0].lower(), source[name.end() : end]
            at = text_from = end + 1
            if to:
                at = text_from = self.end_of_raw(to, at)
                yield "", False, "", ""  # answers send()
        yield source[text_from:], False, "", ""

    def end_of_raw(self, tag: str, at: int) -> int:
        """Where a raw element's content and closing tag end; where it is never closed, a script or style takes the rest."""
        key = "</" + tag
        if at < self.none_from.get(key, len(self.source) + 1):
            found = re.compile(re.escape(key) + r"\s*>", re.I).search(self.source, at)
            if found:
                return found.end()
            self.none_from[key] = at
        return len(self.source) if tag in ("script", "style") else at


class Page:
    """The tree of one page as parallel lists in document order, and its text pieces."""

    def __init__(self, source: str):
        self.parent, self.tag, self.last = [-1], ["html"], [0]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        self.stack = [(0, "html", False)]  # node, tag, left out
        self.open_at: dict[str, list[int]] = {}  # places on the stack by tag
        self.apart = [False]  # set apart by element or name
        self.named: list[int] = []  # open nodes set apart that hold no article or main element so far
        self._read(source)

    def _pop_to(self, at: int) -> None:
        for node, tag, _ in reversed(self.stack[at:]):
            self.last[node] = len(self.tag) - 1
            self.open_at[tag].pop()
            if self.named and self.named[-1] == node:
                self.named.pop()
            if tag in BLOCKS:
                self.block += 1
        del self.stack[at:]

    def _top_of(self, kinds) -> int:
        """Place on the stack of the innermost open element of these kinds; 0 if there is none."""
        return max((self.open_at[k][-1] for k in kinds if self.open_at.get(k)), default=0)

    def _close_open(self, kinds, scopes) -> None:
        at = self._top_of(kinds)
        if at and at > self._top_of(scopes - kinds):
            self._pop_to(at)

    def _text(self, raw: str) -> None:
        node, _, out = self.stack[-1]
        if raw and not out:
            text = html.unescape(raw)
            self.pieces.append((node, self.block, text))
            self.chars[node] += len(" ".join(text.split()))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._close_open({"p"}, SCOPES)
        if tag in CLOSES:
            self._close_open(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        parent, _, out = self.stack[-1]
        if tag in BLOCKS:
            self.block += 1
        if tag == "br":
            self._text(" ")
        node = len(self.tag)
        apart = tag in APART or bool(attributes) and tag not in ("body", "html", "main") and self._named(attributes)
        if not apart and tag in ("article", "main"):
            for k in self.named:
                self.apart[k] = False
            self.named.clear()
        out = out or tag in LEFT_OUT
        self.parent.append(parent)
        self.tag.append(tag)
        self.last.append(node)
        self.apart.append(apart)
        self.chars.append(0)
        self.tags.append(0)
        self.link_chars.append(0)
        self.link_tags.append(0)
        if not out:
            self.tags[parent] += 1
        if tag not in VOID:
            if apart:
                self.named.append(node)
            self.open_at.setdefault(tag, []).append(len(self.stack))
            self.stack.append((node, tag, out))

    @staticmethod
    def _named(attributes: str) -> bool:
        """One of the names is a word that is set apart, but for layouts that only say whether they have such a part."""
        for found in NAMES.findall(attributes):
            for name in html.unescape(found).strip("\"'").split():
                words = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
                if words[0] not in ("has", "with", "no", "without") and any(w in APART_WORDS and words[k - 1] not in ("has", "with", "no", "without") for k, w in enumerate(words)):
                    return True
        return False

    def _read(self, source: str) -> None:
        tokens = Markup(source).tokens()
        for text, closing, tag, attributes in tokens:
            self._text(text)
            if not tag:
                continue
            if not closing:
                self._open(tag, attributes)
                if tag in RAW:
                    tokens.send(tag)
                    if self.stack[-1][1] == tag:
                        self._pop_to(len(self.stack) - 1)
                continue
            at = self._top_of((tag,))
            if at and (tag in BLOCKS or at > self._top_of(k for k in BARRIERS if k != tag)):
                self._pop_to(at)
            elif not at and tag == "p":
                self.block += 1
        self._pop_to(1)
        self.last[0] = len(self.tag) - 1

    def densities(self) -> list[float]:
        """Composite text density of every node."""
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            link = self.tag[i] == "a"
            if link:
                self.link_chars[i], self.link_tags[i] = self.chars[i], self.tags[i]
            self.chars[p] += self.chars[i]
            self.tags[p] += self.tags[i]
            self.link_chars[p] += self.link_chars[i]
            self.link_tags[p] += self.link_tags[i] + link
        all_chars, all_links = max(1, self.chars[0]), self.link_chars[0]
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags):
            if not c:
                out.append(0.0)
                continue
            t = max(1, t)
            base = math.log(c / max(1, c - lc) * lc + all_links / all_chars * c + math.e)
            out.append(c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / max(1e-9, math.log(base + 1e-9) if base > math.e else 1.0)))
        return out

    def content(self) -> list[bool]:
        """For every node, whether its own text is main text."""
        density, n = self.densities(), len(self.tag)
        if not self.chars[0]:
            return [False] * n
        total, children = [0.0] * n, [[] for _ in density]
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += density[i]
        for i in range(1, n):
            children[self.parent[i]].append(i)
        for i, own in enumerate(children):
            if not own:
                total[i] = density[i]
        apart, widened = [False] * n, [-1] * n  # in a part set apart; outermost article or main element around
        for i in range(1, n):
            p = self.parent[i]
            apart[i] = apart[p] or self.apart[i]
            widened[i] = widened[p] if widened[p] >= 0 else i if self.tag[i] in ("article", "main") and not apart[i] else -1
        best = list(range(n))  # the node of largest sum in each subtree, of what is not set apart
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not apart[i] and (total[best[i]], -best[i]) > (total[best[p]], -best[p]):
                best[p] = best[i]
        body = next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        top = best[body]
        threshold, i = density[top], top
        while i not in (body, -1, 0):
            i = self.parent[i]
            threshold = min(threshold, density[i])
        chosen, todo = set(), [body]
        while todo:
            i = todo.pop()
            if self.chars[i] and not apart[i] and density[i] >= threshold - 1e-9:
                chosen.add(widened[best[i]] if widened[best[i]] >= 0 else best[i])
                todo += children[i]
        shared = self._common(chosen)
        if shared not in (0, body):
            chosen = {widened[shared] if widened[shared] >= 0 else shared}
        headings, seen = set(), set()
        for i in chosen:  # a heading beside the chosen node, or beside what it stands in, belongs to it
            while self.parent[i] not in (0, body, -1) and self.parent[i] not in seen:
                i = self.parent[i]
                seen.add(i)
                headings.update(k for k in children[i] if self.tag[k] in HEADINGS)
        change = [0] * (n + 1)
        for i in chosen | headings:
            change[i] += 1
            change[self.last[i] + 1] -= 1
        out, depth = [], 0
        for i in range(n):
            depth += change[i]
            out.append(depth > 0 and not apart[i])
        return out

    def _common(self, nodes: set[int]) -> int:
        """The lowest node that all of them stand in or are."""
        at, end = min(nodes, default=0), max(nodes, default=0)
        while at > 0 and self.last[at] < end:
            at = self.parent[at]
        return max(at, 0)

    def text(self) -> str:
        blocks: list[str] = []
        now, parts = None, []
        wanted = self.content()
        for node, block, piece in self.pieces:
            if not wanted[node]:
                continue
            if block != now:
                blocks.append("".join(parts))
                now, parts = block, []
            parts.append(piece)
        blocks.append("".join(parts))
        return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """`pages` without the page source but with its main text and n_chars, its length in code points."""
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_column, into, "n_chars")]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(start, BATCH_PAGES)
                found = [main_text(x.as_py()) for x in part.column(html_column)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*kept, into, "n_chars"])

    schema = pages.select(*kept).withColumn(into, F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    return pages.select(*kept, F.col(html_column).cast("string").alias(html_column)).mapInArrow(run, schema)


def op2_textdensity(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
