"""Main text of web pages by composite text density.

A tolerant parser builds the DOM (implied end tags, raw-text elements, unclosed tags).
Elements that are boilerplate by their kind (navigation, headers, footers, asides, forms,
scripts, styles, hidden parts) or by a name that says reader comments, adverts or consent are
cut off, but for one that holds the only article; a header in an article stays if it has a
heading.  Each node of the rest gets its composite density: characters a tag, adjusted by the
characters and tags of links,

    C/T * log_b(C T / (LC LT)),   b = ln(C LC / (C - LC) + C LC_body / C_body + e),

and the sum of its children's densities (its own text counts as one child).  The node of the
greatest sum is the core.  The threshold is the least density on the path from the core up to
body; nodes at or above it contribute their subtree of the greatest sum, and the text is that
of the least subtree which holds the core and these.  An article or main element around the
core sets its limits: what stands beside it does not widen the choice, what stands in it is
kept.  Without one, a single h1 before the chosen subtree belongs to the text, and blocks that
are little but links go if they come before or after all contributing subtrees.

Names that are no proof (menu, social, related, search, ...) decide nothing inside the article:
such a block stays if it reads like the rest, with few links and at least half of the
characters a tag that the path to body has.  Outside they are cut, and a core in such a block
gives way to one elsewhere unless that one's sum is below a fifth of its own.

Edge cases: null and empty pages give an empty text; a page of plain text is its own main
text; repeated rows are extracted each; an empty table gives an empty result; only page_id,
url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body option title caption thead tbody tfoot tr td th legend".split())
#: an opening tag closes these, up to a tag of the second set
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "a": (frozenset(["a"]), BLOCK),
    "body": (frozenset(["head"]), frozenset()),
}
_P_BARRIER = frozenset("table td th button caption html body article aside section div main nav header footer ul ol dl blockquote form fieldset figure".split())
#: boilerplate by element
DROPPED = frozenset(
    "head script style xmp iframe noembed noframes textarea title noscript template nav header footer aside form button select input datalist "
    "object embed applet svg canvas audio video map dialog menu search".split()
)
#: words of class, id or role that say boilerplate wherever they stand
STRONG_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertisements adverts adslot comment comments commentlist disqus reader-comments replies respond "
    "consent cookie cookies gdpr newsletter paywall popup sidebar sidenav".split()
)
#: words that say it outside the article only
WEAK_WORDS = frozenset(
    "alert alerts banner breadcrumb breadcrumbs complementary contentinfo copyright disclaimer discussion footer header login masthead menu menubar modal nav navbar "
    "navigation notice notices notification notifications pager pagination promo promotion promoted recommended related reply responses search share sharing signup skip "
    "social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_NO_TEXT = frozenset("head script style xmp iframe noembed noframes textarea title noscript template button select input datalist object embed applet svg canvas audio video map".split())
#: comments go even if they hold article elements, as each comment may be one
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reader-comments replies respond".split())
#: words before such a word that say something else ("has-sidebar", "no-ads")
_WITHOUT = frozenset("has no with without".split())
_NEGATING = _WITHOUT | frozenset("entry article post main content page layout".split())
#: elements that hold a piece of running text
_TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption summary".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: what a node is: text, boilerplate by a weak name, by its element, by a strong name, or never text
PLAIN, WEAK, ELEMENT, STRONG, NEVER = range(5)


def _kind(tag: str, attributes: str) -> int:
    if tag in _NO_TEXT:
        return NEVER
    found = ELEMENT if tag in DROPPED else PLAIN
    if not attributes or attributes.isspace() or tag in ("html", "body", "article", "main"):
        # whole pages and articles are no boilerplate, whatever they are called, but a comment may be an article
        return STRONG if tag == "article" and _named(attributes or "") == NEVER else found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return NEVER
    return max(found, min(STRONG, _named(attributes)))


def _named(attributes: str) -> int:
    """What the words of class, id and role say; NEVER for comments."""
    found = PLAIN
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in value.strip("\"'").lower().split():
                words = re.split(r"[-_]+", token)
                for i, w in enumerate(words):
                    before = words[i - 1] if i else ""
                    if w in _COMMENT_WORDS and before not in _WITHOUT:
                        return NEVER
                    if before not in _NEGATING:
                        found = max(found, STRONG if w in STRONG_WORDS else WEAK if w in WEAK_WORDS else PLAIN)
    return found


class Page:
    """The DOM as parallel lists; ``events`` are the texts and the limits of nodes in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind = ["#root"], [-1], [PLAIN]
        #: (node, text), (node, None) at its start, (~node, None) at its end
        self.events: list[tuple[int, str | None]] = []
        stack, at, end = [0], 0, len(source)

        def close(depth: int) -> None:
            while len(stack) > depth:
                self.events.append((~stack.pop(), None))

        def close_implied(kinds: frozenset, barrier: frozenset) -> None:
            for i in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[i]]
                if tag in barrier:
                    return
                if tag in kinds:
                    close(i)
                    # a row also closes the cell around which it was found, and so on
                    return close_implied(kinds, barrier) if len(kinds) > 1 else None

        while at < end:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self.events.append((stack[-1], html.unescape(source[at:stop])))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self.events.append((stack[-1], m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2].lower()
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == tag:
                        close(i)
                        break
                    if tag not in BLOCK and self.tag[stack[i]] in BLOCK:
                        break  # an inline end tag does not close the block around it
                continue
            if tag in CLOSES_P:
                close_implied(frozenset(["p"]), _P_BARRIER)
            if tag in IMPLIED:
                close_implied(*IMPLIED[tag])
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.kind.append(_kind(tag, m[3]))
            self.events.append((node, None))
            if tag in VOID:
                self.events.append((~node, None))
            elif tag in RAW:
                closing = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
                at = closing.end() if closing else end
                self.events.append((~node, None))
            else:
                stack.append(node)
        close(0)
        self._cut()

    def _cut(self) -> None:
        """``open``: outside all boilerplate but for weak names; ``named``: inside a block of a weak name."""
        n, kind, parent = len(self.tag), self.kind, self.parent
        holds, headed, inside = [t in ("article", "main") for t in self.tag], [t in ("h1", "h2") for t in self.tag], [False] * n
        for i in range(1, n):
            inside[i] = inside[parent[i]] or holds[parent[i]]
        for i in range(n - 1, 0, -1):
            headed[parent[i]] |= headed[i]
        free = [True] * n
        for i in range(1, n):
            # the header of an article itself is where its heading stands
            if self.tag[i] == "header" and kind[i] in (WEAK, ELEMENT) and inside[i] and headed[i]:
                kind[i] = PLAIN
            free[i] = free[parent[i]] and kind[i] <= WEAK
        if any(holds) and not any(h and f for h, f in zip(holds, free, strict=True)):
            # the only articles lie in what looks like boilerplate, as in a menu that is never closed
            for i in range(n - 1, 0, -1):
                holds[parent[i]] |= holds[i] and kind[i] <= ELEMENT
            for i in range(1, n):
                if holds[i] and kind[i] == ELEMENT:
                    kind[i] = PLAIN
                free[i] = free[parent[i]] and kind[i] <= WEAK
        self.open, self.named = free, [False] * n
        for i in range(1, n):
            self.named[i] = self.named[parent[i]] or kind[i] == WEAK

    def measure(self) -> None:
        """Characters, tags, and those of links, of each open node, with its density and the sum of its children's."""
        n = len(self.tag)
        self.chars, self.tags, self.link_chars, self.link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.events:
            if text is not None and self.open[node]:
                own[node] += sum(map(len, text.split()))
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for i in range(n - 1, -1, -1):
            if not self.open[i]:
                continue
            self.chars[i] += own[i]
            self.link_chars[i] += own[i] if in_link[i] else 0
            if i:
                p = self.parent[i]
                self.chars[p] += self.chars[i]
                self.tags[p] += self.tags[i] + 1
                self.link_chars[p] += self.link_chars[i]
                self.link_tags[p] += self.link_tags[i] + (self.tag[i] == "a")
        share = self.link_chars[0] / max(1, self.chars[0])
        self.density, self.total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if self.open[i]:
                self.density[i] = composite(self.chars[i], self.tags[i], self.link_chars[i], self.link_tags[i], share)
                self.total[i] += composite(own[i], 0, own[i] if in_link[i] else 0, 0, share)
                if i:
                    self.total[self.parent[i]] += self.density[i]

    def core(self) -> int:
        """The node of the greatest sum, of equal ones the first, and of those on a path the innermost; weak names break near ties."""
        total = self.total
        usual = [i for i in range(len(total)) if self.open[i]]
        best = max(usual, key=lambda i: (total[i], -i))
        if self.named[best]:
            other = max((i for i in usual if not self.named[i]), key=lambda i: (total[i], -i))
            best = other if 5 * total[other] >= total[best] else best
        for i in usual:
            if self.parent[i] == best and total[i] == total[best]:
                best = i
        return best

    def main(self) -> str:
        """The article's text."""
        n, parent = len(self.tag), self.parent
        self.measure()
        if not self.chars[0]:
            return ""
        core = self.core()
        threshold = least_plain = math.inf
        around, i = 0, core
        while i >= 0:
            if self.chars[i] and self.tag[i] not in ("html", "#root"):
                threshold = min(threshold, self.density[i])
                least_plain = min(least_plain, self.chars[i] / max(1, self.tags[i]))
            if self.tag[i] in ("article", "main") and not around:
                around = i
            i = parent[i]
        if around:
            top, marked = around, {around}
        else:
            # of each subtree at or above the threshold, the node of the greatest sum
            best = list(range(n))
            for i in range(n - 1, 0, -1):
                if self.open[i] and self._counts(i) and self.total[best[i]] > self.total[best[parent[i]]]:
                    best[parent[i]] = best[i]
            marked = {core} | {best[i] for i in range(n) if self.open[i] and self._counts(i) and self.chars[i] and self.density[i] >= threshold}
            held = [0] * n  # marked nodes in each subtree
            for i in range(n - 1, -1, -1):
                held[i] += i in marked
                if i:
                    held[parent[i]] += held[i]
            top = max(i for i in range(n) if held[i] == len(marked))
        start, end = self._limits()
        first, last = min(start[m] for m in marked), max(end[m] for m in marked)
        shown = [False] * n
        for i in range(n):
            above = i == 0 or shown[parent[i]]
            within = first <= start[i] and end[i] <= last
            if not above or not self.open[i]:
                continue
            if self.kind[i] == WEAK and not (i <= top and end[i] >= end[top]):
                shown[i] = within and self._reads_like_text(i, least_plain / 2)
            else:
                shown[i] = within or not self._is_link_list(i) or (start[i] <= first and end[i] >= last)
        heading = None if around else self._heading(top)
        parts = [self.text(heading, shown)] if heading else []
        return "\n".join(x for x in [*parts, self.text(top, shown)] if x)

    def _counts(self, i: int) -> bool:
        return not self.named[i]

    def _limits(self) -> tuple[list[int], list[int]]:
        """Where each node starts and ends among the events."""
        n = len(self.tag)
        start, end = [-1] * n, [len(self.events)] * n
        for at, (node, text) in enumerate(self.events):
            if text is None:
                if node >= 0:
                    start[node] = at
                else:
                    end[~node] = at
        return start, end

    def _reads_like_text(self, i: int, plain: float) -> bool:
        if self.tag[i] in _TEXT_LEVEL:
            return 2 * self.link_chars[i] <= self.chars[i]
        return 3 * self.link_chars[i] <= self.chars[i] and self.chars[i] / max(1, self.tags[i]) >= plain

    def _is_link_list(self, i: int) -> bool:
        return self.tag[i] in ("ul", "ol", "div", "section", "table", "p") and self.link_tags[i] >= 3 and self.link_chars[i] > 0.6 * self.chars[i]

    def _heading(self, top: int) -> int | None:
        """The page's only h1, if it stands before and outside of top."""
        found = [i for i in range(1, len(self.tag)) if self.tag[i] == "h1" and self.open[i] and not self.named[i]]
        if len(found) != 1 or found[0] >= top:
            return None
        i = top
        while i > 0:
            i = self.parent[i]
            if i == found[0]:
                return None
        return found[0]

    def text(self, top: int, shown: list[bool]) -> str:
        blocks, run, depth = [], [], 0

        def flush() -> None:
            joined = " ".join("".join(run).split())
            if joined:
                blocks.append(joined)
            run.clear()

        for node, text in self.events:
            inside = node if node >= 0 else ~node
            if text is None:
                if inside == top:
                    depth = 1 if node >= 0 else 0
                if self.tag[inside] in BLOCK:
                    flush()
                elif self.tag[inside] == "br":
                    run.append(" ")
            elif (depth or not top) and shown[node]:
                run.append(text)
        flush()
        return "\n".join(blocks)


def composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite density of c characters and t tags, lc and lt of them of links; share: of link characters on the page."""
    if not c:
        return 0.0
    base = math.log(c * lc / max(1, c - lc) + c * share + math.e)
    return c / max(1, t) * math.log(c * max(1, t) / (max(1, lc) * max(1, lt))) / max(0.1, math.log(base))


def main_text(source: str | None) -> str:
    return Page(source).main() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
