"""Main text of web pages by tag-path ratios.

A page is read once, from left to right, as blocks of text, each with the path of tags from the root to its block element. Blocks are
grouped by path; a path's ratio is its text per block, weighed by its punctuation and by the share of its text outside links. Ratios are
smoothed over neighbouring blocks in page order and fused into one score a block; paths that hold a share of the best score are content
paths, and the innermost element that holds all their text is the content node, widened to the article or main part around it, or without
one by the headings, paragraphs and blocks of content score beside it. All its blocks are the text, but for those in navigation, asides, forms,
adverts, notices and comments, told by their tags and by class, id and role names that hold nothing but words of that kind.

Time and memory are linear in the page, whatever is unclosed or nested in it: paths and elements are numbered nodes of trees, and an end
that was sought once in vain is not sought again.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, register, table

#: Share of the best smoothed score from which a path is content; neighbours weighed in smoothing.
SHARE, SMOOTH = 0.2, (0.25, 0.5, 0.25)
#: Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template svg math iframe object canvas head select".split())
_BLOCK = frozenset("""html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
_OUT = frozenset("nav footer aside form menu button dialog input label fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: What a new item, cell or row ends besides a paragraph.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of names that rule a part out, and words that may stand beside them in a name ("comment-list" is a list of comments, but
#: "comments-on-the-law" and "share-price" are about something).
_SIGN = re.compile(
    r"ads?|advert\w*|breadcrumbs?|comments?|cookies?|consent|disqus|footer|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*"
    r"|recommend\w*|related|repl(?:y|ies)|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widgets?")
_HEAD_SIGN = re.compile(r"banner|header|masthead")
_BESIDE = frozenset("""area article bar blog block body bottom box button buttons col column container content entry form global group inner
item items left link links list main outer page panel post posts primary reader readers right row secondary section site slot sticky
stories text thread title top unit user users wrap wrapper zone""".split())
_HEAD_BESIDE = frozenset("bar container global inner main page section site sticky top wrap wrapper".split())
_NAME = re.compile(r"[^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"class\s*=\s*(\"[^\"]*\"|'[^']*')", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def ruled_out(names: str, in_article: bool) -> bool:
    """Whether one of the class, id or role names consists of words that rule a part out, with at most words of layout beside them."""
    for name in names.split():
        parts = [x.lower() for x in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if x and not x.isdigit()]
        signs = [x for x in parts if _SIGN.fullmatch(x)]
        heads = [x for x in parts if _HEAD_SIGN.fullmatch(x)]
        rest = set(parts) - set(signs) - set(heads)
        if signs and rest <= _BESIDE or heads and not in_article and rest <= _HEAD_BESIDE:
            return True
    return False


class Scanner:
    """The tokens of a page in order: ``(text, name, closing, attributes)``, a stretch of text and the tag after it ("" if none)."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.unclosed: set[str] = set()
        self.raw = ""

    def tokens(self):
        page, at, seen = self.page, 0, 0  # text from ``at`` on is not handed out yet, ``seen`` is where to look on
        while (open_ := page.find("<", seen)) >= 0 and (open_ < self.last or page.startswith("<!--", open_)):
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 4)
                yield page[at:open_], "", False, ""
                at = seen = len(page) if end < 0 else end + 3
                continue
            first = page[open_ + 1: open_ + 2]
            closing = first == "/"
            start = open_ + 1 + closing
            if first in ("!", "?"):
                yield page[at:open_], "", False, ""
                at = seen = page.find(">", open_) + 1
            elif page[start: start + 1].isascii() and page[start: start + 1].isalpha():
                stop = _NAME.match(page, start).end()
                end = self._end(stop)
                yield page[at:open_], page[start:stop].lower(), closing, page[stop:end]
                at = seen = end + 1
                if self.raw:  # the reader of the tokens asked to pass over what is inside this element
                    at = seen = self._behind(self.raw, at)
                    self.raw = ""
            else:
                seen = open_ + 1
        yield page[at:], "", False, ""

    def _end(self, at: int) -> int:
        """Where the tag ends: the first ``>`` outside quotes, or after one search in vain the first ``>`` at all."""
        start = at
        while self.quotes and (found := _STOP.search(self.page, at)):
            if found[0] == ">":
                return found.start()
            at = self.page.find(found[0], found.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.page.find(">", start)

    def _behind(self, name: str, at: int) -> int:
        """Behind the end tag of an element whose inside is no text; scripts, styles and heads without one reach to the end of the page."""
        close = None if name in self.unclosed else re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
        if close is not None:
            return close.end()
        self.unclosed.add(name)
        return len(self.page) if name in ("script", "style", "head") else at


class Block:
    """One block of text: its pieces, the innermost block element around it, its path, and whether something around it rules it out."""

    __slots__ = ("parts", "linked", "element", "path", "out")

    def __init__(self, element: int, path: int, out: bool):
        self.parts, self.linked, self.element, self.path, self.out = [], 0, element, path, out

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


class Page:
    """Blocks of a page in order, and its block elements as a tree: ``parent`` and ``tag`` by number, 0 is the page itself.

    Unclosed elements end with the element around them, paragraphs before the next block.
    """

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.tag = [0], [""]
        paths: dict[tuple[int, str], int] = {}
        # Tag, block element, path, ruled out, inside an article.
        stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
        levels = [0]  # where the block elements stand on the stack
        opened: Counter[str] = Counter()
        current = None

        def cut(depth: int):
            for e in stack[depth:]:
                opened[e[0]] -= 1
            del stack[depth:]
            while levels[-1] >= depth:
                levels.pop()

        scanner = Scanner(page)
        for text, name, closing, attributes in scanner.tokens():
            if text and not (current is None and text.isspace()):
                if current is None:
                    _, element, path, out, _ = stack[-1]
                    current = Block(element, path, out)
                    self.blocks.append(current)
                current.parts.append(text)
                current.linked += len(text) if opened["a"] else 0
            if not name:
                continue
            if closing:
                block = name in _BLOCK
                current = None if block else current
                if not opened[name]:
                    continue
                depth = len(stack) - 1
                while stack[depth][0] != name and (block or stack[depth][0] not in _BLOCK):
                    depth -= 1
                if stack[depth][0] == name and depth:
                    cut(depth)
                continue
            single = attributes.rstrip().endswith("/")
            if name in _RAW:
                if not single:
                    scanner.raw = name
                continue
            if name == "br" and current is not None:
                current.parts.append(" ")
            if name in _BLOCK:
                current = None
                ends = _ENDS.get(name, ())
                while levels[-1] and (stack[levels[-1]][0] == "p" or stack[levels[-1]][0] in ends):
                    cut(levels[-1])
            if name in _VOID or single:
                continue
            _, element, path, out, in_article = stack[-1]
            names = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)) if attributes else ""
            out = (out or name in _OUT or name == "header" and not in_article
                   or bool(attributes) and bool(_HIDDEN.search(_CLASS.sub("", attributes)))
                   or name not in ("html", "body", "main", "article") and bool(names) and ruled_out(names, in_article))
            if name in _BLOCK:
                path = paths.setdefault((path, name), len(paths) + 1)
                self.parent.append(element)
                self.tag.append(name)
                element = len(self.tag) - 1
                levels.append(len(stack))
            stack.append((name, element, path, out, in_article or name in ("article", "main")))
            opened[name] += 1


def scores(size: np.ndarray, signs: np.ndarray, linked: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fused score of every block and the mean score of its path."""
    _, path = np.unique(paths, return_inverse=True)
    rows = np.bincount(path)
    mean = lambda values: (np.bincount(path, values) / rows)[path]
    ratio = mean(size) * (1 + mean(signs)) * mean(1 - np.minimum(1, linked / size))
    fused = np.sqrt(ratio * np.convolve(np.pad(ratio, 1, mode="edge"), SMOOTH, "valid"))
    return fused, mean(fused)


def extract(text: str | None, share: float = SHARE) -> str:
    """The main text: the content node's blocks, one a line. Without any content node it is empty."""
    page = Page(text or "")
    rows = [(b, t) for b in page.blocks if not b.out and (t := b.text())]
    if not rows:
        return ""
    size = np.array([len(t) for _, t in rows], float)
    signs = np.array([len(_PUNCTUATION.findall(t)) for _, t in rows], float)
    fused, of_path = scores(size, signs, np.array([b.linked for b, _ in rows], float), np.array([b.path for b, _ in rows]))
    if fused.max() <= 0:
        return ""
    content = of_path >= share * fused.max() * (1 - 1e-12)
    if not content.any():
        content = fused == fused.max()
    # Content blocks and all blocks under every element; children have higher numbers than their parents.
    held, total, apart = [0] * len(page.tag), [0] * len(page.tag), [0] * len(page.tag)
    for k, (b, _) in enumerate(rows):
        held[b.element] += int(content[k])
        total[b.element] += 1
        heading = page.tag[b.element] in _HEADINGS or page.tag[page.parent[b.element]] in _HEADINGS
        prose = page.tag[b.element] == "p" and 2 * b.linked < size[k]
        apart[b.element] += not (heading or prose or content[k])
    for e in range(len(page.tag) - 1, 0, -1):
        held[page.parent[e]] += held[e]
        total[page.parent[e]] += total[e]
        apart[page.parent[e]] += apart[e]
    node = max(e for e, n in enumerate(held) if n == held[0])
    around = [node]
    while around[-1]:
        around.append(page.parent[around[-1]])
    for tags in (("article", "main"), ("section",)):
        if wide := [e for e in around if page.tag[e] in tags]:
            node = wide[0]
            break
    else:
        # No such part: take in what else is content, a heading or a paragraph, and the blocks beside a lone one.
        while node and page.tag[page.parent[node]] not in ("", "html", "body") and (
                apart[page.parent[node]] == apart[node] or total[node] == 1):
            node = page.parent[node]
    inside = [False] * len(page.tag)
    inside[node] = True
    for e in range(node + 1, len(page.tag)):
        inside[e] = inside[page.parent[e]]
    return "\n".join(t for b, t in rows if inside[b.element])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html), other columns are not read.

    A null or empty page has an empty text; null ids and urls stay null; repeated rows are read each for itself, an empty table gives none.
    """
    def run(batch: pa.RecordBatch):
        texts = [extract(page) for page in batch.column("html").to_pylist()]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


@register("op8_html_text")
def op8(spark, sf_dir) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
