"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Lines of page furniture (menus, headers,
footers, side bars, notices, adverts, forms, reader comments) go; of the rest each weighs its
text, links only inside an article. An article or main element adds to the weight of its lines,
and on a page that has one what lies outside weighs a part. Weights are summed over a sliding
window of lines: where the sum surges the main text begins, where it dives it ends.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a line, that are never text, and that are page furniture.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("script style noscript template iframe object embed svg math canvas video audio map head select textarea button datalist title".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS |= frozenset(("noscript", "template"))
#: Words of class, id or role that mark furniture, whole.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager sidebar rail widget widgets header masthead topbar toolbar footer copyright legal disclaimer social share sharing follow related recommended recommendations trending more-stories comment comments commentlist disqus replies reply respond discussion complementary contentinfo search form skip hidden tagcloud outbrain taboola".split()
)
#: Those of them that may be what an article is about, or part of it: they mark nothing inside one.
OUTSIDE = frozenset("header masthead topbar toolbar rail copyright legal disclaimer follow trending discussion search form skip hidden alert overlay reply consent gdpr".split())
#: Those that mark a compound by its first part, where the second is the name of a box.
BEGINS = frozenset("ad ads advert advertisement sponsored promo cookie cookies consent newsletter share social related comment comments nav menu breadcrumb pagination widget popup modal login signup subscribe".split())
BOXES = frozenset("slot box banner bar container wrapper wrap list area section block unit buttons links form notice notices widget posts articles stories signup modal popup menu items panel".split())
#: Those that mark a compound outside an article by its last part.
ENDS = frozenset("header footer nav navigation navbar menu sidebar comments ads banner breadcrumbs newsletter widget".split())
#: First parts of a compound that says what a page has or hasn't.
ABOUT = frozenset("no has with without not is".split())
#: Marks of what a page may hold more of than of its own text.
MUCH = frozenset("comment comments commentlist disqus replies respond discussion ad ads advert adverts advertisement".split())
#: Words that mark an element as holding the article.
MAIN = re.compile(r"(?:^|[\s_-])(?:article-?body|articlebody|post-?body|entry-?content|post-?content|article-?content|story-?body|main-?content)(?=$|[\s_-])", re.IGNORECASE)

# a quote opens a value only after an equals sign, and only if it is closed
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NEXT_TAG = re.compile(r"<[a-zA-Z/!]")
_ARTICLE_ENDS = re.compile(r"</(?:article|main|body|html)\s*>", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def mark(words: str, inside: bool) -> str:
    """The word of a class, id or role list that marks furniture, or none; inside an article fewer do."""
    for word in words.lower().split():
        if word in MARKS and not (inside and word in OUTSIDE):
            return word
        parts = re.split("[-_]+", word)
        if len(parts) > 1 and parts[0] not in ABOUT:
            if parts[0] in BEGINS and parts[1] in BOXES:
                return parts[0]
            if not inside and parts[-1] in ENDS:
                return parts[-1]
    return ""


def _after(page: str, name: str, at: int) -> int:
    """Where the element that begins before `at` ends; `at` itself if it has no end before the article's."""
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(page, at):
        if not found.group(1):
            depth += not found.group(0).endswith("/>")
            continue
        depth -= 1
        if not depth:
            stop = _ARTICLE_ENDS.search(page, at, found.start())
            return at if stop and name != "head" else found.end()
    return at


@dataclass
class Line:
    """Text of one block: whether it is furniture, lies in an article, is a heading, and how many of its characters are links."""

    text: str
    furniture: bool
    article: bool
    links: int
    heading: bool = False
    marks: tuple[int, ...] = ()


@dataclass
class _Open:
    name: str
    furniture: bool
    article: bool
    mark: int = -1


@dataclass
class _Reader:
    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0

    def end(self, furniture: bool, article: bool, heading: bool, marks: tuple[int, ...]) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append(Line(text, furniture, article, min(self.links, len(text)), heading, marks))
        self.parts.clear()
        self.links = 0


def lines(page: str) -> list[Line]:
    """Lines of a page in order, without markup, scripts, styles and comments in the markup.

    An element without an end takes nothing with it: of a script or the like what stands before the
    next tag, of others the tag alone. A class that names furniture says nothing on an element that
    holds more than half of the page's text, unless it names comments or adverts.
    """
    reader, stack, named = _Reader(), [], []
    endless: set[str] = set()  # names whose end tag doesn't come any more
    furniture = article = 0
    in_link = 0
    heading = ""
    at, size = 0, len(page)

    def finish() -> None:
        reader.end(furniture > 0, article > 0, bool(heading), tuple(o.mark for o in stack if o.mark >= 0))

    def close(position: int) -> None:
        nonlocal furniture, article
        for gone in stack[position:]:
            furniture -= gone.furniture
            article -= gone.article
        del stack[position:]

    while at < size:
        found = _TAG.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            text = html.unescape(page[at:stop])
            reader.parts.append(text)
            if in_link:
                reader.links += len(_SPACE.sub(" ", text).strip())
        if not found:
            break
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            if found.group(0).startswith("<![CDATA["):
                reader.parts.append(found.group(0)[9:].removesuffix("]]>"))
            continue
        ending = found.group(1) == "/"
        if name == "a":
            in_link = max(0, in_link + (-1 if ending else 1))
        if name in BLOCKS:
            finish()
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = "" if ending else name
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if stack[i].name in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break  # an end tag without begin doesn't leave the article
            continue
        if name in RAW or name in UNSEEN:
            if name == "head":  # may lack its end
                end = re.compile(r"</head\s*>|<body[\s>]", re.IGNORECASE).search(page, at)
                at = end.start() if end else at
            elif name in VOID or name not in RAW and found.group(0).endswith("/>"):
                pass
            else:
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                if not end:
                    endless.add(name)
                if name not in RAW:
                    at = _after(page, name, at) if end else at
                elif end:  # text up to its own end, whatever tags stand in it
                    at = end.end()
                else:
                    following = _NEXT_TAG.search(page, at)
                    at = following.start() if following else size
            continue
        if name in VOID or found.group(3).endswith("/") and name in ("br", "hr", "img"):
            continue
        marks: dict[str, str] = {}
        for a, v in _ATTR.findall(found.group(3)):
            marks.setdefault(a.lower(), v[1:-1] if v[:1] in ("'", '"') and len(v) > 1 else v)
        words = f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}"
        main = name in ("article", "main") or marks.get("itemprop", "").lower() == "articlebody" or bool(MAIN.search(words)) or marks.get("role", "").lower() in ("main", "article")
        plain = name in ("html", "body") or main and name in ("article", "main") and not re.search(r"\b(?:comments?|reply|related|promo|teaser|ad)\b", words, re.IGNORECASE)
        bad = not plain and not MAIN.search(words) and (name in FURNITURE or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", marks.get("style", ""), re.IGNORECASE)))
        word = "" if plain or bad or MAIN.search(words) else mark(words, article > 0)
        if name in ("article", "main") and plain and furniture and not any(o.name in ("article", "main") for o in stack):
            close(next((i for i, o in enumerate(stack) if o.furniture), len(stack)))  # furniture that was never closed ends here
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and not bad and not word:
            continue  # their ends may be left out
        inside = main and not bad and not word
        stack.append(_Open(name, bad, inside, len(named) if word else -1))
        if word:
            named.append(word)
        furniture += bad
        article += inside
    finish()
    held = [0] * len(named)
    for line in reader.lines:
        for i in line.marks:
            held[i] += len(line.text)
    whole = sum(len(line.text) for line in reader.lines if not line.furniture)
    true = {i for i, word in enumerate(named) if word in MUCH or 2 * held[i] <= whole}
    for line in reader.lines:
        line.furniture |= not true.isdisjoint(line.marks)
    return reader.lines


@dataclass(frozen=True)
class Blocks:
    """Lines of a window, weights of a window at which it surges and under which it dives.

    A page whose windows all stay below `surge` surges at its heaviest one. Lines of an article weigh
    `bonus` more, those outside one `outside` of their text where the page has one; outside, lines
    whose text is links to `link_share` or more weigh nothing.
    """

    window: int = 3
    surge: float = 80
    dive: float = 20
    bonus: float = 40
    outside: float = 0.25
    link_share: float = 0.6


def main_lines(found: list[Line], plan: Blocks = Blocks()) -> list[Line]:
    """Lines between surges and dives; short lines right before the first are left out unless they are headings."""
    left = [x for x in found if not x.furniture]
    inside = any(x.article for x in left)
    weights = []
    for x in left:
        own = 0 if x.links >= plan.link_share * len(x.text) else len(x.text) - x.links
        weights.append(len(x.text) + plan.bonus if x.article else own * (plan.outside if inside else 1))
    n = len(left)
    sums = [sum(weights[i : i + plan.window]) for i in range(n)]
    surge = min(plan.surge, max(sums, default=0))
    out: list[Line] = []
    i = 0
    while i < n:
        if not weights[i] or sums[i] < surge:
            i += 1
            continue
        j = i
        while j < n and sums[j] >= min(plan.dive, surge):  # from the surge to the dive
            j += 1
        while i < j and weights[i] < min(plan.dive, surge) and not left[i].heading:
            i += 1
        out += [x for x, w in zip(left[i:j], weights[i:j], strict=True) if w]
        i = max(j, i + 1)
    return out


def main_text(page: str | None, plan: Blocks = Blocks()) -> str:
    """The main text of a page, its blocks joined by newlines; empty for none."""
    return "\n".join(x.text for x in main_lines(lines(page or ""), plan))


def extracted(pages: DataFrame, page: str = "html", key: str = "page_id", address: str = "url", plan: Blocks = Blocks()) -> DataFrame:
    """One row per row of pages: key, address, text, n_chars (code points).

    A null or empty page, or one without main text, has an empty text. Rows are taken one by one, so
    repeated rows and null keys stay as they are; other columns are not read. Broken markup is read
    as far as it goes: a tag that never ends takes the rest of the page. Pages of any length are read
    whole, one at a time. No rows give no rows.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p.as_py(), plan) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, address, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, address)}
    return pages.select(F.col(key), F.col(address), F.col(page)).mapInArrow(extract, f"`{key}` {kinds[key]}, `{address}` {kinds[address]}, text string, n_chars long")
