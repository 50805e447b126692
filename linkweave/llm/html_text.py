"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with the path of tags from the root to it. Text length, number of
blocks, punctuation and linked characters are summed per path. A path's ratio, length a block, is smoothed over
the sequence of blocks, fused with its punctuation and its share of unlinked text, and weighed by what its tags say (an
article speaks for a path; the blocks of a menu or an advert are left out first). Paths above a threshold of the best are content, and so are
the other paths within the container that they share, such as headings and lists.

Every page is worked on by itself in an Arrow function; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkweave.llm.textbytes import pieces

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ASIDE = frozenset("nav footer aside form button select textarea menu dialog fieldset option".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu "
    "nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
KEEPS_IN = frozenset("ul ol dl table tr select".split())

NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?s?|menu|nav(?:bar|igation)?|sidebar|side|widgets?|footer|foot|"
    r"masthead|topbar|breadcrumbs?|comments?|comment-?list|disqus|respond|reply|replies|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|trending|pagination|pager|search|skip|toolbar|banner|"
    r"copyright|legal|disclaimer|tags)(?:$|[\s_-])",
    re.IGNORECASE,
)
FIRM = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?s?|menu|nav(?:bar|igation)?|breadcrumbs?|comments?|comment-?list|"
    r"disqus|respond|reply|replies|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|skip|pagination|"
    r"pager|toolbar|copyright)(?:$|[\s_-])",
    re.IGNORECASE,
)
"""Noise that a paragraph's own name is believed for."""
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPHS = frozenset("p blockquote li dt dd td th pre figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|content|main)(?:$|[\s_-])", re.IGNORECASE)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
# a tag whose end is hidden behind a quote that never closes ends at the next sign
LOOSE = re.compile(r"<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>[^>]*)>")
# headings, lists, paragraphs, quotations and tables, which hold text of an article however much of it is linked
PROSE = frozenset("h1 h2 h3 h4 h5 h6".split()) | PARAGRAPHS
SCOPES = frozenset("button td th".split())
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")


class Paths:
    """The tag paths of a page as a tree of numbers, so that a path costs the same however deep it lies. 0 is the root."""

    def __init__(self):
        self.parent, self.label, self.prose = [0], [""], [False]
        self._known: dict[tuple[int, str], int] = {}

    def below(self, parent: int, tag: str, label: str) -> int:
        k = self._known.setdefault((parent, label), len(self.label))
        if k == len(self.label):
            self.parent.append(parent)
            self.label.append(label)
            self.prose.append(self.prose[parent] or tag in PROSE)
        return k

    def inside(self, top: int) -> np.ndarray:
        """Which paths lie below one; a path comes after its parent."""
        out = np.zeros(len(self.label), bool)
        for k in range(1, len(self.label)):
            out[k] = self.parent[k] == top or out[self.parent[k]]
        return out

    def steps(self, k: int, top: int, most: int) -> list[str]:
        """The labels from below `top` to a path, no more than `most`."""
        out: list[str] = []
        while k and k != top and len(out) < most:
            out.append(self.label[k])
            k = self.parent[k]
        return out[::-1]


@dataclass
class Block:
    path: int
    text: str
    linked: int
    noise: bool
    main: bool
    group: int = 0
    """Main text within an element whose class or id alone names noise: the number of that element, else 0."""
    aside: int = 0
    """Text of a main element within an element whose name alone hints at noise: the number of that element, else 0."""


@dataclass(frozen=True)
class PathRules:
    sigma: float = 1.0
    """Width of the smoothing over neighbouring blocks."""
    threshold: float = 0.25
    """Paths that reach this share of the best path's fused ratio are content."""
    most_linked: float = 0.5
    """Paths with more of their text in links are not, but for headings, lists and the like in the article."""
    main_weight: float = 4.0


def _flags(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool, bool, bool, bool, str]:
    """(noise, named noise, hinted noise, main, named main, label): what an element's name and attributes say of its text.

    Classes and ids are judged name by name, and a name that says both is noise (comment-content). Noise that only names speak
    for gives way to a main element: to one that is it by a name, tag or role of its own, or to one within it (see content).

    Within a main element a heading's name says nothing; a name of which only a part is noise (related-work), or a paragraph's that
    may be prose as well, is a hint: its links decide.
    """
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    names = [*found.get("class", "").split(), found.get("id", "")]
    role = found.get("role", "").lower()
    bad = [bool(NOISE.search(x)) for x in names]
    named = any(MAIN.search(x) and not n for x, n in zip(names, bad, strict=True))
    called = tag in ("article", "main") or role in ("main", "article")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    noise = tag in ASIDE or role in ROLES or bool(hidden) or (tag == "header" and not inside_main)
    main = named or called
    named_noise = any(bad) and not main and tag not in ("html", "body")
    hinted = False
    if named_noise and inside_main:
        said = [x for x, n in zip(names, bad, strict=True) if n]
        whole = any(all(NOISE.search(t) for t in re.split(r"[\s_-]+", x) if t) for x in said)
        firm = any(FIRM.search(x) for x in said)
        hinted = tag not in HEADINGS and not (firm if tag in PARAGRAPHS else whole or firm)
        named_noise = tag not in HEADINGS and not hinted
    label = tag + (f".{found['class']}" if found.get("class") else "")
    # an id tells paths apart where it says something: those of single paragraphs don't
    if (own := found.get("id", "")) and (MAIN.search(own) or NOISE.search(own)):
        label += "#" + own.replace("/", "_")
    if role in ROLES or role in ("main", "article"):
        label += f"[{role}]"
    return noise, named_noise, hinted, main and not noise, (named or not any(bad)) and main and not noise, label


@dataclass
class Open:
    """An open element: what it hands down to its text, and the nearest open elements that matter to those below."""

    tag: str = ""
    noise: bool = False
    named: int = 0
    group: int = 0
    """The element whose named noise gave way to a main element."""
    main: bool = False
    aside: int = 0
    path: int = 0
    paragraph: int = 0
    """Place of the open paragraph that a block would close."""
    keeps: int = 0
    """Place of the list or table that items can't close beyond."""


def blocks(page: str) -> tuple[list[Block], Paths]:
    """The text blocks of a page in page order, without those of elements that show no text, and their paths.

    Every sign is looked at a bounded number of times, however deep elements nest and whatever is left unclosed.
    """
    out: list[Block] = []
    paths = Paths()
    stack = [Open()]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    texts: list[str] = []
    links, unseen, linked, k, groups = 0, 0, 0, 0, 0
    last = page.rfind(">")

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            top = stack[-1]
            out.append(Block(top.path, text, min(linked, len(text)), top.noise or top.named > 0, top.main and not top.named, top.group, top.aside))
        texts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            text = html.unescape(raw)
            texts.append(text)
            if links:
                linked += len(text)

    def leave(upto: int) -> None:
        nonlocal unseen
        close()
        while len(stack) > upto:
            gone = stack.pop().tag
            places[gone].pop()
            unseen -= gone in UNSEEN

    while k < len(page):
        at = page.find("<", k)
        if at > last >= 0 or (at >= 0 > last):  # no tag ends beyond; what may begin is a comment
            at = page.find("<!", k)
        if at < 0:
            add(page[k:])
            break
        add(page[k:at])
        m = TOKEN.match(page, at) or LOOSE.match(page, at)
        if not m:
            add("<")
            k = at + 1
            continue
        k = m.end()
        if m.re is TOKEN and m["cdata"] is not None:
            add(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                add(" ")
            elif tag not in INLINE:
                if places.get(tag):
                    leave(places[tag][-1])
                else:
                    close()
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                add(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag in CLOSES_P and stack[-1].paragraph:
            leave(stack[-1].paragraph)
        for other in CLOSES.get(tag, ()):
            open_ones, keeps = places.get(other, []), stack[-1].keeps
            n = len(open_ones)
            while n and open_ones[n - 1] > keeps:
                n -= 1
            if n < len(open_ones):
                leave(open_ones[n])
        close()
        above = stack[-1]
        noise, own_named, hinted, main, wins, label = _flags(tag, m["attributes"], above.main)
        named, group, aside = above.named, above.group, above.aside
        if named and wins:
            named, group = 0, named
        elif own_named and not named:
            groups += 1
            named = groups
        if hinted and not aside:
            groups += 1
            aside = groups
        if not m["attributes"].rstrip().endswith("/") or tag not in ("svg", "math"):
            place = len(stack)
            stack.append(Open(
                tag, above.noise or noise, named, group, above.main or main, aside, paths.below(above.path, tag, label),
                place if tag == "p" else 0 if tag in SCOPES else above.paragraph, place if tag in KEEPS_IN else above.keeps,
            ))
            places.setdefault(tag, []).append(place)
            unseen += tag in UNSEEN
            links = 0
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, k)
            add(page[k : end.start()] if end else "")
            k = end.start() if end else len(page)
    close()
    return out, paths


def content(found: list[Block], paths: Paths, rules: PathRules = PathRules()) -> list[Block]:
    """The blocks on content paths. Noise is left out block by block, and blocks of main elements make paths of their own.

    What a name hints at is noise if more than `most_linked` of its text is linked.

    Main text within named noise is content where it holds more unlinked text than all other main text: the article in a
    wrapper of an odd name, but not the teasers or comments beside an article.
    """
    found = [b for b in found if not b.noise]
    hints: dict[int, list[int]] = {}
    for b in found:
        if b.aside:
            sums = hints.setdefault(b.aside, [0, 0])
            sums[0] += b.linked
            sums[1] += len(b.text)
    found = [b for b in found if not b.aside or hints[b.aside][0] <= rules.most_linked * hints[b.aside][1]]
    free: dict[int, int] = {}
    for b in found:
        if b.main:
            free[b.group] = free.get(b.group, 0) + len(b.text) - b.linked
    most = max((n for group, n in free.items() if group), default=0)
    holds = {group for group, n in free.items() if n > free.get(0, 0) and n >= rules.threshold * most}
    found = [b for b in found if not b.group or b.group in holds]
    if not found:
        return []
    names = {p: k for k, p in enumerate(dict.fromkeys((b.path, b.main) for b in found))}
    path = np.array([names[b.path, b.main] for b in found])
    size = np.array([len(b.text) for b in found], float)
    number = np.bincount(path)
    length = np.bincount(path, size)
    points = np.bincount(path, [len(PUNCTUATION.findall(b.text)) for b in found])
    linked = np.bincount(path, [b.linked for b in found]) / length
    in_main = np.array([main for _, main in names])
    ratio = (length / number)[path]
    reach = np.arange(-3, 4)
    weights = np.exp(-(reach**2) / (2 * rules.sigma**2))
    around = np.convolve(ratio, weights, "same" if len(ratio) >= 7 else "full")
    whole = np.convolve(np.ones(len(ratio)), weights, "same" if len(ratio) >= 7 else "full")
    if len(ratio) < 7:
        around, whole = around[3 : 3 + len(ratio)], whole[3 : 3 + len(ratio)]
    smooth = np.bincount(path, around / whole) / number
    fused = np.sqrt(smooth * length / number) * (1 + points / number) * (1 - linked) * np.where(in_main, rules.main_weight, 1.0)
    listed = [p for p, _ in names]
    heavy = linked > rules.most_linked
    fused[heavy] = 0
    fused *= np.sqrt(length)  # a path of many blocks speaks for more of the page
    if fused.max() <= 0:
        return []
    best = int(fused.argmax())
    chosen = fused >= rules.threshold * fused[best]
    # the container of the best path: the main elements, else its parent
    if in_main[best]:
        inside = in_main
    else:
        parent = paths.parent[listed[best]]
        deep = len(paths.steps(parent, 0, 2)) > 1
        inside = paths.inside(parent)[listed] if deep else np.zeros(len(listed), bool)
        if not inside.any():  # children of the body: headings beside the paragraphs, and runs of text
            inside = np.array([_beside(paths, p, parent) for p in listed])
    if in_main[best]:
        take = inside & (~heavy | np.array([paths.prose[p] for p in listed]))
    else:
        take = (chosen | inside) & ~heavy
    return [b for b, k in zip(found, path, strict=True) if take[k]]


def _beside(paths: Paths, path: int, parent: int) -> bool:
    """Whether a path is a heading, paragraph, list item or the like right below another."""
    steps = paths.steps(path, parent, 3)
    if len(steps) > 2 or (steps and paths.parent[path] != parent and paths.parent[paths.parent[path]] != parent):
        return False
    return bool(re.fullmatch(r"(?:h[1-6]|p|ul/li|ol/li|blockquote|pre)(?:\.[^/]*)?", "/".join(steps)))


def main_text(page: str | None, rules: PathRules = PathRules()) -> str:
    """Blocks of main text joined by line ends; '' for NULL, empty or text-free pages."""
    return "\n".join(b.text for b in content(*blocks(page or ""), rules))


def extracted(pages: DataFrame, rules: PathRules = PathRules(), keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns `keep` with text and n_chars (code points) of every page; repeated rows give a row each."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "__html"):
                texts = [main_text(x, rules) for x in batch.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=[*keep, "text", "n_chars"],
                )

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, pages[page].cast("string").alias("__html")).mapInArrow(extract, f"{kinds}, text string, n_chars long")
