"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each at a path of block-level tags from the root. Per path the text
length and the punctuation are added up and divided by its number of blocks; both ratios are fused to
a score, scores are smoothed over neighbouring blocks, and the blocks of all paths whose mean score
reaches a threshold are the text, in page order. The container is <article> or <main> where they hold
text, else the element around most of the content found so far. Its text gets a term on the score that
reaches the threshold, so headings, table heads, listings and other blocks without punctuation stay;
a path whose text is all links, as in a menu, has no score to add to. In a container found by content
boxes of their own get a lower term and need a ratio. Beside a container <article> or <main> nothing counts.
Menus, headers, footers, sidebars, forms and hidden parts never count. A class, id or role that names
a notice, an advert and the like excludes its element, unless that holds half of the content or more;
reader comments so named are left out whatever their share, as long as there is any other text.

Defined results: a null or empty page, or one without text, has the empty text; broken markup is read
as far as it goes (a new block ends an open paragraph, unknown end tags are ignored, an unfinished tag
is dropped); nothing is cut by length.
"""

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lidarlake.llm.common import slices

# Fixed values of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
ENDS_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
             "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}

# Fixed values of this method: what never belongs to an article.
OTHER_TAGS = frozenset("head nav footer aside form button select option dialog svg math canvas object template audio video".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promotion recommended related respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget complementary "
    "contentinfo".split()
)
COMMENT_NAMES = frozenset("comment comments disqus".split())
# Words that may follow such a name without naming another thing, and words that make it a mere state.
PART_NAMES = frozenset(
    "area bar block body bottom box button buttons center column container content form group holder inner item "
    "items left link links list message module outer overlay panel post posts region right row section slot text "
    "thread title top unit wrap wrapper zone".split()
)
STATE_NAMES = frozenset("disable enable has hide is no show with without".split())
FLOW = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre address details summary figure figcaption table thead tbody "
    "tfoot tr td th caption".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？«»\"'()¿¡-]")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _names(given) -> list:
    """Words of each class, id and role of an element, as ordered dictionaries' keys."""
    tokens = " ".join(given.get(k, "") for k in ("class", "id", "role")).split() if given else ()
    return [dict.fromkeys(w.lower() for w in _NAME.findall(t)).keys() for t in tokens]


def _says(names, wanted) -> bool:
    """Whether a name ends with a wanted word, apart from words for parts and numbers, and is no state."""
    for words in map(list, names):
        while len(words) > 1 and words[-1] not in wanted and (words[-1] in PART_NAMES or words[-1].isdigit()):
            words.pop()
        if words and words[-1] in wanted and words[0] not in STATE_NAMES:
            return True
    return False


class Page:
    """Elements (parent, tag, path, other, named, ...) and text blocks (element, text, link characters) of a page.

    ``other`` holds for all inside an element, ``named`` and ``comments`` only for the element whose class, id or
    role says so.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.other, self.main = [-1], [""], [0], [False], [False]
        self.named, self.comments = [False], [False]
        self.paths, self.blocks = {}, []
        self._stack, self._text, self._linked, self._link = [0], [], 0, False
        self._open = defaultdict(list)  # places in the stack of the open elements of each tag
        self._read(source)
        self._flush()

    def _flush(self):
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._stack[-1], text, self._linked))
        self._text, self._linked = [], 0

    def _say(self, raw):
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._link:
                self._linked += len(text)

    def _read(self, s):
        at, n = 0, len(s)
        while at < n:
            cut = s.find("<", at)
            if cut < 0:
                self._say(s[at:])
                return
            self._say(s[at:cut])
            if s.startswith("<!--", cut):
                end = s.find("-->", cut + 4)
                at = n if end < 0 else end + 3
                continue
            if s.startswith(("<!", "<?"), cut):
                end = s.find(">", cut)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(s, cut) or _LOOSE.match(s, cut)
            if not m:
                if re.match("</?[a-zA-Z]", s[cut : cut + 3]):
                    return
                self._say("<")
                at = cut + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(s, at)
                at = n if end is None else s.find(">", end.start()) + 1 or n
            else:
                self._start(tag, m[3])

    def _start(self, tag, attributes):
        if tag in INLINE:
            self._link = self._link or tag == "a"
            return
        if tag == "br":
            self._text.append(" ")
            return
        if tag in VOID and tag != "hr":
            return
        self._flush()
        if tag in ENDS_PARAGRAPH:
            self._close(("p",), ("table", "td", "th", "button"))
        if tag in ENDS_SAME:
            self._close(ENDS_SAME[tag], SCOPE.get(tag, ("table", "select", "datalist")))
        self._link = False
        if tag == "hr":
            return
        top = self._stack[-1]
        given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        key = (self.path[top], tag)
        inside = self.main[top]
        self.parent.append(top)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.main.append(inside or tag in ("article", "main") or given.get("role") == "main")
        self.other.append(self.other[top] or self._is_other(tag, given, inside))
        names = [] if tag in ("html", "body", "main", "article") else _names(given)
        self.named.append(any(w & OTHER_NAMES or ("header" in w and not inside) for w in names) if not inside else _says(names, OTHER_NAMES))
        self.comments.append(_says(names, COMMENT_NAMES))
        self._open[tag].append(len(self._stack))
        self._stack.append(len(self.parent) - 1)

    @staticmethod
    def _is_other(tag, given, inside):
        if tag in OTHER_TAGS or (tag == "header" and not inside):
            return True
        if tag in ("html", "body", "main", "article") or not given:
            return False
        return "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "")))

    def _end(self, tag):
        if tag in INLINE:
            self._link = self._link and tag != "a"
        elif tag == "br":
            self._text.append(" ")
        elif tag not in VOID:
            self._flush()
            self._close((tag,), ())

    def _close(self, tags, scope):
        """Close the innermost open element of ``tags`` and all inside it, unless one of ``scope`` is in between."""
        found = max((self._open[t][-1] for t in tags if self._open[t]), default=0)
        if not found or any(self._open[t] and self._open[t][-1] > found for t in scope):
            return
        while len(self._stack) > found:
            self._open[self.tag[self._stack.pop()]].pop()
        self._link = False


class Ratios:
    """Text and punctuation ratios of the paths of a page, over blocks that are not ``other``."""

    def __init__(self, page: Page, other: list):
        path = np.array([page.path[e] for e, _, _ in page.blocks])
        self.use = np.array([not other[e] for e, _, _ in page.blocks])
        # Text inside links counts against a path.
        self.size = np.array([max(0, len(t) - 2 * linked) for _, t, linked in page.blocks], float) * self.use
        marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in page.blocks], float) * self.use
        _, place, many = np.unique(path, return_inverse=True, return_counts=True)
        length, points = np.bincount(place, self.size) / many, np.bincount(place, marks) / many
        # Without any punctuation the length of the text has to do.
        score = (length * points if (length * points).any() else length)[place] * self.use
        # Neighbours are the blocks before and after that count: an advert between two does not part them.
        counted = score[self.use]
        padded = np.concatenate([counted[:1], counted, counted[-1:]])
        smooth = np.zeros(len(score))
        smooth[self.use] = (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4
        self.mean = (np.bincount(place, smooth * self.use) / many)[place]
        self.spread = smooth.std()
        # Text of the path of each block: a path of links only holds none.
        self.total = np.bincount(place, self.size)[place]

    def chosen(self, near=None, share=0.5, term=0.49):
        """Blocks whose score reaches ``share`` of the standard deviation.

        ``near`` blocks get more on top: ``term`` of it (1) or all of ``share`` (2), or never count (-1).
        """
        near = np.zeros(len(self.mean), int) if near is None else near
        score = self.mean + np.choose(near + 1, [0, 0, term, share]) * self.spread
        ratio = (self.mean > 0) | (near == 2)
        found = self.use & ratio & (self.total > 0) & (near >= 0) & (score >= share * self.spread)
        if not found.any():
            found = self.use & (self.size > 0) & (near >= 0)
            if found.any():
                found &= self.total == self.total[found].max()
        return found


def _inside(page: Page, blocks_weight) -> np.ndarray:
    """Per element the weight of the blocks in it."""
    weight = np.zeros(len(page.parent))
    for (e, _, _), w in zip(page.blocks, blocks_weight):
        weight[e] += w
    for e in range(len(weight) - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
    return weight


def _spread(page: Page, other) -> list:
    """``other`` with all elements inside its elements."""
    out = list(other)
    for e in range(1, len(out)):
        out[e] = bool(out[e] or out[page.parent[e]])
    return out


def _others(page: Page) -> list:
    """Elements outside the article; a name does not exclude an element with half of the content."""
    without = _spread(page, np.array(page.other) | np.array(page.comments))
    if (Ratios(page, without).size > 0).any():
        base = without
    else:
        base = page.other
    plain = Ratios(page, base)
    # Text in <article> or <main> weighs more: an advert longer than a very short article stays one.
    main = np.array([page.main[e] for e, _, _ in page.blocks])
    weight = _inside(page, plain.size * (plain.chosen() | main) * np.where(main, 4, 1))
    named = np.array(page.named) & (2 * weight < weight[0])
    return _spread(page, np.array(base) | named)


def _near(page: Page, ratios: Ratios, most) -> np.ndarray:
    """How near each block is to the container: 2 in its text, 1 in another box in it, 0 outside, -1 outside <article> and <main>."""
    main = np.array([page.main[e] for e, _, _ in page.blocks])
    if (main & ratios.use & (ratios.total > 0)).any():
        return np.where(main, 2, -1)
    weight = _inside(page, ratios.size * ratios.chosen())
    # Elements are numbered in page order, so the last with that share is the innermost.
    around = max(e for e, w in enumerate(weight) if w >= most * weight[0])
    # A page of one long paragraph: what holds the paragraph is the container.
    while page.tag[around] in FLOW and page.tag[around] not in ("td", "th"):
        around = page.parent[around]
    whole = page.tag[around] not in ("", "html", "body")
    near = [0] * len(page.parent)
    near[around] = 2
    for e in range(around + 1, len(near)):
        # Of a whole page only running text next to the content, not boxes with text of their own.
        up = near[page.parent[e]]
        near[e] = up if page.tag[e] in FLOW else min(up, 1) if whole else 0
    return np.array([near[e] for e, _, _ in page.blocks])


def main_text(source: str | None, most=0.9) -> str:
    """Text of the article of a page."""
    page = Page(source or "")
    if not page.blocks:
        return ""
    ratios = Ratios(page, _others(page))
    if not ratios.size.any():
        return ""
    kept = ratios.chosen(_near(page, ratios, most))
    return "\n".join(t for (_, t, _), k in zip(page.blocks, kept) if k)


def visible_text(source: str | None) -> str:
    """All blocks of a page outside its head, one per line."""
    page = Page(source or "")
    return "\n".join(t for e, t, _ in page.blocks if page.tag[e] != "head")


def extract_main_text(df: DataFrame, html_col="html") -> DataFrame:
    """``df`` without its html, with text and n_chars; columns of these names are replaced."""
    kept = [c for c in df.columns if c not in ("text", "n_chars", html_col)]
    rows = df.select(F.struct(*kept).alias("row"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                arrays = [part.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "n_chars"])

    fields = [StructField("row", rows.schema["row"].dataType), StructField("text", StringType()), StructField("n_chars", LongType())]
    done = rows.mapInArrow(run, StructType(fields))
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], "text", "n_chars")
