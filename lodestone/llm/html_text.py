"""Main text of web pages by tree scoring.

A tolerant one-pass tokenizer builds a tree of elements.  Text is gathered in
blocks (paragraphs, headings, list items, cells, ... and bare runs in between).
Each block gives points for its length and commas to its parent and half of them
to its grandparent; a container's points are scaled by one minus its link density
and by hints in its tag, class and id.  The best container is kept, and of its
siblings those that score at least a fifth as much or are long, link-poor
paragraphs.  What cannot be article text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) is dropped wherever it stands.

Defined results: null or empty html gives the empty text; markup cut off anywhere,
unclosed and misnested tags are accepted; a page without paragraphs is scored by
its bare text; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
_MARK = re.compile("[\"'>]")
#: One attribute: matches follow each other, so names are not looked for in other names or in values.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|["'][^"']*["']?|=\s*[^\s>]*""")
# Elements of the HTML standard by how they are treated.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg canvas select".split())
_DROP = frozenset("nav footer aside form button menu dialog fieldset label head audio video".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: An open element of the key is closed by the start of one of the values, unless a barrier stands between.
_CLOSES = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_BARRIER = frozenset("table ul ol dl div section article body main td".split())
_CLOSED_BY = {t: [c for c, by in _CLOSES.items() if t in by and c not in _BARRIER] for t in set().union(*_CLOSES.values())}
_INLINE = frozenset("p b i em strong span a font u".split())  # points pass through these
_GOOD = re.compile(r"article|body|content|entry|main|post|story|text|page", re.I)
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|foot|header|masthead|menu|modal|nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|related|recommend\w*|share|sharing|sidebar|social|sponsor\w*|subscribe|tags|toolbar|widget|warning|alert|gdpr|legal|copyright|signup|login|search|replies|reply|respond)(?:$|[\s_-])",
    re.I,
)
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")
_LONG_NUMBER = re.compile(r"&#(?:([xX])(0*+)([0-9a-fA-F]*+)|(0*+)([0-9]*+))")


class _Node:
    __slots__ = ("tag", "parent", "hint", "drop", "score", "chars", "linked", "number", "last", "block", "outer")

    def __init__(self, tag: str, parent: _Node | None, hint: str, drop: bool):
        self.tag, self.parent, self.hint, self.drop = tag, parent, hint, drop
        self.score = 0.0
        self.chars = self.linked = 0
        self.number = self.last = 0  # its own place and that of its last descendant, in page order
        self.block = self if tag in _BLOCK or parent is None else parent.block  # the nearest block from here up
        self.outer = self if tag not in _INLINE else parent and parent.outer  # the nearest element that takes points


class _Open:
    """The open elements; every question takes a time that does not grow with their number."""

    def __init__(self, root: _Node):
        self.stack, self.places = [root], {}
        self.barriers = [0]

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BARRIER:
            self.barriers.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, place: int) -> list[_Node]:
        """Close the element at a place and all that were opened in it."""
        gone = self.stack[place:]
        del self.stack[place:]
        for n in gone:
            self.places[n.tag].pop()
        while self.barriers[-1] >= place:
            self.barriers.pop()
        return gone

    def last(self, tag: str) -> int | None:
        held = self.places.get(tag)
        return held[-1] if held else None

    def closed_by(self, tag: str) -> int | None:
        """The place of the innermost element within the last barrier that the start of a tag closes."""
        place = max((held[-1] for c in _CLOSED_BY.get(tag, ()) if (held := self.places.get(c))), default=-1)
        return place if place > self.barriers[-1] else None


def _tag_end(page: str, pos: int, known: dict[int, int]) -> int:
    """The end of the tag whose name ends at pos: after the first > outside quotes, or at the end of the page.  A quote that
    nothing closes is an ordinary character: the tag ends at its first >.  known: ends by the places of quotes looked
    at before, so that no stretch of the page is walked twice."""
    path, at = [], pos
    while True:
        m = _MARK.search(page, at)
        if m is None:
            end = len(page)
            break
        place = m.start()
        if place in known:
            end = known[place]
            break
        path.append(place)
        if m[0] == ">":
            end = place + 1
            break
        close = page.find(m[0], place + 1)
        if close < 0:
            end = -1
            break
        at = close + 1
    known.update(dict.fromkeys(path, end))
    return end if end >= 0 else (page.find(">", pos) + 1 or len(page))


def _number(m: re.Match) -> str:
    """A numeric reference without leading zeros; one of more digits than a code point has is no character."""
    kind, zeros, digits = m[1] or "", m[2] or m[4], m[3] or m[5]
    if not zeros and len(digits or "") <= 7:
        return m[0]
    return f"&#{kind}{digits or 0}" if len(digits) <= 7 else "&#x110000"


def _dropped(tag: str, attrs: str, article: bool) -> tuple[str, bool]:
    hint, drop = "", tag in _DROP or (tag == "header" and not article)
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                hint += f" {value}"
            elif name == "role" and value.lower() in _ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                drop = True
        if hint and tag not in ("html", "body", "article", "main") and _BAD.search(hint):
            drop = True
    return hint, drop


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = _Node("#root", None, "", False)
    nodes = [root]
    open_ = _Open(root)
    now = root
    known: dict[int, int] = {}
    blocks: list[tuple[_Node, str]] = []
    parts: list[str] = []
    linked = 0
    depth_a = article = 0
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&#" in text:
                text = _LONG_NUMBER.sub(_number, text)
            text = _SPACE.sub(" ", _html.unescape(text)).strip()
            parts.clear()
            if text:
                home = now.block
                blocks.append((home, text))
                home.chars += len(text)
                home.linked += min(len(text), linked)
        linked = 0

    def close(place: int) -> None:
        nonlocal now, depth_a, article
        for gone in open_.pop_to(place):
            depth_a -= gone.tag == "a"
            article -= gone.tag in ("article", "main")
        now = open_.stack[-1]

    while pos < end:
        m = _TOKEN.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not now.drop:
            text = page[pos:stop]
            parts.append(text)
            if depth_a:
                linked += len(text.strip())
        if m is None:
            break
        name = m[2]
        if name is None:
            pos = max(m.end(), stop + 1)
            if m[0].startswith("<![CDATA[") and not now.drop:
                parts.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        pos = _tag_end(page, m.end(), known)
        rest = page[m.end() : pos]
        attrs = rest[:-1] if rest.endswith(">") else rest
        tag = name.lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            if (place := open_.last(tag)) is not None:
                close(place)
            continue
        if tag in _BLOCK:
            flush()
            if (place := open_.closed_by(tag)) is not None:
                close(place)
        if tag in _VOID:
            continue
        if tag in _RAW and not rest.rstrip(">").endswith("/"):
            shut = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, pos)
            pos = shut.end() if shut else end
            continue
        if rest.endswith("/>"):
            continue
        hint, drop = _dropped(tag, attrs, article > 0)
        if drop and not now.drop:
            flush()
        now = _Node(tag, now, hint, drop or now.drop)
        now.number = now.last = len(nodes)
        nodes.append(now)
        open_.push(now)
        depth_a += tag == "a"
        article += tag in ("article", "main")
    flush()
    # a closed element is never opened again, so descendants follow each other: sums and intervals take one pass
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
        n.parent.last = max(n.parent.last, n.last)
    return _assemble(blocks, nodes)


def _assemble(blocks: list[tuple[_Node, str]], nodes: list[_Node]) -> str:
    if not blocks:
        return ""
    scored: dict[int, _Node] = {}
    for home, text in blocks:
        if len(text) < 25 and home.tag not in ("p", "h1", "h2", "h3"):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        holder = home.parent if home.tag in ("p", "pre", "li", "td", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption") and home.parent is not None else home
        share = 1.0
        # an unclosed paragraph may hold the next one: points still reach the container
        while holder is not None and (holder := holder.outer) is not None and share > 0.01:
            holder.score += points * share
            scored[id(holder)] = holder
            holder, share = holder.parent, share / (2 if share == 1.0 else 3)
    if not scored:
        return " ".join(t for _, t in blocks)

    def final(n: _Node) -> float:
        s = n.score * (1 - n.linked / max(1, n.chars))
        if n.tag in ("article", "main"):
            s *= 1.5
        if n.hint and _GOOD.search(n.hint):
            s *= 1.25
        return s

    best = max(scored.values(), key=final)
    limit = max(2.0, final(best) * 0.2)
    siblings = [n for n in nodes if n.parent is best.parent and n is not best] if best.parent is not None else []
    starts = [n.number for n in siblings]
    out = []
    for home, text in blocks:
        if best.number <= home.number <= best.last:
            out.append(text)
            continue
        k = bisect_right(starts, home.number) - 1
        if k < 0 or home.number > siblings[k].last:
            continue
        at = siblings[k]
        density = at.linked / max(1, at.chars)
        if (id(at) in scored and final(at) >= limit and density < 0.25) or (at.tag == "p" and at.chars > 80 and density < 0.25):
            out.append(text)
    return " ".join(out)


def texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            out = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=schema)

    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
