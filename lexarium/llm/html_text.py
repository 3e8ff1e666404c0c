"""HTML extraction by consensus host paths.

1. Each page is cut into block elements and every container is scored by the
   text of the blocks right below it. Its best container casts a vote.
2. Paths are generalised (tag and class names, digits replaced) and votes are
   summed per host and path in Spark.
3. Every page is extracted again at the best-voted path of its host that it has;
   a page that has none of them, or no host, uses its own best container.

Elements that never hold main text (navigation, forms, scripts ...) and those
whose role, id or class names say so are left out, reader comments included.
A name says so if it ends with such a word, words of place, build or look behind it apart
("cookie-banner", "nav-links"); one that only begins with it ("cookie-recipe",
"navigation-systems", "comment-free") says nothing. Buttons and labels
within a sentence are text, standing alone they are not.
Inline markup vanishes, character references are decoded, white space inside a
block becomes one space, and blocks are joined by a newline in page order.

Null and empty pages give the empty text. Equal and repeated pages give equal
results; paths with equal votes come in the order of their names. Pages that are
cut off, and very long ones, are read to their end. An empty table gives an empty one. Further columns are not needed and do
not enter. All hosts' winning paths are joined to the pages by host, with the
hot hosts' rows dealt over ``SALTS`` parts, unless the winners are few enough
to be broadcast (``MAX_BROADCAST_ROWS``, counted first).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import durable, spread, table

SALTS = 16
MAX_BROADCAST_ROWS = 50_000
#: Of its host's votes a path needs at least this share to speak for it; a page with no such path uses its own.
SHARE = 0.005

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)(?:>|(?=<)|\Z)")
_ATTR = re.compile(r"([a-zA-Z_:@][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Elements whose content is raw: markup in it is not read.
_RAW = {"script", "style", "title", "textarea", "noscript", "xmp", "iframe", "noembed", "noframes"}
#: Elements that never hold main text.
_OUT = _RAW | {"head", "nav", "footer", "aside", "form", "select", "option", "input", "fieldset", "template", "svg", "math", "canvas", "object", "embed", "audio", "video", "map", "menu", "dialog", "datalist"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "html", "body", "head", "div", "p", "article", "section", "main", "header", "footer", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "address", "details", "summary", "hgroup", "search", "center", "template", "dialog", "menu",
}
_PARAGRAPH_ENDS = _BLOCK - {"html", "head", "body", "td", "th", "tr", "li", "dt", "dd", "thead", "tbody", "tfoot", "caption"} | {"hr"}
#: An opening tag closes these, if open inside the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_PARAGRAPH_BOUNDS = {"#root", "article", "section", "main", "div", "li", "dd", "tr", "blockquote", "body", "aside", "nav", "header", "footer", "form"}
_SPACED = {"br", "hr", "td", "th", "img"}
_STACKED = _BLOCK | _OUT
#: Inline, but a block of which they are all is none of the text.
_CONTROLS = {"button", "label"}
_KNOWN = _STACKED | _VOID | _CONTROLS | {"a"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role names that mark what is not main text.
_MARKS = set(
    "ad ads advert adverts advertisement advertising adbox adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus respond reply replies share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search searchbox widget widgets pagination pager toolbar complementary contentinfo form dialog paywall disclaimer".split()
)
#: Words behind a mark that leave it one: of place, build and look.
_NEUTRAL = set(
    "area bar block box button buttons card cards container content group inner item items left link links list main outer posts articles primary right row secondary section slot title top bottom unit wrap wrapper "
    "body desktop fixed floating form icon icons inline large mobile panel small sticky text thread toggle wide".split()
)
_MAIN_MARKS = {"article", "content", "main", "post", "entry", "story", "body", "text"}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def _marked(attrs: dict[str, str]) -> bool:
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    names = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
    return attrs.get("role") == "alert" or any(_names_aside(name) for name in names.split())


def _names_aside(name: str) -> bool:
    """Whether one class, id or role is of what is not main text."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    while len(words) > 1 and words[-1] in _NEUTRAL and words[-1] not in _MARKS:
        words.pop()
    return bool(words) and words[-1] in _MARKS


def _label(tag: str, attrs: dict[str, str]) -> str:
    names = sorted(re.sub(r"\d+", "#", c) for c in attrs.get("class", "").split())
    return ".".join([tag, *names])


class Page:
    """Blocks of a page: (text, element) in page order; elements: (parent, tag, label, marked by tag, marked by name)."""

    def __init__(self, source: str):
        self.elements: list[tuple[int, str, str, bool, bool]] = [(-1, "#root", "", False, False)]
        self.blocks: list[tuple[str, int, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_now, open_tags, bits, links, linked, control, controlled, loose = [0], ["#root"], [], 0, 0, 0, 0, 0
        elements, blocks, known = self.elements, self.blocks, _KNOWN

        def end_block() -> None:
            nonlocal linked, control, controlled, loose
            if bits and (loose or not controlled):
                text = "".join(bits)
                if "&" in text:
                    text = html.unescape(text)
                text = " ".join(text.split())
                if text:
                    blocks.append((text, open_now[-1], min(linked, len(text))))
            bits.clear()
            linked = control = controlled = loose = 0

        position, n, find, match = 0, len(source), source.find, _TAG.match
        while position < n:
            start = find("<", position)
            if start < 0:
                break
            if start > position:
                bits.append(source[position:start])
                linked += (start - position) * (links > 0)
                if not source[position:start].isspace():
                    controlled, loose = controlled + (control > 0), loose + (control == 0)
            m = match(source, start)
            if m is None:
                position = self._past(source, start, bits)
                continue
            position = m.end()
            closing, tag, raw = m.groups()
            tag = tag.lower()
            if tag not in known:
                continue
            if tag in _CONTROLS:
                control = 0 if closing else 1
                continue
            if closing:
                if tag == "a":
                    links = 0
                elif tag in _STACKED:
                    if open_tags[-1] == tag:
                        end_block()
                        open_now.pop()
                        open_tags.pop()
                    elif tag in open_tags:
                        end_block()
                        depth = len(open_tags) - 1 - open_tags[::-1].index(tag)
                        del open_now[depth:], open_tags[depth:]
                continue
            if tag == "a":
                links = 1
                continue
            if tag in _RAW:
                stop = _RAW_ENDS[tag].search(source, position)
                position = stop.end() if stop else (len(source) if tag != "noscript" else position)
                continue
            if tag in _SPACED:
                if tag == "hr":
                    end_block()
                bits.append(" ")
            if tag in _VOID or tag not in _STACKED:
                continue
            cell = tag in ("td", "th")
            if not cell:
                end_block()
            if tag in _PARAGRAPH_ENDS and "p" in open_tags:
                self._close({"p"}, _PARAGRAPH_BOUNDS, open_now, open_tags)
            if tag in _CLOSES:
                self._close(*_CLOSES[tag], open_now, open_tags)
            if cell:
                continue
            if raw and not raw.isspace():
                attrs = _attributes(raw)
                if raw.endswith("/") and tag in ("svg", "math"):
                    continue
                elements.append((open_now[-1], tag, _label(tag, attrs), tag in _OUT, _marked(attrs)))
            else:
                elements.append((open_now[-1], tag, tag, tag in _OUT, False))
            open_now.append(len(elements) - 1)
            open_tags.append(tag)
        if position < len(source):
            bits.append(source[position:])
            loose += control == 0 and not source[position:].isspace()
        end_block()

    @staticmethod
    def _past(source: str, start: int, bits: list[str]) -> int:
        """The end of a comment, declaration or tag with an open quote; a lone < is text."""
        following = source[start + 1 : start + 2]
        if source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            return stop + 3 if stop >= 0 else len(source)
        if following in ("!", "?", "/") and following or following.isalpha():
            stop = source.find(">", start)
            return stop + 1 if stop >= 0 else len(source)
        bits.append("<")  # text goes on behind it
        return start + 1

    @staticmethod
    def _close(tags: set[str], bounds: set[str], open_now: list[int], open_tags: list[str]) -> None:
        """Close the innermost of ``tags``, and what stands in it, unless one of ``bounds`` is nearer."""
        for depth in range(len(open_tags) - 1, 0, -1):
            if open_tags[depth] in tags:
                del open_now[depth:], open_tags[depth:]
                return
            if open_tags[depth] in bounds:
                return

    def chain(self, element: int) -> list[int]:
        out = []
        while element > 0:
            out.append(element)
            element = self.elements[element][0]
        return out[::-1]

    def path(self, element: int) -> str:
        return "/".join(self.elements[i][2] for i in self.chain(element))

    def left_out(self) -> list[bool]:
        """Elements that don't count: marked ones and what is in them, unless most text or a main element is inside."""
        n = len(self.elements)
        size = [0] * n
        core = [False] * n
        for text, element, _ in self.blocks:
            size[element] += len(text)
        for i in range(n - 1, 0, -1):
            parent, tag, *_ = self.elements[i]
            core[i] |= tag in ("article", "main", "h1")
            size[parent] += size[i]
            core[parent] |= core[i]
        out = [False] * n
        for i in range(1, n):
            parent, tag, _, by_tag, by_name = self.elements[i]
            own = by_tag
            if by_name:
                holds = size[i] * 2 > size[0] and (core[i] or tag in ("body", "html", "main", "article"))
                own |= not holds or tag not in ("html", "body", "main", "article", "div", "section")
            if tag == "header":
                own |= not any(self.elements[j][1] in ("article", "main") for j in self.chain(parent))
            out[i] = out[parent] or own
        return out

    def in_header(self, element: int) -> bool:
        return any(self.elements[j][1] == "header" for j in self.chain(element))

    def scores(self, out: list[bool]) -> dict[int, float]:
        """Of each container: text in its own blocks that is not links, more for elements meant for it."""
        score: dict[int, float] = {}
        for text, element, linked in self.blocks:
            if out[element]:
                continue
            own = max(0, len(text) - 2 * linked)
            tag = self.elements[element][1]
            holder = element
            if tag in ("p", "li", "pre", "tr", "dd", "dt", "td", "th", "figcaption", "caption", "summary", "address") or tag in _HEADINGS:
                holder = self.elements[element][0]
            share = 1.0
            while holder > 0 and share > 0.2:
                score[holder] = score.get(holder, 0.0) + own * share
                if self.elements[holder][1] in ("article", "main", "body"):
                    break
                holder, share = self.elements[holder][0], share * (0.95 if self.elements[holder][1] in ("ul", "ol", "dl", "table", "tbody", "thead", "blockquote", "figure", "section", "p", "li", "details") else 0.6)
        for i in score:
            _, tag, label, *_ = self.elements[i]
            words = {w.lower() for w in _SPLIT.split(label) if w}
            score[i] *= (2.0 if tag in ("article", "main") else 0.9 if tag in ("body", "html") else 1.0) * (1.5 if words & _MAIN_MARKS and tag not in ("body", "html") else 1.0)
        return score

    def best(self, out: list[bool]) -> tuple[int, float]:
        score = self.scores(out)
        if not score:
            return 0, 0.0
        top = max(score, key=lambda i: (score[i], -i))
        return top, score[top]

    def text(self, roots: set[int], out: list[bool]) -> str:
        keep = []
        inside = [False] * len(self.elements)
        for i in range(len(self.elements)):
            inside[i] = i in roots or i > 0 and inside[self.elements[i][0]]
        for text, element, _ in self.blocks:
            if inside[element] and not out[element]:
                if self.elements[element][1] in _HEADINGS or not self.in_header(element):
                    keep.append(text)
        return "\n".join(keep)


def vote(source: str) -> tuple[str, float]:
    """The generalised path of the page's best container and its score."""
    page = Page(source)
    top, score = page.best(page.left_out())
    return page.path(top) if top else "", score


def extract(source: str, paths: list[str]) -> str:
    page = Page(source)
    out = page.left_out()
    if paths:
        at: list[str] = [""]
        for parent, _, label, *_ in page.elements[1:]:
            at.append(f"{at[parent]}/{label}" if parent else label)
        places: dict[str, set[int]] = {}
        for i, own in enumerate(at):
            if i and not out[i]:
                places.setdefault(own, set()).add(i)
        for path in paths:
            if path in places:
                return page.text(places[path], out)
    top, _ = page.best(out)
    roots = {top}
    if page.elements[top][1] == "article":
        path = page.path(top)
        roots |= {i for i, e in enumerate(page.elements) if e[1] == "article" and not out[i] and page.path(i) == path}
    return page.text(roots, out)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])
    for rows in batches:
        found: dict[tuple[str, str], float] = {}
        for host, source in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            path, score = vote(source)
            if path and score > 0:
                # a page's voice grows with the logarithm of its text alone
                found[host, path] = found.get((host, path), 0.0) + 1.0 + len(str(int(score)))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.float64())], schema=schema)


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for rows in batches:
        texts = [extract(source, paths or []) for source, paths in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"),
    )


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the generalised paths with at least SHARE of the host's votes (so 200 at most), by votes, equal ones by name."""
    votes = _hosted(pages).where("host <> ''").select("host", "html").mapInArrow(_vote_rows, "host string, path string, score double")
    # whole votes: their sum is the same in any order
    summed = votes.groupBy("host", "path").agg(F.sum(F.col("score").cast("long")).alias("score"))
    whole = summed.groupBy("host").agg(F.sum("score").alias("all"))
    best = summed.join(whole, "host").where(F.col("score") >= SHARE * F.col("all"))
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "path"))), lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    winners = durable(winning_paths(pages))
    rows = _hosted(pages)
    if winners.count() <= MAX_BROADCAST_ROWS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        dealt = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(_extract_rows, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
