"""Structural units of texts: blocks that stay whole, windows within a token or character budget, and spans put together again.

Recognising a block needs what stood before it, so texts are read by small Python
functions in Arrow batches, one text at a time; what is done with the pieces
(checks, unions of spans, assembling) is DataFrame work.
"""

from __future__ import annotations

import ast
import html
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

#: How headings, fences, table rules, HTML tables, top keys and spans that stay whole are written.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")
TABLE = re.compile(r"<table(?:\s|>)", re.I)
KEY = re.compile(r"^([A-Za-z_][\w.-]*):")
WHOLE = re.compile(r"<tr\b[^>]*>.*?</tr>|```[^\n]*\n.*?```|^[ \t]*\|[^\n]+\|[ \t]*$", re.S | re.I | re.M)
HEADER_ROW = re.compile(r"<tr\b[^>]*>.*?<th\b.*?</tr>", re.S | re.I)

LETTERS = frozenset(string.ascii_letters)
#: Characters of a text that are encoded at once.
BLOCK = 8_192

#: Characters that packed prose may have, that a table row or fence may have as one view, and that evidence may have.
SOFT, LARGEST_UNIT, EVIDENCE = 1800, 6000, 6000
#: Rows, and characters of them, that a task holds before it hands them on.
ROWS_AT_ONCE, CHARS_AT_ONCE = 2_000, 2_000_000
ATOMIC = {"code_fence", "table", "python_definition", "yaml_mapping"}


def per_text(rows: DataFrame, keys: list[str], text: list[str], work: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """(keys, schema): the rows that ``work(*text columns)`` gives for each row with a text; one text and a bounded piece of what it gives at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = _parse_datatype_string(schema)
    own = rows.select(*keys, *text)
    out = StructType([own.schema[k] for k in keys] + list(made))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _pieces(b, len(keys), work, arrow)

    return own.mapInArrow(run, out)


def _pieces(b: pa.RecordBatch, keys: int, work: Callable[..., Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What ``work`` gives for the texts behind the first ``keys`` columns, handed on before it is more than ROWS_AT_ONCE rows or much more than CHARS_AT_ONCE characters."""
    def piece() -> pa.RecordBatch:
        kept = [b.column(k).take(pa.array(at, pa.int64())) for k in range(keys)]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(zip(*made), list(schema)[keys:]))], schema=schema)

    at, made, held = [], [], 0
    for i in range(b.num_rows):
        args = [c[i].as_py() for c in b.columns[keys:]]
        if args[0] is None:
            continue
        for r in work(*args):
            at.append(i)
            made.append(r)
            held += sum(len(x) for x in r if isinstance(x, str))
            if len(at) >= ROWS_AT_ONCE or held >= CHARS_AT_ONCE:
                yield piece()
                at, made, held = [], [], 0
    if at:
        yield piece()


def _fence_end(lines: list[str], i: int) -> int | None:
    opened = FENCE.match(lines[i])
    if not opened:
        return None
    mark = opened.group(1)
    closes = (k for k in range(i + 1, len(lines)) if (m := FENCE.match(lines[k])) and m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark))
    return next(closes, len(lines) - 1) + 1


def _pipe_end(lines: list[str], i: int) -> int | None:
    if "|" not in lines[i] or i + 1 >= len(lines) or not RULE.match(lines[i + 1]):
        return None
    return next((k for k in range(i + 2, len(lines)) if "|" not in lines[k]), len(lines))


def _html_end(lines: list[str], i: int) -> int | None:
    if not TABLE.search(lines[i]):
        return None
    return next((k for k in range(i, len(lines)) if "</table>" in lines[k].casefold()), len(lines) - 1) + 1


#: What may open a block, in order of precedence: (kind, place after its last line, or None).
OPENERS = [
    ("heading", lambda lines, i: i + 1 if HEADING.match(lines[i]) else None), ("code_fence", _fence_end), ("table", _pipe_end), ("table", _html_end),
]


def markdown_blocks(lines: list[str]) -> Iterator[tuple[str, list[str], int, int]]:
    """(kind, headings, first line, line after the last) of blocks that aren't blank."""
    headings: list[str] = []
    prose: int | None = None
    i = 0
    while i <= len(lines):
        blank = i == len(lines) or not lines[i].strip()
        kind, end = next(((kind, e) for kind, find in OPENERS if (e := find(lines, i))), (None, None)) if not blank else (None, None)
        if prose is not None and (blank or kind):
            yield "paragraph", list(headings), prose, i
            prose = None
        if kind:
            if kind == "heading":
                level, title = HEADING.match(lines[i]).groups()
                headings = [*headings[: len(level) - 1], title.strip()]
            yield kind, list(headings), i, end
        elif not blank and prose is None:
            prose = i
        i = end or i + 1


def definition_blocks(text: str, lines: list[str]) -> Iterator[tuple[str, list[str], int, int]]:
    """Top definitions of Python, and those within classes; ValueError if it can't be parsed."""
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        raise ValueError("Python text that cannot be parsed") from e
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    first = lambda node: min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
    starts: dict[int, list[str]] = {0: []}
    for node in tree.body:
        if isinstance(node, kinds):
            starts[first(node)] = [node.name]
            if isinstance(node, ast.ClassDef):
                starts |= {first(m): [node.name, m.name] for m in node.body if isinstance(m, kinds)}
    yield from _between(starts, lines, "python_definition")


def mapping_blocks(lines: list[str]) -> Iterator[tuple[str, list[str], int, int]]:
    """What stands below each top key of YAML."""
    starts: dict[int, list[str]] = {0: []} | {i: [m.group(1)] for i, line in enumerate(lines) if (m := KEY.match(line))}
    yield from _between(starts, lines, "yaml_mapping")


def _between(starts: dict[int, list[str]], lines: list[str], kind: str) -> Iterator[tuple[str, list[str], int, int]]:
    order = sorted(starts)
    for lo, hi in zip(order, [*order[1:], len(lines)]):
        yield kind, starts[lo], lo, hi


def trimmed(lines: list[str], lo: int, hi: int) -> tuple[int, int]:
    """The stretch without blank lines at its ends."""
    full = [i for i in range(lo, hi) if lines[i].strip()]
    return (full[0], full[-1] + 1) if full else (lo, lo)


def blocks_of(text: str, source_format: str) -> Iterator[tuple[str, list[str], int, int, str]]:
    lines = text.splitlines()
    if source_format == "markdown":
        found = markdown_blocks(lines)
    elif source_format == "python":
        found = definition_blocks(text, lines)
    elif source_format == "yaml":
        found = mapping_blocks(lines)
    else:
        raise ValueError(f"no structural blocks of {source_format!r}")
    for kind, headings, lo, hi in found:
        lo, hi = trimmed(lines, lo, hi)
        if lo < hi:
            yield kind, headings, lo, hi, "\n".join(lines[lo:hi])


def packed_blocks(text: str, source_format: str, most: int = SOFT) -> Iterator[tuple]:
    """(part, kind, headings, line_start, line_end, content): what is atomic alone, the rest joined under one heading while it is short enough."""
    lines = text.splitlines()
    open_: list | None = None
    part = 0

    def close() -> Iterator[tuple]:
        nonlocal open_, part
        if open_:
            part += 1
            kind, headings, lo, hi, content = open_
            yield part, kind, headings, lo + 1, hi, content
            open_ = None

    for kind, headings, lo, hi, content in blocks_of(text, source_format):
        if kind in ATOMIC or (open_ and (open_[1] != headings or len(open_[4]) + len(content) > most)):
            yield from close()
        if open_:
            open_ = ["section", headings, open_[2], hi, "\n".join(lines[open_[2]:hi])]
        else:
            open_ = [kind, headings, lo, hi, content]
        if kind in ATOMIC:
            yield from close()
    yield from close()


def structural_chunks(rows: DataFrame, keys: list[str], text: str, source_format: Column | str = "markdown", most: int = SOFT) -> DataFrame:
    """(keys, part, kind, headings, line_start, line_end, content). Fences, tables, definitions and mappings are never split; ``most`` is a soft bound for the rest."""
    if most < 1:
        raise ValueError("a bound below 1")
    form = F.lit(source_format) if isinstance(source_format, str) else source_format
    rows = rows.withColumn("__format", form)
    return per_text(rows, keys, [text, "__format"], lambda t, f: packed_blocks(t, f, most), "part int, kind string, headings array<string>, line_start int, line_end int, content string")


def readable(text: str) -> str:
    """Without tags, links as their labels, references decoded, runs of blanks as one."""
    bare = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"<[^>]+>", " ", text))
    return re.sub(r"[ \t]+", " ", html.unescape(bare)).strip()


def context_of(title: str | None, heading: str | None, content: str) -> str:
    """What a view inherits: title, heading, and a table's first two lines."""
    lines = content.splitlines()
    table = lines[:2] if len(lines) > 1 and lines[0].lstrip().startswith("|") and "---" in lines[1] else []
    return "\n".join(p for p in (title, heading, "\n".join(table)) if p)


def cut_at_newline(text: str, lo: int, hi: int) -> int:
    """``hi``, or the place behind the last line end before it, if the text goes on."""
    line_end = text.rfind("\n", lo, hi) if hi < len(text) else -1
    return line_end + 1 if line_end > lo else hi


def structure_ranges(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Rows, fences and paragraphs in order; those that are too long in pieces that end at line ends. Nothing but white space is left out."""
    def paragraphs(lo: int, hi: int) -> Iterator[tuple[int, int]]:
        for m in re.finditer(r"\S(?:.*?\S)?(?=\n\s*\n|\s*\Z)", text[lo:hi], re.S):
            yield lo + m.start(), lo + m.end()

    def units() -> Iterator[tuple[int, int]]:
        at = 0
        for m in WHOLE.finditer(text):
            yield from paragraphs(at, m.start())
            yield m.span()
            at = m.end()
        yield from paragraphs(at, len(text))

    for lo, hi in units():
        if len(readable(text[lo:hi])) <= most and hi - lo <= LARGEST_UNIT:
            yield lo, hi
            continue
        while lo < hi:
            end = min(lo + most, hi)
            line_end = text.rfind("\n", lo, end) if end < hi else -1
            end = line_end + 1 if line_end > lo else end
            yield lo, end
            lo = end


VIEW = "char_start int, char_end int, line_start int, line_end int, context_chars int, tokens int, content string, retrieval_text string"


def _view(text: str, first_line: int, lo: int, hi: int, context: str, said: str, tokens: int) -> tuple:
    return lo, hi, first_line + text.count("\n", 0, lo), first_line + text.count("\n", 0, hi - 1), len(context), tokens, text[lo:hi], said


def structure_views(chunks: DataFrame, keys: list[str], title: str, heading: str, text: str, first_line: str, most: int = 384) -> DataFrame:
    """Views of rows, fences and paragraphs, of at most ``most`` readable characters, each with a quarter of that as context."""
    if not 128 <= most <= 1536:
        raise ValueError("a bound of 128 to 1536 characters")

    def views(content: str, of: str | None, under: str | None, first: int) -> Iterator[tuple]:
        header = HEADER_ROW.search(content)
        context = readable(context_of(of, under, content) + ("\n" + header.group(0) if header else ""))[: most // 4]
        for lo, hi in structure_ranges(content, most):
            said = (context + "\n" if context else "") + readable(content[lo:hi])
            yield _view(content, first, lo, hi, context, said, len(said))

    return per_text(chunks, keys, [text, title, heading, first_line], views, VIEW)


class _Sizes(dict):
    """Bytes of each token, found out when it is first seen."""

    def __init__(self, token_bytes: Callable[[int], bytes]):
        super().__init__()
        self.token_bytes = token_bytes

    def __missing__(self, token: int) -> int:
        self[token] = len(self.token_bytes(token))
        return self[token]


class Budget:
    """Windows of a text within a number of tokens, its context included.

    With ``parts``, no match of the vocabulary's pattern reaches over a blank behind a letter of ASCII: what stands before has the
    same tokens whatever follows, and what follows the same whatever stands before. Then a text is encoded once (see ``_Read``).
    """

    def __init__(self, encode: Callable[[str], list[int]], token_bytes: Callable[[int], bytes], most: int, parts: bool = False):
        if most < 16:
            raise ValueError("a budget below 16 tokens")
        self.encode, self.most, self.parts = encode, most, parts
        self.sizes = _Sizes(token_bytes)
        self.contexts: dict[str, str] = {}

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def trimmed(self, context: str) -> str:
        """The longest beginning of at most a quarter of the budget."""
        if context in self.contexts:
            return self.contexts[context]
        lo, hi = 0, len(context)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.count(context[:mid] + "\n") <= self.most // 4 else (lo, mid - 1)
        if len(self.contexts) < 1_000:
            self.contexts[context] = context[:lo]
        return context[:lo]

    def window(self, prefix: str, text: str, lo: int) -> tuple[int, int]:
        """(end, tokens) of the window from ``lo``: the furthest end, a guess from whole tokens moved until one character more is too many, put back to a line end if there is one."""
        reach = 8 * self.most
        while True:
            ahead = text[lo:lo + reach]
            tokens = self.encode(prefix + ahead)
            if len(tokens) > self.most or lo + reach >= len(text):
                break
            reach *= 2
        if len(tokens) <= self.most:
            return len(text), len(tokens)
        size = sum(map(self.sizes.__getitem__, tokens[: self.most])) - len(prefix.encode("utf-8", "surrogatepass"))
        guess = len(ahead.encode("utf-8", "surrogatepass")[: max(size, 0)].decode("utf-8", "ignore"))
        return self.settle(text, lo, lo + guess, lambda end: self.count(prefix + text[lo:end]))

    def settle(self, text: str, lo: int, hi: int, count: Callable[[int], int]) -> tuple[int, int]:
        while hi > lo and count(hi) > self.most:
            hi -= 1
        while hi < len(text) and count(hi + 1) <= self.most:
            hi += 1
        if hi == lo:
            raise ValueError("one character exceeds the token budget")
        end = cut_at_newline(text, lo, hi)
        return end, count(end)

    def windows(self, content: str, title: str | None, heading: str | None, first: int) -> Iterator[tuple]:
        context = self.trimmed(context_of(title, heading, content))
        prefix = context + "\n" if context else ""
        read = _Read(self, content) if self.parts else None
        lo, line = 0, first
        while lo < len(content):
            hi, tokens = (read.window(prefix, lo) if read else None) or self.window(prefix, content, lo)
            last = line + content.count("\n", lo, hi - 1)
            yield lo, hi, line, last, len(context), tokens, content[lo:hi], prefix + content[lo:hi]
            lo, line = hi, last + (content[hi - 1] == "\n")


class _Read:
    """A text that is encoded once, a block at a time, from one blank behind a letter to another; a window's own encoding is that of its first and last words."""

    def __init__(self, budget: Budget, text: str):
        self.budget, self.text = budget, text
        self.at = self.stop = 0
        self.ends: list[int] = []  # bytes from ``at`` to behind each token

    def first_cut(self, lo: int, hi: int) -> int:
        at = lo
        while (at := self.text.find(" ", at + 1, hi)) > 0:
            if self.text[at - 1] in LETTERS:
                return at
        return -1

    def last_cut(self, lo: int, hi: int) -> int:
        at = hi
        while (at := self.text.rfind(" ", lo, at)) > 0:
            if self.text[at - 1] in LETTERS:
                return at
        return -1

    def read(self, at: int) -> None:
        """The block from a cut."""
        stop = at + BLOCK
        stop = len(self.text) if stop >= len(self.text) else max(self.last_cut(at, stop), at)
        self.at, self.stop, self.raw = at, stop, self.text[at:stop].encode("utf-8", "surrogatepass")
        self.ends = list(accumulate(map(self.budget.sizes.__getitem__, self.budget.encode(self.text[at:stop]))))

    def tokens_to(self, place: int) -> int:
        """Tokens of the block before a cut."""
        size = place - self.at if len(self.raw) == self.stop - self.at else len(self.text[self.at:place].encode("utf-8", "surrogatepass"))
        return bisect_right(self.ends, size)

    def window(self, prefix: str, lo: int) -> tuple[int, int] | None:
        """What ``Budget.window`` gives; None where there is no cut near, or no end within a block."""
        text, most = self.text, self.budget.most
        start = self.first_cut(lo, lo + most)
        if start < 0:
            return None
        head = self.budget.count(prefix + text[lo:start])
        if head >= most:
            return None
        if not (self.at <= start < self.stop and (self.stop == len(text) or head + len(self.ends) - self.tokens_to(start) > most)):
            self.read(start)
        before = head - self.tokens_to(start)  # what the window has more than the block up to the same place
        if before + len(self.ends) <= most:
            return (len(text), before + len(self.ends)) if self.stop == len(text) else None
        size = self.ends[most - before - 1]
        guess = self.at + (size if len(self.raw) == self.stop - self.at else len(self.raw[:size].decode("utf-8", "ignore")))

        def count(end: int) -> int:
            cut = self.last_cut(start, min(end, self.stop))
            return self.budget.count(prefix + text[lo:end]) if cut < 0 else before + self.tokens_to(cut) + self.budget.count(text[cut:end])

        return self.budget.settle(text, lo, guess, count)


_BUDGETS: dict[tuple, Budget] = {}


def budget_of(vocabulary: str, pattern: str, most: int) -> Budget:
    """One for each Python worker: the vocabulary file (ranks of byte strings) is read once."""
    key = (vocabulary, pattern, most)
    if key not in _BUDGETS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _BUDGETS[key] = Budget(own.encode_ordinary, own.decode_single_token_bytes, most, pattern == public_tokenizers.PATTERN)
    return _BUDGETS[key]


def token_views(chunks: DataFrame, keys: list[str], title: str, heading: str, text: str, first_line: str, vocabulary: str, pattern: str, most: int = 384) -> DataFrame:
    """Windows of at most ``most`` tokens of the vocabulary at a path that every executor has, context included, that end at line ends where they can."""
    return per_text(chunks, keys, [text, title, heading, first_line], lambda *row: budget_of(vocabulary, pattern, most).windows(*row), VIEW)


def broken(views: DataFrame, parents: DataFrame, keys: list[str], text: str, most: int, exact: bool = True) -> DataFrame:
    """(keys, views, chars, reach, broken, over): what views of a parent cover, how many are not what the parent has there, and how many are over the bound.

    With ``exact`` the text that is indexed must end with the view's.
    """
    same = F.substr(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).eqNullSafe(F.col("content"))
    if exact:
        same = same & F.endswith("retrieval_text", "content")
    return views.join(parents.select(*keys, F.col(text)), keys).groupBy(*keys).agg(
        F.count("*").alias("views"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"), F.max("char_end").alias("reach"),
        F.count_if(~same).alias("broken"), F.count_if(F.col("tokens") > most).alias("over"),
    )


def grown(text: str, spans: list[dict]) -> Iterator[tuple[int, int]]:
    """What evidence needs around its spans (char_start, char_end): two lines on each side, the row and header of a table, the whole of a fence."""
    lines = text.splitlines(keepends=True)
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line))
    piped = [line.lstrip().startswith("|") for line in lines]
    fences = [i for i, line in enumerate(lines) if line.lstrip().startswith("```")]
    for span in spans:
        char_lo, char_hi = span["char_start"], span["char_end"]
        if not 0 <= char_lo < char_hi <= len(text):
            raise ValueError("a span outside its text")
        first, last = text.count("\n", 0, char_lo), text.count("\n", 0, char_hi - 1)
        lo, hi = max(0, first - 2), min(len(lines), last + 3)
        yield from _table_parts(text, char_lo, char_hi)
        if any(piped[first:last + 1]):
            top = next((i + 1 for i in range(first - 1, -1, -1) if not piped[i]), 0)
            if top + 1 < len(lines) and "---" in lines[top + 1]:
                yield offsets[top], offsets[top + 2]
        before = [i for i in fences if i < first]
        after = next((i for i in fences if i > last), None)
        if len(before) % 2 and after is not None and offsets[after + 1] - offsets[before[-1]] <= LARGEST_UNIT:
            lo, hi = before[-1], after + 1
        yield (char_lo, char_hi) if offsets[hi] - offsets[lo] > LARGEST_UNIT else (offsets[lo], offsets[hi])


def _table_parts(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    start, end = text.rfind("<table", 0, hi), text.find("</table>", hi)
    if start < 0 or end < 0 or text.rfind("</table>", 0, lo) >= start:
        return
    if head := re.compile(r"<thead\b.*?</thead>", re.S).search(text, start, end):
        yield head.span()
    row, row_end = text.rfind("<tr", start, lo + 1), text.find("</tr>", hi)
    if row >= 0 and row_end >= hi and row_end + 5 - row <= LARGEST_UNIT:
        yield row, row_end + 5


def union(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): disjoint stretches that cover the same as ``ranges`` (keys, lo, hi); touching ones are joined."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def generation_text(evidence: DataFrame, keys: list[str], text: str, spans: str, most: int = EVIDENCE) -> DataFrame:
    """(keys, value, pieces): what a generator reads of each evidence row: its spans (array of char_start, char_end) grown and joined; the spans alone if that is over ``most`` characters.

    Keys must be unique. Rows without spans are refused: their text is what they are.
    """
    pieces = union(per_text(evidence, keys, [text, spans], grown, "lo int, hi int"), keys)
    whole = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    rows = evidence.join(pieces.groupBy(*keys).agg(whole.alias("pieces")), keys)
    joined = F.array_join(F.transform("pieces", lambda p: F.substr(F.col(text), p["lo"] + 1, p["hi"] - p["lo"])), "\n")
    alone = F.array_join(F.transform(spans, lambda s: F.substr(F.col(text), s["char_start"] + 1, s["char_end"] - s["char_start"])), "\n")
    value = F.when(F.length(joined) > most, alone).otherwise(joined)
    return rows.select(*keys, F.substring(value, 1, most).alias("value"), "pieces")
