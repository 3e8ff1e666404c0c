import random

import public_tokenizers
import pytest
import tiktoken

from lexarium.operators import structure as s

TEXT = """intro line
second intro line
# One
para a

para b
~~~py
# not a heading

~~ still
~~~
| a | b |
|---|:-:|
| 1 | 2 |

| no | table |
## Sub
<TABLE>
<tr><td>x
</td></tr>
</table> tail
last
### Deep
```
open to the end

"""


def test_markdown_blocks_and_packing():
    got = list(s.packed_blocks(TEXT, "markdown", 1800))
    assert [(k, h, a, b) for _, k, h, a, b, _ in got] == [
        ("paragraph", [], 1, 2), ("section", ["One"], 3, 6), ("code_fence", ["One"], 7, 11), ("table", ["One"], 12, 14), ("paragraph", ["One"], 16, 16),
        ("heading", ["One", "Sub"], 17, 17), ("table", ["One", "Sub"], 18, 21), ("paragraph", ["One", "Sub"], 22, 22), ("heading", ["One", "Sub", "Deep"], 23, 23), ("code_fence", ["One", "Sub", "Deep"], 24, 25)]
    lines = TEXT.splitlines()
    assert all(content == "\n".join(lines[a - 1:b]) for *_, a, b, content in got)
    assert [k for _, k, *_ in s.packed_blocks(TEXT, "markdown", 5)][1:4] == ["heading", "paragraph", "paragraph"]


def test_no_block_is_split_or_lost():
    rng = random.Random(3)
    pieces = ["# h", "text", "", "```", "~~~", "a | b", "|--|--|", "<table>", "</table>", "## k", "more text here"]
    for _ in range(300):
        lines = [rng.choice(pieces) for _ in range(rng.randint(0, 25))]
        got = list(s.packed_blocks("\n".join(lines), "markdown", rng.choice([1, 20, 1800])))
        seen = [i for _, _, _, a, b, _ in got for i in range(a, b + 1)]
        assert seen == sorted(set(seen)) and {i for i, x in enumerate(lines, 1) if x.strip()} <= set(seen)
        for _, kind, _, a, b, content in got:
            assert content == "\n".join(lines[a - 1:b]) and content.strip()
            if kind == "code_fence":
                assert s.FENCE.match(lines[a - 1])
            elif kind != "table":
                assert not any(s.FENCE.match(x) for x in lines[a - 1:b])


def test_python_and_yaml():
    code = "import x\n\n@d\ndef f():\n    return 1\n\nclass A:\n    y = 1\n    def g(self):\n        pass\n"
    assert [(h, a, b) for _, _, h, a, b, _ in s.packed_blocks(code, "python")] == [([], 1, 1), (["f"], 3, 5), (["A"], 7, 8), (["A", "g"], 9, 10)]
    assert [(h, a, b) for _, _, h, a, b, _ in s.packed_blocks("# c\n\na: 1\n  b: 2\nc.d: 3\n", "yaml")] == [([], 1, 1), (["a"], 3, 4), (["c.d"], 5, 5)]
    with pytest.raises(ValueError):
        list(s.packed_blocks("def (", "python"))
    with pytest.raises(ValueError):
        list(s.packed_blocks("x", "toml"))


def test_chunks_in_spark(spark):
    rows = spark.createDataFrame([(1, TEXT, "markdown"), (2, None, "markdown"), (3, "", "yaml"), (4, "k: 1", "yaml")], "i long, t string, f string")
    got = s.structural_chunks(rows, ["i"], "t", s.F.col("f")).collect()
    assert sorted((r["i"], r["part"]) for r in got) == [(1, k) for k in range(1, 11)] + [(4, 1)]


def plain_windows(encode, content, title, heading, most):
    """One character more at a time."""
    context = s.context_of(title, heading, content)
    while context and len(encode(context + "\n")) > most // 4:
        context = context[:-1]
    prefix, lo, out = context + "\n" if context else "", 0, []
    while lo < len(content):
        hi = lo
        while hi < len(content) and len(encode(prefix + content[lo:hi + 1])) <= most:
            hi += 1
        if hi < len(content) and content.rfind("\n", lo, hi) > lo:
            hi = content.rfind("\n", lo, hi) + 1
        out.append((lo, hi))
        lo = hi
    return out


def test_token_windows_equal_plain_ones(spark, odd_rows=("", "x" * 900, "a\n" * 200, "   \n\n  b  " * 30, "ünïcödé 漢字 😀 " * 40)):
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(8)
    texts = [*odd_rows, None, *("\n".join(" ".join(rng.choice(["the", "wording", "ofß", "1234", "\t", "x_y"]) for _ in range(rng.randint(0, 30))) for _ in range(9)) for _ in range(6))]
    rows = spark.createDataFrame([(i, t, "A title of some words", "head" if i % 2 else None, 10) for i, t in enumerate(texts)], "i long, t string, title string, head string, line int")
    views = s.token_views(rows, ["i"], "title", "head", "t", "line", path, public_tokenizers.PATTERN, 32)
    got = {}
    for r in views.collect():
        got.setdefault(r["i"], []).append((r["char_start"], r["char_end"]))
        assert r["tokens"] == len(encode(r["retrieval_text"])) <= 32 and r["retrieval_text"].endswith(r["content"])
        assert r["line_start"] == 10 + texts[r["i"]][: r["char_start"]].count("\n")
    for i, t in enumerate(texts):
        if t and (t.startswith("xxx") or not t.isascii()):
            continue  # one character more may be fewer tokens: a window may end further on than where the plain one stops
        assert sorted(got.get(i, [])) == (plain_windows(encode, t, "A title of some words", "head" if i % 2 else None, 32) if t else [])
    checks = s.broken(views, rows, ["i"], "t", 32).collect()
    assert all(r["broken"] == r["over"] == 0 and r["chars"] == r["reach"] == len(texts[r["i"]]) for r in checks) and len(checks) == len([t for t in texts if t])


def test_structure_views(spark):
    text = "one para\nof two lines\n\nnext &amp; [link](u)\n<tr><th>name</th></tr>\n<tr>\n<td>cell</td></tr>\n```\ncode\n```\n| a | b |\n" + "long words " * 60
    rows = spark.createDataFrame([(1, text, "T", None, 5), (2, "", "T", None, 1), (3, None, "T", None, 1)], "i long, t string, title string, head string, line int")
    got = sorted((r["char_start"], r["content"], r["retrieval_text"], r["line_start"], r["line_end"]) for r in s.structure_views(rows, ["i"], "title", "head", "t", "line", 128).collect())
    said = [c for _, c, *_ in got]
    assert said[:6] == ["one para\nof two lines", "next &amp; [link](u)", "<tr><th>name</th></tr>", "<tr>\n<td>cell</td></tr>", "```\ncode\n```", "| a | b |"]
    assert got[1][2] == "T\n name\nnext & link" and (got[3][3], got[3][4]) == (10, 11)
    assert "".join(said[6:]).split() == ("long words " * 60).split() and all(len(c) <= 128 for c in said[6:])


def test_union_is_disjoint_and_covers(spark):
    rng = random.Random(4)
    ranges = [(k, lo, lo + rng.randint(1, 9)) for k in range(6) for lo in (rng.randint(0, 80) for _ in range(rng.randint(1, 14)))]
    got = sorted(map(tuple, s.union(spark.createDataFrame(ranges, "k int, lo int, hi int"), ["k"]).collect()))
    for k in range(6):
        own = [(lo, hi) for key, lo, hi in got if key == k]
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        assert {x for lo, hi in own for x in range(lo, hi)} == {x for key, lo, hi in ranges if key == k for x in range(lo, hi)}


def test_generation_text_grows_to_units(spark):
    table = "a\nb\nc\n| h | i |\n|---|---|\n" + "".join(f"| r{i} | v |\n" for i in range(9)) + "z"
    fence = "p\n```\n1\n2\n3\n4\n5\n6\n```\nq\nr\ns"
    page = "<table><thead><tr><th>H</th></tr></thead>\n" + "".join(f"<tr>\n<td>{i}</td>\n</tr>\n" for i in range(9)) + "</table>"
    span = lambda t, x: {"char_start": t.index(x), "char_end": t.index(x) + len(x)}
    rows = [(1, table, [span(table, "| r6 | v |")]), (2, fence, [span(fence, "4")]), (3, page, [span(page, "<td>7</td>")]), (4, "x\n" * 9000, [{"char_start": 0, "char_end": 1}, {"char_start": 8000, "char_end": 8001}]), (5, "é" * 7000, [{"char_start": 5, "char_end": 6500}])]
    df = spark.createDataFrame(rows, "i int, t string, spans array<struct<char_start:int,char_end:int>>")
    got = {r["i"]: r["value"] for r in s.generation_text(df, ["i"], "t", "spans").collect()}
    assert got[1] == "| h | i |\n|---|---|\n\n" + "".join(f"| r{i} | v |\n" for i in (4, 5, 6, 7, 8))
    assert got[2] == fence[fence.index("```"):fence.index("q")]
    assert got[3].startswith("<thead>") and "<td>7</td>" in got[3] and "<td>3</td>" not in got[3]
    assert got[4] == "x\nx\nx\n\n" + "x\n" * 5 and len(got[5]) == 6000
    with pytest.raises(Exception, match="outside its text"):
        s.generation_text(spark.createDataFrame([(1, "ab", [{"char_start": 1, "char_end": 9}])], df.schema), ["i"], "t", "spans").collect()
