"""Greedy and structure chunks against plain loops and hand-made sources."""

from __future__ import annotations

import random

import pytest

from talus.operators import chunking


def plain_lines(text, size, overlap):
    """The chunks as a loop over lines makes them."""
    lines, out, now, used, start = text.split("\n"), [], [], 0, 1
    for i, line in enumerate(lines):
        if now and used + len(line) + 1 > size:
            out.append((start, i, "\n".join(now)))
            keep = min(overlap, len(now))
            now = now[len(now) - keep :]
            used, start = sum(len(x) + 1 for x in now), max(1, i + 1 - keep)
        now.append(line)
        used += len(line) + 1
    return [*out, (start, len(lines), "\n".join(now))]


def _texts():
    rng = random.Random(3)
    made = ["\n".join("x" * rng.choice([0, 1, 5, 30, 90]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    return [*made, "", "\n", "\n\n", "a", "a" * 500, "é\n\U0001f600\n" * 40, "a\r\nb\x0cc\u2028d\n", "x\n" * 200]


@pytest.mark.parametrize(("size", "overlap"), [(100, 3), (40, 50), (1, 1), (60, 0), (4000, 50)])
def test_line_cuts_equal_a_plain_loop(size, overlap):
    for t in _texts():
        assert list(chunking.line_cuts(t, size, overlap)) == plain_lines(t, size, overlap)


@pytest.mark.parametrize(("size", "overlap"), [(100, 20), (30, 40), (7, 0), (1000, 200)])
def test_newline_cuts_cover_the_text(size, overlap):
    for t in _texts():
        got, end = list(chunking.newline_cuts(t, size, overlap)), 0
        for k, (a, x) in enumerate(got):
            assert x and t[a : a + len(x)] == x and a <= end and len(x) <= size
            end = a + len(x)
            if k < len(got) - 1:
                feed = t.rfind("\n", a, a + size)
                assert len(x) == (feed + 1 - a if feed > a + size // 2 else size)
        assert end == len(t)


def test_chunks_of_a_table(spark):
    texts = [None, *_texts()]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, content string").repartition(3)
    got = {}
    for r in chunking.line_chunks(df, 100, 3).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.total_chunks, r.start_line, r.end_line, r.content)
    for i, t in enumerate(texts):
        want = plain_lines(t or "", 100, 3)
        assert [got[i][k] for k in sorted(got[i])] == [(len(want), *w) for w in want]
    long = chunking.review_chunks(df.where("doc_id = 1"), 60, 2).collect()
    assert [(r.start_line, r.end_line, r.content) for r in sorted(long, key=lambda r: r.chunk_index)] == plain_lines(texts[1], 30, 2)
    assert chunking.newline_chunks(df.where("text is null or text = ''")).count() == 0
    assert chunking.line_chunks(df.limit(0)).count() == 0


SOURCE = '''# head

import os
@wrap
def f(a):
    return a


x = 1; y = 2
# between
class C:
    def m(self): pass
    # inside

# tail
'''


def test_structure_chunks():
    cuts = [c for (c,) in chunking.structure_cuts(SOURCE, 1000, 200)]
    assert cuts == ["# head", "import os", "@wrap", "def f(a):\n    return a", "x = 1", "y = 2", "# between", "class C:\n    def m(self): pass", "# inside\n\n# tail"]
    # nothing but white space is lost: separators between nodes of one line aside
    assert "".join("".join(cuts).split()) == "".join(SOURCE.replace(";", "").split())


def test_structure_chunks_of_long_nodes_and_errors(spark):
    body = "def g():\n" + "".join(f"    a{i} = {i}\n" for i in range(300))
    df = spark.createDataFrame([(0, body), (1, "x = (\n" * 300), (2, None), (3, "\n\n")], "doc_id long, text string")
    got = {}
    for r in chunking.structure_chunks(df).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.content
    own = [got[0][k] for k in sorted(got[0])]
    assert own[0] == "# --- Start of large FunctionDef: g ---" and own[-1] == "# --- End of large FunctionDef: g ---"
    inner = own[1:-1]
    assert "".join([inner[0], *(x[200:] for x in inner[1:])]) == body.strip()
    assert [got[1][k] for k in sorted(got[1])] == [("x = (\n" * 300)[a : a + 1000] for a in range(0, 1800, 800)]
    assert 2 not in got and 3 not in got
