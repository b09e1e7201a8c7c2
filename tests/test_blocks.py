"""Blocks between braces on hand-made C#."""

from __future__ import annotations

import re

from talus.operators import blocks

CLASS = """class A {
  [HttpPost]
  [Authorize]
  public async Task Save(string a,
      int b)
  {
    if (b > 1) { while (true) { break; } }
    Call(string.Empty);
  }
  private int One() { return 1; }
  internal T Of(T x) where T : class {
    var s = "TypeNameHandling = TypeNameHandling.None"; Deserialize(x);
  }
  public T To(T x) { new S { TypeNameHandling =
      TypeNameHandling.All }; Deserialize(x); }
}
public void Open(string q) { [HttpGet]
"""


def _files(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")


def test_extents():
    got = [(a, b, d) for a, b, d, _ in blocks.block_rows(CLASS, re.compile(blocks.METHOD))]
    assert got == [(2, 9, 1), (10, 10, 1), (11, 13, 1), (14, 15, 1), (17, 18, 0)]
    bodies = [x for *_, x in blocks.block_rows(CLASS, re.compile(blocks.METHOD))]
    assert bodies[0].startswith("  [HttpPost]\n") and bodies[0].endswith("\n  }") and bodies[1] == "  private int One() { return 1; }"
    assert list(blocks.block_rows("public int A() { } }}} public int B() {", re.compile(blocks.METHOD)))[1][:3] == (1, 1, 0)


def test_extents_equal_a_plain_count(spark):
    text = "\n".join(["public int F0() {", "{ {", "} }", "public int F1() { {", "}", "}", "x", "}", "public int F2() { }"])
    got = {(r.start_line, r.end_line) for r in blocks.blocks(_files(spark, ("a", text))).collect()}
    want, rows = set(), text.split("\n")
    for i, line in enumerate(rows):
        if "public" in line:
            depth, seen = 0, False
            for j in range(i, len(rows)):
                for c in rows[j]:
                    depth += (c == "{") - (c == "}")
                    seen |= c == "{"
                    if seen and depth == 0:
                        break
                if seen and depth == 0:
                    break
            want.add((i + 1, j + 1))
    assert got == want


def test_findings(spark):
    files = _files(spark, ("Web/AController.cs", CLASS), ("Web/Plain.cs", CLASS), ("tests/BController.cs", CLASS.replace("if (b > 1)", "ModelState.IsValid")), (None, CLASS), ("CController.cs", None), ("D", ""))
    got = sorted((r.doc_id, r.line_no, r.type, r.confidence) for r in blocks.method_issues(files).collect())
    first = [(0, 4, "Missing Input Validation", "medium"), (0, 8, "Missing Input Validation", "medium"), (0, 17, "Missing Input Validation", "medium")]
    assert [g for g in got if g[2] == "Missing Input Validation"] == [*first, (2, 17, "Missing Input Validation", "low")]
    assert blocks.method_issues(files.limit(0)).count() == 0


def test_type_handling(spark):
    body = "public object L(int n) {{\n  x.TypeNameHandling = {};\n  return Deserialize(n);\n}}\n"
    files = _files(spark, ("a", body.format("TypeNameHandling.All")), ("b", body.format("TypeNameHandling.None")), ("c", body.format("TypeNameHandling.All").replace("Deserialize", "Write")))
    assert [(r.doc_id, r.line_no, r.severity, r.confidence) for r in blocks.method_issues(files).collect()] == [(0, 2, "critical", "high")]


def test_innermost_block(spark):
    text = "public int A() {\n x\n public int B() {\n  y\n }\n z\n}\nw"
    found = blocks.blocks(_files(spark, ("a", text)))
    lines = spark.createDataFrame([(0, n) for n in range(1, 9)], "doc_id long, line_no int")
    got = {r.line_no: r.start_line for r in blocks.innermost(lines, found).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 1, 7: 1, 8: None}
