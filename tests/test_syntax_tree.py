"""Syntax-tree checks on hand-made sources."""

from __future__ import annotations

from talus.operators import syntax_tree


def _tree(spark, *texts):
    return syntax_tree.nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def _issues(frame):
    return sorted((r.doc_id, r.line_no, r.issue) for r in frame.collect())


def test_errors_null_and_empty(spark):
    t = _tree(spark, "x = (", None, "", "a\0b")
    assert _issues(syntax_tree.syntax_errors(t)) == [(0, 1, "Syntax Error"), (3, 1, "Syntax Error")]
    assert {r.doc_id for r in t.where("kind = 'Module'").collect()} == {1, 2}
    assert syntax_tree.sizes(_tree(spark, "x").limit(0)).count() == 0


def test_complexity_counts_inner_functions_twice(spark):
    code = "def f(a):\n  if a and b or c:\n    pass\n  for i in a:\n    break\n  def g():\n    while 1:\n      continue\n  try:\n    pass\n  except A: pass\n  except B: pass\n"
    t = _tree(spark, code, "def h():\n" + "  if x: pass\n" * 10)
    got = {(r.name, r.complexity, r.line_no) for r in syntax_tree.complexity(t).collect()}
    assert got == {("f", 10, 1), ("g", 3, 6), ("h", 11, 1)}
    assert {(r.name, r.complexity) for r in syntax_tree.complexity(t, strict=False).collect()} == {("f", 6), ("g", 2), ("h", 11)}
    assert _issues(syntax_tree.complex_functions(t)) == [(1, 1, "Function Complexity")]


def test_unused(spark):
    code = "import os, sys as s\nfrom a.b import c\nimport x.y\nu, v = 1, 2\n_w = 3\nself = 4\nz = v\nx.y.f(c)\n"
    assert _issues(syntax_tree.unused(_tree(spark, code))) == [(0, 1, "Unused Import"), (0, 1, "Unused Import"), (0, 4, "Unused Variable"), (0, 7, "Unused Variable")]


def test_sizes(spark):
    loops = "for a in b:\n  while c:\n    for d in e:\n      pass\n"
    wide = "class C:\n" + "  def m(self): pass\n" * 16
    long = "def f(a, b, c, d, e, g):\n" + "  pass\n" * 50
    other = "try:\n  f(7)\nexcept:\n  x = 8\nexcept_ = 1\ntry:\n  f(60)\nexcept Exception:\n  f(True)\n"
    got = _issues(syntax_tree.sizes(_tree(spark, loops, wide, long, other, "class D:\n" + "  pass\n" * 300)))
    assert got == [(0, 3, "Deeply Nested Loops"), (1, 1, "Large Class (Methods)"), (2, 1, "Long Function/Method"), (2, 1, "Long Parameter List"), (3, 2, "Magic Number"), (3, 3, "Bare Except"), (3, 8, "Broad Exception Handling"), (4, 1, "Large Class (Lines)")]


def test_calls(spark):
    code = "\n".join(
        ["cur.execute(f'a {b}')", "cur.execute('a' + b)", "cur.execute('a', b)", "subprocess.run(c, shell=True)", "os.system('a {}'.format(b))", "pickle.loads(b)", "yaml.safe_load(b)", "p = input()", "open(p)", "open('a' + p)", "open(q)"]
        + ["jwt.decode(t, verify=False)", "jwt.decode(t, algorithms=['a'])", "hashlib.md5(b)", "eval(p)", "exec(q)", "model.eval(p)", "f()(1)"]
    )
    want = [(1, "SQL Injection"), (2, "SQL Injection"), (4, "Command Injection Risk"), (5, "Command Injection"), (6, "Insecure Deserialization"), (9, "Path Traversal"), (10, "Path Traversal"), (12, "Insecure JWT Verification"), (12, "JWT Algorithm Vulnerability"), (14, "Weak Hashing Algorithm"), (15, "Dangerous eval with tainted data"), (15, "Use of eval"), (16, "Use of exec")]
    assert _issues(syntax_tree.dangerous_calls(_tree(spark, code))) == [(0, n, i) for n, i in want]


def test_imports(spark):
    t = _tree(spark, "import a.b, c\nfrom .d import e, f\nfrom . import g\nimport c\n")
    assert {(r.module, r.level) for r in syntax_tree.imports(t).collect()} == {("a.b", 0), ("c", 0), ("d", 1), ("g", 1)}
    assert syntax_tree.imports(t).count() == 4


def test_each_check_reads_few_rows_and_finds_the_same(spark):
    code = "import os, sys\nclass C:\n  pass\ndef f(a, b, c, d, e, g):\n" + "  if a and b:\n    eval(a)\n" * 6 + "  for i in a:\n    x = hashlib.md5(a, 7)\n  try:\n    cur.execute(f'{a}')\n  except:\n    pass\np = input()\nopen(p)\nfrom . import h\n"
    files = spark.createDataFrame([(0, code), (1, "x = ("), (2, None), (3, "")], "doc_id long, text string")
    checks = {"complexity": syntax_tree.complex_functions, "syntax_errors": syntax_tree.syntax_errors, "unused": syntax_tree.unused, "sizes": syntax_tree.sizes, "calls": syntax_tree.dangerous_calls, "imports": syntax_tree.imports}
    assert set(checks) == set(syntax_tree.NEEDS)
    whole = syntax_tree.nodes(files).cache()
    for need, check in checks.items():
        some = syntax_tree.nodes(files, need)
        assert sorted(map(str, check(some).collect())) == sorted(map(str, check(whole).collect())) != []
        assert some.count() < whole.count() / 4 and len(some.columns) < len(whole.columns)
    assert syntax_tree.nodes(files, "unused").where("kind = 'Name' and name = 'a'").count() == 1


def test_unused_and_calls_parse_each_file_once(spark):
    files = spark.createDataFrame([(0, "p = input()\nopen(p)\nx = 1\n")], "doc_id long, text string")
    for check, need in ((syntax_tree.unused, "unused"), (syntax_tree.dangerous_calls, "calls")):
        plan = check(syntax_tree.nodes(files, need))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_imports_parse_each_file_once_and_keep_null_ids(spark):
    files = spark.createDataFrame([(None, "import a\nfrom b import c, d\nfrom .. import e, f\nfrom . import *\n")], "doc_id long, text string")
    got = syntax_tree.imports(syntax_tree.nodes(files, "imports"))
    assert sorted((r.module, r.level) for r in got.collect()) == [("*", 1), ("a", 0), ("b", 0), ("e", 2), ("f", 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_files_that_cannot_hold_a_finding_are_not_parsed(spark):
    prose = ["An important word defines it", "imports from_import importa _import import_ 9", "", None]
    files = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    for need in ("imports", "complexity", "unused", "calls"):
        parsed = syntax_tree.nodes(files, need)._jdf.queryExecution().analyzed().children().head()
        assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, parsed).count() == 0


def test_all_forms_of_statements_are_parsed(spark):
    code = ["import\ta", "from .import b", "from c import(d)", "from e import*", "x=1;import f", "if 1:import g", "\fimport h", "from\\\n i\\\n import\\\n j"]
    code += ["try:\n  pass\nexcept:import k", "'''\n'''\r\nimport l\r\n", "\u00e9=1;import m", "def\\\n n(): import o"]
    code += ["def\tf(): pass\nif x: pass\n", "x: int\ny=z", "for a in b:\n for c in d:\n  while(e): pass", "class A:pass", "\uff45\uff56\uff41\uff4c(1)", "try:pass\nexcept:pass", "x=.7", "async def g():\n" + " if x and y: pass\n" * 9]
    files = spark.createDataFrame(list(enumerate(code)), "doc_id long, text string")
    checks = {"complexity": syntax_tree.complexity, "unused": syntax_tree.unused, "sizes": syntax_tree.sizes, "calls": syntax_tree.dangerous_calls, "imports": syntax_tree.imports}
    assert set(checks) == set(syntax_tree.HINTS)
    whole = syntax_tree.nodes(files).cache()
    for need, check in checks.items():
        assert sorted(map(str, check(syntax_tree.nodes(files, need)).collect())) == sorted(map(str, check(whole).collect())) != []
    assert {r.doc_id for r in syntax_tree.imports(syntax_tree.nodes(files, "imports")).collect()} == set(range(12))
