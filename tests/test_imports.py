"""Imports of hand-made source trees."""

from __future__ import annotations

from talus.operators import imports


def _edges(spark, tree, **some):
    files = spark.createDataFrame(list(tree.items()), "path string, text string")
    return {(r.src, r.dst) for r in imports.import_edges(files, **some).collect()}


def test_absolute_imports(spark):
    tree = {
        "main.py": "import os, pkg.a\nimport pkg.a.thing as t\nimport lib\nimport nowhere, pkg.none.deep\n",
        "use.py": "from pkg import b, nothing\nfrom pkg.sub import *\nfrom main import x\nimport use\nfrom use import y\n",
        "pkg/__init__.py": "",
        "pkg/a.py": "from pkg import a, b\n",
        "pkg/b.py": None,
        "pkg/sub/c.py": "import json\n",
        "pkg/sub/d.py": "def f():\n    if 1:\n        from pkg.sub import c\n",
        "lib.py": "import typing",
        "data/none.txt": "import main",
        "os.py": "",
        "only/sub/deep.py": "from only import sub\nimport only.sub\n",
    }
    want = {
        ("main.py", "pkg/a.py"), ("main.py", "lib.py"), ("main.py", "pkg"),  # pkg.none.deep falls back to the package
        ("use.py", "pkg"), ("use.py", "pkg/b.py"), ("use.py", "pkg/sub"), ("use.py", "main.py"),
        ("pkg/a.py", "pkg"), ("pkg/a.py", "pkg/b.py"),
        ("pkg/sub/d.py", "pkg/sub"), ("pkg/sub/d.py", "pkg/sub/c.py"),
        ("only/sub/deep.py", "only/sub"),  # by its full name alone: only/ holds no Python file, so its names aren't tried
    }
    assert _edges(spark, tree) == want


def test_a_folder_wins_over_a_file_of_its_name_and_longer_names_win(spark):
    tree = {"x.py": "import a.b\nimport a.b.c.d\n", "a/b.py": "", "a/b/c.py": "", "a.py": ""}
    assert _edges(spark, tree) == {("x.py", "a/b"), ("x.py", "a/b/c.py")}


def test_relative_imports(spark):
    tree = {
        "p/__init__.py": "",
        "p/m.py": "from . import n, gone\nfrom .q import r\nfrom .n import f\nfrom .. import top\nfrom ... import outside\n",
        "p/n.py": "from . import n\n",
        "p/q/r.py": "from ..n import g\nfrom .. import m\nfrom ...p.q import r\n",
        "top.py": "from .p import m\n",
    }
    want = {
        ("p/m.py", "p"), ("p/m.py", "p/n.py"), ("p/m.py", "p/q"), ("p/m.py", "p/q/r.py"), ("p/m.py", "top.py"),
        ("p/n.py", "p"),
        ("p/q/r.py", "p/n.py"), ("p/q/r.py", "p"), ("p/q/r.py", "p/m.py"), ("p/q/r.py", "p/q"),
        ("top.py", "p"), ("top.py", "p/m.py"),
    }
    assert _edges(spark, tree) == want


def test_files_that_do_not_parse_are_read_by_lines(spark):
    tree = {"bad.py": "import a, b.c\nfrom d import e\n  import f\nx = (\n", "nul.py": "from a import x\0", "a.py": "", "b/c.py": "", "d.py": "", "f.py": "", "e.py": ""}
    assert _edges(spark, tree) == {("bad.py", "a.py"), ("bad.py", "b/c.py"), ("bad.py", "d.py"), ("nul.py", "a.py")}


def test_scripts(spark):
    tree = {
        "src/app.js": "import React from 'react';\nimport { a,\n b } from './util';\nimport '../styles.css';\nimport x from \"@scope/x\";\nconst y = require( './data.json' );\nimport z from 'http://a/b.js';\n",
        "src/util.ts": "export * from './app';\nimport w from './view/';\nimport up from '../../out';\nimport me from './util';\n",
        "src/util.js": "",
        "src/view/index.tsx": "require('/src/util.ts'); require(\"/src/./view/../app\")",
        "styles.css": "import './src/app'",
        "src/data.json": "{}",
        "out.js": "import a from './src/a.b'",
        "src/a.b.jsx": "",
        "src/dir.js": "require('./both')",
        "src/both/index.js": "",
        "src/both.ts": "",
    }
    want = {
        ("src/app.js", "src/util.js"), ("src/app.js", "styles.css"), ("src/app.js", "src/data.json"),
        ("src/util.ts", "src/view/index.tsx"), ("src/util.ts", "src/util.js"),
        ("src/view/index.tsx", "src/util.ts"), ("src/view/index.tsx", "src/app.js"),
        ("out.js", "src/a.b.jsx"),
        ("src/dir.js", "src/both/index.js"),  # an index of one extension comes before a file of the next
    }
    assert _edges(spark, tree) == want
    assert _edges(spark, tree, scripts=False) == set()


def test_nothing_and_repeated_paths(spark):
    assert _edges(spark, {"a.py": "import b"}) == set()
    files = spark.createDataFrame([("a.py", "import b")] * 3 + [("b.py", ""), (None, "import b"), ("b.py", None)], "path string, text string")
    assert [tuple(r) for r in imports.import_edges(files).collect()] == [("a.py", "b.py")]
    assert imports.import_edges(files.limit(0)).count() == 0


def test_many_importers_of_one_module(spark):
    files = spark.range(20_000).selectExpr("concat('m', id, '.py') as path", "if(id = 0, '', 'import m0') as text")
    assert imports.import_edges(files, scripts=False).where("dst = 'm0.py'").count() == 19_999


def test_a_file_is_read_and_parsed_once(spark, tmp_path):
    """Requests are read three times, but the files only for them and for the targets."""
    log = str(tmp_path / "log")

    def run(batches):
        for b in batches:
            with open(log, "a") as f:
                f.writelines(f"{p}\n" for p in b.column(0).to_pylist())
            yield b

    files = spark.createDataFrame([("a.py", "import b"), ("b.py", "")], "path string, text string").mapInArrow(run, "path string, text string")
    assert [tuple(r) for r in imports.import_edges(files, scripts=False).collect()] == [("a.py", "b.py")]
    assert open(log).read().split().count("a.py") == 2
