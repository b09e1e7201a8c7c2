"""Source trees and versioned tables on temporary folders."""

from __future__ import annotations

import hashlib
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talus.sources import files, scratch, snapshot

SAMPLES = {g: (g.replace("**/", "a/b/").replace("*.", "x.") + ("c/d.py" if g.endswith("/") else ""), g.replace("**/", "").replace("*.", "x.") + ("d.py" if g.endswith("/") else "")) for g in files.EXCLUDED}


def _tree(root, tree):
    for path, data in tree.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_every_default_pattern_is_hit_and_missed():
    assert len(files.EXCLUDED) == 31
    for glob, hits in SAMPLES.items():
        pattern = re.compile(files.glob_pattern(glob))
        assert all(pattern.match(p) for p in hits), glob
        name = glob.removeprefix("**/").rstrip("/").removeprefix("*")
        misses = (f"a/{name.lstrip('.')}x/d.py", f"a/x{name}", name.strip("./")) if glob.endswith("/") else (f"a{name}/d.py", f"a{name}x", f"a{name[1:]}y")
        assert not any(pattern.match(p) for p in misses), (glob, misses)


def test_scan(spark, tmp_path):
    tree = {"a.py": "x = 1\n", "p/__init__.py": "#", "p/.hidden.py": "y", "p/_under/é b.py": "z", "node_modules/n/i.js": "no", "p/build/x.py": "no", "pic.PNG": "P", "pic.png": "no", "e.txt": "", "e.bin": "", "nul.dat": b"a\0b", "late.dat": b"a" * 1024 + b"\0", "bad.txt": b"a\xffb", "lib.so": "text", "deep/" + "d/" * 30 + "f.go": "go"}
    _tree(tmp_path, tree)
    got = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    want = {"a.py", "p/__init__.py", "p/.hidden.py", "p/_under/é b.py", "pic.PNG", "e.bin", "nul.dat", "late.dat", "bad.txt", "lib.so", "deep/" + "d/" * 30 + "f.go"}
    assert set(got) == want
    assert {p for p, r in got.items() if r.binary} == {"e.bin", "nul.dat", "lib.so"} and got["nul.dat"].text is None
    assert got["bad.txt"].text == "a�b" and got["bad.txt"].size == 3
    assert all(r.md5 == hashlib.md5(tree[p] if isinstance(tree[p], bytes) else tree[p].encode()).hexdigest() for p, r in got.items())
    assert files.scan(spark, f"file://{tmp_path}", exclude=(), errors="ignore").where("path = 'bad.txt'").first().text == "ab"
    assert {r.path for r in files.scan(spark, str(tmp_path), types=("py", ".go"), exclude=("p/**",)).collect()} == {"a.py", "deep/" + "d/" * 30 + "f.go"}


def test_many_folders(spark, tmp_path):
    _tree(tmp_path, {f"d{i}/e{j}/f{k}.py": f"{i}{j}{k}" for i in range(30) for j in range(12) for k in range(2)})
    df = files.scan(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 200
    assert df.count() == df.select("path").distinct().count() == 720


def test_walks(spark, tmp_path):
    _tree(tmp_path, {"a.py": "1", "t/b.tsx": "1", "t/c.txt": "1", "test/d.js": "1", "my/test/e.js": "1"})
    paths = lambda df: {r.path for r in df.collect()}
    assert paths(files.dependency_walk(spark, str(tmp_path), ["t*/*.js"])) == {"a.py", "t/b.tsx", "my/test/e.js"}
    assert paths(files.project_walk(spark, str(tmp_path), ["test/", "a"])) == {"t/b.tsx", "my/test/e.js"}


def test_nothing_and_missing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert files.scan(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="missing"):
        files.scan(spark, str(tmp_path / "missing")).count()


def test_second_run_gives_changed_files_alone(spark, tmp_path):
    root, kept = tmp_path / "tree", f"file://{tmp_path}/kept"
    _tree(root, {"a.py": "1", "b.py": "2", "c.py": "3"})
    run = lambda: {r.path for r in snapshot.changed_files(files.scan(spark, str(root)), kept).collect()}
    assert run() == {"a.py", "b.py", "c.py"}
    assert snapshot.keep_files(files.scan(spark, str(root)), kept) == 1
    assert run() == set()
    _tree(root, {"b.py": "new", "d.py": "1"})  # d has the content of a, under a new path
    (root / "c.py").unlink()
    assert run() == {"b.py", "d.py"}
    assert snapshot.keep_files(files.scan(spark, str(root)), kept) == 2
    assert run() == set()
    assert snapshot.changed_files(spark.createDataFrame([("a.py", None)], "path string, md5 string"), kept).count() == 1


def test_merge_replaces_keys_and_a_killed_write_counts_for_nothing(spark, tmp_path):
    t = snapshot.Snapshot(spark, f"file://{tmp_path}/t", ["k"], "k string, v string, ts long")
    rows = lambda: sorted((r.k or "", r.v, r.ts) for r in t.read().collect())
    put = lambda *x: t.merge(spark.createDataFrame(list(x), "k string, v string, ts long"), "ts")
    assert rows() == [] and t.version() is None
    put(("a", "old", 1), ("a", "new", 2), ("b", "é", 1), (None, "n", 1))
    assert rows() == [("", "n", 1), ("a", "new", 2), ("b", "é", 1)]
    put(("b", "two", 0), (None, "m", 2))
    assert rows() == [("", "m", 2), ("a", "new", 2), ("b", "two", 0)]
    # a write that never came to its end
    (tmp_path / "t/v3").mkdir()
    (tmp_path / "t/v3/part-00000.parquet").write_bytes(b"half")
    assert t.version() == 2 and len(rows()) == 3
    assert put(("c", "x", 1)) == 4 and len(rows()) == 4 and t.read(2).count() == 3
    assert tuple(t.stats("v", snapshot.F.lit(2), "ts").first()) == (4, 2, 8)
    t.remove(snapshot.F.col("ts") < 2)
    assert rows() == [("", "m", 2), ("a", "new", 2)]


def test_stored_tables_leave_no_shuffle_files(spark):
    folder = Path(spark.conf.get("spark.local.dir", None) or spark.sparkContext.getConf().get("spark.local.dir"))
    before = set(folder.rglob("shuffle_*.data"))
    out, path = scratch.stored(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count(), "tidy")
    assert out.count() == 7
    for _ in range(100):  # Spark removes them beside the next query
        left = set(folder.rglob("shuffle_*.data")) - before
        if len(left) <= 1:  # that of the count above
            break
        time.sleep(0.1)
    scratch.discard(spark, path)
    assert len(left) <= 1
    assert spark.conf.get(scratch._TIDY, "false") == "false"
