"""The queries against their SQL, and operators against brute force on small tables."""

from __future__ import annotations

import pytest

from talus.llm import common, decontamination, ngram_jaccard, queries, token_records, url_filter

from ..conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def _shingles(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").split() if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_join_equals_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [None, "", "one two", "one two", " ".join(base), " ".join(base), " ".join(base[:58] + ["x", "y"]), " ".join(base[5:]), " ".join(base[:30] + ["z"] + base[31:]), " ".join(reversed(base))]
    texts += [" ".join(base[: 20 + k] + [f"k{k}"]) for k in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert ngram_jaccard.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("task_edges", [1 << 20, 5])
def test_components_of_a_path_and_a_star(spark, task_edges):
    """In one task, and in several whose stars are then joined in rounds."""
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    node, _ = common.components(spark.createDataFrame(edges, "src long, dst long"), task_edges=task_edges)
    got = {r.node: r.component for r in node.collect() if r.node != r.component}
    assert got == {**{i: 0 for i in range(1, 21)}, **{100 + i: 100 for i in range(1, 30)}}


def test_components_of_text_nodes_and_of_nothing(spark):
    node, _ = common.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x"), (None, "a")], "src string, dst string"))
    assert {r.node: r.component for r in node.collect()} == {"b": "a", "c": "a", "y": "x"}
    node, _ = common.components(spark.createDataFrame([], "src string, dst string"))
    assert node.count() == 0


def test_quality_on_held_out_rows(spark):
    at = SMALL.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [(r.score, labels[r.doc_id]) for r in queries.QUERIES["op8_quality_fm"](spark, at).collect() if r.held_out and r.doc_id in labels]
    good, bad = [x for x, y in got if y == 1], [x for x, y in got if y == 0]
    won = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert won / (len(good) * len(bad)) > 0.85


def test_decontamination_in_blocks(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one, many = (decontamination.contamination(docs, bench, b).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").toPandas() for b in (1 << 24, 4_000))
    assert rows_of(one) == rows_of(many)


def test_records_round_trip_and_damage():
    data = b"".join(token_records.frame(x) for x in (b"", b"abc", b"\n" * 9))
    assert [p for _, p in token_records.frames(data)] == [b"", b"abc", b"\n" * 9]
    with pytest.raises(ValueError):
        list(token_records.frames(data[:-6] + b"x" + data[-5:]))


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="http://a.com/en/1">'
    rows = [(1, "http://A.com/en/1", ""), (2, "http://x.dev/1", link), (3, "http://b.net/de/1", link), (4, None, None), (5, "http://y.dev/", "")]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.com", "com/en/", "block")
    assert got[3] == ("b.net", "net/de/", "allow")
    assert got[4] == ("", None, "allow") and got[5][2] == "allow"


def test_encoder_equals_the_library_on_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    e = token_records.Encoder(public.path(token_records.TOKENIZER))
    texts = ["", " ", "\n\n", "a", "don't stop, he said: \"foo.bar\"!!  x", "  two\n\n three \n", "tab\there", "naïve café, Ärger; ß.", "a<|endoftext|> b", "x y", "日本 語。", "1,234.5 (a) [b]", "é, ½. ²)"]
    for t in texts:
        got = token_records.np.frombuffer(e(t), e.kind).tolist()
        assert got == e.tokenizer.encode(t, add_special_tokens=False).ids, t
