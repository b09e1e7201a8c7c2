"""The field against enumeration, on held-out rows, on code-switched text and in the defined cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from talus.llm import language_crf

from ..conftest import SMALL

MIDDLE = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def field(spark):
    return language_crf.train(spark.read.parquet(f"{MIDDLE}/documents.parquet"))


@pytest.mark.parametrize("span", [1, 2, 3, 64])
def test_chain_equals_enumeration(span):
    rng, k = np.random.default_rng(5), 3
    start, moves = rng.normal(size=k), rng.normal(size=(k, k)) * 2
    sizes = [1, 0, 5, 2, 7, 4, 3, 6, 0]
    first = np.r_[0, np.cumsum(sizes)]
    scores = rng.normal(size=(first[-1], k)) * 3
    got = language_crf.chain(scores, first, start, moves, span)
    for a, b in zip(first[:-1], first[1:], strict=True):
        want = np.zeros((b - a, k))
        for y in itertools.product(range(k), repeat=int(b - a)):
            w = np.exp(sum(scores[a + t, y[t]] for t in range(b - a)) + sum(moves[p, q] for p, q in itertools.pairwise(y)) + (start[y[0]] if y else 0))
            for t, label in enumerate(y):
                want[t, label] += w
        if b > a:
            assert np.allclose(want / want.sum(1, keepdims=True), got[a:b])


def test_spans_change_nothing_in_a_long_text():
    rng = np.random.default_rng(6)
    start, moves, scores = rng.normal(size=4), rng.normal(size=(4, 4)) * 4, rng.normal(size=(5_000, 4)) * 5
    one = language_crf.chain(scores, np.array([0, 5_000]), start, moves, 5_000)
    assert np.allclose(one, language_crf.chain(scores, np.array([0, 5_000]), start, moves, 64))


def test_words_and_features():
    raw = np.frombuffer("Ab 1cd-é,x".encode() + b"y z", np.uint8)
    ends = np.array([0, len(raw) - 3, len(raw)])
    start, stop, first = language_crf.bounds(raw, ends)
    assert [bytes(raw[a:b]).decode() for a, b in zip(start, stop, strict=True)] == ["Ab", "cd", "é", "x", "y", "z"]
    assert first.tolist() == [0, 4, 6]
    whole, _, at = language_crf.features(raw, start, stop)
    for i in range(len(start)):  # a word's features don't depend on its neighbours
        own, _, _ = language_crf.features(raw[start[i] : stop[i]], np.array([0]), np.array([stop[i] - start[i]]))
        assert sorted(own) == sorted(whole[at[i] : at[i + 1] if i + 1 < len(at) else None])


def test_held_out_accuracy(spark, field):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = language_crf.predict(docs, field).where(language_crf.held_out(language_crf.F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_code_switched_text(spark, field):
    words = {r.lang: r.text.split() for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").where(language_crf.held_out(language_crf.F.col("doc_id")) & (language_crf.F.col("n_chars") > 600)).select("lang", "text").collect()}
    parts = [(x, " ".join(words[x][:40])) for x in ("de", "en", "fr", "es")]
    text = " ".join(p for _, p in parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    hit, at = {}, 0
    spans = language_crf.language_spans(docs, field).orderBy("start").collect()
    for lang, part in parts:
        inside = [(max(s.start, at), min(s.end, at + len(part)), s.lang) for s in spans]
        hit[lang] = sum(max(0, b - a) for a, b, x in inside if x == lang) / sum(max(0, b - a) for a, b, _ in inside)
        at += len(part) + 1
    assert min(hit.values()) > 0.85, hit
    assert language_crf.predict(docs, field).first().n_switches >= 3


def test_defined_cases(spark, field):
    texts = [None, "", "12 34 --", "ß", "the and of that with", "the and of that with", "日本語", "x" * 100_000, " the" * 50_000]
    rows = [(str(i) if i else None, x, "mine", 9) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score string, _y long")
    got = {r.doc_id: r for r in language_crf.predict(docs, field).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (None, "1", "2")] == [("und", 0.0)] * 3
    assert got["4"].lang_pred == "en" and got["4"][1:4] == got["5"][1:4] and got["4"].lang_pred == got["8"].lang_pred
    assert all(got[k].lang_pred in field.labels and 0 <= got[k].score <= 1 for k in ("3", "6", "7", "8"))
    assert got["8"].n_words == 50_000 and got["4"]._y == 9
    assert language_crf.predict(docs.limit(0), field).count() == 0
    assert language_crf.language_spans(docs, field).where("doc_id = '8'").agg({"n_words": "sum"}).first()[0] == 50_000


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "7 7", "en")], "doc_id long, text string, lang string")
    for some in (docs, docs.where("lang is null"), docs.limit(0)):
        f = language_crf.train(some)
        assert f.labels == [] and {r.lang_pred for r in language_crf.predict(docs, f).collect()} == {"und"}
    one = language_crf.train(spark.createDataFrame([(k, "some words", "xx") for k in range(9)], "doc_id long, text string, lang string"))
    assert language_crf.predict(docs, one).where("doc_id = 1").first().lang_pred == "xx"
