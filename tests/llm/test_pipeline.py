"""Every stage of the pipeline on rows with nulls, repeats, empty and long texts and clashing columns."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LONG = " ".join(f"w{k}" for k in range(400))
PASSAGE = " ".join(f"b{k}" for k in range(60))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    texts = [None, "", LONG, LONG, LONG.replace("w3 ", "q "), "mail me a.b@c.de now", PASSAGE + " " + "x y z " * 5, "word " * 20_000, *(" ".join(f"t{i}x{k}" for k in range(30)) for i in range(40))]
    rows = [(i if i != 9 else None, t, "en" if i % 3 else None, f"src{i % 2}", len(t) if t and i != 11 else None, "mine", i, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], rows[20]], "doc_id long, text string, lang string, source string, n_chars long, score string, _text long, bucket string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i != 12), 0) for i in range(10, 48)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_near_duplicates_leave_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = _stage("near_duplicates")(spark, docs, folder)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sum(r.text is not None and r.text.startswith("w0 ") for r in rows) == 1 and len(rows) == docs.count() - 4
    assert sum(r.text == "mail me a.b@c.de now" for r in rows) == 1 and {None, ""} <= {r.text for r in rows}


def test_decontamination_takes_the_passage_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = _stage("decontamination")(spark, docs, folder)
    assert got.columns == docs.columns and got.count() == docs.count() - 1 and not any((r.text or "").startswith("b0 ") for r in got.collect())


def test_pii_hides_and_keeps_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = _stage("pii")(spark, docs, folder)
    assert got.columns == docs.columns and got.count() == docs.count()
    hidden = [r for r in got.collect() if r.text and "[EMAIL]" in r.text]
    assert [(r.text, r.n_chars, r.score) for r in hidden] == [("mail me [EMAIL] now", 19, "mine")] * 2


def test_packing_keeps_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = _stage("packing")(spark, docs, folder).collect()
    assert len(got) == docs.count() and {r.text for r in got} == {r.text for r in docs.collect()}


def test_run_and_empty_tables(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and not any((r.text or "").startswith("b0 ") or "a.b@c.de" in (r.text or "") for r in got)
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0, name
