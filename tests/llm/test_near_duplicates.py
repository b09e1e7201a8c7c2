from __future__ import annotations

from talus.llm import ngram_jaccard


def test_one_row_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    a, near, lone, other, third = " ".join(base), " ".join(base[:58] + ["x", "y"]), " ".join(f"u{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30)), " ".join(f"z{i}" for i in range(30))
    rows = [(1, a)] * 3 + [(2, near), (2, lone)]  # repeated rows; one id with a near copy and a text of its own
    rows += [(None, other)] * 3 + [(None, other + " end"), (None, near)]  # null ids
    rows += [(5, third), (4, third), (4, third)]
    rows += [(7, ""), (7, ""), (8, ""), (9, None), (9, None), (None, None)]
    got = ngram_jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "text"]
    kept = sorted(map(tuple, got.collect()), key=str)
    first = [r for r in kept if r in {(None, other), (None, other + " end")}]
    assert len(first) == 1
    assert [r for r in kept if r not in first] == sorted([(1, a), (2, lone), (4, third), (7, ""), (8, ""), (9, None), (None, None)], key=str)
