from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from talus.llm import packing, token_records


def test_lengths_are_token_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    e = token_records.Encoder(public.path(token_records.TOKENIZER))
    texts = [None, "", "one two", "日本語の文章には空白がない。" * 50, "QUJD" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.padded_to) for r in packing.pack_documents(docs).collect()}
    want = [len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    assert {k: n for k, (n, _) in got.items()} == dict(enumerate(want))
    assert all(n <= to for n, to in got.values())


def test_boundaries_of_very_long_rows_are_optimal(spark):
    n = [9_001, 9_017, 9_040, 20_001, 20_100, 20_130, 20_500, 300_001, 300_900]
    got = packing.pack(spark.createDataFrame([(i, x) for i, x in enumerate(n)], "doc_id long, w long"), F.col("w"), ["doc_id"], buckets=4).collect()
    up = sorted({-(-x // 8) * 8 for x in n})
    best = min(sum(min(e for e in (*cut, up[-1]) if e >= x) - x for x in n) for cut in combinations(up[:-1], 3))
    assert sum(r.padded_to - r.n_tokens for r in got) == best
