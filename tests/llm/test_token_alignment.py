"""Alignment of two tokenizers against a plain search over all token pairs."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from talus.llm import token_alignment

from ..conftest import SMALL

public = pytest.importorskip("public_tokenizers")


def _bytes_of_a(tokenizer, ids):
    """By the library's own decoder of single ids where it gives whole characters, else by the letters of the vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(k): k for k in own}
    for k in range(256):
        if k not in own:
            letters[chr(256 + len(letters) - len(own))] = k
    return [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in ids]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(public.path(token_alignment.A_TOKENIZER))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public.path(token_alignment.B_TOKENIZER))
    every, pairs = [], Counter()
    for x in texts:
        groups = []
        if x:
            a, b = ta.encode(" " + x, add_special_tokens=False).ids, tb.encode(x)
            bytes_a = _bytes_of_a(ta, a)
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(tb.id_to_piece, b)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + x).encode():
                i = j = at_a = at_b = 0
                now = ([], [])
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        now[0].append(a[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        now[1].append(b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b and now[1]:
                        groups.append(now)
                        now = ([], [])
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        pairs.update(links.keys())
        every.append((groups, links))
    top = {}
    for (p, _), n in pairs.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for groups, links in every:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if pairs[p] == top[p[0]]), sum(n * pairs[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def _got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


TEXTS = [None, "", " ", "a", "the cat sat on the mat", "the cat sat on the mat", "a<|endoftext|>b <s> </s> <unk>", "under▁score", "naïve café — 日本語 テスト 12345 1,234.5", "\n\n\tcode  =  {x:1}\r\n", "x" * 3000, "a\x00b", "  leading  and trailing   ", "🙂🙃 emoji", "the the the the", "­soft", "zq" * 500 + " end"]


def test_defined_cases(spark):
    rows = [(i if i else None, x) for i, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", token_alignment.F.lit("clash")).withColumn("a", token_alignment.F.lit(1))
    want = sorted(((i if i is not None else -1), *w) for (i, _), w in zip(rows, plain(TEXTS), strict=True))
    assert _got(token_alignment.align(docs)) == want
    assert token_alignment.align(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 20_000, "stream_entries": 16, "held_rows": 8}])
def test_equals_plain_search(spark, sizes):
    """Also with batches and streams so small that most ids are dealt to several."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((i, *w) for (i, _), w in zip(rows, plain([x for _, x in rows]), strict=True))
    assert _got(token_alignment.align(docs, **sizes)) == want


def test_links_in_blocks():
    """A long group makes its distinct pairs some at a time; their counts are products."""
    a, b = np.array([5, 6, 5, 7] * 9), np.array([1, 2, 2] * 8)
    group = np.repeat([0, 1], [18, 18]), np.repeat([0, 1], [12, 12])
    doc = np.array([0, 3])
    want = Counter((int(x), int(y), int(doc[g])) for x, g in zip(a, group[0], strict=True) for y, h in zip(b, group[1], strict=True) if g == h)
    for most in (1, 4, 1 << 20):
        keys, times = token_alignment.link_keys(a, b, *group, doc, 4, most)
        got = {(int(k >> 20), int(k >> 16) & 15, int(k) & 0xFFFF): int(n) for k, n in zip(keys, times, strict=True)}
        assert got == want and len(got) == len(keys)
