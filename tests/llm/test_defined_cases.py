"""Operators in the cases their docstrings define, and against brute force on small tables."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from talus.llm import chat_preference, decontamination, packing, pii, quality_fm, token_records

from ..conftest import SMALL


# chat preferences


def _pairs(spark, rows):
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("prompt", chat_preference.F.lit(7))
    return {r.pair_id: r for r in chat_preference.format_preferences(df.repartition(2)).collect()}


def _shown(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_longest_common_prefix(spark):
    same = [("user", "hi"), ("assistant", "héllo"), ("user", "more")]
    sides = {"chosen": [*same, ("assistant", "good"), ("user", "ok"), ("assistant", "bye")], "rejected": [*same, ("assistant", "bad")]}
    rows = [(1, s, k, *t) for s, turns in sides.items() for k, t in enumerate(turns)]
    got = _pairs(spark, rows)[1]
    assert (got.paired, got.prefix_turns, got.prompt) == (True, 3, _shown(*same))
    assert got.chosen == _shown(*sides["chosen"][3:]) and got.rejected == _shown(*sides["rejected"][3:])
    trained = [got.chosen[int(a) : int(b)] for a, b in (x.split(":") for x in got.chosen_mask.split(","))]
    assert trained == ["good<|im_end|>\n", "bye<|im_end|>\n"]


def test_preferences_without_a_side_with_nulls_and_ties(spark):
    rows = [(1, "chosen", 0, "user", "a"), (2, "chosen", 0, None, None), (2, "rejected", 0, "", ""), (3, "chosen", 1, "user", "b"), (3, "chosen", 1, "assistant", "a"), (3, "rejected", 1, "assistant", "a"), (3, "rejected", None, "user", "b"), (None, "chosen", 0, "user", "x")]
    got = _pairs(spark, rows)
    assert set(got) == {1, 2, 3}
    assert (got[1].paired, got[1].prompt, got[1].rejected) == (False, "", None) and got[1].chosen == _shown(("user", "a"))
    assert (got[2].prefix_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert got[3].chosen == _shown(("assistant", "a"), ("user", "b")) and got[3].rejected == _shown(("user", "b"), ("assistant", "a")) and got[3].prefix_turns == 0
    assert _pairs(spark, []) == {}


# personal data


def _plain_spans(text):
    """The contract's base spans by Python's own regular expressions."""
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(v):
        d = [int(c) for c in digits(v)][::-1]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) * 1

    found = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 12 <= len(digits(v)) <= 19 and luhn(v) % 10 == 0, "phone": lambda v: 9 <= len(digits(v)) <= 15}
    for rank, (kind, p) in enumerate(kinds.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text or "") if ok[kind](m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


SPANS = [None, "", "a.b@c.de and 1.2.3.4 or 1.2.3.444", "4111 1111 1111 1111 4111-1111-1111-1112", "+49 (30) 123-456 x +1", "é" * 50 + "x@y.zz.", "1.2.3.4.5.6.7.8", "a@b@c.de", "x@y.z" * 3, "+1234567890123456", "0" * 30, "9.9.9.9@a.b", "378282246310005 " * 40]


def test_base_spans_equal_plain_search(spark):
    rows = [(i, t) for i, t in enumerate([*SPANS, *(r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base_spans", pii.F.lit("clash"))
    got = pii.find_spans(docs, pii.train(docs)).select("doc_id", pii.shown(pii.F.col("base_spans")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: _plain_spans(t) for i, t in rows}
    assert pii.find_spans(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a.b@c.de, 1.2.3.4!", "x"), (2, None, None), (3, "nothing", "y")], "doc_id long, text string, keep string")
    got = {r.doc_id: (r.text, r.keep) for r in pii.redact(docs, pii.train(docs)).collect()}
    assert got == {1: ("to [EMAIL], [IP]!", "x"), 2: (None, None), 3: ("nothing", "y")}


# decontamination


def _plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for k in range(max(1, len(b) - 12)) if b else ():
            win = b[k : k + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {str(i)} if i is not None else set()
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_contamination_equals_plain_search(spark):
    long = " ".join(f"w{k}" for k in range(40))
    items = [(1, long), (1, long), (2, "Short One"), (3, None), (4, "--"), (None, "other words here"), (10, " ".join(f"w{k}" for k in range(5, 18))), (5, "É a")]
    texts = [None, "", long, long.upper(), "x " * 30 + " ".join(f"w{k}" for k in range(7, 21)), "short one short, one", "other words here!", "w1 w2", "é A", "z " * 500 + "short one", " ".join(f"w{k}" for k in range(12))]
    docs = spark.createDataFrame([*enumerate(texts), (None, long), (2, long)], "doc_id long, text string").withColumn("items", decontamination.F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in decontamination.contamination(docs, bench).collect())
    assert got == sorted((i, *_plain_hits(t, items)) for i, t in [*enumerate(texts), (-1, long), (2, long)])
    clean = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(texts) + 2 and not any(r.contaminated or r.n_hit for r in clean)
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


# quality


def test_quality_cases(spark):
    rows = [(i if i else None, None if i == 1 else "" if i == 2 else f"good words number {i} " * 20 if i % 2 else "!!! ### " * 20, None if i % 5 == 0 else 10, "x") for i in range(40)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 40)] + [(3, 0), (5, 7), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality_fm.score_quality(docs, quality_fm.train(docs, labels)).collect()
    assert len(got) == 41 and all(0 <= r.score <= 1 for r in got)
    for none in (labels.limit(0), labels.where("quality = 7")):
        assert {r.score for r in quality_fm.score_quality(docs, quality_fm.train(docs, none)).collect()} == {0.5}
    assert quality_fm.score_quality(docs.limit(0), quality_fm.train(docs.limit(0), labels)).count() == 0


# packing and records


def _tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_packing_of_repeated_null_and_long_rows(spark):
    rows = [(None, "")] * 50 + [(7, "a b c")] * 5 + [(i, "word " * (i % 90)) for i in range(300)] + [(999, "long " * 80_000), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.pack_group, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].padded_to <= packing.TOKEN_BUDGET
        assert all(r.n_tokens <= r.padded_to for r in b) and len({r.padded_to for r in b}) == 1
    assert sum(r.n_tokens == 1 for r in got) >= 51
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_records_read_back(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [(3, "one two"), (1, None), (2, ""), (None, "null id"), (3, "again"), (3, "again"), (-5, "né\n\n x"), (9, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_records.op10_token_records(spark, _tables(spark, tmp_path, documents=docs)).orderBy("start").collect()
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    empty = tmp_path / "empty"
    assert token_records.op10_token_records(spark, _tables(spark, empty, documents=docs.limit(0))).count() == 0
