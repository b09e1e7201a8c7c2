"""Packing into optimal length buckets.

A document's length is the number of its token ids, from op10's tokenizer and
with the end id. The global histogram of lengths goes through a dynamic program that chooses the
bucket boundaries with the least padding; inside a bucket, rows form batches
that fill a token budget once padded to the boundary.

Each group of rows leaves one batch that may not be full, so a bucket of n rows
has n / group_rows short batches at most.

Defined cases: a null or empty text has only the end id; a null length counts
as 0 and sits in the first bucket; a row longer than the budget is a batch of
its own; repeated rows are packed each, and spread over groups by their copy
number; null doc_ids are spread likewise; an empty table gives no rows. Input
columns of pack_texts pass through; clashing ones are replaced.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, with_columns
from .token_records import encoder, tokenizer_path

PAD_TO = 8
BUCKETS = 12
TOKEN_BUDGET = 65_536
GROUP_ROWS = 4_096


def length_class(n: Column, pad_to: int = PAD_TO) -> Column:
    """The padded lengths that may be boundaries: all multiples of pad_to.

    Those that occur are d at most if all rows hold pad_to * d * d / 2 tokens,
    so the histogram that reaches the driver grows with the root of the corpus.
    """
    return F.greatest(F.ceil(n / pad_to), F.lit(1)).cast("long") * pad_to


def best_boundaries(lengths: list[int], counts: list[int], totals: list[int], buckets: int) -> list[int]:
    """Boundaries (ascending, of lengths; the last is the longest) with the least total padding.

    lengths are ascending; counts and totals hold the rows of each and the sum
    of their true lengths. The cost of a bucket satisfies the quadrangle
    inequality, so the best split points are monotone and each layer of the
    program is solved by halving.
    """
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    size = np.asarray(lengths, float)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, float))])
    real = np.concatenate([[0.0], np.cumsum(np.asarray(totals, float))])
    cost = lambda i, j: size[j - 1] * (rows[j] - rows[i]) - (real[j] - real[i])  # noqa: E731  rows i..j-1 in one bucket
    best, back = np.concatenate([[0.0], np.full(n, np.inf)]), []
    for _ in range(buckets):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            v = best[i] + cost(i, j)
            k = int(np.argmin(v))
            new[j], cut[j] = v[k], i[k]
            todo += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        best = new
        back.append(cut)
    out, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(df: DataFrame, length: Column, order: list[str], buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, pad_to: int = PAD_TO, group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with n_tokens, bucket, padded_to, pack_group, batch and slot.

    A bucket may hold a third of all rows, so it's dealt by its row count into
    groups of about group_rows; batches form inside a group, where at most the
    last one is not full. The histogram is aggregated before it moves.
    """
    df = df.withColumn("n_tokens", F.coalesce(length, F.lit(0)).cast("long"))
    hist = df.groupBy(length_class(F.col("n_tokens"), pad_to).alias("c")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).toArrow().sort_by("c")  # kept out of Python objects
    if not hist.num_rows:
        edges, counts = [pad_to], [0]
    else:
        c, n, t = (hist.column(k).to_numpy() for k in ("c", "n", "t"))
        edges = best_boundaries(c, n, t, buckets)
        counts = np.bincount(np.searchsorted(edges, c), weights=n, minlength=len(edges)).astype(int).tolist()
    pick = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("bucket") + 1)
    bucket = F.size(F.filter(F.array(*(F.lit(int(e)).cast("long") for e in edges)), lambda e: e < F.col("n_tokens")))
    out = df.withColumn("bucket", bucket)
    out = out.withColumn("padded_to", pick(edges).cast("long"))
    groups = [max(1, -(-n // group_rows)) for n in counts]
    key = F.xxhash64(*order)
    out = out.withColumn("pack_group", F.pmod(key, pick(groups)).cast("long"))
    place = F.row_number().over(W.partitionBy("bucket", "pack_group").orderBy(*order)) - 1
    fits = F.greatest(F.lit(budget).cast("long") / F.col("padded_to"), F.lit(1)).cast("int")
    out = out.withColumn("_place", place).withColumn("batch", F.floor(F.col("_place") / fits).cast("long"))
    return out.withColumn("slot", (F.col("_place") - F.col("batch") * fits).cast("long")).drop("_place")


def with_token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs with n_tokens, the token ids of each text with its end id, as op10 writes them."""
    path = tokenizer or tokenizer_path()

    def make(b):
        encode = encoder(path)
        width = array(encode.kind).itemsize
        return [pa.array([len(encode(t.as_py() or "")) // width + 1 for t in b.column("text").cast(pa.string())], pa.int64())]

    return with_columns(docs, make, "n_tokens long")


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id with its batch and slot, by its token ids; repeated rows are counted before they move."""
    d = with_token_lengths(docs.select("doc_id", "text")).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("_rows"))
    d, _ = stored(d, "lengths")  # the histogram and the batches read them, the tokenizer runs once
    d = d.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy"))
    return pack(d, F.col("n_tokens"), ["doc_id", "n_tokens", "_copy"]).drop("_copy")


def pack_texts(docs: DataFrame) -> DataFrame:
    """docs, all columns and whole texts, with n_tokens, bucket, padded_to, pack_group, batch and slot; for rows that differ in doc_id or text."""
    d, _ = stored(with_token_lengths(docs), "lengths")
    return pack(d.withColumn("_text_hash", F.xxhash64("text")), F.col("n_tokens"), ["doc_id", "n_tokens", "_text_hash"]).drop("_text_hash")


def op9_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
