"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(bias + w.x + 1/2 sum_f [(V_f.x)^2 - (V_f^2).(x^2)]), which is
linear in the features of a text. It's trained on at most SAMPLE_ROWS labelled
rows, taken evenly by a hash of doc_id; held-out rows are never among them.

Defined cases: a null or empty text is scored by its statistics (all zero); a
null n_chars counts as the length of the text; without labels, every score is
0.5; labels other than 0 and 1, or null, and ids labelled both ways are left
out; an id labelled or occurring more than once counts once, by the row with
the least features; a null doc_id is no part of held_out and never labelled; a
very long text takes 8 bytes a word; an empty table gives no rows. doc_id may
be of any type; input columns pass through, one named as the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, with_columns
from .words import SPACE_CUTS, cut, parts

WORD_BITS = 14
FACTORS = 8
SAMPLE_ROWS = 12_000
EPOCHS = 8
N_STATS = 14
N_FEATURES = (1 << WORD_BITS) + N_STATS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 sentence marks, 5 other ASCII, 6 beyond ASCII."""
    c = np.full(256, 5, np.uint8)
    c[97:123], c[65:91], c[48:58], c[128:] = 0, 1, 2, 6
    c[[32, 9, 10, 11, 12, 13]] = 3
    c[[ord(x) for x in ".,;:?'\"-()"]] = 4
    return c


_CLASS = _classes()


def features(texts, n_chars) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature numbers and values of each row: distinct hashed words, then the statistics."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, int)
    data = np.frombuffer((texts.buffers()[2] if n else None) or b"", np.uint8)
    index, value = [], []
    fixed = np.arange(1 << WORD_BITS, N_FEATURES, dtype=np.int32)
    for w in cut(texts, SPACE_CUTS):
        bucket = (w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        for i in range(len(w.first) - 1):
            row = w.rows.start + i
            a, b = int(w.first[i]), int(w.first[i + 1])
            raw = data[ends[row] : ends[row + 1]]
            size, words = max(len(raw), 1), b - a
            some = np.unique(bucket[a:b])
            share = np.bincount(_CLASS[raw], minlength=7) / size
            lines = int(np.count_nonzero(raw == 10)) + 1
            known = n_chars[row] if n_chars[row] is not None else len(raw)
            distinct = len(np.unique(w.hashes[a:b])) / max(words, 1)
            pairs = len(np.unique(w.hashes[a : b - 1] * np.uint64(3) + w.hashes[a + 1 : b])) / (words - 1) if words > 1 else float(words)
            stats = [*share, distinct, pairs, words / size * 4, np.log1p(words) / 10, np.log1p(lines) / 10, np.log1p(max(known, 0)) / 10, min(words, 50) / 50]
            index.append(np.concatenate([some, fixed]))
            value.append(np.concatenate([np.full(len(some), 1 / np.sqrt(max(len(some), 1)), np.float32), np.array(stats, np.float32)]))
    return index, value


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the factor sums, of rows laid end to end."""
        x = value[:, None] * self.v[index]
        total = np.add.reduceat(x, starts, axis=0)
        square = np.add.reduceat(x * x, starts, axis=0)
        return self.bias + np.add.reduceat(value * self.w[index], starts) + 0.5 * (total * total - square).sum(1), total

    def score(self, index: list[np.ndarray], value: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(index))
        for i, (a, b) in enumerate(zip(index, value, strict=True)):
            x = b[:, None] * self.v[a]
            total = x.sum(0)
            out[i] = self.bias + b @ self.w[a] + 0.5 * float(total @ total - (x * x).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(index: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adam on the logistic loss; the rows are a bounded sample."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, factors)).astype(np.float32))
    if not len(label) or label.min() == label.max():
        return Machine(0.0 if not len(label) else (4.0 if label[0] else -4.0), m.w, np.zeros_like(m.v))
    slots = [np.zeros((N_FEATURES, factors + 1), np.float32) for _ in range(2)]
    bias_slots = np.zeros(2)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            t += 1
            idx, val = np.concatenate([index[r] for r in rows]), np.concatenate([value[r] for r in rows])
            sizes = np.array([len(index[r]) for r in rows])
            starts = np.cumsum(sizes) - sizes
            raw, total = m.raw(idx, val, starts)
            g = np.repeat(1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows], sizes) / len(rows)
            gv = (g * val)[:, None] * (np.repeat(total, sizes, axis=0) - val[:, None] * m.v[idx])
            cols = np.column_stack([g * val, gv])
            grad = np.stack([np.bincount(idx, cols[:, c], N_FEATURES) for c in range(factors + 1)], 1)
            grad += decay * np.column_stack([m.w, m.v])
            gb = float(g[starts].sum())
            slots[0] = 0.9 * slots[0] + 0.1 * grad
            slots[1] = 0.999 * slots[1] + 0.001 * grad * grad
            step = rate * (slots[0] / (1 - 0.9**t)) / (np.sqrt(slots[1] / (1 - 0.999**t)) + 1e-8)
            m.w -= step[:, 0].astype(np.float32)
            m.v -= step[:, 1:].astype(np.float32)
            bias_slots[:] = 0.9 * bias_slots[0] + 0.1 * gb, 0.999 * bias_slots[1] + 0.001 * gb * gb
            m.bias -= rate * (bias_slots[0] / (1 - 0.9**t)) / (np.sqrt(bias_slots[1] / (1 - 0.999**t)) + 1e-8)
    return m


def _fit_table(t: pa.Table) -> pa.Table:
    """The machine of the rows (y, doc_id, i, x), in one row."""
    t = t.sort_by("doc_id")
    arrays = lambda c: [np.asarray(x.values) for x in t.column(c)]
    m = fit(arrays("i"), arrays("x"), np.asarray(t.column("y"), np.float32))
    return pa.table({"bias": pa.array([m.bias], pa.float64()), "w": pa.array([m.w], pa.list_(pa.float32())), "v": pa.array([m.v.ravel()], pa.list_(pa.float32()))})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Features are made on the executors, and one task fits those of sample_rows rows at most; the driver gets the parameters."""
    small_batches(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_z")).where("_y = _z")
    # the ids are picked before texts are read: no text is sorted or shuffled for the sample
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "_y")
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(picked), "doc_id")  # at most sample_rows ids

    def make(batches):
        for b in parts(batches):
            index, value = features(b.column("text"), b.column("n_chars").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_y").cast(pa.int32()), b.column("doc_id"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["y", "doc_id", "i", "x"])

    made = rows.mapInArrow(make, f"y int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, i array<int>, x array<float>")
    one = made.groupBy("doc_id").agg(F.min_by(F.struct("y", "i", "x"), F.xxhash64("i", "x")).alias("r")).select("doc_id", "r.*")
    got = one.groupBy().applyInArrow(_fit_table, "bias double, w array<float>, v array<float>").first()  # one task fits sample_rows rows at most
    if got is None:
        return fit([], [], np.zeros(0, np.float32))
    return Machine(got.bias, np.array(got.w, np.float32), np.array(got.v, np.float32).reshape(N_FEATURES, -1))


def score_quality(docs: DataFrame, machine: Machine, into: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make(b):
        index, value = features(b.column("text"), b.column("n_chars").to_pylist())
        return [pa.array(shared.value.score(index, value), pa.float64())]

    return with_columns(docs, make, f"{into} double")


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    got = score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
