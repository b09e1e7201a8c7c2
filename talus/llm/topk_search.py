"""Exact top-k search by inner product with norm buckets.

Components are turned into floor(256 * x). Vectors are range-partitioned by
length, longest first, and cut into buckets of similar length. Against each
bucket a query has a local cosine threshold: its k-th best score so far over
its length times the longest length in the bucket. Above 1 the bucket is
skipped; a high threshold prunes by coordinates (a query's largest coordinate
bounds what a vector must have there), a low one by length alone; products of
what remains are computed and kept exactly.

Queries are dealt in blocks of a bounded size, each broadcast and run against
all rows; thresholds start from the longest vectors. Equal vectors of a bucket
are multiplied once, and only those ids of theirs that can still rank are kept.

Defined cases: null vectors and those with null or non-finite components take
no part; a null vec_id takes no part; vectors of other dimension count as
padded with zeros; fewer than k candidates give fewer rows; scores beyond a
long are clamped to it; a repeated vec_id is a candidate as often as it occurs,
but never for its own id, and as a query has the best of all its vectors'
partners; an empty table gives no rows; a vector may have any length, which its
task holds. Only the id and the vector are read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stored

K = 5
QUERY_BLOCK = 8_192
BUCKET_ROWS = 2_048
BUCKET_RATIO = 0.9
COORDINATE_FROM = 0.6
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (floor(256 * x) as doubles, exact up to 2^53) and len2 (squared length)."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # a double keeps the floor of values that don't fit a long
    q = F.transform(v.cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * 256).cast("double")).otherwise(x * 256))
    out = embeddings.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("v"))
    return out.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def matrix(vectors) -> np.ndarray:
    lists = [np.asarray(x, float) for x in vectors]
    width = max((len(x) for x in lists), default=0)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; Python's integers where doubles could round."""
    n = min(q.shape[1], v.shape[1])
    q, v = q[:, :n], v[:, :n]
    if not n or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * n < _EXACT:
        return q @ v.T
    whole = lambda a: np.array([[int(x) for x in r] for r in a], object)
    return np.clip(whole(q) @ whole(v).T, -_LONG - 1, _LONG)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.q, self.k, self.least = ids, queries, k, least.astype(float)
        self.norm = np.sqrt((queries * queries).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(self.norm[:, None] > 0, queries / self.norm[:, None], 0.0)
        self.focus = np.abs(unit).argmax(1) if unit.shape[1] else np.zeros(len(ids), int)
        self.at_focus = unit[np.arange(len(ids)), self.focus] if unit.shape[1] else np.zeros(len(ids))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def add(self, vec_ids: np.ndarray, v: np.ndarray) -> None:
        """One bucket: rows of similar length."""
        length = np.sqrt((v * v).sum(1))
        longest = length.max(initial=0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = self.least / (self.norm * longest)  # NaN where either is zero
        alive = np.flatnonzero(~(local > 1 + 1e-9) & ~((self.norm * longest == 0) & (self.least > 0)))
        if not len(alive):
            return
        # equal vectors: one product, the ids that may rank
        order = np.lexsort((vec_ids, *v.T)) if v.shape[1] else np.argsort(vec_ids)
        vec_ids, v, length = vec_ids[order], v[order], length[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]).any(1)
        first = np.flatnonzero(new)
        until = np.append(first[1:], len(v))
        v, length = v[first], length[first]
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(length[:, None] > 0, v / length[:, None], 0.0)
        for part in np.array_split(alive, max(1, -(-len(alive) * len(v) // 4_000_000))):
            high = np.array([x >= COORDINATE_FROM for x in local[part]])
            for some, by_coordinate in ((part[high], True), (part[~high], False)):
                if len(some):
                    self._verify(some, vec_ids, v, length, unit, first, until, by_coordinate)

    def _verify(self, some, vec_ids, v, length, unit, first, until, by_coordinate) -> None:
        least = self.least[some]
        can = self.norm[some][:, None] * length[None, :] * (1 + 1e-9) + 1e-6 >= least[:, None]
        if by_coordinate and unit.shape[1] > int(self.focus[some].max(initial=0)):
            c, x = self.at_focus[some][:, None], unit[:, self.focus[some]].T
            cosine = c * x + np.sqrt(np.maximum(0, 1 - c * c)) * np.sqrt(np.maximum(0, 1 - x * x))
            can &= cosine * self.norm[some][:, None] * length[None, :] * (1 + 1e-9) + 1e-6 >= least[:, None]
        rows = np.flatnonzero(can.any(0))
        if not len(rows):
            return
        score = _products(self.q[some], v[rows])
        # vectors that only the query's own id has give it no partner
        low, high = vec_ids[first[rows]], vec_ids[until[rows] - 1]
        good = can[:, rows] & (score >= least[:, None]) & ((low != high) | (low != self.ids[some][:, None]))
        if len(rows) > 4 * self.k:  # of many, none below the k-th best vector of this bucket
            s = np.where(good, score.astype(float), -np.inf)
            good &= score.astype(float) >= np.partition(s, -self.k, axis=1)[:, [-self.k]]
        for i in np.flatnonzero(good.any(1)):
            at, own = some[i], self.ids[some[i]]
            more = [(int(score[i, j]), int(d)) for j in np.flatnonzero(good[i]) for d in _others(vec_ids, first[rows[j]], until[rows[j]], own, self.k)]
            self.found[at] = sorted(self.found[at] + more, key=lambda x: (-x[0], x[1]))[: self.k]
            if len(self.found[at]) == self.k:
                self.least[at] = max(self.least[at], float(self.found[at][-1][0]))


def _others(vec_ids, a, b, own, k):
    """The k smallest ids of equal vectors that aren't the query's."""
    ids = vec_ids[a:b]
    low = int(np.searchsorted(ids, own))
    high = int(np.searchsorted(ids, own, side="right"))
    return [*ids[: min(low, k)], *ids[high : high + max(0, k - low)]]


def _search(shared, k: int):
    def run(frames):
        ids, queries, least = shared.value
        best = Best(ids, queries, least, k)
        for f in frames:
            v = matrix(f["v"])
            vec_ids = f["vec_id"].to_numpy()
            length = np.sqrt(f["len2"].to_numpy())
            a = 0
            while a < len(f):  # longest first
                b = min(len(f), a + BUCKET_ROWS)
                b = max(a + 1, a + int(np.count_nonzero(length[a:b] >= BUCKET_RATIO * length[a])))
                best.add(vec_ids[a:b], v[a:b])
                a = b
        rows = [(int(q), d, s) for q, got in zip(ids, best.found, strict=True) for s, d in got]
        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries among vectors; both as from quantised()."""
    spark = vectors.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // query_block))
    # written once in order; each block of queries reads it, and its result is written before the next one is made
    ordered, path = stored(vectors.repartitionByRange(F.col("len2").desc(), F.col("vec_id")).sortWithinPartitions(F.col("len2").desc(), "vec_id"), "vectors-by-length")
    head = ordered.orderBy(F.col("len2").desc(), "vec_id").limit(2 * BUCKET_ROWS).collect()  # a bounded start for the thresholds
    head_ids, head_v = np.array([r.vec_id for r in head], np.int64), matrix([r.v for r in head])
    results = []
    for i in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow()  # about query_block rows
        ids, q = np.asarray(some.column("vec_id"), np.int64), matrix(some.column("v").to_pylist())
        best = Best(ids, q, np.full(len(ids), -np.inf), k)
        for a in range(0, len(head_ids), BUCKET_ROWS):
            best.add(head_ids[a : a + BUCKET_ROWS], head_v[a : a + BUCKET_ROWS])
        shared = spark.sparkContext.broadcast((ids, q, best.least))
        got, got_path = stored(ordered.mapInPandas(_search(shared, k), "query_id long, vec_id long, score long"), "top-k")
        shared.destroy()
        results.append(got_path)
    discard(path)
    out = spark.read.schema(got.schema).parquet(*results)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP4_SQL = """
with e as (
  select vec_id, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
