"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of 13 consecutive words (a shorter
item is one window). Its five-word shingles (all its words, if it has fewer)
are ordered by rarity over all documents; as a window must be contained whole,
its necessary prefix is the rarest shingle alone. Document shingles join these
prefixes; position and length bounds drop candidates that would overrun the
document, and the window is then verified word by word.

The benchmark is read in blocks of a bounded size, each broadcast; a larger
benchmark makes more blocks, and the documents are passed once per block.

Defined cases: a null or wordless document has no words and is clean; a null or
wordless item has no window; repeated items count by their distinct item_id, a
null item_id by none (its windows still hit); repeated documents are judged
each; an empty benchmark leaves all clean; an empty table gives no rows. Input
columns pass through, those named n_words, n_hit, n_items, items or contaminated
are replaced. A very long text takes some ten bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, with_columns
from .words import ALNUM_CUTS, SHINGLE, cut, parts, rolled

WINDOW = 13
BLOCK_BYTES = 4 << 20
_ORDER_WINDOWS = 1 << 16
_CHECK_ROWS = 200_000


@dataclass
class Windows:
    """The distinct windows of a block of items, as places in the block's words.

    The items of window w are names[item[first[w]:first[w + 1]]]. By prefix
    key: the windows, and the place of the shingle in them.
    """

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list[str]
    #: Distinct shingles of the windows, sorted.
    shingles: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    window: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    width: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def order_by(self, times: np.ndarray) -> None:
        """Keep the rarest shingle of each window; times goes with shingles."""
        keys, offsets = np.zeros(len(self.start), np.uint64), np.zeros(len(self.start), np.int64)
        for at in range(0, len(self.start), _ORDER_WINDOWS):
            start, length = self.start[at : at + _ORDER_WINDOWS], self.length[at : at + _ORDER_WINDOWS]
            win, place = _spread(np.maximum(length - SHINGLE + 1, 1))
            width, h = np.minimum(length, SHINGLE)[win], np.zeros(len(win), np.uint64)
            for k in np.unique(width):
                of = width == k
                h[of] = rolled(self.words, int(k))[start[win[of]] + place[of]]
            order = np.lexsort((h, times[np.searchsorted(self.shingles, h)], win))
            best = order[np.searchsorted(win[order], np.arange(len(start)))]
            keys[at : at + len(start)], offsets[at : at + len(start)] = h[best], place[best]
        order = np.argsort(keys, kind="stable")
        self.keys, self.window, self.offset, self.width = keys[order], order, offsets[order], np.minimum(self.length, SHINGLE)[order]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of members: the owner of each member and its place with the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def windows_of(items: list[tuple[str | None, str | None]]) -> Windows:
    """All in arrays: a block of some MB of text takes some ten times its size while this runs."""
    none = np.zeros(0, np.uint64)
    parts_ = [(w.hashes, np.diff(w.first)) for w in cut(pa.array([t for _, t in items], pa.string()), ALNUM_CUTS)]
    words = np.concatenate([none, *(h for h, _ in parts_)])
    n = np.concatenate([np.zeros(0, np.int64), *(k for _, k in parts_)])
    begin = np.cumsum(n) - n
    of, place = _spread(np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0))
    start, length = begin[of] + place, np.minimum(n, WINDOW)[of]
    digest = np.zeros(len(start), np.uint64)
    for k in np.unique(length):
        digest[length == k] = rolled(words, int(k))[start[length == k]]
    _, one, window = np.unique(digest, return_index=True, return_inverse=True)
    names = sorted({name for name, _ in items if name is not None})
    number = {name: i for i, name in enumerate(names)}
    item = np.array([number.get(name, -1) for name, _ in items], np.int64)[of] if len(of) else np.zeros(0, np.int64)
    pair = np.unique(window[item >= 0] * max(len(names), 1) + item[item >= 0])
    first = np.searchsorted(pair // max(len(names), 1), np.arange(len(one) + 1))
    long = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(long[: len(long) - SHINGLE + 1] == long[SHINGLE - 1 :]) if len(long) >= SHINGLE else np.zeros(0, np.int64)
    short = [rolled(words, k)[begin[n == k]] for k in range(1, SHINGLE) if (n == k).any()]
    shingles = np.unique(np.concatenate([none, rolled(words, SHINGLE)[inside], *short]))
    return Windows(words, start[one], length[one], first, pair % max(len(names), 1), names, shingles)


def _count_rows(known):
    """Documents that hold each shingle of the block, counted within the task."""

    def run(batches):
        keys, widths = known.value
        count = np.zeros(len(keys), np.int64)
        for b in parts(batches):
            for w in cut(b.column("text"), ALNUM_CUTS):
                row = w.row_of
                for k in widths:
                    s = rolled(w.hashes, k)
                    at = np.searchsorted(keys, s)
                    at[at == len(keys)] = 0
                    hit = np.flatnonzero((keys[at] == s) & (row[: len(s)] == row[k - 1 :])) if len(s) else np.zeros(0, int)
                    pair = np.unique(row[hit] * len(keys) + at[hit])
                    np.add.at(count, pair % max(len(keys), 1), 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], names=["k", "n"])

    return run


def _hits(w, block: Windows):
    """Of the words of some rows: which are hit, and (row, window) of all occurrences."""
    covered = np.zeros(len(w.hashes) + 1, np.int64)
    row, rows, wins = w.row_of, [], []
    for k in np.unique(block.width):
        s = rolled(w.hashes, int(k))
        of = np.flatnonzero(block.width == k)
        keys = block.keys[of]
        low, high = np.searchsorted(keys, s, side="left"), np.searchsorted(keys, s, side="right")
        at = np.flatnonzero(high > low)
        reach = np.cumsum(high[at] - low[at])
        a = 0
        while a < len(at):  # some candidates at a time
            b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + _CHECK_ROWS, side="right")))
            part = at[a:b]
            times = high[part] - low[part]
            entry = of[np.repeat(low[part], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            win, start = block.window[entry], np.repeat(part, times) - block.offset[entry]
            n, r = block.length[win], np.repeat(row[part], times)
            fits = (start >= w.first[r]) & (start + n <= w.first[r + 1])
            win, start, n, r = win[fits], start[fits], n[fits], r[fits]
            place = np.arange(WINDOW)
            got = w.hashes[np.minimum(start[:, None] + place, len(w.hashes) - 1)]
            same = ((got == block.words[np.minimum(block.start[win][:, None] + place, len(block.words) - 1)]) | (place >= n[:, None])).all(1)
            np.add.at(covered, start[same], 1)
            np.add.at(covered, (start + n)[same], -1)
            rows.append(r[same])
            wins.append(win[same])
            a = b
    none = np.zeros(0, np.int64)
    return np.cumsum(covered[:-1]) > 0, np.concatenate(rows or [none]), np.concatenate(wins or [none])


def _judge(shared, first: bool):
    def make(b):
        block = shared.value
        n = b.num_rows
        words, hits = np.zeros(n, np.int64), [[] for _ in range(n)]
        items = [set() for _ in range(n)] if first else [set(x) for x in b.column("_items").to_pylist()]
        before = None if first else b.column("_hit_words").to_pylist()
        for w in cut(b.column("text"), ALNUM_CUTS):
            hit, rows, wins = _hits(w, block)
            words[w.rows] = np.diff(w.first)
            at = np.flatnonzero(hit)
            for i in np.unique(w.row_of[at]):
                a, z = np.searchsorted(at, w.first[i : i + 2])
                hits[w.rows.start + i] = at[a:z] - w.first[i]
            for i, k in np.unique(np.stack([rows, wins], 1), axis=0):
                items[w.rows.start + i].update(block.names[x] for x in block.item[block.first[k] : block.first[k + 1]])
        if not first:
            hits = [np.union1d(x, y).astype(np.int64) for x, y in zip(hits, before, strict=True)]
        return [pa.array(words), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return make


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Items in blocks of about block_bytes each, by a hash of the row; one block is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        t = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow()
        yield list(zip(t.column("i").to_pylist(), t.column("t").to_pylist(), strict=True))


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted as strings) and contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    out, first = docs.drop("_hit_words", "_items"), True
    for items in _blocks(benchmark, block_bytes):
        block = windows_of(items)
        widths = sorted({min(SHINGLE, int(n)) for n in np.unique(block.length)})
        known = spark.sparkContext.broadcast((block.shingles, widths))
        times = np.zeros(len(block.shingles), np.int64)
        if len(times):
            found = docs.select("text").mapInArrow(_count_rows(known), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each shingle of the block
            times[found.column("k").to_numpy()] = found.column("n").to_numpy()
        block.order_by(times)
        if not first:
            out, _ = stored(out, "decontamination")
        out = with_columns(out, _judge(spark.sparkContext.broadcast(block), first), "n_words long, _hit_words array<long>, _items array<string>") if first else _again(out, spark.sparkContext.broadcast(block))
        first = False
    out = out.withColumns({"n_hit": F.size("_hit_words").cast("long"), "n_items": F.size("_items").cast("long"), "items": F.col("_items")})
    return out.drop("_hit_words", "_items").withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def _again(out: DataFrame, shared) -> DataFrame:
    names = out.columns
    judge = _judge(shared, False)
    at = [names.index(c) for c in ("n_words", "_hit_words", "_items")]

    def run(batches):
        for b in parts(batches):
            columns = list(b.columns)
            for i, a in zip(at, judge(b), strict=True):
                columns[i] = a
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(run, out.schema)


def digest(items: list[str]) -> str:
    return sha256(",".join(items).encode()).hexdigest()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
with d as (select doc_id, {_WORDS_SQL} as w from documents),
b as (select item_id, {_WORDS_SQL} as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from win),
grams as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
occ as (select g.doc_id, g.i, g.n, win.item_id from grams g join win on g.n = win.n and g.s = win.s),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
        from (select distinct doc_id, cast(item_id as varchar) as item_id from occ) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit on d.doc_id = hit.doc_id left join its on d.doc_id = its.doc_id
"""
