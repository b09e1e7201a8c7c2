"""N-gram Jaccard join: near-duplicate groups of texts over five-word shingles.

Two texts link when their sets of distinct shingles have a Jaccard similarity
of at least threshold; the result is the connected component of each text.
The join is size-aware. Every set orders its shingles from rare to frequent,
and a linked pair shares c shingles within the first n - ceil(t * n) + c of
either. Light sets (up to a boundary size) emit every 2-subset of that prefix
for c = 2; larger ones emit the single shingles for c = 1, which are inverted
lists, and light sets that could link with larger ones join those lists too.
The boundary is the size with the least cost over the histogram of set sizes.

Equal sets form one class first, and inside a list not all pairs meet: every
member is verified against a few leaders. Lists of one leader with nearly the
same members then become one group, so that a pair doesn't meet once a list.
While much is left apart, it meets other members of the group's largest
component. What remains in different components is compared with all members that could link, by size and
by the triangle inequality of Jaccard distances to the common leader, so no
link between components is lost while large groups of near copies stay linear.
Verification first bounds a pair's distance by small parity sketches, which
never rule out a link; only sets of pairs that pass are moved and intersected.

Defined cases: a null text or one without words has an empty set and links with
nothing; fewer than five words are one shingle; repeated rows and equal texts
are one component; a null doc_id has a component only through others' ids; a
text of any length is cut whole, its set held by its task; sets at the threshold
link; an empty table gives no rows. Only doc_id and text are read, so other
columns never clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, components, discard, maybe_in, small_batches, stored
from .words import mix, parts, shingle_sets

PERCENT = 75
#: Shingles are counted in 2^RARITY_BITS cells to order them by rarity, 4 bytes each at any input: a shingle
#: stands out once it is more frequent than the spread of its cell, the root of all shingles by cells.
RARITY_BITS = 20
SLICE_CELLS = 1 << 16
#: So many tasks' counts are added at a time.
FAN = 64
#: To meet other heads moves every row through some tables and joins, which costs about so many comparisons of two rows in a task.
ROUND_COST = 64
#: Rows of a group in one cell of the last join.
CELL_ROWS = 512
LIST_BITS = 24
#: Lists of so many rows are compared whole: at most 3.5 pairs a row.
SHORT = 8
#: Heads of a list, by its key; members of a group's main component that rows left apart from it meet.
LEADERS = 3
HEADS = 3
SCAN_WEIGHT = 2.0
#: Input rows whose share of the intermediate tables goes to one task: with shingles, some 100 MB for long texts.
TASK_ROWS = 1 << 14
MAX_BOUNDARY = 64


def needed(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def prefix(n: int, c: int, percent: int = PERCENT) -> int:
    return min(n, n - needed(n, percent) + c)


def choose_boundary(sizes: list[tuple[int, int]], percent: int = PERCENT) -> int:
    """The size up to which sets enumerate 2-subsets, by the rows emitted and the lists scanned."""

    def subsets(n):
        p = prefix(n, 2, percent)
        return p * (p - 1) / 2

    def cost(b):
        light = sum(k * subsets(n) for n, k in sizes if n <= b)
        return light + SCAN_WEIGHT * sum(k * prefix(n, 1, percent) for n, k in sizes if n >= needed(b + 1, percent) and n > 0)

    return min(range(1, MAX_BOUNDARY + 1), key=lambda b: (cost(b), b))


def set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _longs(a) -> pa.Array:
    return pa.array(a, pa.int64())


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's counts over a power of two of cells, 4n to 8n of them, as 64-bit words.

    Two sketches of one width differ in no more cells than their sets in
    shingles; the halves of a sketch, combined by exclusive or, are the
    sketch of half the width.
    """
    words = max(1, 1 << (-(-4 * len(s) // 64) - 1).bit_length())
    cell = s & np.uint64(64 * words - 1)
    odd = np.bincount(cell.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def pack_counts(c: np.ndarray) -> bytes:
    """Counts byte plane by byte plane: the upper ones are mostly zero."""
    return zlib.compress(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_counts(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _class_rows(by_row: bool):
    names = ["doc_id", "set_id", "n", "sketch", "task", "slice", "counts", *(["text_key"] if by_row else [])]
    shift = np.uint64(64 - RARITY_BITS)

    def run(batches):
        """(doc_id, set_id, n, sketch) of each row, and its text_key if by_row; then the task's counts of shingle cells, in slices."""
        count = np.zeros(1 << RARITY_BITS, np.uint32)
        for b in parts(batches):
            n, key, sketches = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for i, s in shingle_sets(b.column("text")):
                n[i] = len(s)
                if len(s):
                    key[i], sketches[i] = set_key(s), sketch(s)
                    np.add.at(count, (s >> shift).astype(np.int64), 1)
            none = pa.nulls(b.num_rows, pa.int64())
            out = [b.column("doc_id"), _longs(key), _longs(n), pa.array(sketches, pa.list_(pa.int64())), none, none, pa.nulls(b.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*out, *([b.column("text_key")] if by_row else [])], names=names)
        cells = count.reshape(-1, SLICE_CELLS)
        some = np.flatnonzero(cells.any(1))
        none = pa.nulls(len(some), pa.int64())
        out = [none, none, none, pa.nulls(len(some), pa.list_(pa.int64())), _longs(np.full(len(some), TaskContext.get().partitionId())), _longs(some), pa.array([pack_counts(cells[k]) for k in some], pa.binary())]
        yield pa.RecordBatch.from_arrays([*out, *([none] if by_row else [])], names=names)

    return run


def _add_counts(t: pa.Table) -> pa.Table:
    """One row: the sum of the packed counts of a slice (at most FAN of them), which stay below 2^32."""
    total = np.zeros(SLICE_CELLS, np.uint64)
    for c in t.column("counts"):
        total += unpack_counts(c.as_py())
    return pa.table({"task": _longs([t.column("task")[0].as_py() // FAN]), "slice": t.column("slice")[:1], "counts": pa.array([pack_counts(np.minimum(total, 2**32 - 1))], pa.binary())})


def count_cells(slices: DataFrame) -> np.ndarray:
    """The counts of all tasks' slices (task, slice, counts), added FAN tasks at a time; the driver gets 4 bytes a cell."""
    last = slices.agg(F.max("task")).first()[0]
    out = np.zeros((1 << RARITY_BITS) // SLICE_CELLS * SLICE_CELLS, np.uint32).reshape(-1, SLICE_CELLS)
    while last is not None:
        slices = slices.groupBy(F.floor(F.col("task") / FAN).alias("_part"), F.col("slice").alias("_slice")).applyInArrow(_add_counts, "task long, slice long, counts binary")
        last //= FAN
        if last == 0:
            t = slices.toArrow()
            for k, c in zip(t.column("slice").to_pylist(), t.column("counts"), strict=True):
                out[k] = unpack_counts(c.as_py())
            break
    return out.reshape(-1)


def _posting_rows(rarity: Broadcast, boundary: int, percent: int):
    shift = np.uint64(64 - RARITY_BITS)
    both_from = needed(boundary + 1, percent)

    def run(batches):
        times = rarity.value
        for b in parts(batches):
            keys, ids = [], []
            for _, s in shingle_sets(b.column("text")):
                n = len(s)
                if n < 2:  # links with equal sets only
                    continue
                ranked = s[np.argsort(times[(s >> shift).astype(np.int64)], kind="stable")]
                out = []
                if n <= boundary:
                    p = np.sort(ranked[: prefix(n, 2, percent)])
                    i, j = np.triu_indices(len(p), 1)
                    out.append(mix(mix(p[i]) + p[j]))
                if n >= both_from:
                    out.append(ranked[: prefix(n, 1, percent)])
                k = np.concatenate(out)
                keys.append(k)
                ids.append(np.full(len(k), set_key(s)))
            if keys:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(keys).view(np.int64)), _longs(np.concatenate(ids))], names=["key", "set_id"])

    return run


def _set_rows(batches):
    """The sets of some rows, each once per batch."""
    for b in parts(batches):
        found = {set_key(s): s.view(np.int64) for _, s in shingle_sets(b.column("text")) if len(s) > 1}
        if found:
            yield pa.RecordBatch.from_arrays([_longs(list(found)), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["set_id", "shingles"])


def _differing(x: Column, y: Column) -> Column:
    """Cells in which two sketches differ, at the width of the narrower one. Close sizes are at most one doubling apart; others count as equal."""
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2 + 1).cast("int"), (F.size(c) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    count = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    return F.when(F.size(x) == F.size(y), count(x, y)).when(F.size(x) == 2 * F.size(y), count(half(x), y)).when(2 * F.size(x) == F.size(y), count(x, half(y))).otherwise(0)


def _close(a: Column, b: Column, percent: int) -> Column:
    """The size bound: only these sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


class JaccardJoin:
    """The join over one table; members: (doc_id, set_id, n) of its rows.

    by_row: members have text_key too, and known has the winner of each set's component and the rows of the set.
    """

    def __init__(self, docs: DataFrame, percent: int = PERCENT, leaders: int = LEADERS, heads: int = HEADS, by_row: bool = False):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([_text_key().alias("text_key")] if by_row else []))
        self.percent, self.leaders, self.heads, self.by_row = percent, leaders, heads, by_row
        self.spark, self.tasks = docs.sparkSession, 0
        small_batches(self.spark)
        self.temporary: dict[str, list[str]] = {}

    def _few(self, df: DataFrame) -> DataFrame:
        """df in as many tasks as the input's rows ask for, where a session deals more shuffle partitions than that."""
        return df.coalesce(self.tasks) if self.tasks else df

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        out, path = stored(df, f"jaccard-{label}")
        self.temporary.setdefault(label, []).append(path)
        return out

    def _drop(self, *labels: str) -> None:
        """Remove tables that nothing reads any more, so that disk holds those of the present step."""
        discard(*(path for x in labels for path in self.temporary.pop(x, ())))

    def _classes(self):
        got = self._keep(self.docs.mapInArrow(_class_rows(self.by_row), f"doc_id long, set_id long, n long, sketch array<long>, task long, slice long, counts binary{', text_key long' if self.by_row else ''}"), "classes")
        self.members = got.where("n is not null").select("doc_id", *(["text_key"] if self.by_row else []), "set_id", "n")
        self.tasks = -(-self.members.count() // TASK_ROWS)
        times = count_cells(got.where("slice is not null").select("task", "slice", "counts"))
        sizes = self.members.where("n > 1").groupBy("n").count().where(f"n <= {2 * MAX_BOUNDARY}").collect()
        self.boundary = choose_boundary([(r.n, r["count"]) for r in sizes], self.percent)
        first = lambda c: F.first(c).alias(c)
        best = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"), F.count("*").alias("rows")] if self.by_row else []
        self.sets = self._keep(self._few(got.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("low"), first("n"), first("sketch"), *best)), "sets")
        return self.spark.sparkContext.broadcast(times)

    def _lists(self, rarity):
        """(a, b) of the pairs of lists with SHORT rows at most; and (key, set_id, leader) of the longer lists.

        The least and the greatest member come with the one aggregation that all
        postings pass. They're all of a list of two; for longer lists, a bitmap of
        their keys, of a fixed size, holds most other postings back from the join.
        """
        # a bitmap of a fixed size holds most of the equal sets' other rows back
        firsts = self._keep(self._few(bitmap(self.sets, "low")), "firsts")
        docs = maybe_in(firsts, self.docs, "doc_id", "_maybe").where("_maybe or doc_id is null").select("text")
        p = self._keep(docs.mapInArrow(_posting_rows(rarity, self.boundary, self.percent), "key long, set_id long"), "postings")
        turn = lambda c: self._turn(c, self.leaders)
        heads = p.groupBy("key").agg(F.min(turn("set_id")).alias("low"), F.max(turn("set_id")).alias("high"), F.count("*").alias("k")).where("low <> high")
        heads = self._keep(self._few(heads.select("key", turn("low").alias("leader"), turn("high").alias("other"), "k")), "heads")
        long = heads.where("k > 2").select("key", "leader", "k")
        bits = self._keep(self._few(bitmap(long, "key", LIST_BITS)), "list-bits")
        lists = maybe_in(bits, p, "key", "_maybe", LIST_BITS).where("_maybe").select("key", "set_id").join(long, "key")
        lists = self._keep(self._few(self._few(lists).distinct()), "members")
        twos = heads.where("k = 2").select(F.greatest("leader", "other").alias("a"), F.least("leader", "other").alias("b"))
        m = self._few(lists.where(F.col("k") <= SHORT).groupBy("key").agg(F.collect_list("set_id").alias("m")))
        pair = lambda x, y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(SHORT)), lambda y: pair(x, y))))
        lists_ = lists.where(F.col("k") > SHORT).drop("k")
        first = twos.unionByName(m.select(F.explode(pairs).alias("e")).select("e.*")).unionByName(lists_.where("leader <> set_id").select(*_ordered("leader", "set_id")))
        first = self._keep(self._few(first.distinct()), "pairs")
        self._drop("firsts", "postings", "heads", "list-bits")
        return first, lists_

    def _shingles(self, ids: DataFrame) -> DataFrame:
        """set_id, shingles of these sets, and of a few others: only rows that may hold one of the sets are cut again, by a bitmap of their smallest doc_ids."""
        bits = self._keep(self._few(bitmap(self._few(self.sets.join(ids, "set_id", "left_semi")), "low")), "wanted")
        docs = maybe_in(bits, self.docs, "doc_id", "_maybe").where("_maybe or doc_id is null").select("text")
        return self._keep(self._few(docs.mapInArrow(_set_rows, "set_id long, shingles array<long>").groupBy("set_id").agg(F.first("shingles").alias("shingles"))), "shingles")

    def _tested(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with bounds of their Jaccard distance (low, high) and whether they link.

        Sizes and sketches bound the distance from below; only pairs that could still link meet with their sets, and their distance is exact.
        """
        side = lambda c: self.sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        both = self._few(self._few(pairs.join(side("a"), "a")).join(side("b"), "b"))
        apart = F.greatest(_differing(F.col("s_a"), F.col("s_b")).cast("long"), F.abs(F.col("n_a") - F.col("n_b")))
        bound = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("s"), apart.alias("h"))
        bound = self._keep(bound.select("a", "b", (2 * F.col("h") / (F.col("s") + F.col("h"))).alias("low"), ((F.col("s") - F.col("h")) * 100 >= (F.col("s") + F.col("h")) * self.percent).alias("may")), "bound")
        sets = self._shingles(self._few(bound.where("may").select(F.explode(F.array("a", "b")).alias("set_id")).distinct()))
        left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
        got = self._few(self._few(bound.where("may").select("a", "b").join(left, "a")).join(right, "b")).select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
        d = 1 - F.col("i") / (F.col("s") - F.col("i"))
        got = got.select("a", "b", d.alias("low"), d.alias("high"), (F.col("i") * 100 >= (F.col("s") - F.col("i")) * self.percent).alias("near"))
        out = self._keep(bound.where("not may").select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("near")).unionByName(got), "tested")
        self._drop("bound", "wanted", "shingles")
        return out

    def _turn(self, c: str, salts: int, start: int = 0) -> Column:
        """A bijection of set ids that depends on the list, so that different lists favour different members; its own inverse."""
        values = F.array(*(F.lit((0x5851F42D4C957F2D * (i + start)) & 0x7FFFFFFFFFFFFFFF).cast("long") for i in range(salts)))
        return F.col(c).bitwiseXOR(F.element_at(values, (F.pmod("key", F.lit(salts)) + 1).cast("int")))

    def _placed(self, lists: DataFrame, node: DataFrame):
        """The lists with the component of each member; of those with several components (key, main, all, most): the largest one; how many these are; and the pairs of its members with others."""
        self._drop("placed", "main")
        placed = self._keep(self._few(lists.join(node.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))), "placed")
        by = self._few(placed.groupBy("key", "component").agg(F.count("*").alias("k")))
        main = by.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("all"), F.max("k").alias("most"))
        main = self._keep(self._few(main.where("parts > 1").select("key", "main", "all", "most")), "main")
        return placed, main, *main.agg(F.count("*"), F.coalesce(F.sum(F.expr("(all - most) * (most - 1)")), F.lit(0))).first()

    def _with_heads(self, placed: DataFrame, main: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of what a group's main component leaves apart with some of its members, chosen by the list."""
        of_main = self._few(placed.join(main.select("key", F.col("main").alias("component")), ["key", "component"]))
        starts = [8 * k for k in range(1, self.heads + 1)]
        heads = of_main.groupBy("key").agg(*(F.min(self._turn("set_id", 8, k)).alias(f"h{k}") for k in starts)).select("key", F.explode(F.array_distinct(F.array(*(self._turn(f"h{k}", 8, k) for k in starts)))).alias("head"))
        few = self._few(placed.join(main, "key").where("component <> main").select("key", "set_id", "n"))
        more = self._few(few.join(heads, "key")).join(self.sets.select(F.col("set_id").alias("head"), F.col("n").alias("n_head")), "head").where(_close(F.col("n"), F.col("n_head"), self.percent))
        return self._few(self._few(more.select(*_ordered("set_id", "head")).where("a <> b")).distinct())

    def _joined(self, node: DataFrame, links: DataFrame) -> DataFrame:
        """The components once more links hold: those found so far are stars, so few rounds remain."""
        out, path = components(node.toDF("src", "dst").unionByName(links.toDF("src", "dst")), "jaccard-cc", tasks=self.tasks or None)
        self._drop("cc")
        self.temporary["cc"] = [path]
        return out

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        rarity = self._classes()
        first, lists = self._lists(rarity)
        rarity.unpersist()
        tested = self._tested(first)
        self._drop("pairs")
        none = self.spark.createDataFrame([], "node long, component long")
        node = self._joined(none, tested.where("near").select("a", "b"))
        far = tested.select("a", "b", "low", "high")
        lists = self._few(self._few(lists.select("*", *_ordered("leader", "set_id")).join(far, ["a", "b"], "left")).join(self.sets.select("set_id", "n"), "set_id"))
        head = F.col("leader") == F.col("set_id")
        lists = lists.select("key", "leader", "set_id", "n", F.when(head, 0.0).otherwise(F.col("low")).alias("low"), F.when(head, 0.0).otherwise(F.col("high")).alias("high"))
        lists = self._keep(self._few(self._grouped(self._keep(lists, "lists"))), "groups")
        self._drop("members", "lists")

        rows = lists.count()
        placed, main, several, work = self._placed(lists, node)
        if several and work > ROUND_COST * rows:
            # much is left apart from a large component of its group: it meets other members of that component
            new = self._tested(self._with_heads(placed, main)).where("near").select("a", "b")
            if not new.isEmpty():
                node = self._joined(node, new)
                placed, main, several, _ = self._placed(lists, node)
        if several:
            # all that could still link across components
            pairs = self._keep(self._late_pairs(placed, main), "pairs")
            new = None if pairs.isEmpty() else self._tested(pairs).where("near").select("a", "b")
            if new is not None and not new.isEmpty():
                node = self._joined(node, new)
        least = self._few(self.sets.drop("n", "sketch").join(node.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
        top = least.groupBy("component").agg(F.min("low").alias("component_id"), *([F.min("best").alias("winner")] if self.by_row else []))
        self.known = self._keep(self._few(least.join(top, "component")).select("set_id", "component_id", *(["winner", "rows"] if self.by_row else [])), "result")
        out = self.members.join(self.known, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        self._drop(*(x for x in list(self.temporary) if x not in ("classes", "result")))
        return out

    def _grouped(self, lists: DataFrame) -> DataFrame:
        """The lists (key, leader, set_id, n, low, high) as groups whose members meet: (key, set_id, n, low, high).

        Lists of one leader that hold nearly the same members would let a pair
        meet once a list, so they become one group where the leader's distinct
        members squared are no more than the sum of its lists' lengths squared;
        elsewhere each list is a group. Groups that a hash joins only meet more.
        """
        size = lists.groupBy("key").agg(F.count("*").alias("k"))
        rows = lists.join(size, "key")
        members = rows.groupBy("leader", "set_id").agg(F.sum("k").alias("met")).groupBy("leader").agg(F.count("*").alias("d"), F.sum("met").alias("met"))
        whole = members.where("d * d <= met").select("leader", F.lit(True).alias("whole"))
        group = F.when(F.col("whole"), F.xxhash64(F.lit(True), "leader")).otherwise(F.xxhash64(F.lit(False), "key"))
        return lists.join(whole, "leader", "left").select(group.alias("key"), "set_id", "n", "low", "high").distinct()

    def _late_pairs(self, placed: DataFrame, main: DataFrame) -> DataFrame:
        """Pairs of a group outside its main component, with all members of other components that sizes, sketches and bounds allow.

        A group's rows are dealt to a grid of cells of about CELL_ROWS rows a side, so that a long list is many tasks' work.
        """
        side = F.ceil(F.sqrt(F.col("all") / CELL_ROWS)).cast("int")
        rows = placed.join(main.select("key", "main", side.alias("side")), "key").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("side")).cast("int"))
        rows = self._few(self._few(rows).join(self.sets.select("set_id", "sketch"), "set_id"))
        every = F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other")
        few = rows.where("component <> main").select("*", every).select("key", (F.col("own") * F.col("side") + F.col("other")).alias("cell"), *(F.col(c).alias(f"{c}_p") for c in ("set_id", "n", "component", "low", "high", "sketch")))
        all_ = rows.select("*", every).select("key", (F.col("other") * F.col("side") + F.col("own")).alias("cell"), "set_id", "n", "component", "low", "high", "sketch")
        link = 1 - self.percent / 100 + 1e-9
        reach = (F.col("low") - F.col("high_p") <= link) & (F.col("low_p") - F.col("high") <= link)
        apart = F.col("component") != F.col("component_p")
        s, h = F.col("n") + F.col("n_p"), _differing(F.col("sketch"), F.col("sketch_p"))
        may = apart & _close(F.col("n"), F.col("n_p"), self.percent) & reach & ((s - h) * 100 >= (s + h) * self.percent)
        return self._few(self._few(few.join(all_, ["key", "cell"]).where(may).select(*_ordered("set_id_p", "set_id"))).distinct())


def _ordered(p: str, q: str) -> tuple[Column, Column]:
    return F.greatest(p, q).alias("a"), F.least(p, q).alias("b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    return JaccardJoin(docs, percent).run()


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id, a null being the greatest, and of these with the least hash of the text.

    Rows that repeat id and text are one group, also without words; other rows
    without words all stay. A doc_id with two texts is judged for each text.

    Most rows are settled by a bitmap of the dropped rows, of a fixed size; only rows that hit it are shuffled.
    """
    join = JaccardJoin(docs, percent, by_row=True)
    join.run()
    row = ["doc_id", "text_key"]
    placed = join.members.where("n > 0").join(join.known, "set_id")
    wins = F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("text_key") == F.col("winner.text_key"))
    # a row that stays can be repeated only where several rows have its set
    some, _ = stored(placed.select(*row, wins.alias("wins"), "rows").where("not wins or rows > 1").drop("rows").unionByName(join.members.where("n = 0").select(*row, F.lit(True).alias("wins"))), "jaccard-some")
    drop = some.where("not wins").select(*row).distinct()
    again, _ = stored(some.where("wins").groupBy(*row).count().where("count > 1").select(*row), "jaccard-again")
    drop, _ = stored(drop.unionByName(again), "jaccard-drop")
    own = {"_id": F.col("doc_id").cast("long"), "_key": _text_key()}
    both = lambda: F.xxhash64("_id", "_key")
    known = lambda df: df.select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))
    marked = docs.withColumns(own).withColumn("_row", both())
    bits = lambda df, label: stored(bitmap(df.select(F.xxhash64(*row).alias("_row")), "_row"), label)[0]
    seen = maybe_in(bits(drop, "jaccard-bits"), marked, "_row", "_maybe")
    out = seen.where("not _maybe").unionByName(seen.where("_maybe").join(known(drop), same, "left_anti")).select(*docs.columns)
    if again.isEmpty():
        return out
    # rows with one id and text come together by a partial aggregation, so many copies are no hot task
    rows = maybe_in(bits(again, "jaccard-again-bits"), marked, "_row", "_maybe").where("_maybe")
    one = rows.groupBy("_id", "_key").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("one"))
    return out.unionByName(one.join(known(again), same, "left_semi").select("one.*"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
