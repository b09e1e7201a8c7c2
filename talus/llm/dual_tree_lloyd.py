"""Centroid clustering: Lloyd's rounds by a dual-tree search, with exact integers.

Vectors are dealt to chunks of CHUNK rows, and each chunk holds a cover tree,
built once and stored: a node's points lie within reach of its first point, its
children's first points are more than half the node's scale apart, and points
are ordered so that a node is a slice. A round makes a cover tree of the
centroids and walks both trees: a pair of nodes is dropped once its least
distance exceeds what some centroid surely offers every point of the vectors'
node. A node with one centroid left belongs to it whole; leaves are compared
exactly. Rounds move counts and sums per task and centroid, never vectors, so a
common vector or a cluster with most rows is no hot task.

Defined cases: a vector that is null, has another length, or holds a null or
non-finite component takes no part and has no row; components beyond +-2^21
count as +-2^21, so that a squared distance fits a long; repeated rows each
count and each have a row; a null vec_id takes part but comes last as a first
centroid; among equal hashes the least vector comes first; with fewer vectors
than centroids there are as many centroids as vectors; an empty table gives no
rows; sums of distances beyond a long are null. Only vec_id and embedding are
read, so other columns never clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored

CENTROIDS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
#: Components keep to this bound, in units of 1 / SCALE.
MOST = 1 << 27
CHUNK = 2_048
LEAF = 16
#: Pairs of a point and a centroid compared at a time.
BLOCK = 1 << 15
#: Bounds are doubles of exact integers; this relative slack covers their rounding.
SLACK = 1e-9

_CHUNK_DDL = "ids array<long>, points binary, width int, first array<int>, last array<int>, reach array<double>, kids array<int>, kids_end array<int>"


class CoverTree:
    """A cover tree of the rows of an integer matrix.

    Node i holds points[first[i]:last[i]], all within reach[i] of the first of
    them; its children are the nodes kids[i] to kids_end[i], none for a leaf.
    order tells the given row of each point.
    """

    def __init__(self, points, order, first, last, reach, kids, kids_end):
        self.points, self.order = points, order
        self.first, self.last, self.reach, self.kids, self.kids_end = first, last, reach, kids, kids_end

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        n = len(points)
        every = np.arange(n)
        nodes = [[every, _distances(points, points[0]), 0, 0]] if n else []
        at = 0
        while at < len(nodes):
            rows, away, _, _ = nodes[at]
            reach = float(away.max())
            nodes[at][2] = nodes[at][3] = len(nodes)
            if len(rows) > leaf and reach > 0:
                # the scale is the power of two from reach on; half of it leaves two children at least
                kids = _covered(points, rows, away, 2.0 ** (np.ceil(np.log2(reach)) - 1))
                if len(kids) < len(rows) or leaf == 1:  # points all apart stay together in a leaf
                    nodes += [[r, d, 0, 0] for r, d in kids]
                    nodes[at][3] = len(nodes)
            at += 1
        first, last = np.zeros(len(nodes), np.int32), np.zeros(len(nodes), np.int32)
        order = every.copy()
        for i, (rows, _, a, b) in enumerate(nodes):  # parents come before their children
            if i == 0:
                last[0] = n
            else:
                last[i] += first[i]
            order[first[i] : last[i]] = rows
            start = first[i]
            for k in range(a, b):
                first[k], last[k] = start, len(nodes[k][0])
                start += len(nodes[k][0])
        reach = np.array([float(x[1].max()) for x in nodes])
        ends = np.array([x[2:] for x in nodes], np.int32).reshape(-1, 2)
        return cls(points[order], order, first, last, reach, ends[:, 0], ends[:, 1])

    def is_leaf(self, nodes: np.ndarray) -> np.ndarray:
        return self.kids[nodes] == self.kids_end[nodes]


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(points - to).astype(np.float64))


def _squares(diff: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", diff, diff)


def _covered(points, rows, away, scale):
    """Rows as children: each takes what is within scale of its first row and not yet taken; the node's first row is the first child's."""
    out = []
    while len(rows):
        d = away if not out else _distances(points[rows], points[rows[0]])
        near = d <= scale
        out.append((rows[near], d[near]))
        rows = rows[~near]
    return out


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and the range each comes from."""
    size = last - first
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner], owner


class Nearest:
    """The nearest centroid of every point of a tree; compared counts distances taken. Of equal centroids only the first can be nearest."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.compared = centroids, 0
        number = np.sort(np.unique(centroids, axis=0, return_index=True)[1])
        self.tree = CoverTree.build(centroids[number], 1)
        self.tree.order = number[self.tree.order]

    def assign(self, t: CoverTree) -> np.ndarray:
        out = np.zeros(len(t.points), np.int32)
        c = self.tree
        v, w = np.zeros(min(len(t.points), 1), np.int64), np.zeros(min(len(t.points), 1), np.int64)
        while len(v):  # pairs of nodes, those of one v side by side
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            sizes = np.diff(np.r_[starts, len(v)])
            d = np.sqrt(_squares(t.points[t.first[v]] - c.points[c.first[w]]).astype(np.float64))
            self.compared += len(v)
            sure = np.repeat(np.minimum.reduceat(d, starts), sizes) + t.reach[v]
            keep = d - t.reach[v] - c.reach[w] <= sure * (1 + SLACK) + SLACK
            v, w = v[keep], w[keep]
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            sizes = np.diff(np.r_[starts, len(v)])
            single = c.last[w] - c.first[w] == 1
            whole = (sizes == 1) & single[starts]
            for node, number in zip(v[starts[whole]], c.order[c.first[w[starts[whole]]]], strict=True):
                out[t.first[node] : t.last[node]] = number
            leaf = t.is_leaf(v)
            flat = np.logical_and.reduceat(single, starts) & leaf[starts] & ~whole
            for a, b in _blocks(starts[flat], sizes[flat], (t.last - t.first)[v[starts[flat]]]):
                self._compare(t, v[a], w[a], b, out)
            # the coarser side of what is left is opened; a leaf waits until its centroids are single ones
            open_ = ~np.repeat(whole | flat, sizes)
            wide = np.repeat(np.maximum.reduceat(np.where(single, -1.0, c.reach[w]), starts), sizes)
            down = open_ & ~leaf & (wide < t.reach[v])
            kept_v, kept_w = [], []
            side = open_ & ~down
            if side.any():
                # a single centroid stays as it is; others give their children
                a, b = np.where(single[side], w[side], c.kids[w[side]]), np.where(single[side], w[side] + 1, c.kids_end[w[side]])
                into, owner = _spans(a, b)
                kept_v.append(v[side][owner])
                kept_w.append(into)
            if down.any():
                into, owner = _spans(t.kids[v[down]], t.kids_end[v[down]])
                order = np.argsort(into, kind="stable")
                kept_v.append(into[order])
                kept_w.append(w[down][owner][order])
            v = np.concatenate(kept_v) if kept_v else np.zeros(0, np.int64)
            w = np.concatenate(kept_w) if kept_w else np.zeros(0, np.int64)
        return out

    def _compare(self, t, v, w, sizes, out) -> None:
        """Every point of some leaves with all centroids left to its leaf."""
        starts = np.cumsum(sizes) - sizes
        point, leaf = _spans(t.first[v[starts]], t.last[v[starts]])
        pair, owner = _spans(starts[leaf], starts[leaf] + sizes[leaf])
        number = self.tree.order[self.tree.first[w[pair]]]
        d = _squares(t.points[point[owner]] - self.centroids[number])
        self.compared += len(d)
        begin = np.cumsum(sizes[leaf]) - sizes[leaf]
        least = np.repeat(np.minimum.reduceat(d, begin), sizes[leaf])
        out[point] = np.minimum.reduceat(np.where(d == least, number, len(self.centroids)), begin)


def _blocks(starts, sizes, points):
    """The pair numbers of some leaves at a time, about BLOCK comparisons each, and how many each leaf has."""
    if not len(starts):
        return
    turn = np.cumsum(sizes * points) // BLOCK
    for k in np.unique(turn):
        some = turn == k
        yield _spans(starts[some], starts[some] + sizes[some])[0], sizes[some]


def _chunk_row(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
    t = CoverTree.build(points)
    top = int(np.abs(points).max())
    width = 2 if top < 1 << 15 else 4
    lists = [pa.array([x], pa.list_(pa.int32())) for x in (t.first, t.last)]
    kids = [pa.array([x], pa.list_(pa.int32())) for x in (t.kids, t.kids_end)]
    columns = [pa.array([ids.take(pa.array(t.order)).to_pylist()], pa.list_(pa.int64())), pa.array([t.points.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()), *lists, pa.array([t.reach], pa.list_(pa.float64())), *kids]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _CHUNK_DDL.split(", ")])


def _trees(size: int):
    def run(batches):
        ids, rows, have = [], [], 0
        for b in batches:
            points = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
            at = 0
            while at < b.num_rows:
                take = min(size - have, b.num_rows - at)
                ids.append(b.column("vec_id").slice(at, take))
                rows.append(points[at : at + take])
                have, at = have + take, at + take
                if have == size:
                    yield _chunk_row(pa.concat_arrays(ids), np.concatenate(rows))
                    ids, rows, have = [], [], 0
        if have:
            yield _chunk_row(pa.concat_arrays(ids), np.concatenate(rows))

    return run


def _read(b: pa.RecordBatch, dimensions: int):
    """(ids, tree) of each chunk."""
    for r in range(b.num_rows):
        x = {name: b.column(name)[r] for name in b.schema.names}
        points = np.frombuffer(x["points"].as_buffer(), f"<i{x['width'].as_py()}").reshape(-1, dimensions).astype(np.int64)
        yield x["ids"].values, CoverTree(points, None, *(np.asarray(x[k].values) for k in ("first", "last", "reach", "kids", "kids_end")))


def _sums(shared, dimensions: int):
    def run(batches):
        """Per task: each centroid's count and sums of components."""
        near = Nearest(shared.value)
        k = len(near.centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for b in batches:
            for _, t in _read(b, dimensions):
                c = near.assign(t)
                count += np.bincount(c, minlength=k)
                order = np.argsort(c, kind="stable")
                some = np.unique(c)
                total[some] += np.add.reduceat(t.points[order], np.searchsorted(c[order], some), axis=0)
        some = np.flatnonzero(count)
        dim = np.tile(np.arange(dimensions), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dimensions), pa.int64()), pa.array(dim, pa.int64()), pa.array(np.repeat(count[some], dimensions), pa.int64()), pa.array(total[some].ravel(), pa.int64())], names=["cluster", "dim", "n", "total"])

    return run


def _rows(shared, dimensions: int):
    def run(batches):
        near = Nearest(shared.value)
        for b in batches:
            for ids, t in _read(b, dimensions):
                c = near.assign(t)
                d = _squares(t.points - near.centroids[c])
                yield pa.RecordBatch.from_arrays([ids, pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def whole_vectors(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as integers, of the vectors that take part."""
    fit = F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long")
    return df.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors with the least hashes of their ids, in that order: k rows at most."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in kept.orderBy(h.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; an empty one stays. The driver gets a row per centroid and component."""
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)
    got = chunks.mapInArrow(_sums(shared, centroids.shape[1]), "cluster long, dim long, n long, total long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out = centroids.copy()
    for r in got.groupBy("cluster", "dim").agg(exact("n"), exact("total")).collect():
        out[r.cluster, r.dim] = int(r.total) // int(r.n)
    shared.destroy()
    return out


def cluster_vectors(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector, and the final centroids."""
    spark = df.sparkSession
    kept = whole_vectors(df, dimensions, scale)
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), centroids
    chunks, path = stored(kept.mapInArrow(_trees(chunk), _CHUNK_DDL), "cover-trees")
    for _ in range(rounds):
        centroids = moved(chunks, centroids)
    shared = spark.sparkContext.broadcast(centroids)
    rows, _ = stored(chunks.mapInArrow(_rows(shared, dimensions), "vec_id long, cluster int, distance long"), "clusters")
    discard(path)
    own = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # at most k rows
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(c, fits(d), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in own.items()]
    schema = T.StructType.fromDDL("cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")  # at most k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _assigned(k: str, of: str) -> str:
    """CTE: each kept vector's nearest centroid of the table `of`, ties to the smaller number."""
    return f"""{k} as (select row_no, vec_id, v, unnest(arg_min(struct_pack(cluster := n, distance := d), d * 64 + n, 1)) as best from (
  select row_no, vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d from kept, {of}) group by row_no, vec_id, v)"""


def _sql() -> str:
    """Three rounds over exact integers, written out."""
    parts = [
        f"""kept as (select row_number() over () as row_no, vec_id, list_transform(embedding, lambda x: floor(x::double * {SCALE})::bigint) as v from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSIONS})""",
        f"c0 as (select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int as n, v as c from kept order by sha256('1:' || vec_id), v limit {CENTROIDS})",
    ]
    for r in range(ROUNDS):
        parts += [
            _assigned(f"a{r}", f"c{r}"),
            f"s{r} as (select best.cluster as n, i, sum(v[i]) as s, count(*) as m from a{r}, range(1, {DIMENSIONS + 1}) t(i) group by all)",
            f"m{r} as (select n, list(((s - ((s % m) + m) % m) // m)::bigint order by i) as c from s{r} group by n)",
            f"c{r + 1} as (select c{r}.n, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (n))",
        ]
    parts.append(_assigned("last", f"c{ROUNDS}"))
    return "with " + ",\n".join(parts) + f"""
select vec_id, best.cluster as cluster, best.distance as distance, (sum(best.distance) over (partition by best.cluster))::bigint as cluster_inertia,
  (sum(best.distance) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from last join c{ROUNDS} on c{ROUNDS}.n = best.cluster"""


OP13_SQL = _sql()
