"""Dependency graphs as edge tables (src, dst): degrees, reachability, components and cycles.

Searches run in rounds, each round's rows written to the shared folder and
joined with the edges; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources.scratch import discard, stored, tidied

#: Pairs of twice the distance are made while their paths are at most so many times the edges, or so few.
MOST_PATHS, FEW_PATHS = 2, 1 << 16
#: Fixed value: walks are cut down to the nodes still asked for while that removes more than this share of them.
LEAST_CUT = 0.1


def page_edges(pages: DataFrame) -> DataFrame:
    """Distinct links from a page's URL to its href targets."""
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"#]+)"'), F.lit(1))))
    return pages.select(F.col("url").alias("src"), href.alias("dst")).where("src is not null").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in, complexity (their product). Both counts come from one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    got = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return got.withColumn("complexity", F.col("n_out") * F.col("n_in"))


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path from src to dst. Path lengths double every round, so rounds grow with the logarithm of the longest.

    The result has a row for every pair, which may be the square of the nodes: ask reach() from the roots that matter instead.
    """
    now, path = stored(edges.select("src", "dst").distinct(), "closure")
    n = now.count()
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        new, new_path = stored(now.unionByName(step).distinct(), "closure")
        discard(edges.sparkSession, path)
        now, path = new, new_path
        if (m := now.count()) == n:
            return now
        n = m


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _most_paths(edges: DataFrame) -> int:
    return max(FEW_PATHS, MOST_PATHS * edges.count())


def _single(pairs: DataFrame) -> bool:
    """Whether no node has two pairs as src, or none has two as dst: then pairs of any distance are no more than these, and each comes once."""
    with tidied(pairs.sparkSession):
        most = degrees(pairs).agg(F.max("n_out"), F.max("n_in")).first()
    return min(most[0] or 0, most[1] or 0) <= 1


def _twice(step: DataFrame, most: int, label: str, single: bool = False) -> tuple[DataFrame, str] | None:
    """The pairs (src, dst) twice as many edges apart as those of step; None if more than most paths lead to them, which isn't asked of single ones."""
    if not single:
        with tidied(step.sparkSession):
            paths = degrees(step).agg(F.sum("complexity")).first()[0] or 0
        if paths > most:
            return None
    a, b = step.toDF("src", "_at"), step.toDF("_at", "dst")
    pairs = a.join(b, "_at").select("src", "dst")
    return stored(pairs if single else pairs.distinct(), label)


def reach(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """root, node, depth: what each root reaches, itself at depth 0, by the fewest edges.

    roots has a column root. Rounds double the depth while the pairs of nodes
    that lie a whole step apart stay about as many as the edges, as on chains,
    trees and rings: there rounds grow with the logarithm of the greatest depth.
    A node that roots reach in a step or more ends such a pair itself, so pairs
    from nodes neither reached nor at the end of one are dropped, if edges are many.
    Where paths branch more, a round joins the newest pairs alone with the
    edges and keeps those not seen before, so rows made are bounded by the
    edges that leave reached nodes.
    Null roots and edges with a null end are left out; repeated ones add nothing.
    """
    spark = edges.sparkSession
    edges, edges_path = stored(_clean(edges), "reach-edges")
    first = roots.select("root").where("root is not null").distinct()
    seen, path = stored(first.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "reach")
    most, n = _most_paths(edges), seen.count()
    # seen are the pairs fewer than span edges apart, step the nodes exactly span apart
    span, step, step_path, cut, single = 1, edges, edges_path, most > FEW_PATHS, False
    while most_depth is None or span <= most_depth:
        if cut:
            asked = seen.select("node").union(step.select("dst")).distinct()
            some, some_path = stored(step.join(asked, step.src == asked.node, "left_semi"), "reach-asked")
            cut = some.count() < (1 - LEAST_CUT) * step.count()
            discard(spark, *{step_path} - {edges_path})
            step, step_path = some, some_path
            single = single or _single(step)
        far = seen.join(step, seen.node == step.src).select("root", F.col("dst").alias("node"), (F.col("depth") + span).alias("depth"))
        if most_depth is not None:
            far = far.where(F.col("depth") <= most_depth)
        new, new_path = stored(seen.unionByName(far).groupBy("root", "node").agg(F.min("depth").alias("depth")), "reach")
        discard(spark, path)
        seen, path, m = new, new_path, new.count()
        span *= 2
        if m == n:
            discard(spark, *{step_path, edges_path})
            return seen
        n, twice = m, _twice(step, most, "reach-step", single)
        if twice is None:
            break
        discard(spark, *{step_path} - {edges_path})
        step, step_path = twice
    depth, paths = span - 1, [path]
    new = seen.where(F.col("depth") == depth)
    while most_depth is None or depth < most_depth:
        depth += 1
        ahead = new.join(edges, new.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        new, path = stored(ahead.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if new.isEmpty():
            discard(spark, path)
            break
        paths.append(path)
        seen = spark.read.schema(seen.schema).parquet(*paths)
    discard(spark, *{step_path, edges_path})
    return seen


def dependents(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """root, node, depth: the nodes from which each root is reached."""
    return reach(reversed_edges(edges), roots, most_depth)


def _hash(node: Column) -> Column:
    return F.xxhash64(node)


def coded(edges: DataFrame, roots: DataFrame, deps: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """edges and roots (root, name) with a 64-bit number for each node of text; the nodes (id, node) and their path.

    Searches shuffle nodes round after round, and numbers are a fraction of a
    path's bytes. Numbers are hashes; if two nodes share one, or nodes are no
    texts, nodes stand for themselves. deps: the nodes' sorted direct dependencies too.
    """
    spark, edges = edges.sparkSession, edges.select("src", "dst").where("src is not null and dst is not null")
    code = _hash if dict(edges.dtypes)["src"] == "string" else lambda node: node
    roots = roots.select("root").where("root is not null")
    none = F.lit(None).cast(edges.schema["dst"].dataType)
    end = lambda node, dep: F.struct(F.col(node).alias("node"), dep.alias("dep"))
    ends = edges.select(F.explode(F.array(end("src", F.col("dst")), end("dst", none))).alias("e")).select("e.*").unionByName(roots.select(F.col("root").alias("node"), none.alias("dep")))
    nodes = ends.groupBy("node").agg(F.sort_array(F.collect_set("dep")).alias("deps")) if deps else ends.select("node").distinct()
    nodes, path = stored(nodes, "graph-nodes")
    if code is _hash:
        with tidied(spark):
            shared = not nodes.groupBy(code(F.col("node")).alias("id")).count().where("count > 1").isEmpty()
        if shared:
            code = lambda node: node
    nodes = nodes.select(code(F.col("node")).alias("id"), *nodes.columns)
    return edges.select(code(F.col("src")).alias("src"), code(F.col("dst")).alias("dst")), roots.select(code(F.col("root")).alias("root"), F.col("root").alias("name")).distinct(), nodes, path


def trees(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, deps: each node that a root reaches with its sorted direct dependencies, none for a leaf."""
    numbers, starts, nodes, _ = coded(edges, roots, deps=True)
    seen = reach(numbers, starts).select("root", F.col("node").alias("id"))
    return seen.join(starts, "root").join(nodes, "id").select(F.col("name").alias("root"), "node", "deps")


def impact(edges: DataFrame, changed: DataFrame, n_nodes: int) -> DataFrame:
    """node, n_direct, n_transitive, impact: for each changed node (column root) the nodes that depend on it, itself aside, and their share of all nodes in per cent, half to even."""
    numbers, starts, _, path = coded(edges, changed)
    discard(edges.sparkSession, path)
    # a root's own row, at depth 0, is in its group
    hit = dependents(numbers, starts).groupBy("root").agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_direct"), F.count(F.when(F.col("depth") > 0, 1)).alias("n_transitive"))
    got = hit.join(starts, "root").select(F.col("name").alias("node"), "n_direct", "n_transitive")
    return got.withColumn("impact", F.bround(100 * F.col("n_transitive") / F.lit(max(n_nodes, 1)), 2))


def _trimmed(edges: DataFrame, label: str) -> tuple[DataFrame, str, int]:
    """edges without those at nodes that none or no other edge leaves or enters.

    Rounds ask for paths of twice the length while those stay few; then for one
    more edge, while a round removes a twentieth of the edges or more.
    """
    spark = edges.sparkSession
    now, path = stored(edges, label)
    step, most, n = now, _most_paths(now), now.count()
    held, double = [], True
    while n:
        core = step.select(F.col("dst").alias("_n")).intersect(step.select(F.col("src").alias("_n")))
        inner = lambda e, core=core: e.join(core, F.col("src") == F.col("_n"), "left_semi").join(core, F.col("dst") == F.col("_n"), "left_semi")
        new, new_path = stored(inner(now), label)
        m = new.count()
        done = m == n if double else n - m < max(n // 20, 1)
        if double and m and not done:
            some, some_path = (new, new_path) if step is now else stored(inner(step), "trim-inner")
            twice = _twice(some, most, "trim-step")
            discard(spark, *held, *({some_path} - {new_path}))
            double, held = twice is not None, [twice[1]] if twice else []
        step = twice[0] if double and m and not done else new
        discard(spark, path)
        now, path, n = new, new_path, m
        if done:
            break
    discard(spark, *held)
    return now, path, n


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: the nodes that reach themselves, with the smallest node of their strongly connected component.

    A round trims nodes that can lie on no cycle; gives every node the smallest
    node that reaches it, as its colour; and walks back from each colour's own
    node inside the colour: what it meets is that node's component. Edges inside
    one colour that touch no settled node go to the next round; edges between
    colours lie on no cycle. Only labels move, so a component of any size stays
    a distributed table.
    """
    spark = edges.sparkSession
    whole = _clean(edges)
    loops = whole.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found_paths = []
    empty = whole.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    now, path, n = _trimmed(whole.where("src <> dst"), "scc-edges")
    while n:
        colour, colour_path = _least_before(now)
        ends = now.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").where("c = d").select("src", "dst", "c")
        ends, ends_path = stored(ends, "scc-inside")
        # a colour's own node that an edge enters inside the colour lies on a cycle with all that lead to it
        own = ends.where("dst = c").select(F.col("c").alias("root"))
        met, met_path = stored(dependents(ends, own).select("node", F.col("root").alias("component")), "scc-found")
        found_paths.append(met_path)
        rest = ends.join(met.select(F.col("node").alias("src")), "src", "left_anti").join(met.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        new, new_path, m = _trimmed(rest, "scc-edges")
        discard(spark, path, colour_path, ends_path)
        now, path, n = new, new_path, m
    discard(spark, path)
    out = spark.read.schema(empty.schema).parquet(*found_paths) if found_paths else empty
    return out.unionByName(loops.join(out.select("node"), "node", "left_anti"))


def _least_before(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, colour): the least node from which a node is reached.

    A round looks twice as many edges back as the one before while such pairs
    stay few, and asks the colour's own node for its colour, so that paths shorten.
    """
    spark = edges.sparkSession
    step, held, most = edges, [], _most_paths(edges)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now, path = stored(ends.withColumn("colour", F.col("node")), "scc-colour")
    double = True
    while True:
        over = step.join(now, step.src == now.node).select(F.col("dst").alias("node"), "colour")
        least = over.groupBy("node").agg(F.min("colour").alias("new"))
        moved = now.join(least, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", F.coalesce("new", "colour")).alias("colour"))
        # what reaches the node of my colour reaches me
        jump = moved.select(F.col("node").alias("_c"), F.col("colour").alias("further"))
        moved = moved.join(jump, F.col("colour") == F.col("_c"), "left").select("node", "old", F.least("colour", F.coalesce("further", "colour")).alias("colour"))
        new, new_path = stored(moved, "scc-colour")
        changed = not new.where("colour <> old").isEmpty()
        discard(spark, path)
        now, path = new.select("node", "colour"), new_path
        if not changed:
            discard(spark, *held)
            return now, path
        if double and (twice := _twice(step, most, "scc-step")):
            discard(spark, *held)
            step, held = twice[0], [twice[1]]
        else:
            double = False


def cycles(edges: DataFrame) -> DataFrame:
    """component, position, node: of each strongly connected component the shortest cycle through its smallest node.

    The cycle starts at that node with position 0. Of equally short cycles it
    is the one whose last node is the smallest, then the one before, and so on.
    """
    spark = edges.sparkSession
    whole, whole_path = stored(_clean(edges), "cycle-graph")
    part, part_path = stored(strong_components(whole), "cycle-parts")
    both = whole.join(part.toDF("src", "component"), "src").join(part.toDF("dst", "_d"), "dst").where("component = _d").select("component", "src", "dst")
    inside, inside_path = stored(both, "cycle-edges")
    # forward from the smallest nodes, each in its own component
    ahead, ahead_path = stored(reach(inside, inside.select(F.col("component").alias("root"))).select("node", "depth"), "cycle-depths")
    ends = inside.where("dst = component").join(ahead.toDF("src", "depth"), "src")
    last = ends.groupBy("component").agg(F.min(F.struct("depth", "src")).alias("last")).select("component", F.col("last.src").alias("root"))
    # backward: before each node comes the smallest one that is a step nearer to the start
    near = inside.join(ahead.toDF("src", "depth"), "src").join(ahead.toDF("dst", "_depth"), "dst").where("depth = _depth - 1")
    before = near.groupBy("dst").agg(F.min("src").alias("src")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = reach(before, last).select("root", "node").join(last, "root").join(ahead, "node")
    out, _ = stored(back.select("component", F.col("depth").alias("position"), "node"), "cycles")
    discard(spark, whole_path, part_path, inside_path, ahead_path)
    return out


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each supplier nation to every other nation whose customers have line items of it."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    li = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.where("s_nationkey <> c_nationkey").select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
