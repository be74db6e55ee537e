"""The dependency multigraph as edges (src, dst), and queries on it.

Duplicate edges count in degrees, never in reachability. Iterative queries keep one row for each (source, node) reached, join
the frontier with the edges each round, and write every round to the shared folder, so plans stay small and a lost executor
costs a round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import joined, merged, saved

#: Edges that one task, or the driver for a broadcast, takes at most: some 32 MB. Larger graphs go by rounds of joins.
LOCAL_EDGES = 2_000_000
#: Bytes of the bitmaps of a block of targets, and targets in a block at most.
BITMAP_BYTES, BLOCK_TARGETS = 64 << 20, 4_096
#: Edges that a task takes of parts of a graph that do not hang together.
BIN_EDGES = 200_000


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """node, consumers, dependencies (of the multigraph), distinct_consumers: every node, 0 without edges."""
    all_nodes = nodes(edges) if all_nodes is None else all_nodes
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("consumers"), F.countDistinct("src").alias("distinct_consumers"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("dependencies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_nodes.join(into, "node", "left").join(out, "node", "left").select("node", zero("consumers"), zero("dependencies"), zero("distinct_consumers"))


def reverse(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """node, consumers: the list of sources, repeats kept, in order; every node, [] without."""
    lists = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("src")).alias("consumers"))
    return all_nodes.join(lists, "node", "left").withColumn("consumers", F.coalesce("consumers", F.array().cast(lists.schema["consumers"].dataType)))


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """start, node, level: what each start (column start) reaches along edges, with its least level; the start itself is left out.

    One shuffle a round on the frontier's node; the reached pairs are anti-joined, so a cycle ends. depth None: until nothing is new.
    """
    links = saved(edges.select("src", "dst").distinct(), "links")
    reached = saved(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("level")).distinct(), "starts")
    frontier, all_levels, level = reached, [reached], 0
    while depth is None or level < depth:
        level += 1
        step = links.join(joined(frontier.select("start", F.col("node").alias("src"))), "src").select("start", F.col("dst").alias("node")).distinct()
        before = all_levels[0]
        for more in all_levels[1:]:
            before = before.unionByName(more)
        fresh = saved(step.join(merged(before.select("start", "node")), ["start", "node"], "left_anti").withColumn("level", F.lit(level)), "frontier")
        if not fresh.limit(1).count():
            break
        frontier = fresh
        all_levels.append(fresh)
        if len(all_levels) > 8:
            whole = all_levels[0]
            for more in all_levels[1:]:
                whole = whole.unionByName(more)
            all_levels = [saved(whole, "reached")]
    out = all_levels[0]
    for more in all_levels[1:]:
        out = out.unionByName(more)
    return out.where("level > 0").select("start", "node", "level")


def impact(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """Who is affected by a change: reverse reachability to a depth from 1 to 10."""
    return reach(start, flipped(edges), min(10, max(1, depth)))


def closure(edges: DataFrame) -> DataFrame:
    """start, node: all pairs joined by a path of one edge or more. Paths double each round, so rounds are the logarithm of the longest."""
    pairs = saved(edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct(), "closure")
    count = pairs.count()
    while True:
        longer = pairs.select("start", F.col("node").alias("mid")).join(pairs.select(F.col("start").alias("mid"), "node"), "mid").select("start", "node")
        pairs = saved(pairs.union(longer).distinct(), "closure")
        now = pairs.count()
        if now == count:
            return pairs
        count = now


def closure_counts(edges: DataFrame) -> DataFrame:
    """node, transitive_dependencies, transitive_dependents: sizes of the closures, the node itself left out.

    Components are made nodes of a graph without cycles, of which every edge leads to a lower level. Where it has at most
    LOCAL_EDGES edges all tasks get it, and each takes a block of targets: one bit for each of them at every node, passed up
    level by level, so there is no row for a pair. Larger graphs are cut into the parts that do not hang together, and a task
    does the same for a bin of them; only a part of more than LOCAL_EDGES edges goes by the closure of pairs.
    """
    once = saved(edges.select("src", "dst").distinct(), "once")
    if once.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        own, rest = pieces(once)
        out = local_closures(own)
        return out if rest.isEmpty() else out.unionByName(_closure_counts(rest))
    return _closure_counts(once)


def local_closures(edges: DataFrame) -> DataFrame:
    """node, transitive_dependencies, transitive_dependents of each bin of parts (src, dst, bin), a task for each."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        names, ends = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
        k = len(ends) // 2
        part = part_numbers(ends[:k], ends[k:], len(names))
        of = component_numbers(ends[:k], ends[k:], len(names))
        size = np.bincount(of)
        part_of = np.zeros(len(size), np.int64)
        part_of[of] = part
        links = np.unique(np.stack([of[ends[:k]], of[ends[k:]]]), axis=1)
        src, dst = links[:, links[0] != links[1]]
        counts = [counted_by_parts(x, y, size, part_of)[of] + size[of] - 1 for x, y in ((src, dst), (dst, src))]
        return pa.table({"node": pa.array(names, table.schema.field("src").type), "transitive_dependencies": pa.array(counts[0], pa.int64()), "transitive_dependents": pa.array(counts[1], pa.int64())})

    return edges.groupBy("bin").applyInArrow(run, f"node {kind}, transitive_dependencies long, transitive_dependents long")


def part_numbers(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """A number for each node, the same for nodes that edges join, whatever their direction: the least that neighbours have is taken over, and its own."""
    least = np.arange(n)
    while True:
        now = least.copy()
        low = np.minimum(least[src], least[dst])
        for at in (src, dst, least[src], least[dst]):
            np.minimum.at(now, at, low)
        now = now[now]
        if (now == least).all():
            return np.unique(least, return_inverse=True)[1]
        least = now


def counted_by_parts(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The weight of what each node of an acyclic graph reaches, itself left out: bitmaps of blocks of targets, which parts share, as none reaches another's."""
    n, total = len(weight), np.zeros(len(weight), np.int64)
    order = np.argsort(part, kind="stable")
    counts = np.bincount(part)
    spot = np.empty(n, np.int64)
    spot[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    level = levels(src, dst, n)
    order = np.lexsort((src, level[src]))
    src, dst = src[order], dst[order]
    block = int(min(BLOCK_TARGETS, max(64, BITMAP_BYTES * 8 // max(1, n) // 64 * 64)))
    for first in range(0, int(counts.max(initial=0)), block):
        wide = counts[part] > first
        place = np.cumsum(wide) - 1
        kept = wide[src]
        a, b, at = place[src[kept]], place[dst[kept]], np.flatnonzero(wide)
        width = min(block, int(counts.max()) - first)
        bits = np.zeros((len(at), -(-width // 64)), np.uint64)
        own = np.flatnonzero((spot[at] >= first) & (spot[at] < first + block))
        word, bit = (spot[at[own]] - first) // 64, ((spot[at[own]] - first) % 64).astype(np.uint64)
        bits[own, word] = np.uint64(1) << bit
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        steps = np.append(np.flatnonzero(np.concatenate([[True], np.diff(level[at[a[cuts]]]) != 0])), len(cuts)) if len(a) else np.zeros(1, np.int64)
        for k in range(len(steps) - 1):
            x, y = steps[k], steps[k + 1]
            begin, end = cuts[x], cuts[y] if y < len(cuts) else len(a)
            bits[a[cuts[x:y]]] |= np.bitwise_or.reduceat(bits[b[begin:end]], cuts[x:y] - begin, axis=0)
        total[at] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        # What targets weigh above one each: they are as many as the larger components are.
        held = own[weight[at[own]] > 1]
        if len(held):
            heavy = np.zeros((int(part.max()) + 1, width), np.int64)
            heavy[part[at[held]], spot[at[held]] - first] = weight[at[held]] - 1
            for k in np.flatnonzero(heavy.any(axis=0)):
                total[at] += ((bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64) * heavy[part[at], k]
    return total - weight


def _closure_counts(edges: DataFrame) -> DataFrame:
    all_nodes = nodes(edges)
    components = saved(all_nodes.join(strong_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    sizes = saved(components.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    a, b = (components.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("src", "a"), ("dst", "b")))
    links = saved(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("a != b").select("a", "b").distinct(), "links")
    if links.count() > LOCAL_EDGES or sizes.count() > LOCAL_EDGES:
        return _pair_counts(edges, all_nodes)
    ranked = saved(sizes.withColumn("rank", F.monotonically_increasing_id()), "ranked")
    found = ranked.select("component", "rank").toArrow()
    place = {r: k for k, r in enumerate(found["rank"].to_pylist())}
    ends = links.join(ranked.select(F.col("component").alias("a"), F.col("rank").alias("x")), "a").join(ranked.select(F.col("component").alias("b"), F.col("rank").alias("y")), "b").select("x", "y").toArrow()
    index = lambda c: np.array([place[r] for r in ends[c].to_pylist()], np.int64)
    size = np.array(ranked.select("rank", "size").toArrow().sort_by("rank")["size"].to_pylist(), np.int64)
    order = np.argsort(np.array(found["rank"].to_pylist(), np.int64), kind="stable")  # size is by rank, as places are not
    weight = np.empty(len(place), np.int64)
    weight[order] = size
    out = ranked.select("rank", "component", "size")
    for name, x, y in (("transitive_dependencies", "x", "y"), ("transitive_dependents", "y", "x")):
        counted = reached_counts(edges.sparkSession, index(x), index(y), weight)
        ids = edges.sparkSession.createDataFrame(pa.table({"place": pa.array(range(len(place)), pa.int64()), "rank": found["rank"].cast(pa.int64())}))
        out = out.join(counted.join(ids, "place").select("rank", F.col("n").alias(name)), "rank", "left")
    each = lambda c: (F.coalesce(c, F.lit(0)) + F.col("size") - 1).cast("long").alias(c)
    return components.join(out, "component").select("node", each("transitive_dependencies"), each("transitive_dependents"))


def reached_counts(spark, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> DataFrame:
    """place, n: the weight of what each node of an acyclic graph reaches, itself left out. Nodes are numbered; a node that reaches nothing may be missing."""
    level = levels(src, dst, len(weight))
    order = np.lexsort((src, level[src]))
    shared = spark.sparkContext.broadcast((src[order], dst[order], level, weight))
    block = int(min(BLOCK_TARGETS, max(64, BITMAP_BYTES * 8 // max(1, len(weight)) // 64 * 64)))
    starts = spark.range(0, len(weight), block, max(1, min(4_096, -(-len(weight) // block))))

    def run(batches) -> Iterator[pa.RecordBatch]:
        src, dst, level, weight = shared.value
        cuts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, np.int64)
        heads = src[cuts]
        bounds = np.append(np.flatnonzero(np.concatenate([[True], level[heads][1:] != level[heads][:-1]])), len(heads)) if len(heads) else np.zeros(1, np.int64)
        for batch in batches:
            for start in batch.column("id").to_pylist():
                own = np.arange(start, min(start + block, len(weight)))
                bits = np.zeros((len(weight), -(-len(own) // 64)), np.uint64)
                bits[own, (own - start) // 64] = np.uint64(1) << ((own - start) % 64).astype(np.uint64)
                for k in range(len(bounds) - 1):
                    first, last = bounds[k], bounds[k + 1]
                    at, to = cuts[first], cuts[last] if last < len(cuts) else len(src)
                    bits[heads[first:last]] |= np.bitwise_or.reduceat(bits[dst[at:to]], cuts[first:last] - at, axis=0)
                if (weight[own] == 1).all():
                    n = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                else:
                    n = sum(((bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64) * int(w) for k, w in enumerate(weight[own].tolist()))
                n[own] -= weight[own]
                some = np.flatnonzero(n)
                yield pa.record_batch({"place": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    return starts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def levels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Of each node of an acyclic graph the length of the longest path from it, by taking off, round after round, what leads nowhere."""
    out, left = np.zeros(n, np.int64), np.bincount(src, minlength=n)
    order = np.argsort(dst, kind="stable")
    back, starts = src[order], np.searchsorted(dst[order], np.arange(n + 1))
    ready, level = np.flatnonzero(left == 0), 0
    while len(ready):
        out[ready] = level
        sizes = starts[ready + 1] - starts[ready]
        spots = np.repeat(starts[ready] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        hit, counts = np.unique(back[spots], return_counts=True)
        left[hit] -= counts
        ready, level = hit[left[hit] == 0], level + 1
    return out


def _pair_counts(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    pairs = closure(edges).where("start != node")
    forward = pairs.groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("transitive_dependencies"))
    back = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("transitive_dependents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_nodes.join(forward, "node", "left").join(back, "node", "left").select("node", zero("transitive_dependencies"), zero("transitive_dependents"))


def trimmed(edges: DataFrame, enough: int = 0) -> DataFrame:
    """Edges that can lie on a cycle: nodes without an incoming or outgoing edge go, until none is left to go or at most enough edges are left.

    Most dependency graphs are nearly acyclic, so what components are looked for in afterwards is small.
    """
    rest = saved(edges.select("src", "dst").distinct(), "rest")
    count = rest.count()
    while count > enough:
        kept = rest.join(merged(rest.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").join(merged(rest.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        rest = saved(kept.select("src", "dst"), "rest")
        now = rest.count()
        if now == count:
            return rest
        count = now
    return rest


def weak_components(edges: DataFrame) -> DataFrame:
    """node, part (its least node): nodes that edges join, whatever their direction; self-loops count.

    By stars: each round hangs a node's larger neighbours on the least one, then its smaller ones, until nothing moves. A
    round keeps at most a row for each edge, and paths get shorter by a factor with each.
    """
    ends = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = saved(ends.where("u != v").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u != v").distinct()
        links = saved(small, "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    found = links.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct())
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("part"))
    return found.unionByName(alone).groupBy("node").agg(F.min("part").alias("part"))


def pieces(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src, dst, bin of edges (each once) whose part of the graph has at most LOCAL_EDGES edges, and the other edges.

    Edges of a part have the same bin, and bins are of about BIN_EDGES edges, or of a few larger parts.
    """
    parts = weak_components(edges)
    own = saved(edges.select("src", "dst").distinct().join(merged(parts.select(F.col("node").alias("src"), "part")), "src"), "parts")
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    total = own.count()
    large = saved(sizes.where(F.col("k") > LOCAL_EDGES).select("part"), "large")
    if large.isEmpty():
        rest = own.limit(0).select("src", "dst")
    else:
        rest = own.join(large, "part", "left_semi").select("src", "dst")
        own = own.join(large, "part", "left_anti")
    bins = max(1, -(-total // BIN_EDGES))
    return own.select("src", "dst", F.pmod(F.xxhash64("part"), F.lit(bins)).cast("int").alias("bin")), rest


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it): strongly connected components of two nodes or more, and self-loops.

    At most LOCAL_EDGES edges go to one task, however long the paths are. Larger graphs are cut into the parts that do not
    hang together, and a task takes a bin of them; only a part of more than LOCAL_EDGES edges goes by rounds.
    """
    once = saved(edges.select("src", "dst").distinct(), "once")
    if once.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return rounds_of_components(once)
    own, rest = pieces(once)
    return rounds_of_components(rest).unionByName(with_loops(once, [local_components(own.where("src != dst"))])).groupBy("node").agg(F.min("component").alias("component"))


def with_loops(edges: DataFrame, found: list[DataFrame]) -> DataFrame:
    """node, component of those found, and of self-loops that are in none of them."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    for own in found:
        loops = loops.unionByName(own)
    return loops.groupBy("node").agg(F.min("component").alias("component"))


def rounds_of_components(edges: DataFrame) -> DataFrame:
    """node, component as strong_components has them.

    Edges that cannot lie on a cycle are trimmed. As soon as at most LOCAL_EDGES edges are left one task finishes. Above that
    by colouring: each node takes the least node that reaches it as its colour, passed along edges until none changes; what
    the colour's own node is reached from, within the colour, is one component. Components found and edges between colours
    go, the rest is trimmed again. A round keeps one row for each node and one for each edge; no closure is made.
    """
    rest, found = trimmed(edges.where("src != dst"), LOCAL_EDGES), []
    while (left := rest.limit(LOCAL_EDGES + 1).count()) > LOCAL_EDGES:
        colours = least_reaching(rest)
        a, b = colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        inside = saved(rest.join(merged(a), "src").join(merged(b), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")), "inside")
        roots = colours.where("node = colour").select(F.col("node").alias("start"))
        back = reach_within(roots, inside)
        own = saved(back.join(merged(back.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "component").select("node", "component"), "component")
        found.append(own)
        gone = back.select("node")
        left = inside.join(merged(gone.select(F.col("node").alias("src"))), "src", "left_anti").join(merged(gone.select(F.col("node").alias("dst"))), "dst", "left_anti")
        rest = trimmed(left.select("src", "dst"), LOCAL_EDGES)
    if left:
        found.append(local_components(rest))
    return with_loops(edges, found)


def local_components(edges: DataFrame) -> DataFrame:
    """node, component of at most LOCAL_EDGES edges, in one task, or of each bin of parts (column bin) in one."""
    kind = edges.schema["src"].dataType

    def run(table: pa.Table) -> pa.Table:
        names, ends = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
        n = len(ends) // 2
        of = component_numbers(ends[:n], ends[n:], len(names))
        size, least = np.bincount(of), np.full(of.max(initial=-1) + 1, len(names))
        np.minimum.at(least, of, np.arange(len(names)))
        kept = np.flatnonzero(size[of] > 1)
        return pa.table({"node": pa.array(names[kept], table.schema.field("src").type), "component": pa.array(names[least[of[kept]]], table.schema.field("src").type)})

    binned = edges.select("src", "dst", F.col("bin") if "bin" in edges.columns else F.lit(0).alias("bin"))
    return binned.groupBy("bin").applyInArrow(run, f"node {kind.simpleString()}, component {kind.simpleString()}")


def component_numbers(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """A number for each node, the same for nodes that reach each other: one depth-first search with a stack of its own."""
    order = np.argsort(src, kind="stable")
    ahead, starts = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, of, path, count = [-1] * n, [0] * n, [-1] * n, [], 0
    parts = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        work = [(root, starts[root])]
        seen[root] = low[root] = count
        count += 1
        path.append(root)
        while work:
            node, at = work.pop()
            if at < starts[node + 1]:
                work.append((node, at + 1))
                to = ahead[at]
                if seen[to] < 0:
                    seen[to] = low[to] = count
                    count += 1
                    path.append(to)
                    work.append((to, starts[to]))
                elif of[to] < 0:
                    low[node] = min(low[node], seen[to])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == seen[node]:
                while of[node] < 0:
                    of[path.pop()] = parts
                parts += 1
    return np.array(of, np.int64)


def cycle_witnesses(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """component, cycle: for each component one shortest cycle through its least node, as the nodes from it round to it again.

    Of several the one that comes first by its nodes. Breadth-first search from the least nodes of all components at once,
    along edges inside them: a node keeps the first path of the least length to it, so there is a row for each node.
    """
    own = strong_components(edges) if components is None else components
    own = saved(own, "components")
    a, b = (own.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("src", "component"), ("dst", "other")))
    inside = saved(edges.select("src", "dst").distinct().join(merged(a), "src").join(merged(b), "dst").where("component = other").select("src", "dst", "component"), "inside")
    frontier = saved(own.where("node = component").select("component", "node", F.array("node").alias("path")), "frontier")
    seen, found = frontier.select("node"), []
    while frontier.limit(1).count():
        step = joined(frontier.select("component", F.col("node").alias("src"), "path")).join(merged(inside), ["component", "src"]).groupBy("component", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        step = saved(step, "step")
        found.append(step.where("node = component").select("component", F.col("path").alias("cycle")))
        done = step.where("node = component").select("component")
        frontier = saved(step.join(merged(done), "component", "left_anti").join(merged(seen), "node", "left_anti"), "frontier")
        seen = saved(seen.union(frontier.select("node")), "seen")
    out = found[0] if found else own.select("component", F.array("node").alias("cycle")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def least_reaching(edges: DataFrame) -> DataFrame:
    """node, colour: the least node from which a node can be reached, itself included."""
    colours = saved(nodes(edges).withColumn("colour", F.col("node")), "colours")
    while True:
        passed = edges.join(merged(colours.select(F.col("node").alias("src"), "colour")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("passed"))
        now = F.least("colour", "passed")
        colours = saved(colours.select("node", "colour").join(merged(passed), "node", "left").select("node", now.alias("colour"), (now < F.col("colour")).alias("moved")), "colours")
        if not colours.where("moved").limit(1).count():
            return colours.select("node", "colour")


def reach_within(roots: DataFrame, inside: DataFrame) -> DataFrame:
    """node, component: what reaches each root along edges (src, dst, colour) of its own colour, the root included; a node has one colour, so one row."""
    known = [roots.select(F.col("start").alias("node"), F.col("start").alias("component"))]
    frontier = known[0]
    while True:
        step = inside.join(merged(frontier.select(F.col("node").alias("dst"), "component")), "dst").where("colour = component").select(F.col("src").alias("node"), "component").distinct()
        for own in known:
            step = step.join(merged(own), "node", "left_anti")
        frontier = saved(step, "frontier")
        if not frontier.limit(1).count():
            out = known[0]
            for own in known[1:]:
                out = out.unionByName(own)
            return saved(out, "reached")
        known = [saved(known[0].unionByName(known[1]), "reached"), frontier] if len(known) > 1 else [*known, frontier]


def ego(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, hop: signed distance from one start, upstream (who depends on it) negative and preferred, the start 0."""
    up = impact(edges, start, depth).select("node", F.col("level").alias("up"))
    down = reach(start, edges, depth).select("node", F.col("level").alias("down"))
    both = up.join(down, "node", "full").select("node", F.coalesce(-F.col("up"), F.col("down")).alias("hop"))
    return both.unionByName(start.select(F.col("start").alias("node"), F.lit(0).alias("hop")))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among kept (column node). Repeats are counted before they are joined, so a task sorts one row for each pair of ends."""
    once = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = once.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    return own.select("src", "dst", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("src", "dst")


def visible(nodes: DataFrame, edges: DataFrame, least: float = 0.0, hidden: tuple[str, ...] = (), focus: str | None = None, depth: int = 1) -> DataFrame:
    """src, dst between the visible of nodes (node, domain, score).

    Without a focus those from a score on, outside hidden domains. With one its neighbours up to a depth either way, whatever
    their score, but for those in hidden domains; the focus itself always stays.
    """
    shown = ~F.col("domain").isin(*hidden) if hidden else F.lit(True)
    if focus is None:
        return induced(edges, nodes.where((F.col("score") >= least) & shown))
    start = nodes.where(F.col("node") == focus).select(F.col("node").alias("start"))
    near = ego(edges, start, depth).select("node").distinct()
    return induced(edges, near.join(nodes.where(shown | (F.col("node") == focus)), "node", "left_semi"))


def edge_directions(edges: DataFrame, hops: DataFrame, cyclic: DataFrame) -> DataFrame:
    """src, dst, direction (up, down, neutral), in_cycle (both ends are in some cycle) of the edges between nodes with hops."""
    a, b = hops.select(F.col("node").alias("src"), F.col("hop").alias("a")), hops.select(F.col("node").alias("dst"), F.col("hop").alias("b"))
    c = cyclic.select("node", F.lit(True).alias("cyclic"))
    near = edges.distinct().join(a, "src").join(b, "dst")
    out = near.join(merged(c.select(F.col("node").alias("src"), F.col("cyclic").alias("ca"))), "src", "left").join(merged(c.select(F.col("node").alias("dst"), F.col("cyclic").alias("cb"))), "dst", "left")
    direction = F.when((F.col("a") >= 0) & (F.col("b") > F.col("a")), "down").when((F.col("b") <= 0) & (F.col("a") < F.col("b")), "up").otherwise("neutral")
    return out.select("src", "dst", direction.alias("direction"), F.coalesce(F.col("ca") & F.col("cb"), F.lit(False)).alias("in_cycle"))


def neighbour_domains(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """node, domain, n: domains of a node's distinct neighbours on either side, unknown where a neighbour has none."""
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).unionByName(flipped(edges).select(F.col("src").alias("node"), F.col("dst").alias("near")))
    own = near.where("node != near").distinct().join(domains.select(F.col("node").alias("near"), "domain"), "near", "left")
    return own.groupBy("node", F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def with_replaced(edges: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """edges with those of the given files (column src) replaced by fresh ones."""
    return edges.join(files.select("src").distinct(), "src", "left_anti").select("src", "dst").unionByName(fresh.select("src", "dst"))
