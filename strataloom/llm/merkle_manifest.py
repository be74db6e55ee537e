"""Merkle manifest of a table: a tree for each group, a root over the groups' subroots, a proof for each row.

Rows are leaves in the order of their group and id. A range shuffle numbers them; blocks of arity^b consecutive leaves of a
tree are whole subtrees (the last of a tree may hold fewer). Nodes of blocks meet in a sparse forest, an associative monoid:
it holds unresolved nodes by tree, level and index, and as the number of leaves of each tree is known, so is how many nodes a
run of siblings has; whenever a run is complete it becomes its parent. Each partition makes one forest of its nodes, and
treeReduce merges them. The nodes that a merge has resolved stay in the forest's spine, from which each block gets its path
to the root; the leaves of a block make the rest of their paths themselves. Subroots are the leaves of one more tree.

Sizes: a block holds at most max(1,024, rows / 131,072 rounded up to a power of the arity) leaves, so there are at most
131,072 blocks that are not the only one of their tree, and the forest has at most twice as many nodes, some 50 MB. The
driver also holds a row for each range (at most 20,000). Nothing else leaves the executors.

Defined results: a null value is written as "-"; null groups and null ids come first; rows that repeat a group and id are
ordered by their leaf's hash, and equal rows are leaves of their own; a null id is not tampered with; an empty table gives
an empty result. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ARITY = 2
LEAST_BLOCK = 1_024
MOST_BLOCKS = 1 << 17
RANGE_ROWS = 200_000
MOST_RANGES = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """A value as it enters a leaf: its number of UTF-8 bytes, a colon, itself; null: a minus."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(written, values)).cast("binary"), 256))


def parent(children: Iterable[bytes]) -> bytes:
    """SHA-256 of the children's lowercase hex digests."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def levels(leaves: list[bytes], arity: int, depth: int | None) -> list[list[bytes]]:
    """The nodes over consecutive leaves, level by level: depth levels up, or until one node is left."""
    out = [leaves]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        out.append([parent(out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


class Forest:
    """Unresolved nodes of trees whose numbers of leaves are known. merged() is associative and commutative."""

    def __init__(self, arity: int):
        self.arity = arity
        self.open: dict[tuple[int, int, int], bytes] = {}
        self.width: dict[int, int] = {}
        self.roots: dict[int, bytes] = {}
        #: Every node of a run that was completed here.
        self.spine: dict[tuple[int, int, int], bytes] = {}

    def wide(self, tree: int, level: int) -> int:
        """How many nodes a tree has on a level."""
        return -(-self.width[tree] // self.arity**level)

    def run(self, tree: int, level: int, index: int) -> range:
        """The indices of a node and its siblings."""
        first = index - index % self.arity
        return range(first, min(first + self.arity, self.wide(tree, level)))

    def add(self, tree: int, width: int, level: int, index: int, digest: bytes) -> None:
        """Puts a node in and resolves every run that it completes. width: of the tree's level 0."""
        self.width[tree] = width
        self.open[tree, level, index] = digest
        while True:
            if self.wide(tree, level) == 1:
                self.roots[tree] = self.open.pop((tree, level, index))
                return
            keys = [(tree, level, k) for k in self.run(tree, level, index)]
            if not all(k in self.open for k in keys):
                return
            nodes = [self.open.pop(k) for k in keys]
            self.spine.update(zip(keys, nodes, strict=True))
            level, index = level + 1, index // self.arity
            self.open[tree, level, index] = parent(nodes)

    def merged(self, other: Forest) -> Forest:
        small, large = sorted((self, other), key=lambda f: len(f.open) + len(f.spine))
        large.spine.update(small.spine)
        large.roots.update(small.roots)
        for (tree, level, index), digest in small.open.items():
            large.add(tree, small.width[tree], level, index, digest)
        large.width.update(small.width)
        return large

    def path(self, tree: int, index: int) -> bytes:
        """The siblings of a resolved node of level 0 up to its tree's root, packed by packed_run."""
        out, level = [], 0
        while self.wide(tree, level) > 1:
            own = self.run(tree, level, index)
            out.append(packed_run([self.spine[tree, level, k] for k in own], index - own[0]))
            level, index = level + 1, index // self.arity
        return b"".join(out)


def packed_run(nodes: list[bytes], at: int) -> bytes:
    """The siblings before and after one node of a run: their numbers, a byte each, and their digests."""
    return bytes([at, len(nodes) - at - 1]) + b"".join(nodes[:at]) + b"".join(nodes[at + 1 :])


def runs_of(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(path):
        before, after = path[at], path[at + 1]
        nodes = [path[k : k + 32] for k in range(at + 2, at + 2 + 32 * (before + after), 32)]
        yield nodes[:before], nodes[before:]
        at += 2 + 32 * (before + after)


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in runs_of(path):
        leaf = parent([*before, leaf, *after])
    return leaf


def siblings_hash(path: bytes) -> bytes:
    return parent(n for before, after in runs_of(path) for n in (*before, *after))


def block_depth(rows: int, arity: int) -> int:
    """b of the blocks of arity^b leaves."""
    depth = 1
    while arity**depth < max(LEAST_BLOCK, -(-rows // MOST_BLOCKS)):
        depth += 1
    return depth


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """rows (group, id, leaf, nonce, ...) with tree, the rank of the group, and index, the rank within it.

    Rows are dealt by ranges and sorted; each range counts the groups that begin in it and the rows of each. From one row a
    range the driver adds up where each range's first group has its rank and its first index.
    """
    spark = rows.sparkSession
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS)))
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf", "nonce"]
    sorted_rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, part int, segment long, place long"

    def run(batches):
        part, segment, place, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            segments, places = [], []
            for group in batch.column("group").to_pylist():
                if segment < 0 or group != last:
                    segment, place, last = segment + 1, 0, group
                segments.append(segment)
                places.append(place)
                place += 1
            more = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(segments, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "segment", "place"])

    placed = common.saved(sorted_rows.mapInArrow(run, schema), "leaves")
    ends = placed.groupBy("part").agg(F.min(F.struct("segment", "group")).alias("first"), F.max(F.struct("segment", "place", "group")).alias("last"))
    tree, index, group, bases = -1, 0, None, []
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        goes_on = tree >= 0 and r["first"]["group"] == group
        bases.append((r["part"], tree + (not goes_on), index if goes_on else 0))
        tree, group = bases[-1][1] + r["last"]["segment"], r["last"]["group"]
        index = r["last"]["place"] + 1 + (bases[-1][2] if r["last"]["segment"] == 0 else 0)
    found = placed.join(F.broadcast(spark.createDataFrame(bases, "part int, base_tree long, base_index long")), "part")
    own = F.col("place") + F.when(F.col("segment") == 0, F.col("base_index")).otherwise(0)
    return found.select(*rows.columns, (F.col("base_tree") + F.col("segment")).alias("tree"), own.alias("index"))


def tree_paths(leaves: DataFrame, depth: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """Of leaves (tree, index, leaf): tree, subroot of each tree; and tree, block, alone, path of each block to its tree's root.

    alone: the block is the whole tree. Such trees are done inside their block; the nodes of all other blocks go to the forest.
    """
    spark, block = leaves.sparkSession, arity**depth
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("leaves"))
    marked = leaves.select("tree", "index", "leaf", F.floor(F.col("index") / F.lit(block)).cast("long").alias("block"))

    def nodes_of(table: pa.Table) -> pa.Table:
        """A block's node on level depth; of the block a tree begins with also the node it has if it is the whole tree."""
        held = table.sort_by("index")
        own, first = held["leaf"].to_pylist(), held["block"][0].as_py() == 0
        return pa.table({"tree": [held["tree"][0].as_py()], "block": [held["block"][0].as_py()], "node": [levels(own, arity, depth)[-1][0]], "whole": pa.array([levels(own, arity, None)[-1][0] if first else None], pa.binary())})

    made = marked.groupBy("tree", "block").applyInArrow(nodes_of, "tree long, block long, node binary, whole binary")
    nodes = common.saved(made.join(sizes, "tree").withColumn("width", F.ceil(F.col("leaves") / F.lit(block)).cast("long")), "nodes")

    def forest(rows):
        out = Forest(arity)
        for r in rows:
            out.add(r["tree"], r["width"], 0, r["block"], bytes(r["node"]))
        yield out

    many = nodes.where(F.col("width") > 1).select("tree", "width", "block", "node")
    fragments = many.rdd.mapPartitions(forest)
    whole = fragments.treeReduce(Forest.merged, depth=2 if fragments.getNumPartitions() < 1_000 else 3) if fragments.getNumPartitions() else Forest(arity)
    resolved = spark.createDataFrame(list(whole.roots.items()), "tree long, subroot binary")
    alone = nodes.where(F.col("width") == 1).select("tree", F.col("whole").alias("subroot"))
    shared = spark.sparkContext.broadcast(whole)

    def paths_of(batches):
        for batch in batches:
            trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
            found = [shared.value.path(t, b) if t in shared.value.roots else b"" for t, b in zip(trees, blocks, strict=True)]
            yield pa.record_batch({"tree": batch.column("tree"), "block": batch.column("block"), "alone": pa.array([t not in shared.value.roots for t in trees]), "path": pa.array(found, pa.binary())})

    paths = nodes.select("tree", "block").mapInArrow(paths_of, "tree long, block long, alone boolean, path binary")
    return common.saved(alone.unionByName(resolved), "subroots"), paths


def local_paths(leaves: list[bytes], depth: int | None, arity: int) -> list[bytes]:
    """Of each leaf of a block the siblings inside it."""
    made, out = levels(leaves, arity, depth), []
    for k in range(len(leaves)):
        parts, at = [], k
        for level in made[:-1]:
            first = at - at % arity
            parts.append(packed_run(level[first : first + arity], at - first))
            at //= arity
        out.append(b"".join(parts))
    return out


def proofs(rows: DataFrame, total: int, arity: int = ARITY) -> DataFrame:
    """id, leaf, shown of rows (group, id, leaf, nonce, shown), with subroot, root, path, siblings and shown_root.

    path holds the siblings of a leaf, level by level (runs_of reads it), siblings is their hash; shown_root is what shown,
    the leaf presented, gives with them.
    """
    depth = block_depth(total, arity)
    block = F.floor(F.col("index") / F.lit(arity**depth)).cast("long").alias("block")
    leaves = common.saved(numbered(rows, total), "numbered")
    subroots, own = tree_paths(leaves, depth, arity)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("subroot").alias("leaf"))
    root, upper = tree_paths(tops, depth, arity)

    def top_paths(left: pa.Table, right: pa.Table) -> pa.Table:
        held, over = left.sort_by("index"), right.to_pylist()[0]
        found = [p + over["path"] for p in local_paths(held["leaf"].to_pylist(), None if over["alone"] else depth, arity)]
        return pa.table({"tree": held["index"], "subroot": held["leaf"], "over": pa.array(found, pa.binary())})

    by_block = tops.withColumn("block", block).groupBy("tree", "block")
    over = by_block.cogroup(upper.groupBy("tree", "block")).applyInArrow(top_paths, "tree long, subroot binary, over binary")
    full = own.join(over, "tree")
    top = root.first()  # of one tree, so one row; none if there are no rows at all
    schema = "id long, leaf binary, shown binary, subroot binary, root binary, path binary, siblings binary, shown_root binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held, up = left.sort_by("index"), right.to_pylist()[0]
        paths = [p + up["path"] + up["over"] for p in local_paths(held["leaf"].to_pylist(), None if up["alone"] else depth, arity)]
        shown = held["shown"].to_pylist()
        roots = [folded(leaf, path) for leaf, path in zip(shown, paths, strict=True)]
        made = {"subroot": [up["subroot"]] * len(paths), "root": [bytes(top["subroot"])] * len(paths), "path": paths, "siblings": list(map(siblings_hash, paths)), "shown_root": roots}
        return pa.table({c: held[c] for c in ("id", "leaf", "shown")} | {c: pa.array(v, pa.binary()) for c, v in made.items()})

    own_block = leaves.select("tree", "index", "id", "leaf", "shown", block).groupBy("tree", "block")
    return own_block.cogroup(full.groupBy("tree", "block")).applyInArrow(run, schema)


def tampered(docs: DataFrame) -> Column:
    """Which rows are tampered with to try the manifest: those where 7 divides the CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """id, leaf, shown, subroot, root, path, siblings, shown_root of each document; shown is the leaf of the row as presented, tampered with or not."""
    one_more = F.when(tampered(docs), F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    shown = [one_more if c == "n_chars" else F.col(c) for c in FIELDS]
    leaf = leaf_hash(F.col(c) for c in FIELDS)
    other = F.when(tampered(docs), leaf_hash(shown)).otherwise(leaf)
    made = docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("id"), leaf.alias("leaf"), other.alias("shown"), F.monotonically_increasing_id().alias("nonce"))
    rows = common.saved(made, "hashed")
    return proofs(rows, rows.count(), arity)
