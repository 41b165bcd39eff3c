"""Problem 7: parent-child links to full hierarchies.

Every partition of links builds a weighted disjoint-set forest: each node knows the root
of its local tree and the offset to it; a link that would close a circle stays open. The
local roots of one partition are inner nodes of others, so forests are then merged
hierarchically: where the root of a tree has a tree of its own, offsets add up, and each
merge doubles the reach. A row of a merge is three numbers, whatever the depth. While
some open node still ends at a root, the number of open nodes falls with each merge; when
it no longer falls, the rest never reaches a root. Only then, and only for nodes that
have a root, are paths materialised: a node's way is looked up by its topmost ancestor
and doubles until it is as long as the offset says. The links are never gathered: not on
the driver, not in one task.

Results for odd input: rows with a null end are no links; repeated rows are one link; of
several distinct parents the smallest counts (``parents`` tells how many there were); a
node that is its own parent is a circle; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.offsets import partitions_for
from skein.plans.session import cut_lineage

LINKS_A_FOREST = 200_000  # links whose forest one task holds in memory
_JUMPS = "node long, anc long, off long"


def links_of(edges: DataFrame, kind: str = "inherits") -> DataFrame:
    """node, parent, parents: one link a child."""
    rows = edges.filter((F.col("kind") == kind) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    pairs = rows.groupBy(F.col("source_id").alias("node"), F.col("target_id").alias("parent")).agg(F.lit(1).alias("one"))
    return pairs.groupBy("node").agg(F.min("parent").alias("parent"), F.count("*").cast("int").alias("parents"))


class Forest:
    """Weighted disjoint sets over the links of one partition."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.off: dict[int, int] = {}
        self.open: dict[int, int] = {}

    def find(self, x: int) -> tuple[int, int]:
        """Root of the tree and offset to it; flattens the way."""
        way = []
        while x in self.up:
            way.append(x)
            x = self.up[x]
        total = 0
        for y in reversed(way):
            total += self.off[y]
            self.up[y], self.off[y] = x, total
        return x, total

    def link(self, child: int, parent: int) -> None:
        root, _ = self.find(parent)
        if root == child:
            self.open[child] = parent
        else:
            self.up[child], self.off[child] = parent, 1

    def rows(self):
        """(node, ancestor, offset); an open link is one step."""
        for node in self.up:
            yield node, *self.find(node)
        for node, parent in self.open.items():
            yield node, parent, 1


def local_forests(links: DataFrame, partitions: int) -> DataFrame:
    """node, anc, off: the links of each range of nodes, contracted. Ranges keep nodes that were numbered together, as related ones mostly are."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for child, parent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.link(child, parent)
        rows = []
        for row in forest.rows():
            rows.append(row)
            if len(rows) == 50_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return links.select("node", "parent").repartitionByRange(partitions, "node").mapInArrow(run, _JUMPS)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], names=["node", "anc", "off"])


def merge_forests(jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, anc, off of nodes whose ancestor is a root; the nodes that never reach one)."""
    jumps = cut_lineage(jumps.withColumn("go", F.lit(True)))
    closed, left = [], None
    while True:
        up = jumps.select(F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("off").alias("o2"))
        for done in closed:
            up = up.unionByName(done.select(F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("off").alias("o2")))
        met = jumps.join(up, F.col("anc") == F.col("n2"), "left")
        met = cut_lineage(met.select("node", F.coalesce("a2", "anc").alias("anc"), (F.col("off") + F.coalesce("o2", F.lit(0))).alias("off"), F.col("n2").isNotNull().alias("go")))
        closed.append(met.filter("not go"))
        jumps = met.filter("go")
        still = jumps.count()
        # open nodes that have not fallen in number lie on circles or below them
        if not still or still == left:
            every = closed[0]
            for done in closed[1:]:
                every = every.unionByName(done)
            return every.drop("go"), jumps.select("node")
        left = still


def split_circles(lost: DataFrame, links: DataFrame) -> DataFrame:
    """node, place of the nodes that reach no root: what steps of growing length still arrive at lies on a circle."""
    jump = cut_lineage(links.join(lost, "node", "left_semi").select("node", F.col("parent").alias("to")))
    n = jump.select("to").distinct().count()
    while n:
        again = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        jump2 = cut_lineage(jump.join(again, "to").select("node", F.col("to2").alias("to")))
        n2 = jump2.select("to").distinct().count()
        jump = jump2
        if n2 == n:
            break
        n = n2
    on = jump.select(F.col("to").alias("node")).distinct().withColumn("on", F.lit(True))
    return lost.join(on, "node", "left").select("node", F.when(F.col("on"), "on_cycle").otherwise("below_cycle").alias("place"))


def levels(edges: DataFrame, kind: str = "inherits", forest: int = LINKS_A_FOREST) -> DataFrame:
    """One row for each node: symbol_id, place (root, inner, on_cycle, below_cycle), root, depth, parents. Root and depth are null for nodes that reach no root."""
    return _levels(cut_lineage(links_of(edges, kind)), forest)


def _levels(links: DataFrame, forest: int) -> DataFrame:
    closed, lost = merge_forests(local_forests(links, partitions_for(links.count(), 1, forest)))
    inner = closed.select(F.col("node").alias("symbol_id"), F.lit("inner").alias("place"), F.col("anc").alias("root"), F.col("off").alias("depth"))
    roots = links.select(F.col("parent").alias("symbol_id")).distinct().join(links.select(F.col("node").alias("symbol_id")), "symbol_id", "left_anti")
    roots = roots.select("symbol_id", F.lit("root").alias("place"), F.col("symbol_id").alias("root"), F.lit(0).cast("long").alias("depth"))
    none = F.lit(None).cast("long")
    circles = split_circles(lost, links).select(F.col("node").alias("symbol_id"), "place", none.alias("root"), none.alias("depth"))
    every = inner.unionByName(roots).unionByName(circles)
    return every.join(links.select(F.col("node").alias("symbol_id"), "parents"), "symbol_id", "left").withColumn("parents", F.coalesce("parents", F.lit(0)))


def lost_nodes(edges: DataFrame, kind: str = "inherits", forest: int = LINKS_A_FOREST) -> DataFrame:
    """symbol_id, place (on_cycle, below_cycle) of the nodes that never reach a root."""
    links = cut_lineage(links_of(edges, kind))
    _, lost = merge_forests(local_forests(links, partitions_for(links.count(), 1, forest)))
    return split_circles(lost, links).select(F.col("node").alias("symbol_id"), "place")


def ways_up(links: DataFrame, depths: DataFrame) -> DataFrame:
    """node, way (the node and all above it up to below the root) of the nodes with a root (node, depth), by looking up the way of the topmost ancestor until a way is as long as the depth. As large as the paths themselves, which for chains is the square of their length."""
    open_ = cut_lineage(links.join(depths, "node").select("node", F.col("parent").alias("anc"), "depth", F.array("node").alias("way")))
    done = []
    while True:
        done.append(open_.filter(F.size("way") == F.col("depth")))
        going = open_.filter(F.size("way") < F.col("depth"))
        known = open_.select(F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("way").alias("w2"))
        for d in done[:-1]:
            known = known.unionByName(d.select(F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("way").alias("w2")))
        asked = going.join(known, F.col("anc") == F.col("n2"))
        open_ = cut_lineage(asked.select("node", F.col("a2").alias("anc"), "depth", F.concat("way", "w2").alias("way")))
        if open_.isEmpty():
            every = done[0]
            for d in done[1:]:
                every = every.unionByName(d)
            return every.select("node", "way")


def hierarchy(edges: DataFrame, kind: str = "inherits", forest: int = LINKS_A_FOREST) -> DataFrame:
    """``levels`` with the path (ids from the root to the node; null for nodes that reach no root)."""
    links = cut_lineage(links_of(edges, kind))
    nodes = cut_lineage(_levels(links, forest))
    ways = ways_up(links, nodes.filter("place = 'inner'").select(F.col("symbol_id").alias("node"), "depth"))
    path = F.when(F.col("root").isNotNull(), F.concat(F.array("root"), F.coalesce(F.reverse("way"), F.array().cast("array<long>"))))
    return nodes.join(ways.withColumnRenamed("node", "symbol_id"), "symbol_id", "left").select("symbol_id", "place", "root", "depth", path.alias("path"), "parents")


def descendants(nodes: DataFrame) -> DataFrame:
    """symbol_id, descendant, distance for all pairs of a node and a node below it: as many rows as the paths hold steps."""
    steps = nodes.filter(F.size("path") > 1).select(F.col("symbol_id").alias("descendant"), "depth", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("at", "symbol_id"))
    return steps.select("symbol_id", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
