"""Traversals: blast radius, flows, subgraphs, traces.

Every traversal is a loop of at most ``depth`` joins of a frontier with the edges. A
frontier holds each node once, so that paths never multiply; lineage is cut at every
level by a write to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.batches import map_columns
from skein.operators.graphmodel import CodeGraph
from skein.operators.navigation import degrees
from skein.plans.session import cut_lineage

TRACE_KINDS = ("calls", "type_ref", "instantiates")
ENTRY_KINDS = ("class", "struct", "method", "function")
CONTAINERS = ("class", "struct", "interface", "namespace")
MEMBERS = ("method", "function", "constructor", "property")


def reach(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth, label) of what ``depth`` steps (at, to, label) reach from the ids of ``start``: each id once for each depth and label."""
    levels, frontier = [], start.select(F.col("id").alias("at")).distinct()
    for d in range(1, depth + 1):
        level = cut_lineage(frontier.join(steps, "at").select(F.col("to").alias("id"), "label").distinct().withColumn("depth", F.lit(d)))
        levels.append(level)
        frontier = level.select(F.col("id").alias("at")).distinct()
    return reduce(DataFrame.unionByName, levels) if levels else start.select("id", F.lit(None).cast("string").alias("label"), F.lit(0).alias("depth")).limit(0)


def blast_radius(g: CodeGraph, center: int, depth: int) -> DataFrame:
    """What depends on a symbol, directly or over others: name, qualified_name, kind, path, depth, edge_kind, distinct. A symbol stands once for each depth and edge kind; a circle brings the center back."""
    # merged once, not again for each level
    back = cut_lineage(g.edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), F.col("kind").alias("label")).distinct())
    start = g.spark.range(center, center + 1)
    hit = reach(back, start, depth)
    s = g.symbols.select("id", "file_id", "name", "qualified_name", "kind")
    f = g.files.select(F.col("id").alias("file_id"), "path")
    return hit.join(s, "id").join(f, "file_id").select("name", "qualified_name", "kind", "path", "depth", F.col("label").alias("edge_kind")).distinct()


def trace_flow(g: CodeGraph, file_id: int, depth: int, line: int = 0, reverse: bool = False) -> DataFrame:
    """Files that flow edges lead to from a file (or, reversed, come from): depth, path, language, line, symbol, edge_type. Depth 0 are the edges' own ends at the file; a line of 0 is any."""
    near, far = ("target", "source") if reverse else ("source", "target")
    fe = cut_lineage(g.flow_edges.select("source_file_id", "source_line", "source_symbol", "source_language", "target_file_id", "target_line", "target_symbol", "target_language", "edge_type"))
    base = fe.filter(F.col(f"{near}_file_id") == file_id)
    if line:
        base = base.filter(F.col(f"{near}_line").isNull() | (F.col(f"{near}_line") == line))
    end = lambda df, side, d: df.select(F.lit(d).alias("depth"), F.col(f"{side}_file_id").alias("file_id"), F.col(f"{side}_line").alias("line"), F.col(f"{side}_symbol").alias("symbol"), F.col(f"{side}_language").alias("language"), "edge_type")
    levels = [end(base, near, 0).distinct()]
    frontier = base.select(F.col(f"{near}_file_id").alias("at")).distinct()
    first = True
    for d in range(1, depth + 1):
        step = base if first else fe.join(frontier, F.col(f"{near}_file_id") == F.col("at"), "left_semi")
        first = False
        level = cut_lineage(end(step.filter(F.col(f"{far}_file_id").isNotNull()), far, d).distinct())
        levels.append(level)
        frontier = level.select(F.col("file_id").alias("at")).distinct()
    f = g.files.select(F.col("id").alias("file_id"), "path")
    return reduce(DataFrame.unionByName, levels).join(f, "file_id").select("depth", "path", "line", "symbol", "language", "edge_type")


def trace_both(g: CodeGraph, file_id: int, depth: int) -> DataFrame:
    ahead = trace_flow(g, file_id, depth).withColumn("way", F.lit("forward"))
    return ahead.unionByName(trace_flow(g, file_id, depth, reverse=True).withColumn("way", F.lit("backward")))


def cross_language(g: CodeGraph, source: str, target: str) -> DataFrame:
    """Direct flows from one language to another, grouped by their source: edge_type, source_path, targets, lines."""
    f, t = g.files.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path")), g.files.select(F.col("id").alias("target_file_id"), F.col("path").alias("target_path"))
    fe = g.flow_edges.filter((F.col("source_language") == source) & (F.col("target_language") == target)).join(f, "source_file_id").join(t, "target_file_id")
    return fe.groupBy("edge_type", "source_path").agg(F.count("*").alias("steps"), F.countDistinct("target_path").alias("targets"), F.min("target_path").alias("first_target"))


def cross_language_steps(g: CodeGraph, source: str, target: str, limit: int = 200) -> DataFrame:
    """edge_type, source_path, step, path, line, symbol of the first ``limit`` direct flows between two languages (by type, path and line), as paths: step 0 is the source, the targets follow in order of path and line."""
    f = g.files.select(F.col("id"), "path")
    e = g.flow_edges.filter((F.col("source_language") == source) & (F.col("target_language") == target))
    e = e.join(f.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path")), "source_file_id").join(f.select(F.col("id").alias("target_file_id"), F.col("path").alias("target_path")), "target_file_id")
    order = ["edge_type", "source_path", F.col("source_line").asc_nulls_first(), "target_path", F.col("target_line").asc_nulls_first(), "source_id", "target_id"]
    top = e.orderBy(*order).limit(limit)
    key = ["edge_type", "source_path"]
    first = top.groupBy(*key).agg(F.min(F.struct(F.coalesce("source_line", F.lit(-1)).alias("at"), "source_symbol")).alias("x")).select(*key, F.lit(0).alias("step"), F.col("source_path").alias("path"), F.when(F.col("x.at") >= 0, F.col("x.at")).alias("line"), F.col("x.source_symbol").alias("symbol"))
    ends = top.select(*key, "target_path", "target_line", "target_symbol").distinct()
    w = Window.partitionBy(*key).orderBy("target_path", F.col("target_line").asc_nulls_first(), "target_symbol")
    return first.unionByName(ends.select(*key, F.row_number().over(w).alias("step"), F.col("target_path").alias("path"), F.col("target_line").alias("line"), F.col("target_symbol").alias("symbol")))


def interleaved(g: CodeGraph, limit: int = 50) -> DataFrame:
    """Flow edges so that every type has its turn: the first of each type, then the second, and so on (a list of ``limit``)."""
    f = g.files.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path"))
    w = Window.partitionBy("edge_type").orderBy("source_path", F.col("source_line").asc_nulls_first(), "source_id", "target_id")
    ranked = g.flow_edges.join(f, "source_file_id").withColumn("turn", F.row_number().over(w))
    return ranked.filter(F.col("turn") <= limit).orderBy("turn", "edge_type").limit(limit).select("turn", "edge_type", "source_path", "source_line", "source_symbol", "target_symbol")


def subgraph(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    """The edges between the nodes (id): source_id, target_id, kind, confidence (the greatest)."""
    ids = nodes.select("id")
    inside = g.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return inside.groupBy("source_id", "target_id", "kind").agg(F.max("confidence").alias("confidence"))


def subgraph_nodes(g: CodeGraph, prefix: str | None = None, cap: int = 10_000, concepts: DataFrame | None = None) -> DataFrame:
    """id, name, qualified_name, kind, path, concept of the symbols whose qualified name begins with a prefix: the first ``cap`` by name (the length of an export), each with its first concept of concepts (name, symbol_id)."""
    s = g.symbols if prefix is None else g.symbols.filter(F.startswith("qualified_name", F.lit(prefix)))
    top = s.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "qualified_name", "kind", "path").orderBy("qualified_name", "id").limit(cap)
    if concepts is None:
        return top.withColumn("concept", F.lit(None).cast("string"))
    first = concepts.join(top.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").groupBy(F.col("symbol_id").alias("id")).agg(F.min("name").alias("concept"))
    return top.join(first, "id", "left")


def node_counts(traces: DataFrame) -> DataFrame:
    """root_id, nodes of every trace tree."""
    return traces.groupBy("root_id").agg(F.count("*").alias("nodes"))


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text a row, nodes first: lines that can be written and read in parts."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)).alias("json"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), *edges.columns)).alias("json")))


def dependent_files(g: CodeGraph, changed: DataFrame) -> DataFrame:
    """Files (file_id) with an edge into the changed ones (file_id), without these."""
    s = g.symbols.select("id", "file_id")
    into = s.join(changed, "file_id", "left_semi").select(F.col("id").alias("target_id"))
    sources = g.edges.join(into, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return s.join(sources, "id", "left_semi").select("file_id").distinct().join(changed, "file_id", "left_anti")


def newly_resolvable(unresolved: DataFrame, names: DataFrame) -> DataFrame:
    """Files (file_id) with an unresolved reference to one of the names (name) that now exist."""
    return unresolved.join(names.select(F.col("name").alias("target_name")).distinct(), "target_name", "left_semi").select("file_id").distinct()


# -- traces -------------------------------------------------------------------------
_TRACE = "root_id long, ordinal int, node_id long, parent_id long, depth int, kind string"


def _dfs(depth: int):
    def walk(cols):
        out: dict[str, list] = {k: [] for k in ("root_id", "ordinal", "node_id", "parent_id", "depth", "kind")}
        for root, steps in zip(cols["root_id"], cols["steps"]):
            next_: dict[int, list] = {}
            for s in sorted(steps or [], key=lambda s: (s["at"], s["rank"])):
                next_.setdefault(s["at"], []).append((s["to"], s["kind"]))
            seen, stack, n = set(), [(root, None, 0, "root")], 0
            while stack:
                node, parent, d, kind = stack.pop()
                if node in seen:
                    continue
                seen.add(node)
                if kind == "silent":
                    continue
                for k, v in zip(out, (root, n, node, parent, d, kind)):
                    out[k].append(v)
                n += 1
                if d < depth:
                    stack.extend((to, node, d + 1, k) for to, k in reversed(next_.get(node, [])) if to not in seen)
        return out

    return walk


def trace_steps(g: CodeGraph, fan: int = 20, members: int = 30, same: int = 5) -> DataFrame:
    """at, to, kind, rank: where a trace goes from a symbol, in order of rank.

    First from a type or namespace into at most ``members`` members by their scope (one
    without a way on is only marked as visited: kind ``silent``), then over at most ``fan``
    edges by their lines, then over flow edges of either direction, whose ends are met by
    qualified or simple name, each name standing for at most ``same`` symbols. Members and
    namesakes are cut to these numbers before they are joined."""
    own = g.edges.filter(F.col("kind").isin(*TRACE_KINDS)).groupBy("source_id", "target_id").agg(F.min(F.struct(F.coalesce("source_line", F.lit(-1)).alias("line"), "kind")).alias("m"))
    w = Window.partitionBy("source_id").orderBy("m.line", "target_id")
    calls = own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= fan).select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), F.col("m.kind").alias("kind"), F.lit(1).alias("phase"), "rank")
    s = g.symbols.select("id", "name", "qualified_name")
    flows = g.flow_edges.filter("target_symbol is not null").groupBy("source_symbol", "target_symbol", "edge_type").agg(F.min(F.coalesce("source_line", F.lit(-1))).alias("line"))
    way = lambda a, b, back: flows.select(F.col(a).alias("near"), F.col(b).alias("far"), "edge_type", F.lit(back).alias("back"), "line")
    jumps = way("source_symbol", "target_symbol", 0).unionByName(way("target_symbol", "source_symbol", 1))
    called = s.select("id", F.col("qualified_name").alias("known"), F.lit(0).alias("simple")).unionByName(s.filter("name <> qualified_name").select("id", F.col("name").alias("known"), F.lit(1).alias("simple")))
    v = Window.partitionBy("known").orderBy("simple", "id")
    far = called.join(jumps.select(F.col("far").alias("known")).distinct(), "known", "left_semi").withColumn("k", F.row_number().over(v)).filter(F.col("k") <= same).select(F.col("known").alias("far"), F.col("id").alias("to"), "k")
    near = called.withColumnRenamed("known", "near").withColumnRenamed("id", "at")
    order = F.struct("simple", "back", "line", "far", "edge_type", "k")
    flow = cut_lineage(near.join(jumps, "near").join(far, "far").groupBy("at", "to").agg(F.min(order).alias("o")))
    flow = flow.select("at", "to", F.col("o.edge_type").alias("kind"), F.lit(2).alias("phase"), F.row_number().over(Window.partitionBy("at").orderBy("o", "to")).alias("rank"))
    u = Window.partitionBy("scope_path").orderBy(F.col("line").asc_nulls_first(), "id")
    inner = g.symbols.filter(F.col("kind").isin(*MEMBERS) & F.col("scope_path").isNotNull()).select("scope_path", "line", "id").withColumn("rank", F.row_number().over(u)).filter(F.col("rank") <= members)
    goes_on = own.select(F.col("source_id").alias("id")).unionByName(flow.select(F.col("at").alias("id"))).distinct().withColumn("on", F.lit(True))
    inner = inner.join(goes_on, "id", "left").select("scope_path", F.col("id").alias("to"), F.when(F.col("on"), "member").otherwise("silent").alias("kind"), F.lit(0).alias("phase"), "rank")
    outer = g.symbols.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("at"), F.col("qualified_name").alias("scope_path"))
    into = outer.join(inner, "scope_path").select("at", "to", "kind", "phase", "rank")
    return into.unionByName(calls).unionByName(flow).withColumn("rank", F.struct("phase", "rank")).drop("phase")


def trace_trees(g: CodeGraph, roots: DataFrame, depth: int, fan: int = 20) -> DataFrame:
    """Depth-first traces from the roots (id): root_id, ordinal, node_id, parent_id, depth, kind. A node goes on as in ``trace_steps`` and stands once in a tree.

    What a root can reach is found by joins, level by level, each symbol of a tree being
    opened once; only the order of the visit is made in Python."""
    steps = cut_lineage(trace_steps(g, fan))
    frontier = roots.select(F.col("id").alias("root_id"), F.col("id").alias("at")).distinct()
    opened, parts = frontier, []
    for _ in range(depth):
        level = cut_lineage(frontier.join(steps, "at").select("root_id", "at", "to", "kind", "rank"))
        parts.append(level)
        frontier = cut_lineage(level.filter("kind <> 'silent'").select("root_id", F.col("to").alias("at")).distinct().join(opened, ["root_id", "at"], "left_anti"))
        opened = opened.unionByName(frontier)
    seen = reduce(DataFrame.unionByName, parts)
    trees = seen.groupBy("root_id").agg(F.collect_list(F.struct("at", "to", "kind", (F.col("rank.phase").cast("long") * 2**32 + F.col("rank.rank")).alias("rank"))).alias("steps"))
    every = roots.select(F.col("id").alias("root_id")).distinct().join(trees, "root_id", "left")
    return map_columns(every, _dfs(depth), _TRACE)


def entry_traces(g: CodeGraph, most: int, depth: int) -> DataFrame:
    """Traces from at most ``most`` entry points, as from ``trace_trees``.

    Roots are, in order, the first 4 * ``most`` symbols that go on (those that nothing calls
    first, then those with most edges) and the first 2 * ``most`` targets of flow edges. One
    that stands in the trace of an earlier root or has a trace of one node is passed over."""
    e = g.edges.filter(F.col("kind").isin(*TRACE_KINDS))
    out = e.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing"))
    called = e.filter("kind = 'calls'").select(F.col("target_id").alias("id")).distinct().withColumn("called", F.lit(1))
    first = g.symbols.filter(F.col("kind").isin(*ENTRY_KINDS)).select("id").join(out, "id").join(called, "id", "left").orderBy(F.coalesce("called", F.lit(0)), F.desc("outgoing"), "id").limit(4 * most)
    then = g.flow_edges.filter("target_symbol is not null").select(F.col("target_id").alias("id")).distinct().orderBy("id").limit(2 * most)
    order = list(dict.fromkeys(r.id for part in (first, then) for r in part.select("id").collect()))
    roots = g.spark.createDataFrame([(i,) for i in order], "id long")
    trees = cut_lineage(trace_trees(g, roots, depth))
    # at most 6 * most roots, and of their trees only where they meet other roots
    met: dict[int, set] = {}
    for r in trees.join(F.broadcast(roots.withColumnRenamed("id", "node_id")), "node_id", "left_semi").select("root_id", "node_id").collect():
        met.setdefault(r.root_id, set()).add(r.node_id)
    long = {r.root_id for r in trees.filter("ordinal = 1").select("root_id").collect()}
    taken, visited = [], set()
    for i in order:
        if len(taken) < most and i in long and i not in visited:
            taken.append(i)
            visited |= met[i]
    return trees.filter(F.col("root_id").isin(taken))


def entry_roots(g: CodeGraph, limit: int) -> DataFrame:
    """Symbols that call and are least called, then those that call most (a top-k report): id."""
    d = degrees(g)
    s = g.symbols.filter(F.col("kind").isin(*ENTRY_KINDS)).select("id").join(d, "id").filter("outgoing > 0")
    return s.orderBy((F.col("incoming") > 0).cast("int"), F.desc("outgoing"), "id").limit(limit).select("id", "incoming", "outgoing")
