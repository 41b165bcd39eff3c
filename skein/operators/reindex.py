"""Targeted re-index: what a batch of changed files does to symbols, edges and open references.

The files to resolve again are found before anything is deleted: the changed ones, those
that refer to them, and those with an open reference to a name that now exists. New
symbols get ids from what they are (path, line, name), so that a repeated batch gives
the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.extract import extract_all, extract_imports, extract_refs
from skein.operators.graph import dependent_files, newly_resolvable
from skein.operators.graphmodel import CodeGraph, merge_edges
from skein.operators.resolve import ladder, namespaces
from skein.plans.session import cut_lineage
from skein.sources.walker import language_of

SYMBOL_COLUMNS = ["id", "file_id", "name", "qualified_name", "kind", "line", "col", "end_line", "end_col", "scope_path", "signature", "doc_comment", "visibility"]


def symbol_id(path, line, name):
    """A stable positive id, far from those of numbered tables."""
    return F.abs(F.xxhash64(path, line, name) % F.lit(2**61)) + F.lit(2**61)


def reindex(g: CodeGraph, changes: DataFrame, present: DataFrame, unresolved: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, symbols, edges, imports, unresolved and touched (file_id, why) after changes (path, change) with the present texts (path, content). ``unresolved`` holds the open references so far (source_id, file_id, target_name, kind, line).

    Deleted files take their symbols and all edges at either end with them. What the new
    texts refer to, what was open, and what led from elsewhere into a changed file goes
    through the ladder of ``resolve``; what it does not answer is open."""
    gone = changes.filter("change = 'deleted'").select("path")
    live = changes.filter("change <> 'deleted'").select("path")
    old = g.files.join(changes.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"), "path")
    texts = present.join(live, "path", "left_semi")
    ids = texts.select("path").join(g.files.select(F.col("id").alias("known"), "path"), "path", "left").select("path", F.coalesce("known", symbol_id("path", F.lit(0), F.lit(""))).alias("file_id"))
    now = texts.join(ids, "path").select(F.col("file_id").alias("id"), F.substring_index("path", "/", 1).alias("project"), "path", F.sha2("content", 256).alias("hash"), language_of("path").alias("language"), F.lit(None).cast("long").alias("last_indexed"), "content")
    # one pass over the texts, which both the symbols and the references come from
    read = cut_lineage(extract_all(now, now.select(F.col("id").alias("file_id"), "content")))
    found = read.filter("kind <> 'import'").join(ids, "file_id")
    fresh = found.select(symbol_id("path", "line", "qualified_name").alias("id"), "file_id", "name", "qualified_name", "kind", "line", "col", "end_line", F.lit(None).cast("int").alias("end_col"), "scope_path", "signature", F.lit(None).cast("string").alias("doc_comment"), "visibility")

    dependents = dependent_files(g, old.select("file_id"))
    open_ = unresolved if unresolved is not None else g.spark.createDataFrame([], "source_id long, file_id long, target_name string, kind string, line int")
    waiting = newly_resolvable(open_, fresh.select("name"))
    touched = ids.select("file_id", F.lit("changed").alias("why")).unionByName(dependents.select("file_id", F.lit("dependent").alias("why"))).unionByName(waiting.select("file_id", F.lit("waiting").alias("why")))
    touched = touched.groupBy("file_id").agg(F.min("why").alias("why"))

    files = g.files.join(changes.select("path"), "path", "left_anti").select("id", "project", "path", "hash", "language", "last_indexed").unionByName(now.drop("content").select("id", "project", "path", "hash", "language", "last_indexed"))
    symbols = g.symbols.join(old.select("file_id"), "file_id", "left_anti").select(*SYMBOL_COLUMNS).unionByName(fresh.select(*SYMBOL_COLUMNS))

    dead = g.symbols.join(old.select("file_id"), "file_id", "left_semi").select("id", "qualified_name")
    kept = g.edges.join(dead.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    inside = kept.join(dead.select(F.col("id").alias("target_id"), "qualified_name"), "target_id")
    stay = kept.join(dead.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    homes = g.symbols.select(F.col("id").alias("source_id"), "file_id")
    again = inside.join(homes, "source_id").select("source_id", "file_id", F.col("qualified_name").alias("target_name"), F.substring_index("qualified_name", ".", -1).alias("simple"), "kind", F.col("source_line").alias("line"))

    # the new files' own references, open ones, and those that led into what is gone: by qualified name, else by name
    declared = fresh.groupBy("file_id", F.col("qualified_name").alias("source"), F.col("line").alias("source_line")).agg(F.min("id").alias("source_id"))
    refs = extract_refs(read).join(declared, ["file_id", "source", "source_line"]).select("source_id", "file_id", "target_name", F.col("target_name").alias("simple"), "kind", "line")
    still = open_.join(dead.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("source_id", "file_id", "target_name", F.col("target_name").alias("simple"), "kind", "line")
    asked = cut_lineage(refs.unionByName(still).unionByName(again))
    every = symbols.select("id", "file_id", "name", "qualified_name", "kind", "line").unionByName(g.read("runtime_symbols").select("id", F.lit(None).cast("long").alias("file_id"), "name", "qualified_name", "kind", F.lit(None).cast("int").alias("line")))
    imports = g.imports.join(old.select("file_id"), "file_id", "left_anti").unionByName(extract_imports(read))
    both = asked.select("source_id", "file_id", "target_name", "kind").unionByName(asked.select("source_id", "file_id", F.col("simple").alias("target_name"), "kind"))
    answer = cut_lineage(ladder(both, every, files, imports, namespaces(symbols))).select("source_id", F.col("target_name").alias("said"), "kind", "target_id", "confidence")
    exact, loose = (answer.select("source_id", F.col("said").alias(by), "kind", F.col("target_id").alias(f"{by}_id"), F.col("confidence").alias(f"{by}_sure")) for by in ("target_name", "simple"))
    hit = asked.join(exact, ["source_id", "target_name", "kind"], "left").join(loose, ["source_id", "simple", "kind"], "left").withColumns({"target_id": F.coalesce("target_name_id", "simple_id"), "confidence": F.when(F.col("target_name_id").isNotNull(), F.col("target_name_sure")).otherwise(F.col("simple_sure"))})
    new = hit.filter("target_id is not null").select("source_id", "target_id", "kind", F.col("line").alias("source_line"), "confidence")
    rest = hit.filter("target_id is null").select("source_id", "file_id", "target_name", "kind", "line")
    edges = merge_edges(stay.select("source_id", "target_id", "kind", "source_line", "confidence").unionByName(new))
    gone_files = old.join(gone, "path", "left_semi").select("file_id")
    return {"files": files, "symbols": symbols, "edges": edges, "imports": imports, "unresolved": rest, "touched": touched.join(gone_files, "file_id", "left_anti")}
