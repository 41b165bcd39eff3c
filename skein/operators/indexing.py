"""Building the whole graph from texts: files, symbols, imports, references, edges, open references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.extract import extract_all, extract_imports, extract_refs
from skein.operators.graphmodel import merge_edges
from skein.operators.resolve import ladder, namespaces
from skein.plans.session import cut_lineage
from skein.sources.walker import kept, language_of


def stable_id(*parts):
    """A positive id made of what a row is, so that the same texts give the same ids in any order."""
    return F.abs(F.xxhash64(*parts) % F.lit(2**62))


def build_index(sources: DataFrame, runtime: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a graph from texts (path, content): files, symbols, imports, refs, edges, unresolved.

    ``runtime`` holds symbols (id, name, qualified_name, kind) that references may mean as
    well. Every text is read once; the references of all files then climb the ladder."""
    live = sources.filter(F.col("path").isNotNull() & kept("path")).dropDuplicates(["path"])
    content = F.coalesce("content", F.lit(""))
    texts = live.select(stable_id(F.lit("file"), "path").alias("id"), F.substring_index("path", "/", 1).alias("project"), "path", F.sha2(content, 256).alias("hash"), language_of("path").alias("language"), content.alias("content")).filter("language is not null")
    files = texts.select("id", "project", "path", "hash", "language", F.lit(None).cast("long").alias("last_indexed"))
    found = cut_lineage(extract_all(files, texts.select(F.col("id").alias("file_id"), "content")))
    at = ["file_id", "line", "col", "qualified_name", "kind"]
    symbols = found.filter("kind <> 'import'").dropDuplicates(at).select(stable_id(*at).alias("id"), "file_id", "name", "qualified_name", "kind", "line", "col", "end_line", F.lit(None).cast("int").alias("end_col"), "scope_path", "signature", F.lit(None).cast("string").alias("doc_comment"), "visibility")
    declared = symbols.groupBy("file_id", F.col("qualified_name").alias("source"), F.col("line").alias("source_line")).agg(F.min("id").alias("source_id"))
    refs = cut_lineage(extract_refs(found).join(declared, ["file_id", "source", "source_line"]).select("source_id", "file_id", "target_name", "kind", "line"))
    every = symbols.select("id", "file_id", "name", "qualified_name", "kind", "line")
    if runtime is not None:
        every = every.unionByName(runtime.select("id", F.lit(None).cast("long").alias("file_id"), "name", "qualified_name", "kind", F.lit(None).cast("int").alias("line")))
    imports = extract_imports(found).distinct()
    answers = cut_lineage(ladder(refs, every, files, imports, namespaces(symbols)))
    key = ["source_id", "target_name", "kind"]
    edges = merge_edges(refs.join(answers, key).select("source_id", "target_id", "kind", F.col("line").alias("source_line"), "confidence"))
    return {"files": files, "symbols": symbols, "imports": imports, "refs": refs, "edges": edges, "unresolved": refs.join(answers, key, "left_anti")}
