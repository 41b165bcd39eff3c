"""Keeping the graph: change detection, keyed upserts, cascades, confidence, imported indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graphmodel import CodeGraph, merge_edges


def detect_changes(known: DataFrame, present: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted, unchanged) of known (path, hash) against present (path, hash)."""
    j = known.withColumnRenamed("hash", "old").join(present.withColumnRenamed("hash", "new"), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return j.select("path", change.alias("change"))


def hashed(sources: DataFrame) -> DataFrame:
    """path, hash, size, lines of the texts as they are now."""
    return sources.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").alias("size"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("lines"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_cascade(g: CodeGraph, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files (file_id): their symbols, chunks, and edges at either end go too."""
    files = g.files.join(gone.select(F.col("file_id").alias("id")), "id", "left_anti")
    symbols = g.symbols.join(gone, "file_id", "left_anti")
    dead = g.symbols.join(gone, "file_id", "left_semi").select("id")
    edges = g.edges.join(dead.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(dead.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return {"files": files, "symbols": symbols, "edges": edges, "code_chunks": g.read("code_chunks").join(gone, "file_id", "left_anti"), "flow_edges": g.flow_edges.join(gone.select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_anti").join(gone.select(F.col("file_id").alias("target_file_id")), "target_file_id", "left_anti")}


def dedup_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """What storing new chunks (file_id, content_hash) over old ones does, each hash as often as it occurs: file_id, content_hash, keep, insert, delete."""
    count = lambda df, name: df.groupBy("file_id", "content_hash").agg(F.count("*").alias(name))
    j = count(old, "o").join(count(new, "n"), ["file_id", "content_hash"], "full").fillna({"o": 0, "n": 0})
    return j.select("file_id", "content_hash", F.least("o", "n").alias("keep"), F.greatest(F.col("n") - F.col("o"), F.lit(0)).alias("insert"), F.greatest(F.col("o") - F.col("n"), F.lit(0)).alias("delete"))


def raise_confidence(edges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Edges with the confirmed pairs (source_id, target_id, confidence) raised, never lowered."""
    c = confirmed.groupBy("source_id", "target_id").agg(F.max("confidence").alias("sure"))
    return edges.join(c, ["source_id", "target_id"], "left").withColumn("confidence", F.greatest("confidence", F.coalesce("sure", F.lit(0.0)))).drop("sure")


def persist_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges with externally resolved ones (source_id, target_id, kind, source_line) at confidence 1.0: raised where they exist, else added."""
    return merge_edges(edges.select("source_id", "target_id", "kind", "source_line", "confidence").unionByName(found.select("source_id", "target_id", "kind", "source_line", F.lit(1.0).alias("confidence"))))


def invalidate(g: CodeGraph, files: DataFrame, kinds: tuple[str, ...] = ("lsp_resolved", "scip_ref")) -> DataFrame:
    """All edges; externally resolved ones that leave the files (file_id) fall back to confidence 0.5."""
    s = g.symbols.join(files, "file_id", "left_semi").select(F.col("id").alias("source_id"), F.lit(True).alias("hit"))
    e = g.edges.join(s, "source_id", "left")
    return e.withColumn("confidence", F.when(F.col("hit") & F.col("kind").isin(*kinds), F.lit(0.5)).otherwise(F.col("confidence"))).drop("hit")


def unresolved_batch(unresolved: DataFrame, degrees: DataFrame, limit: int) -> DataFrame:
    """The unresolved references of the most used sources (a batch of ``limit``): source_id, target_name, kind, incoming."""
    d = degrees.select(F.col("id").alias("source_id"), "incoming")
    return unresolved.join(d, "source_id", "left").select("source_id", "target_name", "kind", F.coalesce("incoming", F.lit(0)).alias("incoming")).orderBy(F.desc("incoming"), "source_id", "target_name", "kind").limit(limit)


def low_confidence_batch(edges: DataFrame, limit: int, below: float = 0.8) -> DataFrame:
    """The least sure edges (a batch of ``limit``)."""
    return edges.filter(F.col("confidence") < below).orderBy("confidence", "source_id", "target_id", "kind", F.col("source_line").asc_nulls_first()).limit(limit)


# -- imported indexes ---------------------------------------------------------------
def dotted_symbol(symbol):
    """The dotted name in an index symbol (scheme manager package version descriptor)."""
    d = F.element_at(F.split(symbol, " ", 5), -1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(d, r"`", ""), r"\(\S*\)\.?", ""), r"[/#:]", ".")
    return F.regexp_replace(F.regexp_replace(bare, r"\.+", "."), r"^\.|\.$", "")


def import_occurrences(g: CodeGraph, occurrences: DataFrame, symbols_at) -> DataFrame:
    """Edges (source_id, target_id, kind scip_ref, source_line, confidence 1.0) of an index's occurrences (path, line, symbol, definition). Definitions map index symbols to ours by file and line, else by dotted name; references start at the narrowest symbol around them."""
    f = g.files.select(F.col("id").alias("file_id"), "path")
    o = occurrences.join(f, "path").select("file_id", "line", "symbol", "definition")
    at = g.symbols.groupBy("file_id", "line").agg(F.min("id").alias("id"))
    direct = o.filter("definition").join(at, ["file_id", "line"]).groupBy("symbol").agg(F.min("id").alias("target_id"))
    named = o.select("symbol").distinct().join(direct, "symbol", "left_anti").withColumn("qualified_name", dotted_symbol("symbol")).join(g.every_symbol.groupBy("qualified_name").agg(F.min("id").alias("target_id")), "qualified_name").select("symbol", "target_id")
    refs = o.filter("not definition").select("file_id", "line", "symbol")
    sources = symbols_at(refs.select("file_id", "line").distinct(), g.symbols).select("file_id", "line", F.col("symbol_id").alias("source_id"))
    e = refs.join(sources, ["file_id", "line"]).join(direct.unionByName(named), "symbol").filter(F.col("source_id") != F.col("target_id"))
    return e.select("source_id", "target_id", F.lit("scip_ref").alias("kind"), F.col("line").alias("source_line"), F.lit(1.0).alias("confidence")).distinct()


def latest_changes(events: DataFrame) -> DataFrame:
    """path, change: the last event of each path in a batch of (path, change, seq), so that a create and delete in one batch is a delete."""
    return events.groupBy("path").agg(F.max(F.struct("seq", "change")).alias("x")).select("path", F.col("x.change").alias("change"))


PROVENANCE = ["source_id", "target_id", "kind", "source_line"]


def record_provenance(known: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """Who confirmed which edge (source_id, target_id, kind, source_line, source), with the edges just found by ``source`` in place of older words on them."""
    new = found.select(*PROVENANCE).distinct().withColumn("source", F.lit(source))
    return _without(known, new).select(*PROVENANCE, "source").unionByName(new)


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of the same key, null lines being equal."""
    named = gone.select(*[F.col(c).alias(f"{c}_") for c in PROVENANCE])
    return edges.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in PROVENANCE]), "left_anti")


def unconfirmed(edges: DataFrame, provenance: DataFrame, limit: int, below: float = 0.8) -> DataFrame:
    """The least sure edges that nobody confirmed yet (a batch of ``limit``)."""
    return low_confidence_batch(_without(edges.filter(F.col("confidence") < below), provenance), limit, below)


def confirm(edges: DataFrame, batch: DataFrame, answers: DataFrame) -> DataFrame:
    """Edges after an outside resolver answered (source_id, source_line, target_id) for a batch: those on whose target it agrees are sure, all others as they were."""
    agreed = batch.join(answers, ["source_id", "source_line", "target_id"], "left_semi").select("source_id", "target_id", F.lit(1.0).alias("confidence"))
    return raise_confidence(edges, agreed)


def settle(unresolved: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of kind lsp_resolved at 1.0, what stays open) after an outside resolver answered (source_id, target_name, line, target_id) for open references."""
    said = answers.groupBy(F.col("source_id").alias("s"), F.col("target_name").alias("n"), F.col("line").alias("l")).agg(F.min("target_id").alias("target_id"))
    same = F.col("source_id").eqNullSafe(F.col("s")) & F.col("target_name").eqNullSafe(F.col("n")) & F.col("line").eqNullSafe(F.col("l"))
    hit = unresolved.join(said, same).select("source_id", "target_id", F.lit("lsp_resolved").alias("kind"), F.col("line").alias("source_line"), F.lit(1.0).alias("confidence"))
    return hit, unresolved.join(said, same, "left_anti")
