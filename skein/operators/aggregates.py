"""Counts, rankings and checks over the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graphmodel import CodeGraph
from skein.operators.offsets import part_offsets, sorted_runs

ENTRY_KINDS = ("class", "interface", "function", "struct")


def totals(g: CodeGraph) -> DataFrame:
    """One row: files, symbols, edges."""
    return index_stats(g)


def index_stats(g: CodeGraph, **more: DataFrame) -> DataFrame:
    """One row: files, symbols, edges, and the counts of whatever else is given (unresolved, routes, mappings). Counts that never join."""
    tables = {"files": g.files, "symbols": g.symbols, "edges": g.edges} | more
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).agg(*[F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in tables])


def overview(g: CodeGraph, hot: int = 10, entries: int = 20) -> DataFrame:
    """part, name, detail, n: totals, languages, hotspots and entry points in one list."""
    t = totals(g).select(F.explode(F.create_map(*[x for c in ("files", "symbols", "edges") for x in (F.lit(c), F.col(c))])).alias("name", "n")).select(F.lit("total").alias("part"), "name", F.lit(None).cast("string").alias("detail"), "n")
    lang = language_stats(g).select(F.lit("language"), "language", F.concat("files", F.lit(" files")), "symbols")
    h = hotspots(g, hot).select(F.lit("hotspot"), "qualified_name", "kind", "incoming")
    e = entry_points(g, entries).select(F.lit("entry point"), "qualified_name", "path", F.col("line").cast("long"))
    return t.union(lang).union(h).union(e)


def envelope(df: DataFrame, order: list) -> DataFrame:
    """One row, json: ``{"ok": true, "data": [...]}`` of a result list in order. For lists that a limit bounds."""
    numbered = df.withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("_k", F.struct(*df.columns).alias("row"))))
    return numbered.agg(F.to_json(F.struct(F.lit(True).alias("ok"), F.transform(rows, lambda x: x["row"]).alias("data"))).alias("json"))


def language_stats(g: CodeGraph) -> DataFrame:
    """language, files, symbols; symbols are counted per file first, so that no distinct count is needed."""
    per = g.symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    return g.files.select(F.col("id").alias("file_id"), "language").join(per, "file_id", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def hotspots(g: CodeGraph, limit: int = 10) -> DataFrame:
    """The symbols with most incoming edges (a top-k report). Counted before anything is joined."""
    n = g.edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("incoming"))
    top = n.orderBy(F.desc("incoming"), "id").limit(limit)
    return F.broadcast(top).join(g.every_symbol, "id").select("id", "name", "qualified_name", "kind", "incoming")


def entry_points(g: CodeGraph, limit: int = 20) -> DataFrame:
    """Public types and functions in the order of their files (a top-k report)."""
    f = g.files.select(F.col("id").alias("file_id"), "path")
    s = g.symbols.filter((F.col("visibility") == "public") & F.col("kind").isin(*ENTRY_KINDS)).select("id", "file_id", "name", "qualified_name", "kind", "line")
    return s.join(f, "file_id").orderBy("path", "line", "id").limit(limit).select("id", "name", "qualified_name", "kind", "path", "line")


def visibility_audit(g: CodeGraph, least: int = 3) -> DataFrame:
    """kind, visibility, symbols, referenced (with an incoming edge) of groups of at least ``least``."""
    used = g.edges.select(F.col("target_id").alias("id")).distinct().withColumn("used", F.lit(1))
    s = g.symbols.select("id", "kind", "visibility").join(used, "id", "left")
    return s.groupBy("kind", "visibility").agg(F.count("*").alias("symbols"), F.count("used").alias("referenced")).filter(F.col("symbols") >= least)


def flow_summary(g: CodeGraph) -> DataFrame:
    """Flow edges by type, by pair of languages, and in all, in one pass: level, edge_type, source_language, target_language, n."""
    fe = g.flow_edges.select("edge_type", "source_language", "target_language")
    cube = fe.groupingSets([["edge_type", "source_language", "target_language"], ["edge_type"], ["source_language", "target_language"], []], "edge_type", "source_language", "target_language")
    return cube.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def baseline_check(current: DataFrame, baseline: DataFrame, slack: float = 0.05) -> DataFrame:
    """project, metric, was, now, status: ok, regressed (below the baseline by more than ``slack``), missing or new."""
    j = baseline.withColumnRenamed("value", "was").join(current.withColumnRenamed("value", "now"), ["project", "metric"], "full")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("now") < (1 - slack) * F.col("was"), "regressed").otherwise("ok")
    return j.withColumn("status", status)


def minimum_check(current: DataFrame, minima: DataFrame) -> DataFrame:
    """project, metric, least, now, status: ok or short, of minima (project, metric, least) that a project's metrics must reach; a metric that is not there counts as 0."""
    j = minima.join(current.withColumnRenamed("value", "now"), ["project", "metric"], "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return j.withColumn("status", F.when(F.col("now") < F.col("least"), "short").otherwise("ok"))


def project_metrics(g: CodeGraph) -> DataFrame:
    """project, metric, value: files, symbols and edges of every project."""
    p = g.files.select(F.col("id").alias("file_id"), "project")
    s = g.symbols.select(F.col("id").alias("source_id"), "file_id").join(p, "file_id")
    out = g.edges.groupBy("source_id").agg(F.count("*").alias("n"))
    a = g.files.groupBy("project").agg(F.count("*").alias("value")).select("project", F.lit("files").alias("metric"), "value")
    b = s.join(out, "source_id", "left").groupBy("project").agg(F.count("*").alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return a.unionByName(b.select("project", F.explode(F.create_map(F.lit("symbols"), F.col("symbols"), F.lit("edges"), F.col("edges"))).alias("metric", "value")))


def percentiles(df: DataFrame, key: str, value: str, partitions: int | None = None) -> DataFrame:
    """n, p50, p95, p99 and max of each key by the sorted position floor(p * (n - 1)), exactly. Positions come from exact offsets (see ``offsets``), so that a key with most rows is spread over many tasks."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    runs = sorted_runs(rows, ["_key"], ["_value"], partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    offsets = part_offsets(runs, ["_key"]).select(F.col("part").alias("p"), F.col("_key").alias("k"), "offset")
    counts = runs.groupBy(F.col("_key").alias("k")).agg(F.count("*").alias("n"), F.max("_value").alias("max"))
    here = F.row_number().over(Window.partitionBy("part", "_key").orderBy("_value")) - 1  # a part is bounded
    at = runs.withColumn("here", here).join(F.broadcast(offsets), (F.col("part") == F.col("p")) & F.col("_key").eqNullSafe(F.col("k")), "left").select("_key", "_value", (F.col("here") + F.coalesce("offset", F.lit(0))).alias("at"))
    want = counts.select("k", "n", "max", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(p) * (F.col("n") - 1)).alias("want")) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])).alias("w")).select("k", "n", "max", "w.*")
    hit = at.join(want, F.col("_key").eqNullSafe(F.col("k")) & (F.col("at") == F.col("want")))
    out = hit.groupBy("_key").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == p, F.col("_value"))).alias(p) for p in ("p50", "p95", "p99")], F.max("max").alias("max"))
    return out.withColumnRenamed("_key", key)


def answer_scores(df: DataFrame) -> DataFrame:
    """Scores answers (expected, found, calls, seconds): recall, precision, f1, efficiency, speed and their weighted sum."""
    recall = F.when(F.col("expected") > 0, F.least(F.lit(1.0), F.col("found") / F.col("expected"))).otherwise(1.0)
    f1 = F.when(recall + recall > 0, 2 * recall * recall / (recall + recall)).otherwise(0.0)
    efficiency = 1 / (1 + F.log2(F.greatest(F.lit(1.0), F.col("calls").cast("double"))))
    speed = F.lit(30.0) / (F.lit(30.0) + F.col("seconds"))
    whole = 0.25 * recall + 0.25 * recall + 0.15 * f1 + 0.20 * efficiency + 0.15 * speed
    return df.select("*", F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(efficiency, 6).alias("efficiency"), F.round(speed, 6).alias("speed"), F.round(whole, 6).alias("score"))
