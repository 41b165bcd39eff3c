"""Queries for the operators of the graph engine, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import scalars as sc
from skein.operators import aggregates, concepts, connectors, extract, graph, maintain, navigation, search
from skein.operators.graphmodel import CodeGraph, with_views
from skein.operators.indexing import build_index
from skein.operators.reindex import reindex
from skein.operators.resolve import resolve, unresolved
from skein.plans.fixture import TEXTS
from skein.plans.session import cut_lineage
from skein.sources import walker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, d: fn(CodeGraph(spark, d))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# -- parameters that every data set has ------------------------------------------------
def _hot(g: CodeGraph, own: bool = False) -> tuple[int, str, str]:
    """id, name and qualified name of the most referenced symbol (of the projects' own, if asked)."""
    n = g.edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    s = (g.symbols if own else g.every_symbol).select("id", "name", "qualified_name")
    r = n.join(s, "id").orderBy(F.desc("n"), "id").first()
    return r["id"], r["name"], r["qualified_name"]


HOT = "hot AS (SELECT t.id, t.name, t.qualified_name FROM (SELECT target_id AS id, count(*) AS n FROM e GROUP BY 1) c JOIN sym t ON t.id = c.id ORDER BY c.n DESC, t.id LIMIT 1)"
HOT_OWN = HOT.replace("JOIN sym t", "JOIN symbols t")


def _busy_file(g: CodeGraph) -> int:
    """The file that most flow edges leave for another."""
    return g.flow_edges.filter("target_file_id is not null").groupBy("source_file_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file_id").first()[0]


BUSY = "busy AS (SELECT source_file_id AS id FROM flow WHERE target_file_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


# -- aggregates ------------------------------------------------------------------------
@query(f"{with_views('e')} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM e) AS edges")
def agg_totals(g):
    return aggregates.totals(g)


@query("SELECT f.language, count(DISTINCT f.id) AS files, count(s.id) AS symbols FROM files f LEFT JOIN symbols s ON s.file_id = f.id GROUP BY 1")
def agg_language_stats(g):
    return aggregates.language_stats(g)


@query(f"{with_views('sym', 'e')} SELECT t.id, t.name, t.qualified_name, t.kind, count(*) AS incoming FROM e JOIN sym t ON t.id = e.target_id GROUP BY ALL ORDER BY incoming DESC, t.id LIMIT 10")
def agg_hotspots(g):
    return aggregates.hotspots(g)


@query("SELECT s.id, s.name, s.qualified_name, s.kind, f.path, s.line FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.visibility = 'public' AND s.kind IN ('class', 'interface', 'function', 'struct') ORDER BY f.path, s.line, s.id LIMIT 20")
def agg_entry_points(g):
    return aggregates.entry_points(g)


@query(f"{with_views('e')} SELECT kind, visibility, count(*) AS symbols, count(*) FILTER (WHERE id IN (SELECT target_id FROM e)) AS referenced FROM symbols GROUP BY 1, 2 HAVING count(*) >= 3")
def agg_visibility_audit(g):
    return aggregates.visibility_audit(g)


@query(f"""{with_views('e', 'flow')} SELECT edge_type, source_language, target_language, CAST(grouping_id(edge_type, source_language, target_language) AS INTEGER) AS level, count(*) AS n FROM flow
    GROUP BY GROUPING SETS ((edge_type, source_language, target_language), (edge_type), (source_language, target_language), ())""")
def agg_flow_summary(g):
    return aggregates.flow_summary(g)


_METRICS = """m AS MATERIALIZED (SELECT project, 'files' AS metric, count(*) AS value FROM files GROUP BY 1
    UNION ALL SELECT f.project, 'symbols', count(*) FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY 1
    UNION ALL SELECT f.project, 'edges', count(e.source_id) FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN e ON e.source_id = s.id GROUP BY 1)"""


@query(f"{with_views('e')}, {_METRICS} SELECT * FROM m")
def agg_project_metrics(g):
    return aggregates.project_metrics(g)


@query(f"""{with_views('e')}, {_METRICS}, b AS MATERIALIZED (SELECT project, metric, CASE WHEN metric = 'edges' THEN value + value // 10 ELSE value END AS value FROM m)
    SELECT project, metric, b.value AS was, m.value AS now, CASE WHEN m.value < 0.95 * b.value THEN 'regressed' ELSE 'ok' END AS status FROM b JOIN m USING (project, metric)""")
def agg_quality_check(g):
    now = aggregates.project_metrics(g)
    was = now.withColumn("value", F.when(F.col("metric") == "edges", F.col("value") + F.floor(F.col("value") / 10)).otherwise(F.col("value")))
    return aggregates.baseline_check(now, was).select("project", "metric", "was", "now", "status")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, max(value) FILTER (WHERE k = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (WHERE k = floor(0.95 * (n - 1))) AS p95, max(value) FILTER (WHERE k = floor(0.99 * (n - 1))) AS p99, max(value) AS max FROM r GROUP BY 1""")
def agg_percentiles(g):
    return aggregates.percentiles(g.read("events"), "event_type", "value")


@query("""WITH a AS (SELECT user_id, count(*) AS expected, count(*) FILTER (WHERE value > 20) AS found, count(DISTINCT event_type) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100.0::DOUBLE * count(*)) AS seconds FROM events GROUP BY 1),
    b AS (SELECT *, least(1.0::DOUBLE, found / expected) AS r, 1::DOUBLE / (1::DOUBLE + log2(greatest(1.0::DOUBLE, calls))) AS ef, 30.0::DOUBLE / (30.0::DOUBLE + seconds) AS sp FROM a)
    SELECT user_id, expected, found, calls, round(r, 6) AS recall, round(CASE WHEN r > 0 THEN 2::DOUBLE * r * r / (r + r) ELSE 0 END, 6) AS f1, round(ef, 6) AS efficiency, round(sp, 6) AS speed,
    round(0.25::DOUBLE * r + 0.25::DOUBLE * r + 0.15::DOUBLE * (CASE WHEN r > 0 THEN 2::DOUBLE * r * r / (r + r) ELSE 0 END) + 0.20::DOUBLE * ef + 0.15::DOUBLE * sp, 6) AS score FROM b""")
def agg_answer_scores(g):
    # whole hundredths add up alike in any order
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    e = g.read("events").groupBy("user_id").agg(F.count("*").alias("expected"), F.count(F.when(F.col("value") > 20, 1)).alias("found"), F.countDistinct("event_type").alias("calls"), (cents.cast("double") / (F.lit(100.0) * F.count("*"))).alias("seconds"))
    return aggregates.answer_scores(e).drop("seconds")


# -- navigation ------------------------------------------------------------------------
@query(f"{with_views('sym', 'e')}, {HOT} SELECT id, name, qualified_name, kind, file_id, line, CAST(1.0 AS DOUBLE) AS confidence FROM sym WHERE qualified_name = (SELECT qualified_name FROM hot)")
def nav_definition_exact(g):
    return navigation.definition(g, _hot(g)[2])


@query(f"{with_views('sym', 'e')}, {HOT} SELECT id, name, qualified_name, kind, file_id, line, CAST(0.7 AS DOUBLE) AS confidence FROM sym WHERE name = (SELECT name FROM hot)")
def nav_definition_fallback(g):
    return navigation.definition(g, "no.such.scope." + _hot(g)[1])


_REFS = "SELECT s.qualified_name AS source, s.kind AS source_kind, f.path, e.kind, e.source_line, e.confidence, e.target_id FROM e JOIN symbols s ON s.id = e.source_id JOIN files f ON f.id = s.file_id"


@query(f"{with_views('sym', 'e')}, {HOT} {_REFS} WHERE e.target_id IN (SELECT id FROM sym WHERE qualified_name = (SELECT qualified_name FROM hot))")
def nav_references(g):
    return navigation.references(g, _hot(g)[2])


@query(f"{with_views('sym', 'e')}, {HOT} {_REFS} WHERE e.kind IN ('calls', 'type_ref', 'instantiates') AND e.target_id IN (SELECT id FROM sym WHERE name = (SELECT name FROM hot))")
def nav_incoming_calls(g):
    return navigation.incoming_calls(g, _hot(g)[1])


_CALLEES = """SELECT e.source_id, t.qualified_name AS target, t.kind AS target_kind, f.path, e.kind, e.source_line, e.confidence FROM e JOIN sym t ON t.id = e.target_id LEFT JOIN files f ON f.id = t.file_id
    WHERE e.kind IN ('calls', 'type_ref', 'instantiates') AND e.source_id IN"""


@query(f"{with_views('sym', 'e')}, {HOT_OWN} {_CALLEES} (SELECT id FROM symbols WHERE name = (SELECT name FROM hot))")
def nav_outgoing_calls(g):
    return navigation.outgoing_calls(g, _hot(g, own=True)[1])


@query(f"""{with_views('e')}, i AS (SELECT target_id AS id, count(*) AS n FROM e GROUP BY 1), o AS (SELECT source_id AS id, count(*) AS n FROM e GROUP BY 1),
    c AS (SELECT file_id, scope_path, count(*) AS n FROM symbols WHERE scope_path IS NOT NULL GROUP BY 1, 2)
    SELECT s.id, s.name, s.qualified_name, s.kind, s.line, s.visibility, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing, coalesce(c.n, 0) AS children
    FROM symbols s LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN c ON c.file_id = s.file_id AND c.scope_path = s.qualified_name""")
def nav_symbol_info(g):
    return navigation.symbol_info(g)


@query(f"{with_views('sym', 'e')}, {HOT_OWN} SELECT name, kind, line, signature FROM symbols WHERE file_id = (SELECT file_id FROM symbols WHERE id = (SELECT id FROM hot))")
def nav_file_outline(g):
    path = g.symbols.filter(F.col("id") == _hot(g, own=True)[0]).join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").first()["path"]
    return navigation.file_outline(g, path)


_POINTS = "p AS (SELECT DISTINCT s.file_id, e.source_line AS line FROM e JOIN symbols s ON s.id = e.source_id WHERE e.source_line IS NOT NULL)"


def _points(g):
    s = g.symbols.select(F.col("id").alias("source_id"), "file_id")
    return g.edges.filter("source_line is not null").join(s, "source_id").select("file_id", F.col("source_line").alias("line")).distinct()


@query(f"""{with_views('e')}, {_POINTS}, m AS (SELECT p.file_id, p.line, s.id AS symbol_id, coalesce(s.end_line, s.line) - s.line AS span, row_number() OVER (PARTITION BY p.file_id, p.line ORDER BY coalesce(s.end_line, s.line) - s.line, s.line DESC, s.id) AS k
    FROM p JOIN symbols s ON s.file_id = p.file_id AND p.line BETWEEN s.line AND coalesce(s.end_line, s.line)) SELECT file_id, line, symbol_id, span FROM m WHERE k = 1""")
def nav_enclosing_symbol(g):
    return navigation.enclosing(_points(g), g.symbols)


@query(f"""{with_views('e')}, {_POINTS}, m AS (SELECT p.file_id, p.line, c.id AS chunk_id, row_number() OVER (PARTITION BY p.file_id, p.line ORDER BY c.end_line - c.start_line, c.id) AS k
    FROM p JOIN code_chunks c ON c.file_id = p.file_id AND p.line BETWEEN c.start_line AND c.end_line) SELECT file_id, line, chunk_id FROM m WHERE k = 1""")
def nav_chunk_for_line(g):
    return navigation.chunk_at(_points(g), g.read("code_chunks"))


_DIAG = """SELECT f.path, e.source_line AS line, 'low_confidence' AS category, 'Low-confidence ' || e.kind || ' → ''' || t.qualified_name || ''' (' || CAST(round(e.confidence * 100) AS INTEGER) || '%)' AS message
    FROM e JOIN symbols s ON s.id = e.source_id JOIN files f ON f.id = s.file_id JOIN sym t ON t.id = e.target_id WHERE e.confidence < 0.8
    UNION ALL SELECT f.path, r.line, 'unresolved', 'Unresolved ' || r.kind || ' ''' || r.target_name || '''' FROM refs r JOIN files f ON f.id = r.file_id WHERE r.target_name LIKE 'Missing%'"""


@query(f"{with_views('sym', 'e', 'refs')} {_DIAG}")
def nav_diagnostics(g):
    return navigation.diagnostics(g, g.refs.filter(F.startswith("target_name", F.lit("Missing"))))


# -- traversals ------------------------------------------------------------------------
def _blast(depth: int) -> str:
    return f"""{with_views('sym', 'e')}, {HOT_OWN}, hit AS (SELECT id, CAST(0 AS INTEGER) AS depth, CAST('' AS VARCHAR) AS edge_kind FROM hot
      UNION SELECT e.source_id, h.depth + 1, e.kind FROM hit h JOIN e ON e.target_id = h.id WHERE h.depth < {depth})
      SELECT DISTINCT s.name, s.qualified_name, s.kind, f.path, h.depth, h.edge_kind FROM hit h JOIN symbols s ON s.id = h.id JOIN files f ON f.id = s.file_id WHERE h.depth > 0"""


@query(_blast(1))
def gra_blast_radius_d1(g):
    return graph.blast_radius(g, _hot(g, own=True)[0], 1)


@query(_blast(3))
def gra_blast_radius_d3(g):
    return graph.blast_radius(g, _hot(g, own=True)[0], 3)


def _flow(near: str, far: str, depth: int) -> str:
    return f"""hop_{near} AS (SELECT {far}_file_id AS file_id, {far}_line AS line, {far}_symbol AS symbol, {far}_language AS language, edge_type, CAST(1 AS INTEGER) AS depth FROM flow WHERE {near}_file_id = (SELECT id FROM busy) AND {far}_file_id IS NOT NULL
      UNION SELECT w.{far}_file_id, w.{far}_line, w.{far}_symbol, w.{far}_language, w.edge_type, h.depth + 1 FROM hop_{near} h JOIN flow w ON w.{near}_file_id = h.file_id AND w.{far}_file_id IS NOT NULL WHERE h.depth < {depth}),
      all_{near} AS (SELECT file_id, line, symbol, language, edge_type, depth FROM hop_{near}
      UNION SELECT {near}_file_id, {near}_line, {near}_symbol, {near}_language, edge_type, CAST(0 AS INTEGER) FROM (SELECT source_file_id, source_line, source_symbol, source_language, target_file_id, target_line, target_symbol, target_language, edge_type FROM flow) WHERE {near}_file_id = (SELECT id FROM busy))"""


_FLOW_VIEWS = with_views("e", "flow").replace("flow AS", "flow AS")
_END = "SELECT a.depth, f.path, a.line, a.symbol, a.language, a.edge_type"


@query(f"{_FLOW_VIEWS}, {BUSY}, {_flow('source', 'target', 3)} {_END} FROM all_source a JOIN files f ON f.id = a.file_id".replace("source_line, source_symbol", "source_line, source_symbol"))
def gra_flow_forward(g):
    return graph.trace_flow(g, _busy_file(g), 3)


@query(f"{_FLOW_VIEWS}, {BUSY}, {_flow('target', 'source', 3)} {_END} FROM all_target a JOIN files f ON f.id = a.file_id")
def gra_flow_reverse(g):
    return graph.trace_flow(g, _busy_file(g), 3, reverse=True)


@query(f"{_FLOW_VIEWS}, {BUSY}, {_flow('source', 'target', 2)}, {_flow('target', 'source', 2)} {_END}, 'forward' AS way FROM all_source a JOIN files f ON f.id = a.file_id UNION ALL {_END}, 'backward' FROM all_target a JOIN files f ON f.id = a.file_id")
def gra_flow_bidirectional(g):
    return graph.trace_both(g, _busy_file(g), 2)


@query(f"""{with_views('e', 'flow')} SELECT w.edge_type, a.path AS source_path, count(*) AS steps, count(DISTINCT b.path) AS targets, min(b.path) AS first_target FROM flow w JOIN files a ON a.id = w.source_file_id JOIN files b ON b.id = w.target_file_id
    WHERE w.source_language = 'typescript' AND w.target_language = 'csharp' GROUP BY 1, 2""")
def gra_cross_language(g):
    return graph.cross_language(g, "typescript", "csharp")


@query(f"""{with_views('e', 'flow')}, r AS (SELECT row_number() OVER (PARTITION BY w.edge_type ORDER BY f.path, w.source_line NULLS FIRST, w.source_id, w.target_id) AS turn, w.edge_type, f.path AS source_path, w.source_line, w.source_symbol, w.target_symbol
    FROM flow w JOIN files f ON f.id = w.source_file_id) SELECT CAST(turn AS INTEGER) AS turn, edge_type, source_path, source_line, source_symbol, target_symbol FROM r ORDER BY turn, edge_type LIMIT 50""")
def gra_flow_interleave(g):
    return graph.interleaved(g)


@query(f"""{with_views('sym', 'e')}, {HOT_OWN}, n AS (SELECT id FROM symbols WHERE file_id IN (SELECT id FROM files WHERE project = (SELECT f.project FROM files f JOIN symbols s ON s.file_id = f.id WHERE s.id = (SELECT id FROM hot))))
    SELECT source_id, target_id, kind, max(confidence) AS confidence FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) GROUP BY 1, 2, 3""")
def gra_subgraph_project(g):
    f = g.files.select(F.col("id").alias("file_id"), "project")
    project = g.symbols.filter(F.col("id") == _hot(g, own=True)[0]).join(f, "file_id").first()["project"]
    return graph.subgraph(g, g.symbols.join(f.filter(F.col("project") == project), "file_id", "left_semi"))


@query(f"""{with_views('e')}, c AS (SELECT id AS file_id FROM files WHERE language = 'go'), d AS (SELECT DISTINCT s.file_id FROM e JOIN symbols s ON s.id = e.source_id JOIN symbols t ON t.id = e.target_id WHERE t.file_id IN (SELECT file_id FROM c))
    SELECT file_id FROM d WHERE file_id NOT IN (SELECT file_id FROM c)""")
def gra_dependents(g):
    return graph.dependent_files(g, g.files.filter("language = 'go'").select(F.col("id").alias("file_id")))


@query(f"{with_views('sym', 'e', 'refs')} SELECT DISTINCT file_id FROM refs WHERE target_name IN (SELECT name FROM runtime_symbols)")
def gra_newly_resolvable(g):
    return graph.newly_resolvable(g.refs, g.read("runtime_symbols"))


@query()
def gra_full_trace(g):
    return graph.trace_trees(g, g.spark.createDataFrame([(_hot(g, own=True)[0],)], "id long"), 4)


@query()
def gra_entry_traces(g):
    return graph.entry_traces(g, 40, 3)


@query(f"""{with_views('e')}, o AS (SELECT source_id AS id, count(*) AS outgoing FROM e GROUP BY 1), i AS (SELECT target_id AS id, count(*) AS incoming FROM e GROUP BY 1)
    SELECT s.id, coalesce(i.incoming, 0) AS incoming, o.outgoing FROM symbols s JOIN o USING (id) LEFT JOIN i USING (id) WHERE s.kind IN ('class', 'struct', 'method', 'function') ORDER BY coalesce(i.incoming, 0) > 0, o.outgoing DESC, s.id LIMIT 40""")
def gra_entry_roots(g):
    return graph.entry_roots(g, 40)


# -- resolution ------------------------------------------------------------------------
_FIT = "(kind = 'calls' AND sym_kind IN ('method', 'function', 'constructor', 'test')) OR (kind = 'inherits' AND sym_kind IN ('class', 'struct')) OR (kind = 'implements' AND sym_kind = 'interface') OR (kind = 'instantiates' AND sym_kind IN ('class', 'struct')) OR (kind = 'type_ref' AND sym_kind IN ('class', 'struct', 'interface', 'enum', 'type_alias', 'namespace', 'delegate')) OR kind NOT IN ('calls', 'inherits', 'implements', 'instantiates', 'type_ref')"
_STEM = r"regexp_replace({}, '\.(ts|tsx|js|cs)$', '')"
_BARE = _STEM.format(r"regexp_replace({}, '^(\.{{1,2}}/)+', '')")


def _fits_path(path: str, module: str) -> str:
    """A path that answers to a module: ends with it, raw or with dots as slashes, or holds its last part."""
    stem, bare = _STEM.format(path), _BARE.format(module)
    last = f"regexp_extract({bare}, '[^./]*$')"
    return f"coalesce({module} <> '' AND (ends_with({stem}, {bare}) OR ends_with({stem}, replace({bare}, '.', '/')) OR (length({last}) > 0 AND contains({path}, {last}))), false)"


# written from the description of the steps, reference by reference
_LADDER = f"""r AS (SELECT DISTINCT source_id, target_name, kind, file_id FROM refs), s AS (SELECT sym.id, sym.name, sym.qualified_name, sym.kind AS sym_kind, f.path, count(*) OVER (PARTITION BY sym.name) AS namesakes FROM sym LEFT JOIN files f ON f.id = sym.file_id),
    plain AS (SELECT * FROM r WHERE NOT contains(target_name, '.')),
    first_import AS (SELECT file_id, imported_name, module_path FROM (SELECT *, row_number() OVER (PARTITION BY file_id, imported_name ORDER BY line NULLS LAST, module_path NULLS FIRST) AS n FROM imp) WHERE n = 1),
    space AS (SELECT file_id, qualified_name AS space FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line NULLS FIRST, id) AS n FROM symbols WHERE kind = 'namespace') WHERE n = 1),
    c1 AS (SELECT p.source_id, p.target_name, p.kind, 1 AS step, s.id AS target_id, {_fits_path('s.path', 'i.module_path')} AS by_path FROM plain p JOIN first_import i ON i.file_id = p.file_id AND i.imported_name = p.target_name AND i.module_path <> '' JOIN s ON s.name = p.target_name
      WHERE s.namesakes = 1 OR {_fits_path('s.path', 'i.module_path')}),
    c2 AS (SELECT p.source_id, p.target_name, p.kind, 2, s.id FROM plain p JOIN (SELECT file_id, module_path AS prefix FROM imp UNION SELECT file_id, imported_name FROM imp) m ON m.file_id = p.file_id AND contains(m.prefix, '.') JOIN s ON s.qualified_name = m.prefix || '.' || p.target_name),
    c3 AS (SELECT r.source_id, r.target_name, r.kind, 3, s.id FROM r JOIN s ON s.qualified_name = r.target_name WHERE contains(r.target_name, '.')),
    c4 AS (SELECT p.source_id, p.target_name, p.kind, 4, s.id FROM plain p JOIN space n ON n.file_id = p.file_id JOIN s ON s.qualified_name = n.space || '.' || p.target_name),
    c5 AS (SELECT p.source_id, p.target_name, p.kind, 5, s.id FROM plain p JOIN (SELECT DISTINCT file_id, module_path FROM imp WHERE module_path <> '') m ON m.file_id = p.file_id JOIN s ON s.name = p.target_name
      WHERE s.qualified_name = m.module_path OR starts_with(s.qualified_name, m.module_path || '.') OR {_fits_path('s.path', 'm.module_path')}),
    six AS (SELECT target_name, kind, target_id FROM (SELECT k.target_name, k.kind, s.id AS target_id, row_number() OVER (PARTITION BY k.target_name, k.kind ORDER BY CASE WHEN {_FIT.replace('kind =', 'k.kind =').replace('sym_k.kind', 'sym_kind').replace('OR kind NOT', 'OR k.kind NOT')} THEN 0 ELSE 1 END, s.id) AS n FROM (SELECT DISTINCT target_name, kind FROM plain) k JOIN s ON s.name = k.target_name) WHERE n = 1),
    c6 AS (SELECT p.source_id, p.target_name, p.kind, 6, x.target_id FROM plain p JOIN six x ON x.target_name = p.target_name AND x.kind = p.kind),
    best AS (SELECT source_id, target_name, kind, step, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_name, kind ORDER BY step, target_id) AS n FROM (SELECT source_id, target_name, kind, step, target_id FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5 UNION ALL SELECT * FROM c6)) WHERE n = 1)"""
_CONF = "CAST(CASE step WHEN 1 THEN 0.95 WHEN 2 THEN 0.92 WHEN 3 THEN 0.90 WHEN 4 THEN 0.85 WHEN 5 THEN 0.80 ELSE 0.50 END AS DOUBLE)"
_ALL = with_views("sym", "e", "imp", "refs")


@query(f"{_ALL}, {_LADDER} SELECT source_id, target_name, kind, step, target_id, {_CONF} AS confidence FROM best")
def res_ladder(g):
    return resolve(g)


@query(f"{_ALL}, {_LADDER} SELECT x.source_id, x.file_id, x.target_name, x.kind, x.line FROM refs x WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.source_id = x.source_id AND b.target_name = x.target_name AND b.kind = x.kind)")
def res_unresolved(g):
    return unresolved(g)


@query(f"{_ALL}, {_LADDER} SELECT step, {_CONF} AS confidence, count(*) AS n FROM best GROUP BY 1, 2")
def res_histogram(g):
    return resolve(g).groupBy("step", "confidence").agg(F.count("*").alias("n"))


# -- search ----------------------------------------------------------------------------
_WORDS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', name, qualified_name, signature, doc_comment)), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0)"


@query(f"""WITH d AS (SELECT id, name, qualified_name, kind, {_WORDS} AS w FROM symbols), c AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: x = 'returned')) AS tf FROM d),
    t AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM c)
    SELECT id, round(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score, name, qualified_name, kind FROM c, t WHERE tf > 0 ORDER BY score DESC, id LIMIT 500""")
def sea_bm25_symbols(g):
    return search.search_symbols(g, "returned")


@query("SELECT id, CAST(0.0 AS DOUBLE) AS score, name, qualified_name, kind FROM symbols WHERE name ILIKE '%ware_ouse%' OR qualified_name ILIKE '%ware_ouse%'")
def sea_like_fallback(g):
    return search.like_symbols(g, "ware_ouse")


@query("""WITH s AS (SELECT file_id, lower(content) AS b FROM source_files) SELECT s.file_id, f.path, CAST((length(b) - length(replace(b, 'warehouse', ''))) / 9 + (length(b) - length(replace(b, 'copyright', ''))) / 9 AS INTEGER) AS hits
    FROM s JOIN files f ON f.id = s.file_id WHERE contains(b, 'warehouse') OR contains(b, 'copyright')""")
def sea_content(g):
    return search.search_content(g, "Warehouse copyright")


_LINES = "l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM source_files), t AS (SELECT file_id, CAST(line AS INTEGER) AS line, regexp_replace(raw, '\\r$', '') AS text FROM l)"


@query(f"""WITH {_LINES} SELECT f.path, t.line, CAST(octet_length(encode(substr(text, 1, strpos(text, 'log.debug(') - 1))) AS INTEGER) AS start, CAST(octet_length(encode(substr(text, 1, strpos(text, 'log.debug(') - 1))) + 10 AS INTEGER) AS "end", text FROM t JOIN files f ON f.id = t.file_id WHERE contains(text, 'log.debug(')""")
def sea_grep_literal(g):
    return search.grep(g, "log.debug(")


@query(f"""WITH {_LINES}, m AS (SELECT *, regexp_extract(text, '(?i)raise\\s+\\w+error') AS hit FROM t WHERE regexp_matches(text, '(?i)raise\\s+\\w+error'))
    SELECT f.path, m.line, CAST(octet_length(encode(substr(text, 1, strpos(text, hit) - 1))) AS INTEGER) AS start, CAST(octet_length(encode(substr(text, 1, strpos(text, hit) - 1))) + octet_length(encode(hit)) AS INTEGER) AS "end", text FROM m JOIN files f ON f.id = m.file_id WHERE f.language = 'python'""")
def sea_grep_regex(g):
    return search.grep(g, r"raise\s+\w+error", regex=True, ignore_case=True, languages=["Python"])


@query(f"""WITH {_LINES}, b AS (SELECT octet_length(encode(substr(text, 1, strpos(text, 'Copyright') - 1))) AS at, * FROM t WHERE contains(text, 'Copyright'))
    SELECT f.path, b.line, CAST(b.at AS INTEGER) AS start, CAST(b.at + 9 AS INTEGER) AS "end", b.text FROM b JOIN files f ON f.id = b.file_id WHERE NOT regexp_matches(f.path, '(^|/)node_modules/')""")
def sea_content_lines(g):
    return search.content_lines(g, "Copyright", exclude=["**/node_modules/**"])


@query("SELECT id, path FROM files WHERE (language = 'java' OR language = 'go') AND NOT regexp_matches(path, '(^|/)vendor(/|$)') AND starts_with(path, 'harbor-monolith/')")
def sea_scope(g):
    return g.files.filter(sc.in_scope("path", "language", languages=["Java", "GO"], folder="harbor-monolith", exclude=["**/vendor/**"])).select("id", "path")


@query()
def sea_fuzzy_files(g):
    return search.fuzzy(g.files.select("id", "path"), "path", "srcmeter")


@query()
def sea_fuzzy_symbols(g):
    return search.fuzzy(g.symbols.select("id", "qualified_name"), "qualified_name", "Serv")


def _vector(g) -> list[float]:
    return g.read("embeddings").orderBy("vec_id").first()["embedding"]


_Q = "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"WITH {_Q} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 100")
def sea_knn(g):
    return search.knn(g.read("embeddings"), _vector(g))


_COS = "round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) * sqrt(list_sum(list_transform(CAST(q.v AS DOUBLE[]), lambda x: x * x)))), 6)"


@query(f"WITH {_Q} SELECT vec_id, {_COS} AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 100")
def sea_cosine(g):
    return search.cosine_top(g.read("embeddings"), _vector(g))


_DIST = "round(sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6)"


@query(f"WITH {_Q}, r AS (SELECT vec_id, {_DIST} AS d FROM embeddings, q) SELECT vec_id AS id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY d, vec_id)), 9) AS score FROM r ORDER BY d, vec_id LIMIT 20")
def sea_semantic(g):
    return search.semantic(g.read("embeddings"), _vector(g))


@query(f"""WITH {_Q}, w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0) AS w FROM documents), c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'warehouse')) AS tf FROM w),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM c),
    t AS (SELECT id, round(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE tf > 0 ORDER BY score DESC, id LIMIT 40),
    a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM t), k AS (SELECT vec_id AS id, {_DIST} AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 40), b AS (SELECT id, row_number() OVER (ORDER BY d, id) AS r FROM k)
    SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b ON a.id = b.id ORDER BY score DESC, id LIMIT 20""")
def sea_hybrid(g):
    docs = g.read("documents").select(F.col("doc_id").alias("id"), search.words("text").alias("words"))
    return search.hybrid(docs, g.read("embeddings"), ["warehouse"], _vector(g))


@query()
def sea_embed(g):
    return search.embed(g.read("code_chunks").select("id", F.col("content").alias("text")))


_HIST = "h AS (SELECT CAST(user_id AS VARCHAR) AS query, event_type AS query_type, count(*) AS use_count, max(ts) AS last_used_at, bool_or(value > 99) AS is_saved FROM events GROUP BY 1, 2)"


def _log(g):
    return search.history(g.read("events").select(F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("query_type"), F.col("ts").alias("at"), (F.col("value") > 99).alias("saved")))


@query(f"WITH {_HIST} SELECT * FROM h")
def hist_entries(g):
    return _log(g)


@query(f"WITH {_HIST} SELECT * FROM h WHERE is_saved UNION ALL (SELECT * FROM h WHERE NOT is_saved ORDER BY last_used_at DESC, query, query_type LIMIT 50)")
def hist_prune(g):
    return search.prune_history(_log(g), 50)


@query()
def ctx_smart(g):
    return concepts.smart_context(g, "drain the warehouse ledger")


# -- concepts --------------------------------------------------------------------------
_CON = "c AS (SELECT DISTINCT split_part(qualified_name, '.', 1) || '.' || split_part(qualified_name, '.', 2) AS name FROM symbols WHERE len(string_split(qualified_name, '.')) >= 3)"
_MEM = "m AS (SELECT c.name, s.id AS symbol_id FROM c JOIN symbols s ON starts_with(lower(s.qualified_name), lower(c.name) || '.'))"


@query(f"WITH {_CON} SELECT name, name || '.*' AS pattern FROM c")
def con_discover(g):
    return concepts.discover(g)


_MEM_EQ = "m AS (SELECT c.name, s.id AS symbol_id FROM c JOIN symbols s ON lower(split_part(s.qualified_name, '.', 1) || '.' || split_part(s.qualified_name, '.', 2)) = lower(c.name) AND len(string_split(s.qualified_name, '.')) >= 3)"


@query(f"WITH {_CON}, {_MEM_EQ} SELECT * FROM m")
def con_assign(g):
    return concepts.assign(g, concepts.discover(g))


@query(f"WITH {_CON}, {_MEM_EQ} SELECT c.name, count(m.symbol_id) AS members FROM c LEFT JOIN m USING (name) GROUP BY 1")
def con_list(g):
    c = concepts.discover(g)
    return concepts.listed(c, concepts.assign(g, c))


@query("""SELECT split_part(f.path, '/', 1) || '/' || split_part(f.path, '/', 2) AS name, split_part(f.path, '/', 1) || '/' || split_part(f.path, '/', 2) || '/*' AS pattern, count(*) AS symbols
    FROM files f JOIN symbols s ON s.file_id = f.id GROUP BY 1 HAVING count(*) >= 3""")
def con_directories(g):
    return concepts.folders(g)


# -- connectors ------------------------------------------------------------------------
@query()
def cnx_facts(g):
    return connectors.scan(g)


@query()
def cnx_routes(g):
    return connectors.routes(connectors.scan(g))


@query()
def cnx_flows(g):
    return connectors.all_flows(cut_lineage(connectors.scan(g)), g.symbols, g.files, g.edges)


_URLS = "u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https://docs[.]example[.]invalid(/\\w+/\\w+)', 1)) AS url FROM documents)"
_RT = "rt AS (SELECT row_number() OVER (ORDER BY s) AS route_id, '/' || s || '/{id}' AS template FROM (SELECT DISTINCT split_part(url, '/', 2) AS s FROM u))"


@query(f"WITH {_URLS}, {_RT}, k AS (SELECT DISTINCT url FROM u) SELECT k.url AS call_id, rt.route_id, CAST(0.8 AS DOUBLE) AS confidence FROM k JOIN rt ON lower(split_part(k.url, '/', 2)) = lower(split_part(rt.template, '/', 2))")
def cnx_route_match(g):
    urls = g.read("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"https://docs[.]example[.]invalid(/\w+/\w+)"), 1)).alias("url")).distinct()
    heads = urls.select(F.element_at(F.split("url", "/"), 2).alias("s")).distinct()
    # the heads are words of paths, few enough to number in one place
    rts = heads.select(F.row_number().over(Window.orderBy("s")).cast("long").alias("route_id"), F.concat(F.lit("/"), "s", F.lit("/{id}")).alias("template"), F.lit("GET").alias("method"))
    return connectors.match_routes(urls.select(F.col("url").alias("call_id"), F.lit("get").alias("method"), "url"), rts)


# -- maintenance -----------------------------------------------------------------------
@query("SELECT coalesce(f.path, s.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'deleted' WHEN f.hash = sha256(s.content) THEN 'unchanged' ELSE 'modified' END AS change FROM files f FULL JOIN source_files s ON s.path = f.path")
def inc_changes(g):
    return maintain.detect_changes(g.files.select("path", "hash"), maintain.hashed(g.read("source_files")).select("path", "hash"))


@query("SELECT path, sha256(content) AS hash, CAST(octet_length(encode(content)) AS INTEGER) AS size, CAST(len(string_split(content, chr(10))) AS INTEGER) AS lines FROM source_files")
def src_hashes(g):
    return maintain.hashed(g.read("source_files"))


@query("SELECT id, CASE regexp_extract(path, '[.]([A-Za-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'cs' THEN 'csharp' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'rb' THEN 'ruby' WHEN 'css' THEN 'css' END AS language FROM files")
def src_languages(g):
    return g.files.select("id", walker.language_of("path").alias("language"))


@query("SELECT id FROM files WHERE NOT regexp_matches(path, '(^|/)([.][^/]*|" + "|".join(x for x in walker.EXCLUDED if x[0] != ".") + ")/')")
def src_kept(g):
    return g.files.filter(walker.kept("path")).select("id")


@query(f"{with_views('e')} SELECT * FROM e")
def snk_edges(g):
    return g.edges


@query("""WITH o AS (SELECT file_id, content_hash, count(*) AS o FROM code_chunks WHERE start_line > 0 GROUP BY 1, 2), n AS (SELECT file_id, content_hash, count(*) AS n FROM code_chunks WHERE end_line > 20 GROUP BY 1, 2)
    SELECT file_id, content_hash, least(coalesce(o, 0), coalesce(n, 0)) AS keep, greatest(coalesce(n, 0) - coalesce(o, 0), 0) AS insert, greatest(coalesce(o, 0) - coalesce(n, 0), 0) AS delete FROM o FULL JOIN n USING (file_id, content_hash)""")
def snk_chunk_dedup(g):
    c = g.read("code_chunks")
    return maintain.dedup_chunks(c.filter("start_line > 0"), c.filter("end_line > 20"))


@query(f"{with_views('e')}, d AS (SELECT s.id FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.language = 'ruby') SELECT * FROM e WHERE source_id NOT IN (SELECT id FROM d) AND target_id NOT IN (SELECT id FROM d)")
def snk_cascade(g):
    return maintain.delete_cascade(g, g.files.filter("language = 'ruby'").select(F.col("id").alias("file_id")))["edges"]


@query("""SELECT s.project, s.path, coalesce(n.hash, s.hash) AS hash FROM files s LEFT JOIN (SELECT path, upper(hash) AS hash FROM files WHERE language = 'java') n ON n.path = s.path""")
def snk_upsert(g):
    new = g.files.filter("language = 'java'").select("project", "path", F.upper("hash").alias("hash"))
    return maintain.upsert(g.files.select("project", "path", "hash"), new, ["path"]).select("project", "path", "hash")


@query(f"{with_views('e')}, c AS (SELECT source_id, target_id, max(confidence) AS sure FROM e WHERE kind IN ('lsp_resolved', 'scip_ref') GROUP BY 1, 2) SELECT e.source_id, e.target_id, e.kind, e.source_line, greatest(e.confidence, coalesce(c.sure, 0)) AS confidence FROM e LEFT JOIN c USING (source_id, target_id)")
def brg_raise(g):
    return maintain.raise_confidence(g.edges, g.edges.filter(F.col("kind").isin("lsp_resolved", "scip_ref"))).select("source_id", "target_id", "kind", "source_line", "confidence")


@query(f"""{with_views('e')}, x AS (SELECT s.id FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.language = 'typescript')
    SELECT source_id, target_id, kind, source_line, CASE WHEN kind IN ('lsp_resolved', 'scip_ref') AND source_id IN (SELECT id FROM x) THEN 0.5 ELSE confidence END AS confidence FROM e""")
def brg_invalidate(g):
    return maintain.invalidate(g, g.files.filter("language = 'typescript'").select(F.col("id").alias("file_id"))).select("source_id", "target_id", "kind", "source_line", "confidence")


@query(f"{with_views('e')} SELECT * FROM e WHERE confidence < 0.8 ORDER BY confidence, source_id, target_id, kind, source_line NULLS FIRST LIMIT 200")
def brg_low_confidence(g):
    return maintain.low_confidence_batch(g.edges, 200)


@query(f"""{with_views('sym', 'e', 'refs')}, i AS (SELECT target_id, count(*) AS n FROM e GROUP BY 1) SELECT r.source_id, r.target_name, r.kind, coalesce(i.n, 0) AS incoming FROM refs r LEFT JOIN i ON i.target_id = r.source_id
    WHERE r.target_name LIKE 'Missing%' ORDER BY incoming DESC, r.source_id, r.target_name, r.kind LIMIT 100""")
def brg_unresolved_batch(g):
    return maintain.unresolved_batch(g.refs.filter(F.startswith("target_name", F.lit("Missing"))), navigation.degrees(g), 100)


# -- extraction, functions, budgets ----------------------------------------------------
@query()
def ext_symbols(g):
    return extract.extract_symbols(g.files, g.read("source_files")).drop("refs")


@query()
def ext_refs(g):
    return extract.extract_refs(extract.extract_symbols(g.files, g.read("source_files"))).groupBy("file_id", "kind", "target_name").agg(F.count("*").alias("n"))


@query()
def ext_chunks(g):
    return extract.chunk_files(g.symbols, g.read("source_files")).select("file_id", "symbol_id", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query("""SELECT id, CASE WHEN regexp_matches(name, '(?i)[^aeiou]y$') THEN regexp_replace(name, 'y$', '') || 'ies' WHEN regexp_matches(name, '(?i)(s|x|z|ch|sh)$') THEN name || 'es' ELSE name || 's' END AS plural,
    CAST(ceil(length(signature) / 4.0) AS BIGINT) AS tokens, split_part(qualified_name, '.', 1) AS head FROM symbols""")
def sca_names(g):
    return g.symbols.select("id", sc.plural("name").alias("plural"), sc.token_estimate("signature").alias("tokens"), sc.first_segments("qualified_name", ".", 1).alias("head"))


@query("""WITH t AS (SELECT id, incoming, CASE kind WHEN 'class' THEN 200 WHEN 'struct' THEN 200 WHEN 'method' THEN 100 WHEN 'function' THEN 100 WHEN 'interface' THEN 80 ELSE 60 END AS tokens FROM (SELECT s.id, s.kind, count(*) AS incoming FROM edges e JOIN symbols s ON s.id = e.target_id GROUP BY 1, 2) ORDER BY incoming DESC, id LIMIT 200),
    r AS (SELECT id, incoming, tokens, sum(tokens) OVER (ORDER BY incoming DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM t) SELECT id, incoming, tokens, CAST(total AS BIGINT) AS total FROM r WHERE total <= 4000""")
def win_budget(g):
    n = g.read("edges").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("incoming"))
    cost = F.coalesce(F.create_map(*[F.lit(x) for kv in concepts.TOKENS.items() for x in kv])[F.col("kind")], F.lit(concepts.OTHER_TOKENS))
    top = n.join(g.symbols.select("id", "kind"), "id").orderBy(F.desc("incoming"), "id").limit(200)
    return concepts.budgeted(top.select("id", "incoming", cost.alias("tokens")), [F.desc("incoming"), "id"], 4000)


# -- compositions ----------------------------------------------------------------------
@query()
def cnx_route_handlers(g):
    return connectors.routes_with_handlers(cut_lineage(connectors.scan(g)), g.symbols)


@query(f"WITH {_CON}, {_MEM_EQ}, top AS (SELECT name FROM m GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 1) SELECT s.id, s.qualified_name, s.kind FROM m JOIN symbols s ON s.id = m.symbol_id WHERE m.name = (SELECT name FROM top)")
def con_members(g):
    m = concepts.assign(g, concepts.discover(g))
    name = m.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").first()[0]
    return g.symbols.join(m.filter(F.col("name") == name).select(F.col("symbol_id").alias("id")), "id", "left_semi").select("id", "qualified_name", "kind")


@query(f"""{with_views('e')}, {_CON}, {_MEM_EQ}, top AS (SELECT name FROM m GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 1), n AS (SELECT symbol_id AS id FROM m WHERE name = (SELECT name FROM top))
    SELECT source_id, target_id, kind, max(confidence) AS confidence FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) GROUP BY 1, 2, 3""")
def gra_subgraph_concept(g):
    return graph.subgraph(g, con_members(g))


@query(f"""{with_views('e')}, {_CON}, {_MEM_EQ}, c1 AS (SELECT symbol_id, min(name) AS concept FROM m GROUP BY 1), o AS (SELECT source_id, count(*) AS n FROM e GROUP BY 1)
    SELECT s.id, c1.concept, coalesce(o.n, 0) AS n FROM symbols s LEFT JOIN c1 ON c1.symbol_id = s.id LEFT JOIN o ON o.source_id = s.id""")
def agg_first_concept(g):
    out = g.edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    first = concepts.assign(g, concepts.discover(g)).groupBy(F.col("symbol_id").alias("id")).agg(F.min("name").alias("concept"))
    return g.symbols.select("id").join(first, "id", "left").join(out, "id", "left").select("id", "concept", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{with_views('sym', 'e')}, {HOT}, {_Q}, p AS (SELECT DISTINCT s.file_id, e.source_line AS line, e.source_id FROM e JOIN symbols s ON s.id = e.source_id WHERE e.target_id = (SELECT id FROM hot) AND e.source_line IS NOT NULL),
    m AS (SELECT p.file_id, p.line, c.id AS chunk_id, row_number() OVER (PARTITION BY p.file_id, p.line ORDER BY c.end_line - c.start_line, c.id) AS k FROM (SELECT DISTINCT file_id, line FROM p) p JOIN code_chunks c ON c.file_id = p.file_id AND p.line BETWEEN c.start_line AND c.end_line),
    v AS (SELECT vec_id, {_COS} AS similarity FROM embeddings, q) SELECT p.file_id, p.line, p.source_id, m.chunk_id, v.similarity FROM p JOIN m ON m.file_id = p.file_id AND m.line = p.line AND m.k = 1 LEFT JOIN v ON v.vec_id = m.chunk_id""")
def sea_rerank(g):
    s = g.symbols.select(F.col("id").alias("source_id"), "file_id")
    refs = g.edges.filter((F.col("target_id") == _hot(g)[0]) & F.col("source_line").isNotNull()).join(s, "source_id").select("file_id", F.col("source_line").alias("line"), "source_id").distinct()
    at = navigation.chunk_at(refs.select("file_id", "line").distinct(), g.read("code_chunks"))
    return search.rerank(refs.join(at, ["file_id", "line"]), g.read("embeddings"), _vector(g)).select("file_id", "line", "source_id", "chunk_id", "similarity")


@query("SELECT id FROM code_chunks WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def sea_embed_missing(g):
    return search.missing_vectors(g.read("code_chunks"), g.read("embeddings")).select("id")


@query(f"{with_views('e')}, n AS (SELECT source_id, target_id, kind, source_line FROM e WHERE kind = 'lsp_resolved') SELECT e.source_id, e.target_id, e.kind, e.source_line, CASE WHEN e.kind = 'lsp_resolved' THEN 1.0 ELSE e.confidence END AS confidence FROM e")
def brg_persist(g):
    return maintain.persist_edges(g.edges, g.edges.filter("kind = 'lsp_resolved'"))


def _reindexed(g):
    changed = maintain.detect_changes(g.files.select("path", "hash"), maintain.hashed(g.read("source_files")).select("path", "hash")).filter("change <> 'unchanged'")
    return reindex(g, changed, g.read("source_files").select("path", "content"), unresolved(g))


@query()
def inc_reindex_symbols(g):
    return _reindexed(g)["symbols"]


@query()
def inc_reindex_edges(g):
    return _reindexed(g)["edges"]


@query()
def inc_reindex_touched(g):
    return _reindexed(g)["touched"]


# -- the whole index, and every framework on a small tree of texts ------------------------
@query()
def idx_edges(g):
    return build_index(g.read("source_files"), g.read("runtime_symbols"))["edges"]


def _fixture(g):
    index = build_index(g.spark.createDataFrame(sorted(TEXTS.items()), "path string, content string"))
    return index, cut_lineage(connectors.scan_texts(index["files"], g.spark.createDataFrame(sorted(TEXTS.items()), "path string, content string").join(index["files"].select("path", F.col("id").alias("file_id")), "path")))


def _paths(df, index, *ids):
    for i in ids:
        df = df.join(index["files"].select(F.col("id").alias(f"{i}_file_id"), F.col("path").alias(f"{i}_path")), f"{i}_file_id")
    return df


@query("""SELECT * FROM (VALUES
    ('di_binding', 'shop/java/Billing.java', 2, 'shop/java/BillingService.java', 3, CAST(0.85 AS DOUBLE), 'BillingService'),
    ('di_binding', 'shop/ng/page.ts', 3, 'shop/ng/data.service.ts', 1, CAST(0.85 AS DOUBLE), 'DataService'),
    ('di_binding', 'shop/server/Repo.cs', 2, 'shop/server/Repo.cs', 5, CAST(0.9 AS DOUBLE), 'Repo'),
    ('django_model', 'shop/py/models.py', 1, 'shop/py/models.py', 1, CAST(0.95 AS DOUBLE), 'Category'),
    ('django_view', 'shop/py/views.py', 1, 'shop/py/views.py', 1, CAST(0.85 AS DOUBLE), 'about'),
    ('django_view', 'shop/py/views.py', 4, 'shop/py/views.py', 4, CAST(0.9 AS DOUBLE), 'PostView'),
    ('electron_ipc', 'shop/web/desk.ts', 1, 'shop/desk/main.js', 1, CAST(0.9 AS DOUBLE), 'save'),
    ('event_handler', 'shop/server/Events.cs', 2, 'shop/server/Events.cs', 3, CAST(0.9 AS DOUBLE), 'OrderPaid'),
    ('graphql_resolver', 'shop/schema.graphql', 2, 'shop/py/resolvers.py', 1, CAST(0.8 AS DOUBLE), 'user'),
    ('grpc_call', 'shop/proto/greeter.proto', 2, 'shop/server/Greeter.cs', 4, CAST(0.9 AS DOUBLE), 'SayHello'),
    ('http_call', 'shop/server/Repo.cs', 10, 'shop/server/UsersController.cs', 5, CAST(0.9 AS DOUBLE), 'api/users/{*}?full=1'),
    ('http_call', 'shop/server/Repo.cs', 15, 'shop/server/Program.cs', 2, CAST(0.9 AS DOUBLE), 'orders'),
    ('http_call', 'shop/web/api.ts', 2, 'shop/server/UsersController.cs', 5, CAST(0.8 AS DOUBLE), '/api/users/7'),
    ('http_call', 'shop/web/api.ts', 3, 'shop/server/Program.cs', 2, CAST(1.0 AS DOUBLE), '/orders'),
    ('http_call', 'shop/web/api.ts', 4, 'shop/java/BillController.java', 5, CAST(0.8 AS DOUBLE), '/bills/3'),
    ('http_call', 'shop/web/api.ts', 4, 'shop/py/items.py', 4, CAST(1.0 AS DOUBLE), '/v1/items/${id}'),
    ('message_queue', 'shop/web/queue.ts', 1, 'shop/java/BillingService.java', 4, CAST(0.85 AS DOUBLE), 'paid'),
    ('tauri_event', 'shop/tauri/lib.rs', 3, 'shop/web/desk.ts', 1, CAST(0.9 AS DOUBLE), 'greeted'),
    ('tauri_ipc', 'shop/web/desk.ts', 1, 'shop/tauri/lib.rs', 1, CAST(0.95 AS DOUBLE), 'greet')) AS t(edge_type, source_path, source_line, target_path, target_line, confidence, url_pattern)""")
def fix_flows(g):
    index, facts = _fixture(g)
    flows = _paths(connectors.all_flows(facts, index["symbols"], index["files"], index["edges"]), index, "source", "target")
    return flows.select("edge_type", "source_path", "source_line", "target_path", "target_line", "confidence", "url_pattern")


@query("""SELECT * FROM (VALUES
    ('DELETE', '/bills/{id}', 'shop/java/BillController.java', 5, 'drop'),
    ('GET', '/about', 'shop/py/urls.py', 3, 'about'),
    ('GET', '/admin/photos', 'shop/config/routes.rb', 3, NULL),
    ('GET', '/admin/photos/{id}', 'shop/config/routes.rb', 3, NULL),
    ('GET', '/api/users/{id}', 'shop/server/UsersController.cs', 5, 'Get'),
    ('GET', '/cats/:id', 'shop/nest/cats.ts', 3, 'one'),
    ('GET', '/g/x/:id', 'shop/go/main.go', 4, NULL),
    ('GET', '/ping', 'shop/go/main.go', 5, NULL),
    ('GET', '/shop/cart', 'shop/php/web.php', 3, NULL),
    ('GET', '/v1/items/{item}', 'shop/py/items.py', 4, 'read'),
    ('POST', '/orders', 'shop/server/Program.cs', 2, NULL)) AS t(http_method, route_template, route_path, line, handler)""")
def fix_routes(g):
    index, facts = _fixture(g)
    names = index["symbols"].select(F.col("id").alias("symbol_id"), F.col("name").alias("handler"))
    r = connectors.routes_with_handlers(facts, index["symbols"]).join(names, "symbol_id", "left").withColumnRenamed("file_id", "route_file_id")
    return _paths(r, index, "route").select("http_method", "route_template", "route_path", "line", "handler")


@query("""SELECT * FROM (VALUES
    ('injectables', 'DataService'),
    ('spring-restcontroller', 'BillController'),
    ('spring-service', 'BillingService'),
    ('stores', 'useCartStore')) AS t(name, symbol)""")
def fix_concepts(g):
    index, facts = _fixture(g)
    return connectors.stereotype_concepts(facts, index["symbols"]).join(index["symbols"].select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol")), "symbol_id").select("name", "symbol")


@query("""SELECT * FROM (VALUES
    ('shop', 'Category', 'Categories', 'convention'),
    ('shop', 'Order', 'Orders', 'attribute')) AS t(project, entity_type, table_name, source)""")
def fix_mappings(g):
    index, facts = _fixture(g)
    return connectors.db_mappings(facts, index["symbols"], index["files"]).select("project", "entity_type", "table_name", "source")


@query("""SELECT * FROM (VALUES
    ('CatsController', 'Shop.Server.UsersController.Get', 'calls', 2, CAST(0.5 AS DOUBLE)),
    ('Shop.Server.Repo', 'Shop.Server.IRepo', 'implements', 4, CAST(0.85 AS DOUBLE)),
    ('shop.java.BillingService', 'shop.java.Billing', 'implements', 2, CAST(0.85 AS DOUBLE))) AS t(source, target, kind, source_line, confidence)""")
def fix_edges(g):
    index, _ = _fixture(g)
    s = index["symbols"]
    e = index["edges"].join(s.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target")), "target_id")
    return e.select("source", "target", "kind", "source_line", "confidence")


# -- looking up, continued ------------------------------------------------------------------
_BUSY_SCOPE = "sc AS (SELECT file_id, scope_path, min(name) AS name FROM symbols WHERE scope_path IS NOT NULL GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1), ask AS (SELECT file_id, scope_path, substr(name, 1, 1) AS p, CASE WHEN contains(scope_path, '.') THEN regexp_replace(scope_path, '\\.[^.]*$', '') END AS parent FROM sc)"


@query(f"""{with_views('sym', 'e', 'imp')}, {_BUSY_SCOPE}, c AS (
    SELECT s.id, s.name, s.qualified_name, s.kind, 0 AS distance FROM symbols s, ask WHERE s.file_id = ask.file_id AND s.scope_path = ask.scope_path AND starts_with(lower(s.name), lower(p))
    UNION ALL SELECT t.id, t.name, t.qualified_name, t.kind, 1 FROM sym t, ask WHERE starts_with(lower(t.name), lower(p)) AND t.name IN (SELECT imported_name FROM imp WHERE file_id = ask.file_id)
    UNION ALL SELECT s.id, s.name, s.qualified_name, s.kind, 2 FROM symbols s, ask WHERE s.scope_path = ask.parent AND starts_with(lower(s.name), lower(p))),
    r AS (SELECT c.*, CASE WHEN c.name = p THEN 100 ELSE 101 - length(c.name) END AS score FROM c, ask), t AS (SELECT *, row_number() OVER (PARTITION BY distance ORDER BY score DESC, qualified_name, id) AS k FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY distance, id) AS first FROM t WHERE k <= 200) SELECT id, name, qualified_name, kind, CAST(distance AS INTEGER) AS distance, CAST(score AS INTEGER) AS score FROM o WHERE first = 1 ORDER BY distance, score DESC, qualified_name LIMIT 30""")
def nav_completion(g):
    r = g.symbols.filter("scope_path is not null").groupBy("file_id", "scope_path").agg(F.count("*").alias("n"), F.min("name").alias("name")).orderBy(F.desc("n"), "file_id", "scope_path").first()
    return navigation.completion(g, r["file_id"], r["scope_path"], r["name"][:1])


@query(f"""{with_views('sym', 'e')}, {HOT_OWN}, a AS ({_REFS} WHERE e.kind IN ('calls', 'type_ref', 'instantiates') AND e.target_id IN (SELECT id FROM sym WHERE name = (SELECT name FROM hot)) ORDER BY f.path, e.source_line NULLS FIRST, source, e.kind, e.target_id LIMIT 10),
    b AS ({_CALLEES} (SELECT id FROM symbols WHERE name = (SELECT name FROM hot)) ORDER BY f.path NULLS FIRST, e.source_line NULLS FIRST, target, e.kind, e.source_id LIMIT 10),
    c AS ({_REFS} WHERE e.target_id IN (SELECT id FROM sym WHERE qualified_name = (SELECT qualified_name FROM hot)))
    SELECT 'caller' AS part, source AS name, path, kind FROM a UNION ALL SELECT 'callee', target, path, kind FROM b UNION ALL SELECT DISTINCT 'dependent', source, path, kind FROM c""")
def nav_investigate(g):
    return navigation.investigate(g, _hot(g, own=True)[2])


_HOT_FILE = "(SELECT file_id FROM symbols WHERE id = (SELECT id FROM hot))"


def _hot_path(g):
    return g.symbols.filter(F.col("id") == _hot(g, own=True)[0]).join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").first()["path"]


@query(f"{with_views('sym', 'e')}, {HOT_OWN} SELECT name, line FROM symbols WHERE file_id = {_HOT_FILE}")
def nav_outline_names(g):
    return navigation.file_outline(g, _hot_path(g), "names")


@query(f"{with_views('sym', 'e')}, {HOT_OWN} SELECT name, qualified_name, kind, line, end_line, scope_path, signature, doc_comment, visibility FROM symbols WHERE file_id = {_HOT_FILE}")
def nav_outline_full(g):
    return navigation.file_outline(g, _hot_path(g), "full")


@query(f"{with_views('sym', 'e')}, {HOT_OWN}, l AS (SELECT string_split(content, chr(10)) AS ls FROM source_files WHERE path = (SELECT path FROM files WHERE id = {_HOT_FILE})) SELECT CAST(i AS INTEGER) AS line, regexp_replace(ls[i], '\\r$', '') AS text FROM (SELECT ls, unnest(range(1, len(ls) + 1)) AS i FROM l)")
def nav_file_content(g):
    return navigation.file_content(g, _hot_path(g))


@query("WITH r AS (SELECT string_split(substr(path, length('harbor-monolith/') + 1), '/') AS p FROM files WHERE starts_with(path, 'harbor-monolith/')) SELECT p[1] AS name, len(p) > 1 AS is_folder, count(*) AS files FROM r GROUP BY 1, 2")
def nav_browse(g):
    return navigation.browse(g, "harbor-monolith")


@query(f"{with_views('sym', 'e', 'refs')} SELECT r.source_id, r.target_name, r.kind, r.line FROM refs r JOIN source_files s ON s.file_id = r.file_id WHERE contains(string_split(s.content, chr(10))[r.line + 1], regexp_extract(r.target_name, '[^.]*$'))")
def brg_on_line(g):
    return navigation.on_its_line(g, g.refs).select("source_id", "target_name", "kind", "line")


# -- search, continued ------------------------------------------------------------------------
_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0)"


@query(f"""WITH d AS (SELECT id, name, qualified_name, kind, {_WORDS} AS w, {_SPLIT.format("coalesce(doc_comment, '')")} AS v FROM symbols), c AS (SELECT *, len(w) AS n, len(list_filter(v, lambda x: x = 'param')) AS t1, len(list_filter(range(1, len(w)), lambda i: w[i] = 'holds' AND w[i + 1] = 'the')) AS t2 FROM d),
    t AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE t1 > 0) AS d1, count(*) FILTER (WHERE t2 > 0) AS d2 FROM c)
    SELECT id, round(greatest(1e-6, ln((docs - d1 + 0.5) / (d1 + 0.5))) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(1e-6, ln((docs - d2 + 0.5) / (d2 + 0.5))) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score, name, qualified_name, kind
    FROM c, t WHERE t1 > 0 AND t2 > 0 ORDER BY score DESC, id LIMIT 500""")
def sea_bm25_phrase(g):
    return search.search_symbols(g, 'doc_comment:param "holds the"')


@query(f"""WITH d AS (SELECT doc_id AS id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents), c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'warehouse')) AS t1, len(list_filter(w, lambda x: x = 'index')) AS t2 FROM d WHERE len(w) > 0),
    t AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE t1 > 0) AS d1, count(*) FILTER (WHERE t2 > 0) AS d2 FROM c)
    SELECT id, round(greatest(1e-6, ln((docs - d1 + 0.5) / (d1 + 0.5))) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(1e-6, ln((docs - d2 + 0.5) / (d2 + 0.5))) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, t WHERE t1 > 0 AND t2 > 0""")
def sea_postings(g):
    docs = g.read("documents").select(F.col("doc_id").alias("id"), search.words("text").alias("words"))
    return search.bm25_index(cut_lineage(search.postings(docs)), ["warehouse", "index"])


@query(SQL["sea_content"])
def sea_trigrams(g):
    index = cut_lineage(search.grams(g.read("source_files").select(F.col("file_id").alias("id"), F.col("content").alias("text"))))
    return search.search_indexed(g, index, "Warehouse copyright")


@query(f"""WITH {_Q}, s AS (SELECT file_id, lower(content) AS b FROM source_files), h AS (SELECT s.file_id, f.path, (length(b) - length(replace(b, 'warehouse', ''))) / 9 AS hits FROM s JOIN files f ON f.id = s.file_id WHERE contains(b, 'warehouse') ORDER BY hits DESC, f.path LIMIT 40),
    a AS (SELECT file_id, row_number() OVER (ORDER BY hits DESC, path) AS text_rank FROM h), k AS (SELECT vec_id AS chunk_id, {_DIST} AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 40), v AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS vector_rank FROM k),
    m AS (SELECT c.id AS chunk_id, c.file_id, round(coalesce(1.0::DOUBLE / (60 + a.text_rank), 0) + coalesce(1.0::DOUBLE / (60 + v.vector_rank), 0), 9) AS score, a.text_rank, v.vector_rank FROM code_chunks c LEFT JOIN a ON a.file_id = c.file_id LEFT JOIN v ON v.chunk_id = c.id WHERE a.text_rank IS NOT NULL OR v.vector_rank IS NOT NULL ORDER BY score DESC, c.id LIMIT 40)
    SELECT chunk_id, file_id, score, CAST(text_rank AS INTEGER) AS text_rank, CAST(vector_rank AS INTEGER) AS vector_rank FROM m JOIN files f ON f.id = m.file_id WHERE f.language <> 'css' ORDER BY score DESC, chunk_id LIMIT 20""")
def sea_hybrid_chunks(g):
    languages = [r[0] for r in g.files.select("language").distinct().collect() if r[0] != "css"]
    return search.hybrid_chunks(g, g.read("embeddings"), "warehouse", _vector(g), languages=languages)


@query("SELECT vec_id, embedding FROM embeddings")
def sca_vector_bytes(g):
    return search.unpack_vectors(search.pack_vectors(g.read("embeddings").select("vec_id", "embedding")))


@query("SELECT vec_id, CASE WHEN label = 1 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings")
def snk_vectors_upsert(g):
    v = g.read("embeddings")
    return search.upsert_vectors(v.select("vec_id", "embedding"), v.filter("label = 1").select("vec_id", F.reverse("embedding").alias("embedding")))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT c.id FROM code_chunks c JOIN files f ON f.id = c.file_id WHERE f.language = 'go')")
def snk_vectors_drop(g):
    return search.drop_vectors(g.read("embeddings"), g.read("code_chunks"), g.files.filter("language = 'go'").select(F.col("id").alias("file_id"))).select("vec_id")


# -- reports and exports, continued -------------------------------------------------------------
@query(f"{_ALL}, {_LADDER} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM refs x WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.source_id = x.source_id AND b.target_name = x.target_name AND b.kind = x.kind)) AS unresolved")
def agg_status(g):
    return aggregates.index_stats(g, unresolved=unresolved(g))


@query("SELECT 11 AS routes, 2 AS mappings")
def fix_stats(g):
    index, facts = _fixture(g)
    return aggregates.index_stats(CodeGraph(g.spark, g.folder), routes=connectors.routes(facts), mappings=connectors.db_mappings(facts, index["symbols"], index["files"])).select("routes", "mappings")


@query(f"""{with_views('sym', 'e')} SELECT 'total' AS part, 'files' AS name, NULL AS detail, count(*) AS n FROM files UNION ALL SELECT 'total', 'symbols', NULL, count(*) FROM symbols UNION ALL SELECT 'total', 'edges', NULL, count(*) FROM e
    UNION ALL SELECT 'language', f.language, count(DISTINCT f.id) || ' files', count(s.id) FROM files f LEFT JOIN symbols s ON s.file_id = f.id GROUP BY f.language
    UNION ALL (SELECT 'hotspot', t.qualified_name, t.kind, count(*) AS incoming FROM e JOIN sym t ON t.id = e.target_id GROUP BY t.id, t.qualified_name, t.kind ORDER BY incoming DESC, t.id LIMIT 10)
    UNION ALL (SELECT 'entry point', s.qualified_name, f.path, s.line FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.visibility = 'public' AND s.kind IN ('class', 'interface', 'function', 'struct') ORDER BY f.path, s.line, s.id LIMIT 20)""")
def agg_overview(g):
    return aggregates.overview(g)


@query(f"""{with_views('sym', 'e')}, h AS (SELECT t.id, t.name, t.qualified_name, t.kind, count(*) AS incoming FROM e JOIN sym t ON t.id = e.target_id GROUP BY ALL ORDER BY incoming DESC, t.id LIMIT 10)
    SELECT CAST(to_json({{'ok': true, 'data': list({{'id': id, 'name': name, 'qualified_name': qualified_name, 'kind': kind, 'incoming': incoming}} ORDER BY incoming DESC, id)}}) AS VARCHAR) AS json FROM h""")
def agg_envelope(g):
    return aggregates.envelope(aggregates.hotspots(g), [F.desc("incoming"), "id"])


@query(f"{with_views('e')}, {_METRICS} SELECT project, metric, 1000 AS least, value AS now, CASE WHEN value < 1000 THEN 'short' ELSE 'ok' END AS status FROM m")
def agg_minimum_check(g):
    now = aggregates.project_metrics(g)
    return aggregates.minimum_check(now, now.select("project", "metric", F.lit(1000).alias("least")))


@query("""SELECT CAST(to_json({'type': 'node', 'id': id, 'name': name, 'kind': kind}) AS VARCHAR) AS json FROM symbols UNION ALL
    SELECT CAST(to_json({'type': 'edge', 'source_id': source_id, 'target_id': target_id, 'kind': kind, 'confidence': max(confidence)}) AS VARCHAR) FROM edges WHERE target_id IN (SELECT id FROM symbols) GROUP BY source_id, target_id, kind""")
def gra_export_json(g):
    nodes = g.symbols.select("id", "name", "kind")
    return graph.export_json(nodes, graph.subgraph(g, nodes))


@query(f"""WITH {_CON}, {_MEM_EQ}, n AS (SELECT s.id, s.name, s.qualified_name, s.kind, f.path FROM symbols s JOIN files f ON f.id = s.file_id WHERE starts_with(s.qualified_name, 'a') ORDER BY s.qualified_name, s.id LIMIT 500)
    SELECT n.*, (SELECT min(m.name) FROM m WHERE m.symbol_id = n.id) AS concept FROM n""")
def gra_subgraph_prefix(g):
    return graph.subgraph_nodes(g, "a", 500, concepts.assign(g, concepts.discover(g)))


@query(f"{with_views('e')} SELECT * FROM e WHERE confidence < 0.8 AND kind <> 'calls' ORDER BY confidence, source_id, target_id, kind, source_line NULLS FIRST LIMIT 200")
def brg_unconfirmed(g):
    said = g.spark.createDataFrame([], "source_id long, target_id long, kind string, source_line int, source string")
    return maintain.unconfirmed(g.edges, maintain.record_provenance(said, g.edges.filter("kind = 'calls'"), "scip"), 200)


@query(f"{with_views('sym', 'e', 'refs')} SELECT source_id, wanted AS target_id, 'lsp_resolved' AS kind, line AS source_line, CAST(1.0 AS DOUBLE) AS confidence FROM refs WHERE target_name LIKE 'Missing%'")
def brg_settle(g):
    lost = g.refs.filter(F.startswith("target_name", F.lit("Missing")))
    return maintain.settle(lost, lost.select("source_id", "target_name", "line", F.col("wanted").alias("target_id")))[0]


@query(f"""{with_views('sym', 'e')}, here AS (SELECT file_id, line, min(id) AS id FROM symbols WHERE line IS NOT NULL GROUP BY 1, 2), d AS (SELECT s.qualified_name AS q, min(here.id) AS id FROM symbols s JOIN here ON here.file_id = s.file_id AND here.line = s.line GROUP BY 1), n AS (SELECT qualified_name AS q, min(id) AS id FROM sym GROUP BY 1),
    r AS (SELECT DISTINCT s.file_id, e.source_line AS line, t.qualified_name AS q FROM e JOIN symbols s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id WHERE e.kind = 'scip_ref' AND e.source_line IS NOT NULL AND s.line IS NOT NULL),
    c AS (SELECT r.file_id, r.line, s.id AS symbol_id, row_number() OVER (PARTITION BY r.file_id, r.line ORDER BY coalesce(s.end_line, s.line) - s.line, s.line DESC, s.id) AS k FROM (SELECT DISTINCT file_id, line FROM r) r JOIN symbols s ON s.file_id = r.file_id AND r.line BETWEEN s.line AND coalesce(s.end_line, s.line))
    SELECT DISTINCT c.symbol_id AS source_id, coalesce(d.id, n.id) AS target_id, 'scip_ref' AS kind, r.line AS source_line, CAST(1.0 AS DOUBLE) AS confidence FROM r JOIN c ON c.file_id = r.file_id AND c.line = r.line AND c.k = 1 LEFT JOIN d ON d.q = r.q LEFT JOIN n ON n.q = r.q WHERE coalesce(d.id, n.id) <> c.symbol_id""")
def brg_import(g):
    s = g.symbols.filter("line is not null").join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    named = F.concat(F.lit("scip . . . "), F.replace("qualified_name", F.lit("."), F.lit("/")), F.lit("#"))
    defs = s.select("path", "line", named.alias("symbol"), F.lit(True).alias("definition"))
    refs = g.edges.filter("kind = 'scip_ref' and source_line is not null").join(s.select(F.col("id").alias("source_id"), "path"), "source_id").join(g.every_symbol.select(F.col("id").alias("target_id"), named.alias("symbol")), "target_id")
    return maintain.import_occurrences(g, defs.unionByName(refs.select("path", F.col("source_line").alias("line"), "symbol", F.lit(False).alias("definition"))), navigation.enclosing)


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_MANAGERS = {"package.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "Cargo.toml": "cargo", "go.mod": "go", "pom.xml": "maven", "build.gradle": "gradle", "requirements.txt": "pip", "pyproject.toml": "python", "Gemfile": "bundler", "composer.json": "composer"}


@query(f"""WITH f AS (SELECT project, path, regexp_extract(path, '[^/]*$') AS name FROM files), a AS (
    SELECT project, 'language' AS aspect, coalesce({_case('name', walker.NAMES)}, CASE WHEN contains(name, '.') THEN {_case("lower(regexp_extract(name, '[^.]*$'))", walker.EXTENSIONS)} END) AS value FROM f
    UNION ALL SELECT project, 'manager', {_case('name', _MANAGERS)} FROM f
    UNION ALL SELECT project, 'tests', CASE WHEN regexp_matches(path, '(?i)(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\\.\\w+$|_test\\.\\w+$') THEN 'tests' END FROM f
    UNION ALL SELECT project, 'entry', CASE WHEN regexp_matches(path, '(^|/)(main|index|app|server|program|manage|Program|Main|App)\\.\\w+$') THEN name END FROM f
    UNION ALL SELECT project, 'monorepo', CASE WHEN name IN ('lerna.json', 'nx.json', 'turbo.json', 'pnpm-workspace.yaml') THEN name END FROM f
    UNION ALL SELECT project, 'environment', CASE WHEN regexp_matches(name, '^(\\.env.*|docker-compose.*|Dockerfile)$') THEN name END FROM f)
    SELECT project, aspect, value, count(*) AS n FROM a WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def src_profile(g):
    return walker.profile(g.files)


_ENDING = "regexp_extract(path, '[^.]*$')"


@query(f"SELECT id, coalesce({_case(_ENDING, walker.GREP_TAGS)}, 'unknown') AS tag FROM files")
def src_grep_tags(g):
    return g.files.select("id", walker.grep_tag("path").alias("tag"))


@query("""WITH l AS (SELECT id, split_part(content, chr(10), 1) AS t FROM code_chunks) SELECT id, CASE WHEN octet_length(encode(t)) > 60 THEN substr(t, 1, CAST(list_max(list_filter(range(0, least(60, length(t)) + 1), lambda k: octet_length(encode(substr(t, 1, CAST(k AS BIGINT)))) <= 60)) AS BIGINT)) || '…' ELSE t END AS line FROM l""")
def sca_clip(g):
    return g.read("code_chunks").select("id", sc.clip_bytes(F.substring_index("content", "\n", 1), 60).alias("line"))


@query("""WITH l AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM source_files), s AS (SELECT file_id, id AS symbol_id, line AS a, end_line AS b FROM symbols WHERE line IS NOT NULL AND end_line IS NOT NULL),
    body AS (SELECT s.file_id, s.symbol_id, s.a AS start_line, least(s.b, len(ls) - 1) AS end_line, array_to_string(list_slice(ls, s.a + 1, s.a + greatest(1, s.b - s.a + 1)), chr(10)) AS content FROM s JOIN l USING (file_id) WHERE s.a < len(ls)),
    d AS (SELECT DISTINCT file_id, a, b FROM s), w AS (SELECT file_id, a, greatest(0, coalesce(max(b + 1) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS done FROM d),
    gaps AS (SELECT file_id, done AS a, a - 1 AS b FROM w WHERE a > done UNION ALL SELECT l.file_id, greatest(0, coalesce(max(d.b + 1), 0)), max(len(ls)) - 1 FROM l LEFT JOIN d USING (file_id) GROUP BY l.file_id),
    gap AS (SELECT g.file_id, CAST(NULL AS BIGINT) AS symbol_id, g.a AS start_line, least(g.b, len(ls) - 1) AS end_line, array_to_string(list_slice(ls, g.a + 1, g.b + 1), chr(10)) AS content FROM gaps g JOIN l USING (file_id) WHERE g.a <= g.b AND g.a < len(ls))
    SELECT file_id, symbol_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, sha256(content) AS content_hash FROM (SELECT * FROM body UNION ALL SELECT * FROM gap) WHERE length(trim(regexp_replace(content, '\\s+', ' ', 'g'))) > 0""")
def ext_whole_chunks(g):
    return extract.whole_chunks(g.symbols, g.read("source_files")).select("file_id", "symbol_id", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query(f"""{with_views('e', 'flow')}, t AS (SELECT w.edge_type, a.path AS source_path, w.source_line, w.source_symbol, b.path AS target_path, w.target_line, w.target_symbol FROM flow w JOIN files a ON a.id = w.source_file_id JOIN files b ON b.id = w.target_file_id
    WHERE w.source_language = 'typescript' AND w.target_language = 'csharp' ORDER BY w.edge_type, a.path, w.source_line NULLS FIRST, b.path, w.target_line NULLS FIRST, w.source_id, w.target_id LIMIT 200)
    SELECT edge_type, source_path, 0 AS step, source_path AS path, source_line AS line, source_symbol AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY edge_type, source_path ORDER BY source_line NULLS FIRST, source_symbol) AS k FROM t) WHERE k = 1
    UNION ALL SELECT edge_type, source_path, CAST(row_number() OVER (PARTITION BY edge_type, source_path ORDER BY target_path, target_line NULLS FIRST, target_symbol) AS INTEGER), target_path, target_line, target_symbol FROM (SELECT DISTINCT edge_type, source_path, target_path, target_line, target_symbol FROM t)""")
def gra_cross_language_steps(g):
    return graph.cross_language_steps(g, "typescript", "csharp")


@query("""SELECT id, name, CASE WHEN length(split_part(signature, chr(10), 1)) > 60 THEN substr(split_part(signature, chr(10), 1), 1, 59) || '…' ELSE split_part(signature, chr(10), 1) END AS signature,
    CASE WHEN length(split_part(doc_comment, chr(10), 1)) > 60 THEN substr(split_part(doc_comment, chr(10), 1), 1, 59) || '…' ELSE split_part(doc_comment, chr(10), 1) END AS doc_comment FROM symbols""")
def nav_shown(g):
    return navigation.shown(g.symbols.select("id", "name", "signature", "doc_comment"), doc=True, width=60)
