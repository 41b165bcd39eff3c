"""The registered queries of the core, with the SQL that says the same."""

from __future__ import annotations

import uuid
from datetime import datetime

from skein.operators.hierarchy import descendants, hierarchy, lost_nodes
from skein.operators.keychunks import hot_keys, key_totals
from skein.operators.workledger import WorkLedger, drive, plan_next, replay, state_after
from skein.plans.session import checkpoint_dir
from skein.sources.tables import table


def _ledger_of_runs(spark, d):
    return replay(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}", table(spark, d, "files"), table(spark, d, "file_versions"), table(spark, d, "index_runs"))


def p1_found(spark, d):
    return _ledger_of_runs(spark, d).items().select("run_id", "file_id")


def p1_items(spark, d):
    return _ledger_of_runs(spark, d).items().select("run_id", "file_id", "action", "hash", "state", "token", "path")


def p1_state(spark, d):
    return state_after(table(spark, d, "files"), table(spark, d, "file_versions"), table(spark, d, "index_runs"))


def p1_next(spark, d):
    return plan_next(table(spark, d, "files"), table(spark, d, "file_versions"), table(spark, d, "index_runs")).select("run_id", "file_id", "action", "hash")


def p1_ledger(spark, d):
    """The items of the running runs after workers took them, one of which was lost on the way."""
    led = WorkLedger(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}", buckets=2)
    plan = plan_next(table(spark, d, "files"), table(spark, d, "file_versions"), table(spark, d, "index_runs"))
    return drive(led, plan, datetime(2026, 1, 1)).select("run_id", "file_id", "action", "state")


def p6_found(spark, d):
    return hot_keys(key_totals(table(spark, d, "edges"))).select("target_id", "kind")


def p6_totals(spark, d):
    return key_totals(table(spark, d, "edges"))


def p7_found(spark, d):
    return lost_nodes(table(spark, d, "edges"))


def p7_paths(spark, d):
    nodes = hierarchy(table(spark, d, "edges"))
    return nodes.filter("root is not null").selectExpr("symbol_id", "root", "depth", "array_join(path, '/') AS path")


def p7_descendants(spark, d):
    return descendants(hierarchy(table(spark, d, "edges")))


QUERIES = {f.__name__: f for f in (p1_found, p1_items, p1_state, p1_next, p1_ledger, p6_found, p6_totals, p7_found, p7_paths, p7_descendants)}

_RUNS = """r AS (SELECT run_id, project, started_at, status,
  max(CASE WHEN status = 'succeeded' THEN started_at END) OVER (PARTITION BY project ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM index_runs WHERE status IN ('succeeded', 'running')),
seen AS (SELECT run_id, file_id, hash FROM (
  SELECT r.run_id, v.file_id, lower(v.hash) AS hash, row_number() OVER (PARTITION BY r.run_id, v.file_id ORDER BY v.changed_at DESC, v.version_id DESC) AS k
  FROM r JOIN files f ON f.project = r.project JOIN file_versions v ON v.file_id = f.id AND v.arrived_at <= r.started_at) WHERE k = 1),
p AS (SELECT a.run_id, b.run_id AS prev_id FROM r a LEFT JOIN r b ON b.project = a.project AND b.started_at = a.prev AND b.status = 'succeeded'),
items AS (SELECT s.run_id, s.file_id, s.hash, o.hash AS before, r.status, r.project, r.started_at, r.prev FROM seen s JOIN p ON p.run_id = s.run_id JOIN r ON r.run_id = s.run_id
  LEFT JOIN seen o ON o.run_id = p.prev_id AND o.file_id = s.file_id WHERE s.hash IS DISTINCT FROM o.hash)"""

_WALK = """links AS (SELECT source_id AS node, min(target_id) AS parent FROM edges WHERE kind = 'inherits' GROUP BY source_id),
walk AS (SELECT node AS start, parent AS node FROM links UNION SELECT w.start, l.parent FROM walk w JOIN links l ON l.node = w.node)"""

_CLIMB = """links AS (SELECT source_id AS node, min(target_id) AS parent FROM edges WHERE kind = 'inherits' GROUP BY source_id),
roots AS (SELECT DISTINCT parent AS node FROM links WHERE parent NOT IN (SELECT node FROM links)),
tree AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS depth, CAST(node AS VARCHAR) AS path FROM roots
  UNION ALL SELECT l.node, t.root, t.depth + 1, t.path || '/' || CAST(l.node AS VARCHAR) FROM tree t JOIN links l ON l.parent = t.node)"""

SQL = {
    "p1_found": f"WITH {_RUNS} SELECT run_id, file_id FROM items",
    "p1_items": f"""WITH {_RUNS}, since AS (SELECT i.run_id, i.file_id, min(v.arrived_at) AS at FROM items i JOIN file_versions v ON v.file_id = i.file_id AND v.arrived_at <= i.started_at AND (i.prev IS NULL OR v.arrived_at > i.prev) GROUP BY 1, 2),
        tries AS (SELECT i.run_id, i.file_id, count(*) AS n FROM items i JOIN since USING (run_id, file_id) JOIN index_runs a ON a.project = i.project AND a.status IN ('failed', 'aborted') AND a.started_at < i.started_at AND (i.prev IS NULL OR a.started_at > i.prev) AND a.started_at >= since.at GROUP BY 1, 2)
        SELECT i.run_id, i.file_id, CASE WHEN before IS NULL THEN 'added' WHEN hash IS NULL THEN 'removed' ELSE 'changed' END AS action, hash,
        CASE WHEN status = 'succeeded' THEN 'done' ELSE 'pending' END AS state, coalesce(t.n, 0) + CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END AS token,
        'out/run=' || i.run_id || '/' || i.file_id || '-' || coalesce(substr(hash, 1, 16), 'removed') AS path FROM items i LEFT JOIN tries t USING (run_id, file_id)""",
    "p1_state": f"""WITH {_RUNS}, last AS (SELECT i.file_id, i.hash, r.started_at, row_number() OVER (PARTITION BY i.file_id ORDER BY r.started_at DESC, r.run_id DESC) AS k
        FROM items i JOIN r ON r.run_id = i.run_id WHERE i.status = 'succeeded')
        SELECT file_id, hash, CAST(floor(epoch(started_at)) AS BIGINT) AS last_indexed FROM last WHERE k = 1""",
    "p1_next": f"""WITH {_RUNS} SELECT run_id, file_id, CASE WHEN before IS NULL THEN 'added' WHEN hash IS NULL THEN 'removed' ELSE 'changed' END AS action, hash FROM items WHERE status = 'running'""",
    "p1_ledger": f"""WITH {_RUNS} SELECT run_id, file_id, CASE WHEN before IS NULL THEN 'added' WHEN hash IS NULL THEN 'removed' ELSE 'changed' END AS action, 'done' AS state FROM items WHERE status = 'running'""",
    "p6_found": """WITH d AS (SELECT DISTINCT source_id, target_id, kind, source_line FROM edges)
        SELECT target_id, kind FROM d GROUP BY target_id, kind HAVING count(*) >= 0.01 * (SELECT count(*) FROM d)""",
    "p6_totals": """SELECT target_id, kind, count(*) AS refs, count(DISTINCT source_id) AS sources
        FROM (SELECT DISTINCT source_id, target_id, kind, source_line FROM edges) GROUP BY target_id, kind""",
    "p7_found": f"""WITH RECURSIVE {_WALK},
        good AS (SELECT DISTINCT start FROM walk WHERE node NOT IN (SELECT node FROM links)),
        round AS (SELECT DISTINCT start FROM walk WHERE start = node)
        SELECT node AS symbol_id, CASE WHEN node IN (SELECT start FROM round) THEN 'on_cycle' ELSE 'below_cycle' END AS place
        FROM links WHERE node NOT IN (SELECT start FROM good)""",
    "p7_paths": f"WITH RECURSIVE {_CLIMB} SELECT node AS symbol_id, root, depth, path FROM tree",
    "p7_descendants": f"""WITH RECURSIVE {_CLIMB}, below AS (SELECT node AS symbol_id, node AS descendant, CAST(0 AS BIGINT) AS distance FROM tree
        UNION ALL SELECT b.symbol_id, l.node, b.distance + 1 FROM below b JOIN links l ON l.parent = b.descendant)
        SELECT symbol_id, descendant, distance FROM below WHERE distance > 0""",
}
