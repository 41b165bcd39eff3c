"""Problems 1, 6 and 7: against plain Python on random small tables, with nulls, ties and repeated rows."""

import json
import random
import shutil
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from skein.operators.hierarchy import Forest, descendants, hierarchy, levels, lost_nodes
from skein.operators.keychunks import hot_keys, key_totals
from skein.operators.offsets import part_offsets, sorted_runs
from skein.plans.session import cut_lineage
from skein.operators import workledger
from skein.operators.workledger import WorkLedger, drive, plan_next, plan_runs, replay, state_after

T0 = datetime(2026, 1, 1)
FILES = "id long, project string, note string"
VERSIONS = "version_id long, file_id long, change_kind string, hash string, changed_at timestamp, arrived_at timestamp"
RUNS = "run_id long, project string, started_at timestamp, finished_at timestamp, status string"
EDGES = "source_id long, target_id long, kind string, source_line int, confidence double, state string"


def expected_plan(files, versions, runs):
    out, prev = set(), {}
    for run, project, at, _, status in sorted((r for r in runs if r[4] in ("succeeded", "running") and r[2] and r[1]), key=lambda r: (r[1], r[2], r[0])):
        seen = {}
        for f, p, _ in files:
            if p != project:
                continue
            vs = [v for v in versions if v[1] == f and v[4] and v[5] and v[5] <= at]
            h = max(vs, key=lambda v: (v[4], v[0] if v[0] is not None else -1))[3] if vs else None
            seen[f] = h.lower() if h else None
            if seen[f] != prev.get(project, {}).get(f):
                out.add((run, f))
        if status == "succeeded":
            prev[project] = seen
    return out


@pytest.mark.parametrize("seed", range(3))
def test_plan_matches_a_plain_replay(spark, tmp_path, seed):
    rnd = random.Random(seed)
    files = [(i, f"p{i % 3}", "x") for i in range(12)]
    day = lambda: T0 + timedelta(hours=rnd.randrange(200))
    versions = []
    for k in range(120):
        c = day()
        versions.append((k, rnd.randrange(12), "modified", rnd.choice(["aa", "AA", "bb", "cc", None]), c, c + timedelta(hours=rnd.choice([0, 1, 60]))))
    versions += rnd.sample(versions, 20) + [(None, 3, "modified", "dd", T0, T0), (500, None, "created", "x", T0, T0), (501, 2, "created", "x", None, T0)]
    runs = [(k, f"p{k % 3}", day(), None, rnd.choice(["succeeded", "succeeded", "failed", "aborted"])) for k in range(18)]
    runs += [(100 + p, f"p{p}", T0 + timedelta(hours=300), None, "running") for p in range(3)] + [(200, None, T0, None, "succeeded"), (201, "p0", None, None, "succeeded")]
    f, v, r = spark.createDataFrame(files, FILES), spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(runs, RUNS)
    got = [(x.run_id, x.file_id) for x in plan_runs(f, v, r).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_plan(files, versions, runs)
    kept = {x.file_id: x.hash for x in state_after(f, v, r).collect()}
    with_state = spark.createDataFrame([(i, p, kept.get(i)) for i, p, _ in files], "id long, project string, hash string")
    assert {(x.run_id, x.file_id) for x in plan_next(with_state, v, r).collect()} == {x for x in got if 100 <= x[0] < 103}
    items = replay(spark, str(tmp_path / "ledger"), f, v, r).items().collect()
    assert {(x.run_id, x.file_id) for x in items} == set(got)
    tries = expected_tries(versions, runs, got)
    status = {x[0]: x[4] for x in runs}
    for x in items:
        ok = status[x.run_id] == "succeeded"
        assert (x.state, x.token) == ("done" if ok else "pending", tries[x.run_id, x.file_id] + ok), x
        assert x.worker == (f"run-{x.run_id}" if ok else None)


def expected_tries(versions, runs, items):
    """Failed runs between the last success and a run that knew of an item of it."""
    project, out = {r[0]: r[1] for r in runs}, {}
    counted = sorted((r for r in runs if r[1] and r[2]), key=lambda r: (r[2], r[0]))
    for run, f in items:
        mine = [r for r in counted if r[1] == project[run]]
        k = [r[0] for r in mine].index(run)
        last = max((j for j in range(k) if mine[j][4] == "succeeded"), default=-1)
        after = mine[last][2] if last >= 0 else datetime.min
        since = min(v[5] for v in versions if v[1] == f and v[4] and v[5] and after < v[5] <= mine[k][2])
        out[run, f] = sum(r[4] in ("failed", "aborted") and r[2] >= since for r in mine[last + 1 : k])
    return out


def test_empty_tables_plan_nothing(spark, tmp_path):
    f, v, r = spark.createDataFrame([], FILES), spark.createDataFrame([], VERSIONS), spark.createDataFrame([], RUNS)
    assert plan_runs(f, v, r).count() == 0 and plan_next(f.withColumn("hash", f["note"]), v, r).count() == 0 and state_after(f, v, r).count() == 0
    assert replay(spark, str(tmp_path / "ledger"), f, v, r).items().count() == 0


PLAN = "run_id long, file_id long, action string, hash string, hash_before string"
TOKENS = "run_id long, file_id long, token long"


def test_ledger_survives_lost_workers_and_stale_writers(spark, tmp_path):
    plan = spark.createDataFrame([(1, i, "added", f"h{i}", None) for i in range(8)], PLAN)
    led = WorkLedger(spark, str(tmp_path / "ledger"), buckets=1)
    assert led.add(plan).count() == 8 and led.add(plan).count() == 0  # planning twice changes nothing
    first = led.lease("w1", 0, T0, 60).collect()
    assert len(first) == 8 and {x.token for x in first} == {1}
    assert led.lease("w2", 0, T0 + timedelta(seconds=30), 60).count() == 0  # still leased
    assert {x.state for x in led.expire(T0 + timedelta(seconds=61)).collect()} == {"pending"}
    second = led.lease("w2", 0, T0 + timedelta(seconds=62), 60).collect()
    assert {x.token for x in second} == {2} and {x.path for x in second} == {x.path for x in first}
    _, refused = led.complete(spark.createDataFrame([(1, i, 1 if i < 4 else 2) for i in range(8)], TOKENS))
    assert sorted(x.file_id for x in refused.collect()) == [0, 1, 2, 3]  # the late first worker
    assert led.items().filter("state = 'done'").count() == 4
    now, refused = led.complete(spark.createDataFrame([(1, i, 2) for i in range(4)], TOKENS))
    assert now.count() == 4 and refused.count() == 0 and led.items().filter("state = 'done'").count() == 8
    assert led.lease("w3", 0, T0 + timedelta(days=9), 60).count() == 0  # nothing is done twice


def test_a_lost_worker_costs_no_item_and_repeats_none(spark, tmp_path):
    plan = spark.createDataFrame([(1, i, "added", f"h{i}", None) for i in range(40)], PLAN)
    rows = drive(WorkLedger(spark, str(tmp_path / "l"), buckets=3), plan, T0).collect()
    assert len(rows) == 40 and {r.state for r in rows} == {"done"}
    assert {(r.worker == "worker-1", r.token) for r in rows} == {(True, 2), (False, 1)}


def test_two_writers_from_one_head(spark, tmp_path):
    """The second of two writers that read the same head starts again from what the first left."""
    plan = spark.createDataFrame([(1, 1, "added", "h", None)], PLAN)
    a, b = (WorkLedger(spark, str(tmp_path / "l"), buckets=1) for _ in range(2))
    a.add(plan)
    real, beaten = a.head, []

    def behind(bucket):
        n = real(bucket)
        if not beaten:
            beaten.append(n)
            assert b.lease("first", 0, T0, 60).count() == 1  # the other writer wins
        return n

    a.head = behind
    assert a.lease("second", 0, T0, 60).count() == 0
    assert [(x.worker, x.token) for x in b.items().collect()] == [("first", 1)]


def test_heads_are_created_once_whoever_tries(spark, tmp_path):
    led = WorkLedger(spark, str(tmp_path / "l"), buckets=1)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: led._create("heads/0/000000000001", json.dumps([str(k)])), range(32)))
    assert sum(won) == 1 and led.head(0)[1] == [str(won.index(True))]


def test_heads_without_hard_links(spark, tmp_path, monkeypatch):
    led = WorkLedger(spark, str(tmp_path / "l"), buckets=1)
    monkeypatch.setattr(workledger.os, "link", lambda a, b: (_ for _ in ()).throw(PermissionError("no links here")))
    assert led._create("heads/0/000000000001", "[]") and not led._create("heads/0/000000000001", "[1]") and led.head(0) == (1, [])
    assert not list((tmp_path / "l" / "drafts").iterdir())


def test_a_lease_reads_and_writes_its_bucket_only(spark, tmp_path):
    plan = spark.createDataFrame([(1, i, "added", f"h{i}", None) for i in range(40)], PLAN)
    led = WorkLedger(spark, str(tmp_path / "l"), buckets=4)
    led.add(plan)
    before = [led.head(b) for b in range(4)]
    shutil.rmtree(next((tmp_path / "l" / "data").glob("*")) / "bucket=3")  # what lies elsewhere is not even read
    led.lease("w", 1, T0, 60)
    after = [led.head(b) for b in range(4)]
    assert [x == y for x, y in zip(before, after)] == [True, False, True, True]


def test_folded_events_give_the_same_items(spark, tmp_path):
    plan = spark.createDataFrame([(1, i, "added", f"h{i}", None) for i in range(5)], PLAN)
    led = WorkLedger(spark, str(tmp_path / "l"), buckets=1, folders=3)
    led.add(plan)
    at = T0
    for k in range(5):
        at += timedelta(seconds=100)
        assert {r.token for r in led.lease(f"w{k}", 0, at, 60).collect()} == {k + 1}
    assert len(led.head(0)[1]) <= 3 and {r.worker for r in led.items().collect()} == {"w4"}
    assert len(list((tmp_path / "l" / "data").glob("*/bucket=0"))) < 6


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_key_totals_with_hot_keys_and_nulls(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(rnd.randrange(40), 7, "calls", rnd.choice([None, 1, 2, 3]), 0.5, "s") for _ in range(400)]
    rows += [(rnd.randrange(9), rnd.randrange(5), rnd.choice(["calls", "x", None]), rnd.choice([None, 1]), 0.1, "s") for _ in range(200)]
    rows += [(None, 1, "x", 1, 0.1, "s"), (None, 1, "x", 2, 0.1, "s"), (1, None, None, None, 0.1, "s"), (1, None, None, None, 0.2, "s")]
    want = {}
    for s, t, k, line in {r[:4] for r in rows}:
        n, src = want.setdefault((t, k), [0, set()])
        want[t, k][0] += 1
        src.add(s)
    got = key_totals(spark.createDataFrame(rows, EDGES), chunk=chunk, partitions=6)
    assert {(r.target_id, r.kind): (r.refs, r.sources) for r in got.collect()} == {k: (n, len(s)) for k, (n, s) in want.items()}
    total = sum(n for n, _ in want.values())
    assert {(r.target_id, r.kind) for r in hot_keys(got, 0.2).collect()} == {k for k, (n, _) in want.items() if n >= 0.2 * total}


def test_key_totals_of_nothing(spark):
    empty = key_totals(spark.createDataFrame([], EDGES))
    assert empty.count() == 0 and hot_keys(empty).count() == 0


def test_offsets_are_exact_and_few(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", i) for i in range(300)], "k string, v long")
    runs = sorted_runs(df, ["k"], ["v"], 5)
    offsets = part_offsets(runs, ["k"])
    assert offsets.count() <= 10
    at = {(r.part, r.k): r.offset for r in offsets.collect()}
    seen = {}
    for r in sorted(runs.collect(), key=lambda r: (r.part, r.k, r.v)):
        if (r.part, r.k) not in seen:
            assert at.get((r.part, r.k), 0) == sum(n for (p, k), n in seen.items() if k == r.k and p < r.part)
        seen[r.part, r.k] = seen.get((r.part, r.k), 0) + 1


def climb(up, n):
    way = [n]
    while way[-1] in up:
        nxt = up[way[-1]]
        if nxt == n:
            return "on_cycle", None
        if nxt in way:
            return "below_cycle", None
        way.append(nxt)
    return ("root" if len(way) == 1 else "inner"), way[::-1]


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_matches_climbing(spark, seed):
    rnd = random.Random(seed)
    up = {i: rnd.randrange(max(0, i - 6), i) for i in range(1, 60)}  # a deep tree
    up |= {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 200: 200, 201: 200}  # circles and what hangs on them
    up |= {300 + i: 301 + i for i in range(40)}  # a chain
    rows = [(c, p, "inherits", line, 0.5, "s") for c, p in up.items() for line in (1, None)]
    rows += [(1, 5, "calls", 1, 0.5, "s"), (None, 3, "inherits", 1, 0.5, "s"), (9, None, "inherits", 1, 0.5, "s")]
    whole = hierarchy(spark.createDataFrame(rows, EDGES), forest=25)
    got = {r.symbol_id: r for r in whole.collect()}
    assert {(r.symbol_id, r.place) for r in lost_nodes(spark.createDataFrame(rows, EDGES)).collect()} == {(n, r.place) for n, r in got.items() if r.root is None}
    assert set(got) == set(up) | set(up.values())
    for n, r in got.items():
        place, way = climb(up, n)
        assert (r.place, r.path) == (place, way), n
        if way:
            assert (r.root, r.depth) == (way[0], len(way) - 1)
    pairs = {(r.symbol_id, r.descendant): r.distance for r in descendants(whole).collect()}
    want = {}
    for n in got:
        way = climb(up, n)[1] or []
        for k, a in enumerate(way[:-1]):
            want[a, n] = len(way) - 1 - k
    assert pairs == want


def test_hierarchy_of_nothing_and_of_several_parents(spark):
    assert hierarchy(spark.createDataFrame([], EDGES)).count() == 0
    two = spark.createDataFrame([(3, 2, "inherits", 1, 0.5, "s"), (3, 1, "inherits", 1, 0.5, "s")], EDGES)
    r = {x.symbol_id: x for x in hierarchy(two).collect()}
    assert r[3].root == 1 and r[3].parents == 2


def test_forest_offsets():
    f = Forest()
    for c, p in ((5, 4), (3, 2), (4, 3), (2, 1), (9, 8), (8, 9)):
        f.link(c, p)
    assert f.find(5) == (1, 4) and f.find(3) == (1, 2)
    assert len(f.open) == 1 and {r[0] for r in f.rows()} == {2, 3, 4, 5, 8, 9}


def test_merges_move_three_numbers_a_node_whatever_the_depth(spark, monkeypatch):
    """A deep chain with shuffled ids beside a circle: nothing that is written between merges grows with the reach."""
    from skein.operators import hierarchy as h

    written = []
    monkeypatch.setattr(h, "cut_lineage", lambda df: written.append(df.dtypes) or cut_lineage(df))
    ids = list(range(20_000))
    random.Random(1).shuffle(ids)
    rows = [(c, p, "inherits", 1, 0.5, "s") for c, p in zip(ids, ids[1:])] + [(50_000 + i, 50_000 + (i + 1) % 100, "inherits", 1, 0.5, "s") for i in range(100)]
    edges = spark.createDataFrame(rows, EDGES)
    assert lost_nodes(edges, forest=3_000).groupBy("place").count().collect() == [("on_cycle", 100)]
    assert all(t in ("bigint", "int", "boolean") for cols in written for _, t in cols)
    deepest = levels(edges, forest=3_000).agg({"depth": "max"}).first()[0]
    assert deepest == 19_999


def test_a_long_chain_in_one_forest():
    f = Forest()
    for i in range(200_000):
        f.link(i, i + 1)
    assert f.find(0) == (200_000, 200_000) and sum(1 for _ in f.rows()) == 200_000
