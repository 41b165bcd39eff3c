"""Problem 1: each run processes exactly what is new, changed or removed.

``plan_runs`` derives, for the runs of all projects at once, the files whose content
differs from what the project's last successful run saw. ``WorkLedger`` carries such a
plan through unreliable workers: items are *pending*, *leased* or *done*; an expired
lease returns to pending; every lease carries a fencing token that grows with each lease
of the item, and a write with an older token is refused; outputs go to paths made of run,
item and content only, so that a retry writes the same file again. ``replay`` takes the
recorded runs through a ledger: runs that failed leased what they knew of and fell
silent, the run after them took it again, succeeded runs completed their items, and what
a running run has to do is left pending.

The ledger is a log: each of its buckets has a row of small head files, numbered without
gaps, each naming the folders that hold the bucket's events. A change reads its buckets,
appends events and creates the next heads, which succeeds for one writer only; so a lease
costs what its bucket holds, not what the ledger holds. Items are the latest events.

Results for odd input: versions without file, time of change or time of arrival are
never seen; versions of a file that ``files`` does not hold belong to no project; a null
version id counts as the smallest; rows delivered twice count once; a run without start
or project plans nothing; of two runs started at the same instant the one with the
smaller id comes first; empty tables give empty plans; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_RUNS = 200_000  # runs up to which their windows are sent to all executors
BUCKETS = 8  # of a ledger, unless it is made with another number
FOLDERS = 16  # of events that a bucket has at most before they are folded into one


def run_windows(runs: DataFrame) -> DataFrame:
    """Each succeeded or running run with the start of the project's succeeded run before it: run_id, project, started_at, after (null: the first), ok."""
    r = runs.filter(F.col("status").isin("succeeded", "running") & F.col("started_at").isNotNull() & F.col("project").isNotNull())
    r = r.select("run_id", "project", "started_at", (F.col("status") == "succeeded").alias("ok")).dropDuplicates(["run_id"])
    before = Window.partitionBy("project").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("after", F.last(F.when(F.col("ok"), F.col("started_at")), ignorenulls=True).over(before))


def plan_runs(files: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The items of every succeeded or running run: run_id, file_id, action (added, changed, removed), hash (null if removed), hash_before, since (arrival of the first version the run had to look at).

    A version matters to the runs in whose window (last success, start] it arrived, so the
    versions meet the few windows of their project only; the greatest version per file
    and window is found before anything else moves, and what a run saw before is a
    running maximum over the windows of a file."""
    windows = run_windows(runs)
    if windows.count() <= BROADCAST_RUNS:
        windows = F.broadcast(windows)
    v = versions.filter("file_id is not null and changed_at is not null and arrived_at is not null").select("file_id", "arrived_at", F.struct(F.col("changed_at").alias("at"), F.coalesce("version_id", F.lit(-(2**63) + 1)).alias("id"), F.lower("hash").alias("hash")).alias("v"))
    owned = v.join(files.select(F.col("id").alias("file_id"), "project").dropDuplicates(["file_id"]), "file_id")
    inside = (F.col("arrived_at") <= F.col("started_at")) & (F.col("after").isNull() | (F.col("arrived_at") > F.col("after")))
    met = owned.join(windows, ["project"]).filter(inside)
    own = met.groupBy("file_id", "run_id").agg(F.max("v").alias("own"), F.first("started_at").alias("started_at"), F.first("ok").alias("ok"), F.min("arrived_at").cast("timestamp_ntz").alias("since"))
    past = Window.partitionBy("file_id").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = own.withColumn("before", F.max(F.when(F.col("ok"), F.col("own"))).over(past))
    seen = seen.withColumn("now", F.greatest("before", "own"))
    h0, h1 = F.col("before.hash"), F.col("now.hash")
    action = F.when(h0.isNull(), "added").when(h1.isNull(), "removed").otherwise("changed")
    return seen.filter(~h0.eqNullSafe(h1)).select("run_id", "file_id", action.alias("action"), h1.alias("hash"), h0.alias("hash_before"), "since")


def plan_next(files: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The items of the running runs from the state kept in ``files`` (hash as of each project's last success): run_id, file_id, action, hash, hash_before, since.

    Only files with a version that arrived since then are looked at; of these all versions
    count, since one that came late may be older than what is indexed. A file that was
    never indexed has a null hash or is known by its versions alone."""
    windows = run_windows(runs).filter("not ok")
    if windows.count() <= BROADCAST_RUNS:
        windows = F.broadcast(windows)
    f = files.select(F.col("id").alias("file_id"), "project", F.lower("hash").alias("kept")).dropDuplicates(["file_id"])
    v = versions.filter("file_id is not null and changed_at is not null and arrived_at is not null")
    known = f.join(windows, "project")
    new = v.select("file_id", "arrived_at").join(known, "file_id").filter((F.col("arrived_at") <= F.col("started_at")) & (F.col("after").isNull() | (F.col("arrived_at") > F.col("after"))))
    asked = new.groupBy("file_id", "run_id").agg(F.first("started_at").alias("started_at"), F.first("kept").alias("kept"), F.min("arrived_at").cast("timestamp_ntz").alias("since"))
    best = F.max(F.struct(F.col("changed_at").alias("at"), F.coalesce("version_id", F.lit(-(2**63) + 1)).alias("id"), F.lower("hash").alias("hash")))
    seen = v.join(asked, "file_id").filter(F.col("arrived_at") <= F.col("started_at")).groupBy("run_id", "file_id").agg(best.alias("b"), F.first("kept").alias("hash_before"), F.first("since").alias("since"))
    h0, h1 = F.col("hash_before"), F.col("b.hash")
    action = F.when(h0.isNull(), "added").when(h1.isNull(), "removed").otherwise("changed")
    return seen.filter(~h0.eqNullSafe(h1)).select("run_id", "file_id", action.alias("action"), h1.alias("hash"), "hash_before", "since")


def state_after(files: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """file_id, hash and last_indexed (epoch second) as they stand after each project's last succeeded run."""
    plan = plan_runs(files, versions, runs.filter("status = 'succeeded'"))
    started = runs.filter("started_at is not null").select("run_id", "started_at").dropDuplicates(["run_id"])
    if started.count() <= BROADCAST_RUNS:
        started = F.broadcast(started)
    last = plan.join(started, "run_id").groupBy("file_id").agg(F.max(F.struct("started_at", "run_id", "hash")).alias("x"))
    # timestamps without a zone are UTC whatever the session's zone
    zoned = dict(runs.dtypes)["started_at"] == "timestamp"
    epoch = F.unix_timestamp("x.started_at") if zoned else F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', x.started_at)")
    return last.select("file_id", F.col("x.hash").alias("hash"), epoch.alias("last_indexed"))


def item_path(run_id: Column, file_id: Column, hash_: Column) -> Column:
    """Where, below the ledger's folder, the output of an item goes: the same for every try."""
    return F.concat(F.lit("out/run="), run_id.cast("string"), F.lit("/"), file_id.cast("string"), F.lit("-"), F.coalesce(F.substring(hash_, 1, 16), F.lit("removed")))


def _moment(at: datetime) -> Column:
    return F.lit(at.isoformat(" ")).cast("timestamp_ntz")


def attempts(runs: DataFrame) -> DataFrame:
    """run_id of each succeeded or running run and its ``asks``, in order of time: (now, until, worker) of the failed runs since the last one and, if it succeeded, of itself. A silent worker's lease ends where the next run begins."""
    r = runs.filter(F.col("started_at").isNotNull() & F.col("project").isNotNull() & F.col("run_id").isNotNull()).select("run_id", "project", "status", F.col("started_at").cast("timestamp_ntz").alias("now")).dropDuplicates(["run_id"])
    order = Window.partitionBy("project").orderBy("now", "run_id")
    counts = F.col("status").isin("succeeded", "running")
    onward = r.withColumn("until", F.coalesce(F.lead("now").over(order), F.col("now") + F.expr("INTERVAL 1 DAY"))).withColumn("for", F.first(F.when(counts, F.col("run_id")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    asks = onward.filter("status <> 'running' and for is not null")
    return asks.groupBy(F.col("for").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("now", "until", F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("worker")))).alias("asks"))


ITEM = ("run_id", "file_id", "action", "hash", "since", "path", "state", "token", "worker", "expires_at")
SCHEMA = "run_id long, file_id long, action string, hash string, since timestamp_ntz, path string, state string, token long, worker string, expires_at timestamp_ntz"
#: Fixed order of the states of one token: planned, leased, taken back, done.
_RANK = "CASE WHEN state = 'done' THEN 3 WHEN state = 'leased' THEN 1 WHEN token > 0 THEN 2 ELSE 0 END AS rank"
#: File systems on which renaming onto a name that exists fails, for all writers but the first.
_RENAMES = ("hdfs", "viewfs", "webhdfs", "ofs", "abfs", "abfss")


class WorkLedger:
    """The items of runs and their states under ``root``: run_id, file_id, action, hash, since, path (below root), state, token (of the latest lease), worker, expires_at. All times are without zone.

    A writer that dies before its heads are created leaves nothing but a folder that no
    head names. Heads are created by a hard link (local and mounted folders), a rename
    (HDFS and the like) or a create that must not overwrite (elsewhere; object stores need
    conditional writes for it), each of which only one of several writers can win.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, tries: int = 8, folders: int = FOLDERS):
        self.spark, self.root, self.tries, self.folders = spark, root.rstrip("/"), tries, folders
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._scheme = self._fs.getUri().getScheme()
        self._fs.mkdirs(self._path(f"{self.root}/drafts"))
        self._create("meta", json.dumps({"buckets": buckets}))
        self.buckets: int = json.loads(self._text("meta"))["buckets"]
        for b in range(self.buckets):
            self._fs.mkdirs(self._path(f"{self.root}/heads/{b}"))

    # -- files ----------------------------------------------------------------
    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Creates a file with its content at once; False if it exists."""
        target, draft = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        if self._scheme == "file":
            plain, made = draft.toUri().getPath(), target.toUri().getPath()
            with open(plain, "x") as out:
                out.write(text)
            try:
                os.link(plain, made)
                return True
            except FileExistsError:
                return False
            except OSError:  # a mount without hard links
                try:
                    with open(made, "x") as out:
                        out.write(text)
                    return True
                except FileExistsError:
                    return False
            finally:
                os.unlink(plain)
        rename = self._scheme in _RENAMES
        try:
            out = self._fs.create(draft if rename else target, False)
        except Exception as e:
            if not rename and "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        if rename and not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            return False
        return True

    # -- reading --------------------------------------------------------------
    def head(self, bucket: int) -> tuple[int, list[str]]:
        """Number of a bucket's newest head (0 before the first) and the folders it names."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/heads/{bucket}"))]
        n = max([int(x) for x in names if x.isdigit()], default=0)
        return n, json.loads(self._text(f"heads/{bucket}/{n:012d}")) if n else []

    def _fold(self, heads: dict[int, tuple[int, list[str]]]) -> DataFrame:
        where = [f"{self.root}/data/{name}/bucket={b}" for b, (_, names) in heads.items() for name in names]
        events = self.spark.read.schema(SCHEMA).parquet(*where) if where else self.spark.createDataFrame([], SCHEMA)
        rest = [c for c in ITEM if c not in ("run_id", "file_id", "token")]
        last = events.groupBy("run_id", "file_id").agg(F.max(F.struct("token", F.expr(_RANK), *rest)).alias("x"))
        return last.select(*[F.col(c) if c in ("run_id", "file_id") else F.col(f"x.{c}").alias(c) for c in ITEM])

    def items(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The items as they stand, of some buckets or of all."""
        return self._fold({b: self.head(b) for b in (range(self.buckets) if buckets is None else buckets)})

    # -- writing --------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("run_id", "file_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _append(self, buckets: Iterable[int], make: Callable[[DataFrame], DataFrame], fold: bool = False) -> DataFrame:
        """Appends the events that ``make`` derives from the items of the buckets, again for those buckets in which another writer was first; gives the events. ``fold`` puts them in place of all before."""
        todo, won = list(buckets), []
        for _ in range(self.tries):
            heads = {b: self.head(b) for b in todo}
            if not fold and (full := [b for b in todo if len(heads[b][1]) >= self.folders]):
                self.compact(full)
                heads |= {b: self.head(b) for b in full}
            name = uuid.uuid4().hex
            make(self._fold(heads)).select(*ITEM, self._bucket()).write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
            lost = []
            for b in todo:
                n, names = heads[b]
                mine = self._path(f"{self.root}/data/{name}/bucket={b}")
                if not self._fs.exists(mine):
                    continue
                if self._create(f"heads/{b}/{n + 1:012d}", json.dumps([name] if fold else [*names, name])):
                    won.append(f"{self.root}/data/{name}/bucket={b}")
                else:
                    self._fs.delete(mine, True)
                    lost.append(b)
            if not lost:
                return self.spark.read.schema(SCHEMA).parquet(*won) if won else self.spark.createDataFrame([], SCHEMA)
            todo = lost
        raise RuntimeError("other writers were first in every try")

    def compact(self, buckets: Iterable[int] | None = None) -> None:
        """Folds the events of buckets into one folder each and removes those that the two heads before no longer need, so that readers who are on their way still find theirs."""
        chosen = list(range(self.buckets) if buckets is None else buckets)
        self._append(chosen, lambda items: items, fold=True)
        for b in chosen:
            n, _ = self.head(b)
            late = [set(json.loads(self._text(f"heads/{b}/{k:012d}"))) for k in range(max(1, n - 2), n + 1)]
            kept = set().union(*late)
            for s in self._fs.listStatus(self._path(f"{self.root}/data")):
                name = s.getPath().getName()
                if name not in kept and self._named_once(b, name, n):
                    self._fs.delete(self._path(f"{self.root}/data/{name}/bucket={b}"), True)

    def _named_once(self, bucket: int, name: str, n: int) -> bool:
        """Whether an older head of the bucket names the folder: one that none names may belong to a writer at work."""
        return any(name in json.loads(self._text(f"heads/{bucket}/{k:012d}")) for k in range(n - 3, max(0, n - 4 - self.folders), -1))

    # -- transitions ------------------------------------------------------------
    def add(self, plan: DataFrame) -> DataFrame:
        """Plans items and gives those that are new; those that the ledger already holds are left alone, so planning twice changes nothing."""
        since = F.col("since") if "since" in plan.columns else F.lit(None)
        new = plan.select("run_id", "file_id", "action", "hash", since.cast("timestamp_ntz").alias("since"), item_path(F.col("run_id"), F.col("file_id"), F.col("hash")).alias("path"), F.lit("pending").alias("state"), F.lit(0).cast("long").alias("token"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("timestamp_ntz").alias("expires_at")).dropDuplicates(["run_id", "file_id"])
        first = not any(self.head(b)[0] for b in range(self.buckets))
        return self._append(range(self.buckets), lambda old: new if first and not old.head(1) else new.join(old.select("run_id", "file_id"), ["run_id", "file_id"], "left_anti"))

    def lease(self, worker: str, bucket: int, now: datetime, seconds: int) -> DataFrame:
        """Leases the free items of one bucket (pending, or with a lease that has run out) to a worker and gives them with their tokens."""
        free = (F.col("state") == "pending") | self._expired(_moment(now))
        return self._append([bucket], lambda old: old.filter(free).withColumns({"state": F.lit("leased"), "token": F.col("token") + 1, "worker": F.lit(worker), "expires_at": _moment(now + timedelta(seconds=seconds))}))

    def lease_in_turn(self, asks: DataFrame) -> DataFrame:
        """Leases items to the workers that ask for their run one after the other: run_id, asks (array of now, until, worker in order of time). An ask gets the items that were planned by then and are free; the events are those of the last lease, with a token for each."""
        if asks.count() <= BROADCAST_RUNS:
            asks = F.broadcast(asks)
        turn = F.expr("""aggregate(asks, named_struct('free', IF(state = 'leased', expires_at, CAST(NULL AS timestamp_ntz)), 'n', 0L, 'worker', CAST(NULL AS string)),
            (a, x) -> IF((since IS NULL OR since <= x.now) AND (a.free IS NULL OR a.free <= x.now), named_struct('free', x.until, 'n', a.n + 1L, 'worker', x.worker), a))""")

        def make(old):
            met = old.filter("state <> 'done'").join(asks, "run_id").withColumn("got", turn).filter("got.n > 0")
            return met.withColumns({"state": F.lit("leased"), "token": F.col("token") + F.col("got.n"), "worker": F.col("got.worker"), "expires_at": F.col("got.free")})

        return self._append(range(self.buckets), make)

    def expire(self, now: datetime | None = None) -> DataFrame:
        """Returns leases that have run out (all, without a time) to pending and gives them; their tokens stay, so that the late holder is fenced off."""
        late = F.col("state") == "leased" if now is None else self._expired(_moment(now))
        none = F.lit(None)
        return self._append(range(self.buckets), lambda old: old.filter(late).withColumns({"state": F.lit("pending"), "worker": none.cast("string"), "expires_at": none.cast("timestamp_ntz")}))

    def complete(self, done: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Marks items (run_id, file_id, token) as done. Gives the items done now and the refused rows: those whose token is not the item's latest or whose lease was taken back. Telling twice changes nothing and is not refused."""
        said = done.select("run_id", "file_id", F.col("token").alias("said")).groupBy("run_id", "file_id").agg(F.max("said").alias("said"))
        touched = range(self.buckets)
        if "bucket" in done.columns:
            touched = [r[0] for r in done.select("bucket").distinct().collect()]
        now = self._append(touched, lambda old: old.filter("state = 'leased'").join(said, ["run_id", "file_id"]).filter("said = token").withColumn("state", F.lit("done")))
        fit = self.items(touched).filter("state = 'done'").select("run_id", "file_id", "token")
        return now, done.select("run_id", "file_id", "token").join(fit, ["run_id", "file_id", "token"], "left_anti")

    @staticmethod
    def _expired(now: Column) -> Column:
        return F.coalesce((F.col("state") == "leased") & (F.col("expires_at") <= now), F.lit(False))


def replay(spark: SparkSession, root: str, files: DataFrame, versions: DataFrame, runs: DataFrame) -> WorkLedger:
    """A ledger of the recorded runs: planned, leased by each failed run in turn and by the succeeded one, completed by that one; what running runs have to do is pending."""
    ledger = WorkLedger(spark, root)
    ledger.add(plan_runs(files, versions, runs))
    leased = ledger.lease_in_turn(attempts(runs))
    own = leased.filter(F.col("worker") == F.concat(F.lit("run-"), F.col("run_id").cast("string")))
    ledger.complete(own.select("run_id", "file_id", "token"))
    ledger.expire()
    return ledger


def drive(ledger: WorkLedger, plan: DataFrame, now: datetime, seconds: int = 60) -> DataFrame:
    """Carries a plan through one lost worker and returns the ledger: every item done, once.

    Worker 0 leases the first bucket and falls silent; its lease expires and worker 1 takes
    the items with newer tokens; what worker 0 then reports is refused. All other
    buckets are leased and completed in turn."""
    ledger.add(plan)
    late = ledger.lease("worker-0", 0, now, seconds).select("run_id", "file_id", "token", F.lit(0).alias("bucket"))
    now += timedelta(seconds=seconds + 1)
    ledger.expire(now)
    for b in range(ledger.buckets):
        got = ledger.lease(f"worker-{b + 1}", b, now, seconds)
        if b == 0:
            ledger.complete(late)
        ledger.complete(got.select("run_id", "file_id", "token", F.lit(b).alias("bucket")))
    return ledger.items()
