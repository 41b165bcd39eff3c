"""Problem 6: exact results per key although a few keys hold most rows.

Exact offset chunking: the distinct references are laid out in order (see ``offsets``),
numbered within their key, and processed in chunks of equal size; a chunk's state is its
count, its number of source changes and its first and last source. States of neighbouring
chunks merge in order: a source that ends one chunk and begins the next counts once. The
largest unit of work is a chunk, whatever the key.

Results for odd input: null targets, kinds, sources and lines are values like any other
(two null lines of the same reference are the same reference); repeated rows count once;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.offsets import part_offsets, partitions_for, sorted_runs
from skein.plans.session import cut_lineage

CHUNK = 250_000  # rows of one key that are one unit of work
_STATE = "target_id long, kind string, chunk long, part int, refs long, changes long, first_source long, first_null boolean, last_source long, last_null boolean"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _STATE.split(", ")]


def _moves(a: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before, nulls being equal; True for the first."""
    out = np.ones(len(a), dtype=bool)
    if len(a) > 1:
        x, y = a[1:], a[:-1]
        out[1:] = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
    return out


def chunk_states(runs: DataFrame, offsets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One state for each chunk of a key (for each part of it where a chunk lies in two partitions), however many batches its rows come in."""

    def run(batches):
        held, numbered = None, 0  # the chunk that may go on in the next batch, and the number of its key's next row
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part, t, k, s, off = (batch.column(i) for i in range(5))
            moved = _moves(s).astype(np.int64)
            keys = np.flatnonzero(_moves(t) | _moves(k))
            base = off.to_numpy(zero_copy_only=False)[keys].astype(np.int64)
            goes_on = held is not None and (t[0].as_py(), k[0].as_py()) == held[:2]
            if goes_on:
                base[0] = numbered
            number = np.arange(n) + np.repeat(base - keys, np.diff(np.append(keys, n)))
            # a chunk begins with its key or at a multiple of its size
            begins = np.zeros(n, dtype=bool)
            begins[keys] = True
            begins |= number % chunk == 0
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], n)
            total = np.append(0, np.cumsum(moved))
            rows = list(zip(t.take(starts).to_pylist(), k.take(starts).to_pylist(), (number[starts] // chunk).tolist(), part.take(starts).to_pylist(), (ends - starts).tolist(), (total[ends] - total[starts + 1]).tolist(), s.take(starts).to_pylist(), s.take(ends - 1).to_pylist()))
            numbered = int(number[-1]) + 1
            if held is not None:
                if goes_on and rows[0][2] == held[2]:
                    a, z = held, rows[0]
                    rows[0] = (*a[:4], a[4] + z[4], a[5] + z[5] + (a[7] != z[6]), a[6], z[7])
                else:
                    rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield _states(rows)
        if held is not None:
            yield _states([held])

    return _with_offsets(runs, offsets).mapInArrow(run, _STATE)


def _states(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r[:7], r[6] is None, r[7], r[7] is None) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(zip(*full), _TYPES)], names=_NAMES)


def _with_offsets(runs: DataFrame, offsets: DataFrame) -> DataFrame:
    """A broadcast join keeps the order of its streamed side."""
    o = offsets.select(F.col("part").alias("p"), F.col("target_id").alias("t"), F.col("kind").alias("k"), "offset")
    same = (F.col("part") == F.col("p")) & F.col("target_id").eqNullSafe(F.col("t")) & F.col("kind").eqNullSafe(F.col("k"))
    return runs.join(F.broadcast(o), same, "left").select("part", "target_id", "kind", "source_id", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def merge_states(states: DataFrame) -> DataFrame:
    """target_id, kind, refs, sources from ordered chunk states."""
    w = Window.partitionBy("target_id", "kind").orderBy("chunk", "part", F.col("first_source").asc_nulls_first(), F.col("last_source").asc_nulls_first())
    same = F.lag("last_source").over(w).eqNullSafe(F.col("first_source")) & (F.lag("last_null").over(w) == F.col("first_null"))
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return states.withColumn("new", new).groupBy("target_id", "kind").agg(F.sum("refs").alias("refs"), F.sum(F.col("changes") + F.col("new")).cast("long").alias("sources"))


def key_totals(edges: DataFrame, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """target_id, kind, refs (distinct references), sources (distinct sources) of every key."""
    keys = ["target_id", "kind"]
    once = edges.select("source_id", "target_id", "kind", "source_line").distinct()
    # the count comes from the files' footers
    n = partitions or partitions_for(edges.count(), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = sorted_runs(once, keys, ["source_id", "source_line"], n)
    return merge_states(chunk_states(runs, part_offsets(runs, keys), chunk))


def hot_keys(totals: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys that hold at least ``share`` of all distinct references."""
    totals = cut_lineage(totals)
    everything = totals.agg(F.sum("refs")).first()[0] or 0
    return totals.filter(F.col("refs") >= F.lit(share) * F.lit(everything))
