"""Problem 9: mixing sources to target weights.

Every source gets a quota of tokens. Its texts are put into a random order by hash and
laid end to end (exact offsets, see ``skein.operators.offsets``); a quota is a prefix of
that order, run through several times where a source is small. The order is cut into
blocks, and a splitting tree deals the blocks to output shards: at each node the blocks of
every source are divided between the two halves by a multivariate hypergeometric draw, so
that each shard gets exactly its number of blocks and, by chance alone, its own mix.
Shards then draw disjoint runs of blocks and shuffle them locally. Each draw depends on
the seed and the node alone, so the tree is nowhere stored: a task walks down from the
root to the shards of the blocks it holds. The driver knows the sources, nothing else.

The size of the mix is, unless given, the largest for which every source that has texts
can hold its share within its repeats. Shares of sources without texts fall to the others
in proportion; the report shows wanted and reached shares side by side. If a given size is
too large for a source, it gives all it may and the report shows its shortfall.

Results for odd input: copies of a text are one text (the smallest id keeps it), so that no
text is used more often than allowed; null and empty texts, null sources and sources that
the targets do not name are left out; targets that are null, negative or zero want
nothing; a null or negative number of repeats counts as 1 or 0; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.batches import map_columns
from skein.llm.tokens import TOKENIZER, token_counts
from skein.operators.offsets import part_offsets, partitions_for, sorted_runs
from skein.plans.session import cut_lineage

SEED = 17
BLOCK = 16_384  # tokens of a block
SHARD_BLOCKS = 64  # blocks of an output shard
MOST_BLOCKS = 500_000_000  # blocks of a mix, at most
FILLERS = 256  # texts of a source that are tried for the rest of its quota


def quotas(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens for each source."""
    live = {s: (w, max(0, 1 if r is None else r)) for s, w, r in targets if s is not None and w and w > 0 and available.get(s)}
    live = {s: x for s, x in live.items() if x[1]}
    weight = sum(w for w, _ in live.values())
    if not live:
        return {}
    most = {s: available[s] * r for s, (w, r) in live.items()}
    if total is None:
        total = int(min(most[s] * weight / w for s, (w, _) in live.items()))
    return {s: min(most[s], round(total * w / weight)) for s, (w, _) in live.items()}


class SplitTree:
    """Blocks of each source for each shard: shards get equal numbers of blocks (as far as they divide), sources give all of theirs. A shard's blocks of a source are a run of them, and runs follow each other as the shards do."""

    def __init__(self, blocks: list[int], shards: int, seed: int = SEED):
        self.blocks, self.shards, self.seed = blocks, shards, seed
        self.left = lru_cache(maxsize=4096)(self._left)

    def _left(self, lo: int, hi: int, have: tuple[int, ...]) -> tuple[int, ...]:
        """What of ``have`` the left half of the shards from lo to hi takes: its exact number of blocks, drawn without bias."""
        take = sum(have) * ((lo + hi) // 2 - lo) // (hi - lo)
        rng = np.random.default_rng([self.seed, lo, hi])
        return tuple(rng.multivariate_hypergeometric(np.array(have, dtype=np.int64), take, method="marginals").tolist())

    def shard_of(self, source: int, block: int) -> int:
        """The shard that gets a source's block: one way down the tree."""
        lo, hi, have = 0, self.shards, tuple(self.blocks)
        while hi - lo > 1:
            left, mid = self.left(lo, hi, have), (lo + hi) // 2
            if block < left[source]:
                hi, have = mid, left
            else:
                block -= left[source]
                lo, have = mid, tuple(a - b for a, b in zip(have, left))
        return lo


def _sizes(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    wanted = documents.filter("text is not null and source is not null and length(text) > 0").select("doc_id", "source", "text")
    # an inner join with the few target rows keeps only wanted sources
    wanted = wanted.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi") if targets.count() <= 10_000 else wanted.join(targets.select("source").distinct(), "source", "left_semi")
    sized = token_counts(wanted.withColumn("print", F.md5("text")), tokenizer)
    once = sized.groupBy("print").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x"))
    return once.select("x.doc_id", "x.source", F.col("x.tokens").cast("long").alias("tokens")).filter("tokens > 0")


def _positions():
    """Lays texts end to end; the offset is that of the source's first text in the partition."""
    at: dict[str, int] = {}

    def run(cols):
        out = []
        for s, n, off in zip(cols["source"], cols["tokens"], cols["offset"]):
            x = at.get(s, off)
            at[s] = x + n
            out.append(x)
        return {k: cols[k] for k in ("source", "doc_id", "tokens")} | {"at": out}

    return run


def _last_round(placed: DataFrame, rests: dict[str, int]) -> dict[str, dict[int, int]]:
    """For the last, partial round of each source: where texts stand that fill what its whole texts leave of the quota, less than one text, and where they come to stand. The next ``FILLERS`` texts that could fit are tried in order."""
    some = {s: n for s, n in rests.items() if n}
    if not some:
        return {}
    rest = F.create_map(*[F.lit(x) for kv in some.items() for x in kv])[F.col("source")]
    rows = placed.withColumn("rest", rest).filter("rest is not null").withColumn("whole", F.col("at") + F.col("tokens") <= F.col("rest"))
    ends = {r[0]: r[1] for r in rows.filter("whole").groupBy("source").agg(F.max(F.col("at") + F.col("tokens"))).collect()}
    end = F.create_map(*[F.lit(x) for s in some for x in (s, ends.get(s, 0))])[F.col("source")]
    fits = rows.filter(~F.col("whole")).filter(F.col("tokens") <= F.col("rest") - end)
    near = fits.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("at"))).filter(F.col("k") <= FILLERS)
    out: dict[str, dict[int, int]] = {s: {} for s in some}
    for s, at, n in sorted(tuple(r) for r in near.select("source", "at", "tokens").collect()):
        used = ends.get(s, 0)
        if used + n <= some[s]:
            out[s][at] = used
            ends[s] = used + n
    return out


_DRAWN = "shard int, source string, doc_id long, epoch int, block long, tokens long"


def draw_mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """shard, position, source, doc_id, epoch (0 for a text's first use), block, tokens."""
    spark = documents.sparkSession
    sizes = cut_lineage(_sizes(documents, targets, tokenizer).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
    goals = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").collect()]
    have = {r[0]: (r[1], r[2]) for r in sizes.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
    give = quotas({s: n for s, (n, _) in have.items()}, goals, total)
    names = {s: k for k, s in enumerate(sorted(give))}
    # a draw takes up to 10^9 blocks, so very large mixes have larger ones
    block = max(block, -(-sum(give.values()) // MOST_BLOCKS))
    blocks = [-(-give[s] // block) for s in names]
    shards = max(1, -(-sum(blocks) // shard_blocks))
    runs = sorted_runs(sizes, ["source"], ["h", "doc_id"], partitions_for(sum(n for _, n in have.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    offsets = part_offsets(runs, ["source"], "tokens").select(F.col("part").alias("p"), F.col("source").alias("s"), "offset")
    placed = runs.join(F.broadcast(offsets), (F.col("part") == F.col("p")) & (F.col("source") == F.col("s")), "left").select("source", "doc_id", "tokens", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
    placed = cut_lineage(map_columns(placed, _positions(), "source string, doc_id long, tokens long, at long"))
    everything = {s: n for s, (n, _) in have.items()}
    rests = {s: give.get(s, 0) % n for s, n in everything.items()}
    fill = _last_round(placed, rests)

    def run(batches):
        tree = SplitTree(blocks, shards, seed)
        for batch in batches:
            rows: list[tuple] = []
            for s, d, n, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                q, a = give.get(s, 0), everything[s]
                if not q:
                    continue
                uses = [e * a + x for e in range(q // a)]
                if x + n <= rests[s]:
                    uses.append(q // a * a + x)
                elif x in fill.get(s, ()):
                    uses.append(q // a * a + fill[s][x])
                for e, at in enumerate(uses):
                    b = min(at // block, blocks[names[s]] - 1)
                    rows.append((tree.shard_of(names[s], b), s, d, e, b, n))
            if rows:
                types = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _DRAWN.split(", ")])

    drawn = placed.mapInArrow(run, _DRAWN)
    # a shard holds a bounded number of blocks, so its shuffle is local
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "epoch"), "doc_id", "epoch")
    return drawn.select("shard", (F.row_number().over(shuffled) - 1).alias("position"), "source", "doc_id", "epoch", "block", "tokens")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, tokens, share (reached), texts, uses, most_uses of every target."""
    uses = mix.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    by = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    by = cut_lineage(by)
    everything = by.agg(F.sum("tokens")).first()[0] or 1
    zero = F.lit(0).cast("long")
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    return out.select("source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("tokens", "texts", "uses", "most_uses")], F.round(F.coalesce("tokens", zero) / F.lit(everything), 6).alias("share"))
