"""Problem 8: filling containers of fixed capacity.

Best-two-fit: a container is filled greedily with the largest document that fits; then its
smallest document is exchanged for two unpacked ones that fit the gap so made more
tightly, as long as that helps. Only sizes move: documents are dealt by hash to shards
of about ``SHARD`` items, each of which is packed by itself and can be packed again
alike; a shard leaves at most one container badly filled. Sizes are small integers, so
the largest size not above a gap is one bit operation.

Results for odd input: null texts are no texts; empty ones take no room in the first
container of their shard; texts longer than a container are cut into full containers and
a rest that is packed like a text; repeated rows are packed each; extra columns are
ignored; an empty table gives no containers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tokens import TOKENIZER, token_pieces
from skein.plans.session import cut_lineage

CAPACITY = 2048
SHARD = 200_000


class Shelf:
    """Unpacked items by size."""

    def __init__(self, sizes: list[int], capacity: int):
        self.by: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for i in range(len(sizes) - 1, -1, -1):
            self.by[sizes[i]].append(i)
            self.mask |= 1 << sizes[i]

    def largest(self, most: int) -> int:
        """Largest size up to ``most``, 0 if there is none. Size 0 is bit 0 and never asked for."""
        return (self.mask & ((1 << (most + 1)) - 2)).bit_length() - 1 if most > 0 and self.mask & ((1 << (most + 1)) - 2) else 0

    def take(self, size: int) -> int:
        items = self.by[size]
        i = items.pop()
        if not items:
            self.mask &= ~(1 << size)
        return i

    def put(self, size: int, i: int) -> None:
        self.by[size].append(i)
        self.mask |= 1 << size

    def pair(self, most: int) -> tuple[int, int]:
        """Two sizes with the largest sum up to ``most``, (0, 0) if there are none."""
        best, found = 0, (0, 0)
        a = self.largest(most - 1)
        while a and 2 * a > best:
            b = self.largest(min(a, most - a))
            if b == a and len(self.by[a]) < 2:
                b = self.largest(min(a - 1, most - a))
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == most:
                    break
            a = self.largest(a - 1)
        return found


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of indices into ``sizes``; every index is in exactly one."""
    shelf = Shelf(sizes, capacity)
    bins: list[list[int]] = []
    while shelf.mask & ~1:
        got: list[tuple[int, int]] = []  # sizes fall
        gap = capacity
        while size := shelf.largest(gap):
            got.append((size, shelf.take(size)))
            gap -= size
        while gap and got:
            small, i = got[-1]
            a, b = shelf.pair(gap + small)
            if a + b <= small:
                break
            got.pop()
            got += [(a, shelf.take(a)), (b, shelf.take(b))]
            shelf.put(small, i)
            gap += small - a - b
            got.sort(reverse=True)
        bins.append([i for _, i in got])
    if shelf.by[0]:
        if not bins:
            bins.append([])
        bins[0].extend(reversed(shelf.by[0]))
    return bins


_OUT = "container long, doc_id long, piece int, tokens int, start_char int, end_char int"


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """container, doc_id, piece, tokens, start_char, end_char of every piece of text."""
    sizes = cut_lineage(token_pieces(documents, capacity, tokenizer))
    shards = max(1, -(-sizes.count() // shard))
    dealt = sizes.repartition(shards, F.xxhash64("doc_id", "piece", "tokens")).sortWithinPartitions(F.desc("tokens"), "doc_id", "piece").withColumn("shard", F.spark_partition_id())

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        bins = pack(t.column("tokens").to_pylist(), capacity)
        first = t.column("shard")[0].as_py() << 32
        order = pa.array([i for b in bins for i in b], pa.int64())
        ids = pa.array([first + k for k, b in enumerate(bins) for _ in b], pa.int64())
        out = t.take(order).drop_columns(["shard"]).add_column(0, "container", ids)
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(run, _OUT)


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, texts, tokens, least (containers that any packing needs), filled (share of the room)."""
    by = containers.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    out = by.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return out.select("containers", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("filled"))
