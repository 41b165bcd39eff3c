"""Concepts: groups of symbols by name prefix, folder or stereotype; and budgeted context."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graphmodel import CodeGraph
from skein.operators.navigation import degrees
from skein.operators.search import bm25, words
from skein.plans.session import cut_lineage

#: Tokens that a symbol of a kind takes in a context; others take OTHER_TOKENS.
TOKENS = {"class": 200, "struct": 200, "method": 100, "function": 100, "interface": 80, "trait": 80, "enum": 50, "property": 20, "field": 20, "constant": 20}
OTHER_TOKENS = 60
#: Words of a task that ask for nothing.
STOP_WORDS = frozenset("a an the is are to from with for of in on by and or not this that it be do if at as no has have was were will can new all get set add make find what how where which when why who".split())


def discover(g: CodeGraph, known: DataFrame | None = None) -> DataFrame:
    """name, pattern: the first two parts of qualified names of three or more, without those known (name)."""
    found = g.symbols.filter(F.size(F.split("qualified_name", r"\.")) >= 3).select(F.substring_index("qualified_name", ".", 2).alias("name")).distinct()
    found = found if known is None else found.join(known, "name", "left_anti")
    return found.select("name", F.concat("name", F.lit(".*")).alias("pattern"))


def assign(g: CodeGraph, concepts: DataFrame) -> DataFrame:
    """name, symbol_id of the members of the concepts (name, pattern ``prefix.*``), whatever the case. Names meet prefixes by equality, one for each number of parts that prefixes have."""
    want = concepts.select("name", F.lower(F.regexp_replace("pattern", r"\.\*$", "")).alias("prefix"))
    parts = [r[0] for r in want.select(F.size(F.split("prefix", r"\.")).alias("n")).distinct().collect()]
    s = g.symbols.select(F.col("id").alias("symbol_id"), F.lower("qualified_name").alias("q"), F.size(F.split("qualified_name", r"\.")).alias("n"))
    cuts = s.select("symbol_id", F.explode(F.filter(F.array(*[F.when(F.col("n") > p, F.substring_index("q", ".", p)) for p in parts]) if parts else F.array().cast("array<string>"), lambda x: x.isNotNull())).alias("prefix"))
    return cuts.join(want, "prefix").select("name", "symbol_id")


def listed(concepts: DataFrame, members: DataFrame) -> DataFrame:
    """name, members: every concept with its number of members."""
    n = members.groupBy("name").agg(F.count("*").alias("members"))
    return concepts.select("name").join(n, "name", "left").select("name", F.coalesce("members", F.lit(0).cast("long")).alias("members"))


def folders(g: CodeGraph, least: int = 3) -> DataFrame:
    """name, pattern, symbols: folders (two path parts) with at least ``least`` symbols."""
    per = g.symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    f = g.files.select(F.col("id").alias("file_id"), F.substring_index("path", "/", 2).alias("name"))
    return f.join(per, "file_id").groupBy("name").agg(F.sum("n").alias("symbols")).filter(F.col("symbols") >= least).select("name", F.concat("name", F.lit("/*")).alias("pattern"), "symbols")


def budgeted(items: DataFrame, order: list, budget: int) -> DataFrame:
    """The first items in order whose tokens stay within the budget, at least one. Expects few items (a top-k list)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("total", F.sum("tokens").over(w)).withColumn("k", F.count("*").over(w)).filter((F.col("total") <= budget) | (F.col("k") == 1)).drop("k")


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", text.lower()) if w)


def smart_context(g: CodeGraph, task: str, budget: int = 4000, depth: int = 1, seeds: int = 30, fan: int = 20) -> DataFrame:
    """qualified_name, kind, hop, score, tokens, total: symbols that help with a task, best first, within a budget.

    Seeds are found by all words of the task, else by each of them that is no stop word,
    and, with 0.5, by names that hold a word of four letters or more (twenty a word).
    Neighbours are taken within ``depth`` edges in both directions (``fan`` a symbol in
    each). All are ranked by meaning, nearness, use, confidence of the edge that led to
    them (1 for seeds) and concept."""
    said = [t for t in task.split() if words_of(t)]
    docs = g.symbols.select("id", words("name", "qualified_name", "signature", "doc_comment").alias("words"))
    hits = cut_lineage(bm25(docs, [("", w, False) for t in said for w in [words_of(t)]]).orderBy(F.desc("score"), "id").limit(seeds))
    if hits.isEmpty():
        asked = [words_of(t) for t in said if t.lower() not in STOP_WORDS]
        parts = [bm25(docs, [("", w, False)]).orderBy(F.desc("score"), "id").limit(seeds) for w in asked]
        hits = reduce(DataFrame.unionByName, parts, hits)
    named = [g.symbols.filter(F.contains(F.lower("name"), F.lit(t.lower()))).select("id", F.lit(0.5).alias("score")).orderBy("id").limit(20) for t in said if len(t) >= 4]
    hits = reduce(DataFrame.unionByName, named, hits)
    top = hits.groupBy("id").agg(F.max("score").alias("meaning")).orderBy(F.desc("meaning"), "id").limit(seeds)
    top = cut_lineage(top)
    most = max(top.agg(F.max("meaning")).first()[0] or 0.0, 1.0)
    pairs = g.edges.groupBy("source_id", "target_id").agg(F.max("confidence").alias("sure"))
    both = pairs.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), F.lit("out").alias("way"), "sure").unionByName(pairs.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), F.lit("in").alias("way"), "sure"))
    seen = top.select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("sure"))
    frontier = top.select(F.col("id").alias("at"))
    for h in range(1, depth + 1):
        step = both.join(frontier, "at")
        w = Window.partitionBy("at", "way").orderBy("to")
        new = step.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= fan).groupBy(F.col("to").alias("id")).agg(F.max("sure").alias("sure")).join(seen, "id", "left_anti")
        new = cut_lineage(new)
        seen = seen.unionByName(new.select("id", F.lit(h).alias("hop"), "sure"))
        frontier = new.select(F.col("id").alias("at"))
    d = degrees(g).select("id", "incoming")
    s = g.symbols.select("id", "qualified_name", "kind")
    home = lambda c: F.substring_index(c, ".", 2)
    concept = top.join(s, "id").select(home("qualified_name").alias("concept")).distinct().withColumn("same", F.lit(1.0))
    c = seen.join(s, "id").join(top, "id", "left").join(d, "id", "left").withColumn("concept", home("qualified_name")).join(F.broadcast(concept), "concept", "left")
    c = cut_lineage(c.fillna({"meaning": 0.0, "incoming": 0, "same": 0.0}))
    peak = max(c.agg(F.max("incoming")).first()[0] or 0, 1)
    score = F.round(0.40 * F.col("meaning") / most + 0.25 / (1 + F.col("hop")) + 0.15 * F.col("incoming") / peak + 0.10 * F.col("sure") + 0.10 * F.col("same"), 6)
    cost = F.coalesce(F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])[F.col("kind")], F.lit(OTHER_TOKENS))
    once = c.select("id", "qualified_name", "kind", "hop", score.alias("score"), cost.alias("tokens")).groupBy("qualified_name").agg(F.max(F.struct("score", (-F.col("hop")).alias("near"), "tokens", "kind", (-F.col("id")).alias("first"))).alias("b"))
    flat = once.select("qualified_name", F.col("b.kind").alias("kind"), (-F.col("b.near")).alias("hop"), F.col("b.score").alias("score"), F.col("b.tokens").alias("tokens"))
    return budgeted(flat, [F.desc("score"), "qualified_name"], budget)
