"""Text search: ranked symbols, contents, lines, fuzzy names, vectors and their fusion."""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.batches import map_columns
from skein.functions.scalars import cosine, escape, in_scope, l2_distance, l2_normal, match_words
from skein.operators.graphmodel import CodeGraph
from skein.plans.session import cut_lineage

#: The ranking function's usual parameters and the fusion constant.
K1, B = 1.2, 0.75
RRF = 60


def words(*cols: str) -> Column:
    """Lower-case words of the columns together; letters and digits make a word."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *cols)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def parse_query(query: str) -> list[tuple[str, tuple[str, ...], bool]]:
    """The terms of a query, all of which must be met: (column or "", words in a row, whether the last is a prefix). Quotes make a phrase, ``column:`` asks one column only, ``*`` a prefix."""
    out = []
    for m in re.finditer(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))', query):
        said = m[2] if m[2] is not None else m[3]
        parts = tuple(w for w in re.split(r"[\W_]+", said.lower()) if w)
        if parts:
            out.append((m[1] or "", parts, m[2] is None and said.endswith("*")))
    return out


def _times(words_: Column, parts: tuple[str, ...], prefix: bool) -> Column:
    """How often words stand in a row."""
    fits = lambda w, t, last: F.startswith(w, F.lit(t)) if prefix and last else w == t
    if len(parts) == 1:
        return F.size(F.filter(words_, lambda w: fits(w, parts[0], True)))
    every = lambda i: reduce(lambda a, b: a & b, [fits(F.get(words_, i + k), t, k == len(parts) - 1) for k, t in enumerate(parts)])
    starts = F.sequence(F.lit(0), F.size(words_) - len(parts))
    return F.when(F.size(words_) >= len(parts), F.size(F.filter(starts, lambda i: F.coalesce(every(i), F.lit(False))))).otherwise(0)


def bm25(docs: DataFrame, terms: list, prefix: bool = False) -> DataFrame:
    """id, score of the documents (id, words, and words of single columns under their names) that hold all terms (words, or terms of ``parse_query``). Lengths and document counts come from all documents in one pass that keeps no text."""
    terms = [t if isinstance(t, tuple) else ("", (t.lower(),), prefix) for t in terms]
    hits = [_times(F.col(c or "words"), parts, p).alias(f"tf{i}") for i, (c, parts, p) in enumerate(terms)]
    counted = docs.select("id", F.size("words").alias("len"), *hits)
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _weight(F.col(f"tf{i}"), F.col("len"), stats[f"df{i}"] or 0, stats["n"], stats["mean"])
    keep = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(terms))], F.lit(bool(terms)))
    return counted.filter(keep).select("id", F.round(score, 6).alias("score"))


def _weight(tf: Column, length: Column, df: int, n: int, mean: float | None) -> Column:
    idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) if n else 1e-6
    tf = tf.cast("double")
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


# -- indexes: rows by word or by three letters, so that a search reads a few of them -------
def postings(docs: DataFrame) -> DataFrame:
    """word, id, tf, len of documents (id, words), for writing in partitions or buckets of words."""
    return docs.select("id", F.size("words").alias("len"), F.explode("words").alias("word")).groupBy("word", "id").agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))


def renew(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """An index (postings or grams, by id) after the documents ``changed`` (id) went or came anew: their old rows out, the fresh ones in."""
    return index.join(changed, "id", "left_anti").unionByName(fresh)


def bm25_index(index: DataFrame, terms: list[str]) -> DataFrame:
    """The same as ``bm25`` over whole words, from postings: only the rows of the asked words are read for scores."""
    terms = sorted({t.lower() for t in terms})
    size = index.groupBy("id").agg(F.first("len").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    asked = index.filter(F.col("word").isin(*terms))
    df = {r[0]: r[1] for r in asked.groupBy("word").agg(F.count("*")).collect()}
    weight = reduce(lambda c, t: c.when(F.col("word") == t, _weight(F.col("tf"), F.col("len"), df.get(t, 0), size["n"], size["mean"])), terms, F.when(F.lit(False), F.lit(0.0)))
    both = asked.groupBy("id").agg(F.sum(weight).alias("score"), F.count("*").alias("k"))
    return both.filter(F.col("k") == len(terms)).select("id", F.round("score", 6).alias("score"))


def grams(texts: DataFrame) -> DataFrame:
    """gram, id: the three-letter groups of texts (id, text), lower case, each once a text; a text is one row, so they are made without moving it."""

    def run(cols):
        out: dict[str, list] = {"gram": [], "id": []}
        for i, t in zip(cols["id"], cols["text"]):
            t = (t or "").lower()
            found = {t[k : k + 3] for k in range(len(t) - 2)}
            out["gram"] += found
            out["id"] += [i] * len(found)
        return out

    return map_columns(texts.select("id", "text"), run, "gram string, id long")


def holding(index: DataFrame, term: str) -> DataFrame:
    """id of the texts that hold all groups of a term: those that may hold the term itself."""
    t = term.lower()
    wanted = sorted({t[k : k + 3] for k in range(len(t) - 2)})
    rows = index.filter(F.col("gram").isin(*wanted)).groupBy("id").agg(F.count("*").alias("k"))
    return rows.filter(F.col("k") == len(wanted)).select("id")


def search_indexed(g: CodeGraph, index: DataFrame, query: str, **scope) -> DataFrame:
    """``search_content`` of the texts that the index (gram, id) lets through: those that hold all groups of a word are read, all others are not."""
    terms = [t.replace('""', '"') for t in match_words(query)]
    ids = reduce(DataFrame.unionByName, [holding(index, t) for t in terms if len(t) > 2]).distinct().withColumnRenamed("id", "file_id") if terms else None
    return search_content(g, query, ids, **scope)


def search_symbols(g: CodeGraph, query: str, limit: int = 500) -> DataFrame:
    """Symbols by BM25 over name, qualified name, signature and documentation; if none fits, by LIKE. See ``parse_query`` for what a query can say. ``limit`` is the list's length."""
    terms = parse_query(query)
    cols = ("name", "qualified_name", "signature", "doc_comment")
    if any(c and c not in cols for c, _, _ in terms) or not terms:
        return like_symbols(g, query).limit(limit)
    docs = g.symbols.select("id", words(*cols).alias("words"), *[words(c).alias(c) for c in {c for c, _, _ in terms} if c])
    # the ranking is a list of bounded length, kept while it is asked whether it is empty
    top = cut_lineage(bm25(docs, terms).orderBy(F.desc("score"), "id").limit(limit))
    if top.isEmpty():
        return like_symbols(g, query).limit(limit)
    return top.join(g.symbols.select("id", "name", "qualified_name", "kind"), "id")


def like_symbols(g: CodeGraph, query: str) -> DataFrame:
    """Symbols whose name or qualified name holds the query, % and _ being wild: id, score 0, name, qualified_name, kind."""
    pattern = f"%{query}%"
    hit = F.col("name").ilike(pattern) | F.col("qualified_name").ilike(pattern)
    return g.symbols.filter(hit).select("id", F.lit(0.0).alias("score"), "name", "qualified_name", "kind")


def search_content(g: CodeGraph, query: str, only: DataFrame | None = None, **scope) -> DataFrame:
    """file_id, path, hits of the files in scope (of ``only``, by file_id) whose content holds any word of the query (of three bytes or more), whatever the case."""
    terms = [t.replace('""', '"').lower() for t in match_words(query)]
    f = g.files.filter(in_scope("path", "language", **scope)).select(F.col("id").alias("file_id"), "path")
    body = F.lower("content")
    count = lambda t: ((F.length(body) - F.length(F.replace(body, F.lit(t), F.lit("")))) / len(t)).cast("int")
    hits = sum((count(t) for t in terms), F.lit(0))
    texts = g.read("source_files").select("file_id", "content")
    s = (texts if only is None else texts.join(only, "file_id", "left_semi")).filter(F.coalesce(F.greatest(*[F.contains(body, F.lit(t)) for t in terms], F.lit(False)), F.lit(False)))
    return s.select("file_id", hits.alias("hits")).join(f, "file_id")


def grep(g: CodeGraph, pattern: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False, **scope) -> DataFrame:
    """path, line (from 1), start, end (bytes of the first match), text of every line that matches, in all files in scope."""
    p = pattern if regex else escape(pattern)
    p = rf"\b(?:{p})\b" if whole_word else p
    p = f"(?i){p}" if ignore_case else p
    f = g.files.filter(in_scope("path", "language", **scope)).select(F.col("id").alias("file_id"), "path")
    rows = g.read("source_files").select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "raw"))
    text = F.regexp_replace("raw", r"\r$", "")
    hit = rows.select("file_id", (F.col("at") + 1).alias("line"), text.alias("text")).filter(F.col("text").rlike(p))
    start = F.regexp_instr("text", F.lit(p)) - 1
    found = F.regexp_substr("text", F.lit(p))
    before = F.octet_length(F.substring("text", F.lit(1), start))
    return hit.join(f, "file_id").select("path", "line", before.alias("start"), (before + F.octet_length(found)).alias("end"), "text")


def content_lines(g: CodeGraph, query: str, **scope) -> DataFrame:
    """The lines that hold the query as it is, in the files that ``search_content`` finds."""
    files = search_content(g, query, **scope).select("path")
    return grep(g, query, **scope).join(files, "path", "left_semi")


# -- fuzzy names --------------------------------------------------------------------
def _starts_word(text: str, i: int) -> bool:
    return i == 0 or not text[i - 1].isalnum() or (text[i].isupper() and text[i - 1].islower())


def fuzzy_score(query: str, text: str) -> tuple[int, list[int]] | None:
    """Score and matched positions of a query whose letters come in order in the text; None if they do not. Case counts only if the query has capitals.

    Of all ways to match, the best counts: runs, word starts and small gaps score."""
    t = text if query != query.lower() else text.lower()
    letters = [c for c in query if c != " "]
    # best[i]: score and way of the letters so far that end at position i
    best: dict[int, tuple[int, list[int]]] = {}
    for k, ch in enumerate(letters):
        here: dict[int, tuple[int, list[int]]] = {}
        lead: tuple[int, list[int]] | None = None  # best way that ends before i - 1
        for i, c in enumerate(t):
            if k and i >= 2 and i - 2 in best and (lead is None or best[i - 2][0] > lead[0]):
                lead = best[i - 2]
            if c != ch:
                continue
            bonus = 16 + (8 if _starts_word(text, i) else 0)
            ways = [(bonus - min(8, i), [i])] if k == 0 else []
            if k and i - 1 in best:
                ways.append((best[i - 1][0] + bonus + 12, [*best[i - 1][1], i]))
            if k and lead:
                ways.append((lead[0] + bonus - min(8, i - lead[1][-1]), [*lead[1], i]))
            if ways:
                here[i] = max(ways, key=lambda w: w[0])
        best = here
        if not best:
            return None
    score, way = max(best.values(), key=lambda w: (w[0], [-x for x in w[1]])) if best else (0, [])
    return score - min(20, len(text) // 8), way


def fuzzy_scores(df: DataFrame, column: str, query: str) -> DataFrame:
    """The rows whose column holds the letters of a query in order, with score and spots. A pattern keeps most rows from ever leaving the JVM."""
    smart = query != query.lower()
    pattern = ("" if smart else "(?i)") + ".*".join(escape(c) for c in query if c != " ")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score int, spots array<int>"

    def score(cols):
        got = [fuzzy_score(query, t) or (None, None) for t in cols[column]]
        return cols | {"score": [s for s, _ in got], "spots": [p for _, p in got]}

    return map_columns(df.filter(F.col(column).rlike(pattern)), score, schema).filter("score is not null")


def fuzzy(df: DataFrame, column: str, query: str, limit: int = 50) -> DataFrame:
    """The best rows by ``fuzzy_score`` of a column: all its columns, score, spots (a top-k list)."""
    return fuzzy_scores(df, column, query).orderBy(F.desc("score"), column, *[c for c in df.columns if c != column]).limit(limit)


# -- vectors --------------------------------------------------------------------------
def knn(vectors: DataFrame, query: list[float], limit: int = 100) -> DataFrame:
    """vec_id, distance of the nearest vectors (a top-k list), from all of them; the query is one small literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", F.round(l2_distance("embedding", q), 6).alias("distance")).orderBy("distance", "vec_id").limit(limit)


def cosine_top(vectors: DataFrame, query: list[float], limit: int = 100) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", F.round(cosine("embedding", q), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(limit)


def fuse(text: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """id, score: reciprocal ranks of two ranked lists (id, rank) added up."""
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    both = text.withColumnRenamed("rank", "a").join(near.withColumnRenamed("rank", "b"), "id", "full")
    return both.select("id", F.round(part("a") + part("b"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame, terms: list[str], query: list[float], limit: int = 20) -> DataFrame:
    """Documents (id, words) and vectors (vec_id = id) ranked apart and fused: id, score. Each list is overfetched to twice the limit, at least 20."""
    fetch = max(2 * limit, 20)
    t = bm25(docs, terms).orderBy(F.desc("score"), "id").limit(fetch).select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    v = knn(vectors, query, fetch).select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))
    return fuse(t, v, limit)


def hybrid_chunks(g: CodeGraph, vectors: DataFrame, query: str, near: list[float], limit: int = 20, **scope) -> DataFrame:
    """chunk_id, file_id, score, text_rank, vector_rank of code chunks: each inherits the rank of its file among those that hold the words, vectors (vec_id a chunk's id) rank chunks themselves, and reciprocal ranks add up. Both lists, and then the fused one, are cut at twice the limit (at least 20) before the scope and the limit apply."""
    fetch = max(2 * limit, 20)
    top = search_content(g, query).orderBy(F.desc("hits"), "path").limit(fetch)
    files = top.select("file_id", F.row_number().over(Window.orderBy(F.desc("hits"), "path")).alias("text_rank"))
    v = knn(vectors, near, fetch).select(F.col("vec_id").alias("chunk_id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("vector_rank"))
    chunks = g.read("code_chunks").select(F.col("id").alias("chunk_id"), "file_id")
    either = chunks.join(F.broadcast(files), "file_id", "left").join(F.broadcast(v), "chunk_id", "left").filter("text_rank is not null or vector_rank is not null")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    best = either.withColumn("score", F.round(part("text_rank") + part("vector_rank"), 9)).orderBy(F.desc("score"), "chunk_id").limit(fetch)
    kept = g.files.filter(in_scope("path", "language", **scope)).select(F.col("id").alias("file_id"))
    return best.join(kept, "file_id", "left_semi").orderBy(F.desc("score"), "chunk_id").limit(limit).select("chunk_id", "file_id", "score", "text_rank", "vector_rank")


def semantic(vectors: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    near = knn(vectors, query, limit)
    rank = F.row_number().over(Window.orderBy("distance", "vec_id"))
    return near.select(F.col("vec_id").alias("id"), F.round(1.0 / (RRF + rank), 9).alias("score"))


def embed(texts: DataFrame, dims: int = 64) -> DataFrame:
    """id, embedding of texts (id, text): words hashed with signs into ``dims`` places, of length 1. A stand-in wherever no model is at hand."""
    w = words("text")
    spots = texts.select("id", F.explode(w).alias("w")).select("id", F.pmod(F.xxhash64("w"), F.lit(dims)).cast("int").alias("at"), F.when(F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("x"))
    sums = spots.groupBy("id", "at").agg(F.sum("x").alias("x")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return sums.select("id", l2_normal(raw).alias("embedding"))


def rerank(refs: DataFrame, vectors: DataFrame, context: list[float] | None) -> DataFrame:
    """References (chunk_id, ...) with their chunk's likeness to a definition's context, most alike first in rank; without a context all are alike."""
    if context is None:
        return refs.withColumn("similarity", F.lit(None).cast("double"))
    q = F.array(*[F.lit(float(x)) for x in context])
    v = vectors.select(F.col("vec_id").alias("chunk_id"), F.round(cosine("embedding", q), 6).alias("similarity"))
    return refs.join(v, "chunk_id", "left")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunks (id, content) that have no vector yet."""
    return chunks.select("id", F.col("content").alias("text")).join(vectors.select(F.col("vec_id").alias("id")), "id", "left_anti")


def pack_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Little-endian bytes of float vectors in place of the column."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            packed = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in batch.column(k).to_pylist()]
            yield batch.set_column(k, column, pa.array(packed, pa.binary()))

    return vectors.mapInArrow(run, _retyped(vectors, column, "binary"))


def unpack_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Float vectors of little-endian bytes; bytes that are no whole numbers of floats make an empty vector."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            plain = [None if b is None else np.frombuffer(b, dtype="<f4") if len(b) % 4 == 0 else [] for b in batch.column(k).to_pylist()]
            yield batch.set_column(k, column, pa.array(plain, pa.list_(pa.float32())))

    return vectors.mapInArrow(run, _retyped(vectors, column, "array<float>"))


def _retyped(df: DataFrame, column: str, kind: str) -> str:
    return ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in df.schema)


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (vec_id, embedding) with the new ones in place of or beside the old."""
    return old.join(new.select("vec_id").distinct(), "vec_id", "left_anti").unionByName(new.dropDuplicates(["vec_id"]))


def drop_vectors(vectors: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors without those of the chunks (id, file_id) of some files (file_id)."""
    gone = chunks.join(files, "file_id", "left_semi").select(F.col("id").alias("vec_id"))
    return vectors.join(gone, "vec_id", "left_anti")


# -- history --------------------------------------------------------------------------
def history(log: DataFrame) -> DataFrame:
    """query, query_type, use_count, last_used_at, is_saved of an append-only log (query, query_type, at, saved)."""
    return log.groupBy("query", "query_type").agg(F.count("*").alias("use_count"), F.max("at").alias("last_used_at"), F.max("saved").alias("is_saved"))


def toggle_saved(entries: DataFrame, query: str, query_type: str) -> DataFrame:
    """The entries with one of them saved, or no longer saved."""
    this = (F.col("query") == query) & (F.col("query_type") == query_type)
    return entries.withColumn("is_saved", F.when(this, ~F.col("is_saved")).otherwise(F.col("is_saved")))


def saved_history(entries: DataFrame) -> DataFrame:
    return entries.filter("is_saved")


def prune_history(entries: DataFrame, keep: int) -> DataFrame:
    """The saved entries and the ``keep`` latest others."""
    others = entries.filter(~F.col("is_saved")).orderBy(F.desc("last_used_at"), "query", "query_type").limit(keep)
    return entries.filter("is_saved").unionByName(others)
