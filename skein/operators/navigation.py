"""Looking up symbols: definitions, references, calls, outlines, diagnostics, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import escape
from skein.operators.graphmodel import CodeGraph
from skein.operators.search import fuzzy_scores

CALL_KINDS = ("calls", "type_ref", "instantiates")
LOW_CONFIDENCE = 0.80


def by_name(symbols: DataFrame, query: str) -> DataFrame:
    """A query with a dot names a qualified name, one without a simple name."""
    return symbols.filter(F.col("qualified_name" if "." in query else "name") == query)


def definition(g: CodeGraph, query: str) -> DataFrame:
    """Exact qualified names (confidence 1.0); only without any, symbols whose simple name is the query's last part (0.7)."""
    cols = ["id", "name", "qualified_name", "kind", "file_id", "line"]
    exact = g.every_symbol.filter(F.col("qualified_name") == query).select(*cols, F.lit(1.0).alias("confidence"))
    loose = g.every_symbol.filter(F.col("name") == query.rsplit(".", 1)[-1]).select(*cols, F.lit(0.7).alias("confidence"))
    # a guard of one row at most decides whether the fallback counts
    some = exact.limit(1).select(F.lit(True).alias("some"))
    return exact.unionByName(loose.join(some, F.col("some"), "left_anti"))


def references(g: CodeGraph, query: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Incoming edges of all symbols of a name: who refers, from where, how surely. Ordered output is a matter of the caller's limit."""
    targets = by_name(g.every_symbol, query).select(F.col("id").alias("target_id"))
    e = g.edges if kinds is None else g.edges.filter(F.col("kind").isin(*kinds))
    s = g.symbols.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source"), F.col("kind").alias("source_kind"), "file_id")
    f = g.files.select(F.col("id").alias("file_id"), "path")
    return e.join(targets, "target_id", "left_semi").join(s, "source_id").join(f, "file_id").select("source", "source_kind", "path", "kind", "source_line", "confidence", "target_id")


def incoming_calls(g: CodeGraph, query: str) -> DataFrame:
    return references(g, query, CALL_KINDS)


def outgoing_calls(g: CodeGraph, query: str) -> DataFrame:
    """Callees of all symbols of a name; the path is the callee's, the line the caller's."""
    sources = by_name(g.symbols, query).select(F.col("id").alias("source_id"))
    t = g.every_symbol.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target"), F.col("kind").alias("target_kind"), "file_id")
    f = g.files.select(F.col("id").alias("file_id"), "path")
    out = g.edges.filter(F.col("kind").isin(*CALL_KINDS)).join(sources, "source_id", "left_semi").join(t, "target_id").join(f, "file_id", "left")
    return out.select("source_id", "target", "target_kind", "path", "kind", "source_line", "confidence")


def degrees(g: CodeGraph) -> DataFrame:
    """id, incoming, outgoing for every symbol with an edge, counted in one pass over the edges."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.select("x.*").groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def symbol_info(g: CodeGraph) -> DataFrame:
    """Every symbol with its degrees and the number of its children (symbols in its scope in the same file)."""
    kids = g.symbols.filter("scope_path is not null").groupBy("file_id", F.col("scope_path").alias("qualified_name")).agg(F.count("*").alias("children"))
    s = g.symbols.select("id", "file_id", "name", "qualified_name", "kind", "line", "visibility").join(degrees(g), "id", "left").join(kids, ["file_id", "qualified_name"], "left")
    zero = F.lit(0).cast("long")
    return s.select("id", "name", "qualified_name", "kind", "line", "visibility", *[F.coalesce(c, zero).alias(c) for c in ("incoming", "outgoing", "children")])


def file_outline(g: CodeGraph, path: str, mode: str = "outline") -> DataFrame:
    """The symbols of a file; mode names, outline or full says how much of each."""
    cols = {"names": ["name", "line"], "outline": ["name", "kind", "line", "signature"], "full": ["name", "qualified_name", "kind", "line", "end_line", "scope_path", "signature", "doc_comment", "visibility"]}[mode]
    f = g.files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
    return g.symbols.join(f, "file_id", "left_semi").select(*cols)


def covering(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file_id, line) with the spans (file_id, first, last, ...) that hold them.

    A span is filed under the one or two blocks of its own size (1, 4, 16 ... lines) that
    it touches, a point under its block of every size that spans have. They meet by file,
    size and block, all equalities, so that a file with very many spans makes no more
    pairs than spans truly nest."""
    # the smallest k with 4^k lines or more
    size = F.ceil(F.round(F.log2((F.col("last") - F.col("first") + 1).cast("double")) / 2, 9)).cast("int")
    s = spans.filter("first is not null and last >= first").withColumn("size", size)
    # at most 17, lines being 32-bit numbers
    sizes = sorted(r[0] for r in s.select("size").distinct().collect())
    width = F.pow(F.lit(4.0), F.col("size"))
    s = s.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))))
    blocks = F.array(*[F.struct(F.lit(k).alias("size"), F.floor(F.col("line") / float(4**k)).alias("block")) for k in sizes or [0]])
    p = points.select("file_id", "line", F.explode(blocks).alias("at")).select("file_id", "line", "at.size", "at.block")
    met = p.join(s, ["file_id", "size", "block"])
    return met.filter((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last"))).drop("size", "block")


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """The narrowest symbol around each point (file_id, line): ties go to the later start, then the smaller id."""
    s = symbols.filter("line is not null").select("file_id", F.col("id").alias("symbol_id"), F.col("line").alias("first"), F.coalesce("end_line", "line").alias("last"))
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("span"), (-F.col("first")).alias("start"), "symbol_id")).alias("b")
    return covering(points, s).groupBy("file_id", "line").agg(best).select("file_id", "line", F.col("b.symbol_id").alias("symbol_id"), F.col("b.span").alias("span"))


def chunk_at(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """The narrowest chunk over each point (file_id, line)."""
    c = chunks.select("file_id", F.col("id").alias("chunk_id"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "chunk_id")).alias("b")
    return covering(points, c).groupBy("file_id", "line").agg(best).select("file_id", "line", F.col("b.chunk_id").alias("chunk_id"))


def diagnostics(g: CodeGraph, unresolved: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """path, line, severity, message: unresolved references and edges of low confidence of all files."""
    f = g.files.select(F.col("id").alias("file_id"), "path")
    lost = unresolved.join(f, "file_id").select("path", "line", F.lit("unresolved").alias("category"), F.format_string("Unresolved %s '%s'", "kind", "target_name").alias("message"))
    s, t = g.symbols.select(F.col("id").alias("source_id"), "file_id"), g.every_symbol.select(F.col("id").alias("target_id"), "qualified_name")
    low = g.edges.filter(F.col("confidence") < threshold).join(s, "source_id").join(t, "target_id").join(f, "file_id")
    percent = F.round(F.col("confidence") * 100).cast("int").cast("string")
    said = F.concat(F.lit("Low-confidence "), F.col("kind"), F.lit(" → '"), F.col("qualified_name"), F.lit("' ("), percent, F.lit("%)"))
    return lost.unionByName(low.select("path", F.col("source_line").alias("line"), F.lit("low_confidence").alias("category"), said.alias("message")))


def shown(df: DataFrame, signature: bool = True, doc: bool = False, width: int = 120) -> DataFrame:
    """Symbols as a list shows them: without their signature or documentation unless asked, and these as one line of at most ``width`` characters, the last of them a mark where something was left out."""
    out = df.drop(*[c for c, wanted in (("signature", signature), ("doc_comment", doc)) if not wanted])
    line = lambda c: F.when(F.length(F.substring_index(c, "\n", 1)) > width, F.concat(F.substring(F.substring_index(c, "\n", 1), 1, width - 1), F.lit("…"))).otherwise(F.substring_index(c, "\n", 1))
    return out.withColumns({c: line(c) for c in ("signature", "doc_comment") if c in out.columns})


def completion(g: CodeGraph, file_id: int, scope: str | None, prefix: str, limit: int = 30, tier_cap: int = 200, fuzzy: bool = False) -> DataFrame:
    """Names that begin with a prefix (or hold its letters in order, if ``fuzzy``), nearest first: 0 the same scope, 1 imported, 2 the same namespace. First tier wins; ``limit`` is the list's length."""
    letters = "(?i)" + ".*".join(map(escape, prefix))
    fits = F.col("name").rlike(letters) if fuzzy else F.lower("name").startswith(prefix.lower())
    cols = ["id", "name", "qualified_name", "kind"]
    parent = scope.rsplit(".", 1)[0] if scope and "." in scope else None
    near = g.symbols.filter(fits & (F.col("file_id") == file_id) & F.col("scope_path").eqNullSafe(scope)).select(*cols, F.lit(0).alias("distance"))
    names = g.imports.filter(F.col("file_id") == file_id).select(F.col("imported_name").alias("name")).distinct()
    known = g.every_symbol.filter(fits).join(names, "name", "left_semi").select(*cols, F.lit(1).alias("distance"))
    peers = g.symbols.filter(fits & F.col("scope_path").eqNullSafe(parent) & F.lit(parent is not None)).select(*cols, F.lit(2).alias("distance"))
    score = F.when(F.col("name") == prefix, 100).otherwise(F.lit(100) - F.length("name") + len(prefix))
    tier = Window.partitionBy("distance").orderBy(F.desc("score"), "qualified_name", "id")
    first = Window.partitionBy("qualified_name").orderBy("distance", "id")
    found = near.unionByName(known).unionByName(peers)
    found = fuzzy_scores(found, "name", prefix).drop("spots") if fuzzy else found.withColumn("score", score)
    every = found.withColumn("k", F.row_number().over(tier)).filter(F.col("k") <= tier_cap)
    once = every.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return once.orderBy("distance", F.desc("score"), "qualified_name").limit(limit)


def investigate(g: CodeGraph, query: str, callers: int = 10, callees: int = 10) -> DataFrame:
    """One list of a symbol's callers, callees and direct dependents: part, name, path, kind. Callers and callees go by the simple name."""
    simple = query.rsplit(".", 1)[-1]
    a = incoming_calls(g, simple).orderBy("path", F.col("source_line").asc_nulls_first(), "source", "kind", "target_id").limit(callers).select(F.lit("caller").alias("part"), F.col("source").alias("name"), "path", "kind")
    b = outgoing_calls(g, simple).orderBy(F.col("path").asc_nulls_first(), F.col("source_line").asc_nulls_first(), "target", "kind", "source_id").limit(callees).select(F.lit("callee").alias("part"), F.col("target").alias("name"), "path", "kind")
    c = references(g, query).select(F.lit("dependent").alias("part"), F.col("source").alias("name"), "path", "kind").distinct()
    return a.unionByName(b).unionByName(c)


def file_content(g: CodeGraph, path: str) -> DataFrame:
    """line (from 1), text of a file."""
    text = g.read("source_files").filter(F.col("path") == path)
    return text.select(F.posexplode(F.split("content", "\n")).alias("at", "text")).select((F.col("at") + 1).alias("line"), F.regexp_replace("text", r"\r$", "").alias("text"))


def browse(g: CodeGraph, folder: str = "") -> DataFrame:
    """name, is_folder, files of what lies directly in a folder."""
    head = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring("path", F.lit(len(head) + 1), F.length("path"))
    f = g.files.filter(F.startswith("path", F.lit(head))).select(F.split(rest, "/").alias("parts"))
    return f.groupBy(F.col("parts")[0].alias("name"), (F.size("parts") > 1).alias("is_folder")).agg(F.count("*").alias("files"))


def on_its_line(g: CodeGraph, refs: DataFrame) -> DataFrame:
    """The references (file_id, line, target_name, ...) whose line in the present text holds the last part of their name. Each text is split once and asked for the lines of its references."""
    asked = refs.filter("line is not null").groupBy("file_id").agg(F.collect_set(F.col("line")).alias("wanted"))
    lines = F.split("content", "\n")
    shown = g.read("source_files").select("file_id", lines.alias("lines")).join(asked, "file_id").select("file_id", F.explode("wanted").alias("line"), "lines").select("file_id", "line", F.get("lines", F.col("line")).alias("text"))
    return refs.join(shown, ["file_id", "line"]).filter(F.contains("text", F.substring_index("target_name", ".", -1))).drop("text")
