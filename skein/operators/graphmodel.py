"""The property graph as DataFrames: one place that reads tables and derives views from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import table

#: Edge kinds that lead from one file to another across languages.
FLOW_KINDS = ("http_call", "db_entity", "lsp_resolved", "scip_ref")


@dataclass
class CodeGraph:
    """Views over the tables of a folder. Nothing is read before it is used, and only the columns used are read."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def files(self) -> DataFrame:
        return self.read("files")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.read("symbols")

    @cached_property
    def every_symbol(self) -> DataFrame:
        """Symbols of the projects and of the runtime: id, file_id (null), name, qualified_name, kind, line (null)."""
        own = self.symbols.select("id", "file_id", "name", "qualified_name", "kind", "line")
        runtime = self.read("runtime_symbols").select("id", F.lit(None).cast("long").alias("file_id"), "name", "qualified_name", "kind", F.lit(None).cast("int").alias("line"))
        return own.unionByName(runtime)

    @cached_property
    def edges(self) -> DataFrame:
        """Edges by their key, with the greatest confidence of each."""
        return merge_edges(self.read("edges"))

    @cached_property
    def flow_edges(self) -> DataFrame:
        """File-level edges across languages; the target is null where it lies in the runtime."""
        s = self.symbols.select(F.col("id").alias("source_id"), F.col("file_id").alias("source_file_id"), F.col("qualified_name").alias("source_symbol"))
        t = self.symbols.select(F.col("id").alias("target_id"), F.col("file_id").alias("target_file_id"), F.col("line").alias("target_line"), F.col("qualified_name").alias("target_symbol"))
        f, g = self.files.select(F.col("id").alias("source_file_id"), F.col("language").alias("source_language")), self.files.select(F.col("id").alias("target_file_id"), F.col("language").alias("target_language"))
        e = self.edges.filter(F.col("kind").isin(*FLOW_KINDS)).withColumnRenamed("kind", "edge_type")
        return e.join(s, "source_id").join(f, "source_file_id").join(t, "target_id", "left").join(g, "target_file_id", "left")

    @cached_property
    def imports(self) -> DataFrame:
        """file_id, imported_name, module_path and the first line of it, from import edges."""
        s = self.symbols.select(F.col("id").alias("source_id"), "file_id")
        t = self.every_symbol.select(F.col("id").alias("target_id"), F.col("name").alias("imported_name"), "qualified_name")
        module = F.expr("CASE WHEN instr(qualified_name, '.') > 0 THEN substring(qualified_name, 1, length(qualified_name) - length(imported_name) - 1) END")
        return self.edges.filter("kind = 'imports'").join(s, "source_id").join(t, "target_id").select("file_id", "imported_name", module.alias("module_path"), "source_line").groupBy("file_id", "imported_name", "module_path").agg(F.min("source_line").alias("line"))

    @cached_property
    def refs(self) -> DataFrame:
        """Unresolved references as an extractor leaves them: source_id, file_id, target_name (qualified, simple or unknown), kind, line, wanted (the true target)."""
        t = self.every_symbol.select(F.col("id").alias("target_id"), "name", "qualified_name")
        e = self.edges.filter(~F.col("kind").isin("imports")).groupBy("source_id", "target_id", "kind").agg(F.min("source_line").alias("line"))
        way = F.pmod(F.col("source_id") + F.col("target_id"), F.lit(4))
        name = F.when(way == 0, F.col("qualified_name")).when(way < 3, F.col("name")).otherwise(F.concat(F.lit("Missing"), F.col("target_id").cast("string")))
        s = self.symbols.select(F.col("id").alias("source_id"), "file_id")
        return e.join(t, "target_id").join(s, "source_id").select("source_id", "file_id", name.alias("target_name"), "kind", "line", F.col("target_id").alias("wanted"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row a key, its confidence only ever rising. Rows without a line never share a key."""
    return edges.groupBy("source_id", "target_id", "kind", "source_line").agg(F.max("confidence").alias("confidence"))


#: The same views as SQL for DuckDB.
VIEWS = {
    "sym": """sym AS (SELECT id, file_id, name, qualified_name, kind, line FROM symbols UNION ALL
      SELECT id, CAST(NULL AS BIGINT), name, qualified_name, kind, CAST(NULL AS INTEGER) FROM runtime_symbols)""",
    "e": "e AS (SELECT source_id, target_id, kind, source_line, max(confidence) AS confidence FROM edges GROUP BY ALL)",
    "flow": """flow AS (SELECT e.source_id, e.target_id, e.kind AS edge_type, e.source_line, e.confidence, s.file_id AS source_file_id, s.qualified_name AS source_symbol, f.language AS source_language,
      t.file_id AS target_file_id, t.line AS target_line, t.qualified_name AS target_symbol, g.language AS target_language
      FROM e JOIN symbols s ON s.id = e.source_id JOIN files f ON f.id = s.file_id LEFT JOIN symbols t ON t.id = e.target_id LEFT JOIN files g ON g.id = t.file_id
      WHERE e.kind IN ('http_call', 'db_entity', 'lsp_resolved', 'scip_ref'))""",
    "imp": """imp AS (SELECT s.file_id, t.name AS imported_name,
      CASE WHEN contains(t.qualified_name, '.') THEN substr(t.qualified_name, 1, length(t.qualified_name) - length(t.name) - 1) END AS module_path, min(e.source_line) AS line
      FROM e JOIN symbols s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id WHERE e.kind = 'imports' GROUP BY 1, 2, 3)""",
    "refs": """refs AS (SELECT x.source_id, s.file_id, CASE WHEN (x.source_id + x.target_id) % 4 = 0 THEN t.qualified_name WHEN (x.source_id + x.target_id) % 4 < 3 THEN t.name
      ELSE 'Missing' || x.target_id END AS target_name, x.kind, x.line, x.target_id AS wanted
      FROM (SELECT source_id, target_id, kind, min(source_line) AS line FROM e WHERE kind <> 'imports' GROUP BY ALL) x JOIN sym t ON t.id = x.target_id JOIN symbols s ON s.id = x.source_id)""",
}


def with_views(*names: str) -> str:
    """``WITH RECURSIVE`` and the named views, in order."""
    return "WITH RECURSIVE " + ",\n".join(VIEWS[n] for n in names)
