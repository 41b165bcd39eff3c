"""Resolving references: a ladder of joins of which the first step that answers wins.

Each step yields candidates with its confidence; the best step of each reference is a
minimum over structs, which is aggregated before it is shuffled. Joins go by names, so a
name with many symbols meets only the references to it; AQE splits the hot ones. Where a
module must be compared with names or paths, each pair of a module and an asked name is
compared once, whatever number of files and references share it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import module_fits
from skein.operators.graphmodel import CodeGraph

#: Confidence of each step.
STEPS = {1: 0.95, 2: 0.92, 3: 0.90, 4: 0.85, 5: 0.80, 6: 0.50}
#: Which kinds of symbols an edge kind fits.
FITS = {"calls": ("method", "function", "constructor", "test"), "inherits": ("class", "struct"), "implements": ("interface",), "type_ref": ("class", "struct", "interface", "enum", "type_alias", "namespace", "delegate"), "instantiates": ("class", "struct")}


def resolve(g: CodeGraph, refs: DataFrame | None = None) -> DataFrame:
    """``ladder`` over the graph's own symbols and imports."""
    return ladder(g.refs if refs is None else refs, g.every_symbol, g.files, g.imports, namespaces(g.symbols))


def namespaces(symbols: DataFrame) -> DataFrame:
    """file_id, space: the first namespace symbol of each file."""
    first = symbols.filter("kind = 'namespace' and file_id is not null").groupBy("file_id").agg(F.min(F.struct("line", "id", "qualified_name")).alias("x"))
    return first.select("file_id", F.col("x.qualified_name").alias("space"))


def ladder(refs: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame, spaces: DataFrame) -> DataFrame:
    """source_id, target_name, kind, step, target_id, confidence of every reference (source_id, target_name, kind, file_id) that one of the steps answers.

    1 the name is imported (its first import in the file counts) and the candidate's path
    answers to the module, or it is the only symbol of that name; 2 the name in an
    imported dotted module; 3 qualified name; 4 the name in the namespace of the file; 5 a
    candidate below a module that the file imports, by its qualified name or its path; 6
    simple name, fitting kinds first. Ties go to the smallest id."""
    key = ["source_id", "target_name", "kind"]
    refs = refs.select(*key, "file_id").distinct()
    paths = files.select(F.col("id").alias("sym_file"), "path")
    syms = symbols.select(F.col("id").alias("target_id"), F.col("file_id").alias("sym_file"), "name", "qualified_name", F.col("kind").alias("sym_kind"))
    plain = refs.filter(~F.contains("target_name", F.lit(".")))
    imports = imports.select("file_id", "imported_name", "module_path", "line")

    asked = plain.select("file_id", "target_name").distinct()
    first = imports.groupBy("file_id", "imported_name").agg(F.min(F.struct(F.coalesce("line", F.lit(2**31 - 1)), "module_path")).alias("x")).select("file_id", F.col("imported_name").alias("target_name"), F.col("x.module_path").alias("module"))
    named = asked.join(first, ["file_id", "target_name"]).filter("module is not null and module <> ''").select("file_id", "target_name", "module", F.lit(True).alias("by_name"))
    modules = imports.filter("module_path is not null and module_path <> ''").select("file_id", F.col("module_path").alias("module")).distinct()
    held = asked.join(modules, "file_id").select("file_id", "target_name", "module", F.lit(False).alias("by_name"))
    wants = named.unionByName(held)
    # one answer for each module and name: the smallest candidate by path, by name below the module, and the only one
    below = F.startswith("qualified_name", F.concat("module", F.lit("."))) | (F.col("qualified_name") == F.col("module"))
    by_path = F.coalesce(module_fits("path", "module"), F.lit(False))
    met = wants.select("target_name", "module").distinct().join(syms.join(paths, "sym_file", "left"), F.col("target_name") == F.col("name"))
    found = met.groupBy("target_name", "module").agg(F.min(F.when(by_path, F.col("target_id"))).alias("at_path"), F.min(F.when(by_path | below, F.col("target_id"))).alias("inside"), F.when(F.count("*") == 1, F.min("target_id")).alias("only"))
    answers = wants.join(found, ["target_name", "module"]).select("file_id", "target_name", F.when(F.col("by_name"), F.coalesce("at_path", "only")).alias("one"), F.when(~F.col("by_name"), F.col("inside")).alias("five"))
    answers = answers.groupBy("file_id", "target_name").agg(F.min("one").alias("one"), F.min("five").alias("five"))
    by_module = plain.join(answers, ["file_id", "target_name"])
    s1 = by_module.filter("one is not null").select(*key, F.lit(1).alias("step"), F.col("one").alias("target_id"))
    s5 = by_module.filter("five is not null").select(*key, F.lit(5).alias("step"), F.col("five").alias("target_id"))
    prefixes = imports.select("file_id", F.explode(F.array("module_path", "imported_name")).alias("prefix")).filter(F.contains("prefix", F.lit("."))).distinct()
    full = lambda df, head: df.select(*key, F.concat_ws(".", head, "target_name").alias("wanted_name"))
    s2 = full(plain.join(prefixes, "file_id"), "prefix").join(syms, F.col("wanted_name") == F.col("qualified_name"))
    s3 = refs.filter(F.contains("target_name", F.lit("."))).join(syms, F.col("target_name") == F.col("qualified_name"))
    s4 = full(plain.join(spaces, "file_id"), "space").join(syms, F.col("wanted_name") == F.col("qualified_name"))
    fits = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("sym_kind").isin(*v) for k, v in FITS.items()]) | ~F.col("kind").isin(*FITS)
    # one best symbol per name and edge kind, found before the references come in
    kinds = plain.select("target_name", "kind").distinct()
    six = kinds.join(syms, F.col("target_name") == F.col("name")).groupBy("target_name", "kind").agg(F.min(F.struct((~fits).alias("odd"), "target_id")).alias("b")).select("target_name", "kind", F.col("b.target_id").alias("target_id"))
    s6 = plain.join(six, ["target_name", "kind"])
    steps = [s1, s5, *(s.select(*key, F.lit(i).alias("step"), "target_id") for i, s in ((2, s2), (3, s3), (4, s4), (6, s6)))]
    best = reduce(DataFrame.unionByName, steps).groupBy(*key).agg(F.min(F.struct("step", "target_id")).alias("b"))
    confidence = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])[F.col("b.step")]
    return best.select(*key, F.col("b.step").alias("step"), F.col("b.target_id").alias("target_id"), confidence.alias("confidence"))


def unresolved(g: CodeGraph) -> DataFrame:
    """source_id, file_id, target_name, kind, line of the references that no step answers."""
    return g.refs.select("source_id", "file_id", "target_name", "kind", "line").join(resolve(g), ["source_id", "target_name", "kind"], "left_anti")
