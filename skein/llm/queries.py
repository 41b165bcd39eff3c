"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.chunks import LIMIT, OVERLAP, TOKEN, split_chunks, split_oversized
from skein.llm.docpairs import code_pairs, documented_functions
from skein.llm.handwritten import classify_files
from skein.llm.mixing import draw_mix, mix_report
from skein.llm.packing import CAPACITY, fill_containers, fill_report
from skein.llm.truncated import field_limits, find_truncated
from skein.llm.validity import check_files, invalid_rates
from skein.sources.tables import table


def p2_found(spark, d):
    pieces = split_oversized(table(spark, d, "code_chunks"))
    return pieces.filter("piece = 0 and pieces > 1").select("chunk_id")


def p2_pieces(spark, d):
    return split_chunks(table(spark, d, "code_chunks"))


def p3_found(spark, d):
    found = documented_functions(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "source_files"))
    return found.select("symbol_id").distinct()


def p3_pairs(spark, d):
    return code_pairs(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "source_files"))


def p4_found(spark, d):
    return classify_files(table(spark, d, "files"), table(spark, d, "source_files")).filter("class is not null").select("file_id")


def p4_classes(spark, d):
    by = classify_files(table(spark, d, "files"), table(spark, d, "source_files")).groupBy("project", F.coalesce("class", F.lit("handwritten")).alias("class"))
    return by.agg(F.count("*").alias("files"), F.count("shared").alias("shared"))


def p5_found(spark, d):
    return check_files(table(spark, d, "files"), table(spark, d, "source_files")).filter("not valid").select("file_id")


def p5_rates(spark, d):
    return invalid_rates(check_files(table(spark, d, "files"), table(spark, d, "source_files")))


def p8_containers(spark, d):
    return fill_containers(table(spark, d, "documents"))


def p8_fill(spark, d):
    return fill_report(fill_containers(table(spark, d, "documents")))


def p9_mix(spark, d):
    return draw_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    targets = table(spark, d, "mix_targets")
    return mix_report(draw_mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark, d):
    return find_truncated(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_rates(spark, d):
    by = find_truncated(table(spark, d, "documents")).groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return by.withColumn("rate", F.round(F.col("cut") / F.col("texts"), 6))


def p10_limits(spark, d):
    return field_limits(table(spark, d, "documents"), ["text"])


def p10_causes(spark, d):
    """What each kind of evidence finds: length spikes alone (limit), what the end shows by itself (tail, mark), word statistics (word)."""
    return find_truncated(table(spark, d, "documents")).filter("cut").groupBy("why").agg(F.count("*").alias("texts"))


def p2_cover(spark, d):
    """The characters that the pieces of each chunk cover, overlaps counted once, and whether all keep the limit."""
    by = split_chunks(table(spark, d, "code_chunks")).groupBy("chunk_id").agg((F.sum(F.length("content")) - OVERLAP * TOKEN * (F.max("pieces") - 1)).alias("chars"), (F.max("tokens") <= LIMIT).alias("fits"))
    return by


def p8_cover(spark, d):
    """The characters of each text that containers hold, and whether none is too full."""
    c = fill_containers(table(spark, d, "documents"))
    full = c.groupBy("container").agg(F.sum("tokens").alias("held"))
    worst = full.agg(F.max("held")).first()[0] or 0
    return c.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).cast("long").alias("chars"), F.lit(worst <= CAPACITY).alias("fits"))


def p9_kept(spark, d):
    """Of each wanted source, whether no text is used more often than it may."""
    targets = table(spark, d, "mix_targets")
    return mix_report(draw_mix(table(spark, d, "documents"), targets), targets).select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("within"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_pairs, p4_found, p4_classes, p5_found, p5_rates, p8_containers, p8_fill, p9_mix, p9_shares, p10_found, p10_rates, p10_limits, p10_causes, p2_cover, p8_cover, p9_kept)}

SQL = {
    "p2_found": "SELECT id AS chunk_id FROM code_chunks WHERE length(content) > 2048",
    "p2_cover": "SELECT id AS chunk_id, length(content) AS chars, TRUE AS fits FROM code_chunks",
    "p8_cover": "SELECT doc_id, length(text) AS chars, TRUE AS fits FROM documents WHERE text IS NOT NULL",
    "p9_kept": "SELECT source, TRUE AS within FROM mix_targets",
}
