"""The watch loop: change events as a stream, debounced and applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graphmodel import CodeGraph
from skein.operators.maintain import latest_changes
from skein.operators.reindex import reindex
from skein.sources.walker import language_of

EVENTS = "path string, change string, seq long, at timestamp"


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Change events that watchers append to a folder as JSON lines."""
    return spark.readStream.schema(EVENTS).json(folder)


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "100 milliseconds", until_idle: bool = False):
    """Gives ``apply`` the last change of each source file in every batch, and the batch's number, by which a repeated batch can be told. Starts and returns the query."""

    def batch(df: DataFrame, n: int) -> None:
        apply(latest_changes(df.filter(language_of("path").isNotNull())), n)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_idle else writer.trigger(processingTime=every)).start()


def bursts(events: DataFrame, gap: str = "100 milliseconds", late: str = "10 minutes") -> DataFrame:
    """path, began, ended, events: bursts of changes of a file, as session windows under a watermark; repeated deliveries count once."""
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["path", "seq"])
    return once.groupBy(F.session_window("at", gap).alias("w"), "path").agg(F.count("*").alias("events")).select("path", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def reindexing(spark: SparkSession, folder: Callable[[], str], texts: Callable[[DataFrame], DataFrame], publish: Callable[[dict[str, DataFrame], int], None]) -> Callable[[DataFrame, int], None]:
    """What ``watch`` does with a batch of changes (path, change) so that the graph follows them: reads the tables of the folder that holds by now, re-indexes with the present texts (path, content) of the changed files, and hands the new tables and the batch's number to ``publish``, which writes them and moves the folder on. A batch that comes again gives the same tables."""

    def handle(changes: DataFrame, batch: int) -> None:
        g = CodeGraph(spark, folder())
        publish(reindex(g, changes.select("path", F.when(F.col("change") == "deleted", "deleted").otherwise("modified").alias("change")), texts(changes)), batch)

    return handle
