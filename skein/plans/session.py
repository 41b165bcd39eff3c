"""Settings of a session that operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of this machine only where the session names none (tests, local mode)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="skein-"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
        # files of checkpoints that nothing refers to any more are removed
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs no more than a read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
