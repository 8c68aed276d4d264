"""Session settings the operators are planned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName("sequor")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: spark.checkpoint.dir, which a cluster must name.

    Without it a session of one machine gets a temporary folder.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sequor-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()
