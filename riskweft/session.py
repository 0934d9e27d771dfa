"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app_name: str = "riskweft", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings this package expects.

    ``conf`` keys use ``__`` for dots (``spark__driver__memory="8g"``).  Shuffle
    width and file split size are left to the cluster; AQE coalesces from there.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_checkpoints(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``.

    Only a local master without the setting gets a folder of its own; on a cluster
    a machine-local folder would be lost together with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskweft-checkpoint-"))
    else:
        raise ValueError("Set spark.checkpoint.dir to a folder shared by the cluster")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
