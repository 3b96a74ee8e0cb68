"""Session settings the toolkit is tuned for.

Everything here is optional: every operator works on whatever session it is
given.  Sizing is left to the cluster (AQE coalesces and splits partitions),
so no partition counts are fixed unless the caller passes them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Jobs that run at the same time share the cores.
    "spark.scheduler.mode": "FAIR",
    # Aggregates of more than 100 buffer fields would otherwise not be compiled.
    "spark.sql.codegen.maxFields": "2000",
}


def get_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {key.replace("__", "."): str(value) for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
