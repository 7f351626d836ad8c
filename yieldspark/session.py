"""Session builder with the settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "yieldspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a master or size comes from spark-submit, or local for tests."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER_SET"):
        builder = builder.master(conf.pop("master", f"local[{os.environ.get('BENCH_CPUS', '*')}]"))
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
