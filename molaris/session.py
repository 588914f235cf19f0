"""Session settings the reports run best with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Folder of the package; on a cluster the package is installed at the same place or sent along.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# The JVM does not compile methods above 8000 bytes of bytecode; past that a fused stage runs
# interpreted and is slower than its operators one by one, so let Spark split it there. Wide
# records with many rules get that large.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def workers_find_package(spark: SparkSession) -> None:
    """Python workers that read files import the package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
