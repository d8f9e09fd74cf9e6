"""Session settings that the toolkit relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # GBK and GB18030 in decode() and the CSV reader
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "opsdesk", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
