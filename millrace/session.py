"""Session settings that the models rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    # TIMESTAMP, not TIMESTAMP_NTZ: watermarks and epoch functions reject the latter
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # dt and hr stay strings, so '07' is not read as 7
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a generated method of more bytes is never compiled by the JVM, and then slower than none
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "millrace", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
