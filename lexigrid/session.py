"""A local session with the settings the library is tuned for; on a cluster pass your own."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    build = SparkSession.builder.master(f"local[{cores}]").appName("lexigrid").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions)
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark
