"""Session settings that suit the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "gridloom", cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine. On a cluster, build your own and keep the time zone and adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": shuffle_partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
