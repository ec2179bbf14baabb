"""Session settings for local runs and the settings we rely on anywhere."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning: splits skewed join partitions and merges small ones.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: str = "8", app: str = "edgeloom", memory: str = "12g") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    b = b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in ADAPTIVE.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
