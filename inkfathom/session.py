"""A session with the settings the library is tested under; on a cluster the caller's own session is used."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in more.items()}
    spark = SparkSession.builder.appName("inkfathom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
