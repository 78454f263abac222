"""A session with the settings that the engine relies on, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def keep(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder of spark.checkpoint.dir: it is computed once, and lost executors cost nothing before
    it. Local runs that leave the setting out get a folder of their own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(Path(tempfile.mkdtemp(prefix="tessera-")).as_uri())
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
