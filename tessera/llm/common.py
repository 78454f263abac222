"""What the operators of this subpackage share: session settings, durable cuts of lineage, reading of tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[2]
#: The tables that cut() has written and nobody has deleted, with their sessions and the threads that wrote them.
_left: dict[str, tuple[SparkSession, int]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset. That is only
    for local runs: on a cluster each machine would see its own, so there the setting must be given."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="tessera-")).as_uri()
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to a parquet table in the shared folder and read it back: lost executors cost no recomputation of what stands before.
    The table stays, for results that are read later, until forget() or the end of the driver's Python."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    if not _left:
        atexit.register(_clear)
    _left[path] = spark, threading.get_ident()
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables of frames that cut() gave and that nothing will read again."""
    for f in frames:
        _delete(f._tessera_path, _left.pop(f._tessera_path, (None, 0))[0])


def written() -> set[str]:
    """The tables that cut() has written so far in this thread and that are still there."""
    return {path for path, (_, thread) in list(_left.items()) if thread == threading.get_ident()}


def forget_but(before: set[str], keep: DataFrame) -> None:
    """Delete the tables that this thread has written since before = written(), all but keep."""
    for path in written() - before - {keep._tessera_path}:
        _delete(path, _left.pop(path)[0])


def _delete(path: str, spark: SparkSession | None) -> None:
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    """At the end of the driver's Python, while Spark still runs."""
    for path, (spark, _) in list(_left.items()):
        if spark.sparkContext._jsc is not None:
            _delete(path, spark)


def tune(spark: SparkSession) -> None:
    """Keep batches of rows small, as texts may be very long, and let the workers find this package. These three settings hold
    for the session from then on: plans are lazy, so they must still hold when the caller runs them. No result changes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    found = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(_ROOT) not in found and Path.cwd() != _ROOT and not getattr(spark.sparkContext, "_tessera_shipped", False):
        to = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in (_ROOT / "tessera").rglob("*.py"):
                z.write(p, p.relative_to(_ROOT))
        spark.sparkContext.addPyFile(str(to))
        spark.sparkContext._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
