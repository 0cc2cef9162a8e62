"""What Python workers need from the driver."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = __name__.split(".")[0]
MAX_KEYS = 1_500_000  # keys that are broadcast at most
_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that workers
    can import it wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{PACKAGE}_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts have 4 MB at most."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= most:
        spark.conf.set(key, str(most))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none: one
    under the warehouse, or on a local master a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="lodestone-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.lodestone"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, parts: tuple[str, ...] = ()) -> DataFrame:
    """df with its rows fixed and its lineage ended: a compressed table in the
    shared folder, with a folder for each value of ``parts``."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Deletes the tables of cut frames."""
    for df in cuts:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.lodestone_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of plans that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def narrow(keys: DataFrame) -> DataFrame:
    """Keys for a semi or anti join; up to MAX_KEYS are broadcast, so that what
    they are joined with stays where it is."""
    return F.broadcast(keys) if keys.count() <= MAX_KEYS else keys
