"""Session helpers: a local session for tests and benches, scratch space, staged tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Whether what a query has shuffled is deleted when it ends, and not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of a file of a staged table, see ``scratch_path``.
_STAGED = re.compile(r".*/textpulse/[^/]+-[0-9a-f]{32}(?=/)")


def local_session(cpus: int | str = "*", app: str = "textpulse", memory: str = "16g") -> SparkSession:
    """A single-node session. Clusters bring their own session; nothing else here creates one."""
    partitions = "8" if cpus == "*" else str(max(int(cpus), 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list of rows from the driver. Unlike rows sent as an RDD, Spark knows their size."""
    if not rows:
        return spark.createDataFrame([], schema)
    names = [field.name for field in T.StructType.fromDDL(schema)]
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows))))), schema)


def importable(spark: SparkSession) -> None:
    """Lets workers on this machine import the package from where the driver has it, whatever their folder is.
    A cluster gets it by its own means (--py-files, an image); there the path is one more that does not exist."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [known.get("PYTHONPATH"), root]))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only where it is unset on one machine a temporary one, which goes
    with the process."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="textpulse-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/textpulse/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write rows that several later steps read to the shared folder, and go on from there.

    The steps before run once, what is read back survives the loss of executors, and its size is known. What was
    shuffled for it goes as soon as it is written, so that disk is taken by one step at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads; no later step may read them, nor one that is yet to run."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {m[0] for m in map(_STAGED.match, df.inputFiles()) if m}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
