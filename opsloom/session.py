"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "opsloom", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster the master, memory and shuffle width come from the submit
    command; the arguments are for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (builder.master(master).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary folder is made, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("spark.opsloom.sharedDir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="opsloom-")
        spark.conf.set("spark.opsloom.sharedDir", own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    Later steps then start from files that outlive any executor. The folder
    goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/opsloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a worker.
BATCH = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches hold BATCH bytes at most, which keeps long texts from meeting in memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", conf.get(key) or "0")[0]) > BATCH:
        conf.set(key, f"{BATCH}b")
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan gives fewer tasks than cores.

    For costly narrow work on a table that comes in a few files or row groups.
    A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session, wherever the driver was started."""
    if spark.conf.get("spark.opsloom.shipped", None):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="opsloom-"), "opsloom"), "zip",
                                  os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.opsloom.shipped", "true")
