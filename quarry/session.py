"""Session helpers: a configured SparkSession and a shared scratch folder.

Intermediate tables lie under ``spark.checkpoint.dir``, a reliable filesystem
that driver and executors share. A cluster without that setting is refused;
only a local master gets a folder of its own.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Rows a task of a training or feature job gets at most; small tables take few tasks.
ROWS_PER_TASK = 20_000


def get_spark(master: str | None = None, app: str = "quarry", shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession, path: str | None = None) -> str:
    """The shared folder for intermediate tables.

    It is the folder in ``spark.checkpoint.dir``, else the one the application
    has already set on its context, else ``path``. Only a local master may go
    without any of them; it gets a folder of its own, since driver and
    executors are one process there. On a cluster a missing folder is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else path)
    if not configured:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if not current.isDefined():
        context.setCheckpointDir(configured)
    return configured


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark)
    path = f"{root.rstrip('/')}/quarry-{name}-{uuid.uuid4().hex[:12]}"
    return path


def stored(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A table checkpointed in at least ``parts`` parts (none given: one per ``ROWS_PER_TASK`` rows).

    A join's output often comes in few large parts, which would keep all later work on few cores.
    """
    checkpoint_root(df.sparkSession)
    out = df.checkpoint(eager=True)
    parts = math.ceil(out.count() / ROWS_PER_TASK) if parts is None else parts
    return out.repartition(parts).checkpoint(eager=True) if out.rdd.getNumPartitions() < parts else out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._quarry_shipped = True
