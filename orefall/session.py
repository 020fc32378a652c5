"""Sessions, and this package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARCHIVE = "orefall_code.zip"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each Spark context.

    The driver serves the archive itself, so nothing need be installed on the executors.
    """
    sc = spark.sparkContext
    if ARCHIVE not in sc._python_includes:
        root = Path(__file__).resolve().parent
        path = os.path.join(os.path.abspath(tempfile.mkdtemp(prefix="orefall-code-")), ARCHIVE)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent).as_posix())
        sc.addPyFile(path)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "orefall", **conf: str) -> SparkSession:
    """A one-machine session with the settings that tests and benchmarks use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of files over all cores: files with fewer splits than cores are dealt anew, by a hash of ``keys``.

    Work that is heavy for each row would otherwise keep a core a split busy and leave the
    others idle. Tables with splits enough, as all large ones, stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder is set and used; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="orefall-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")
