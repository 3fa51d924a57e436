"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def build_session(app: str = "corpuslake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, so that they can import it wherever they run."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        archive = os.path.join(tempfile.mkdtemp(prefix="corpuslake-"), "corpuslake.zip")  # Spark copies it to the executors
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(PACKAGE):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, because executors could not read each other's machine-local files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslake-"))
        base = context.getCheckpointDir()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The rest of the plan survives lost executors, and Catalyst knows the true size of the table, so
    a join with it is broadcast exactly when that size is below the broadcast threshold. `options` are those of the writer.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table with fewer files than cores out to all cores before heavy work on them.

    A file of one row group is read by one task, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df
