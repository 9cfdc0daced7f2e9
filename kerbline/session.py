"""Session settings, the shared folder, and lineage cutting used by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kerbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume (AQE with skew splitting, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting (a test, a laptop) gets a temporary folder. On a cluster the
    setting is required: a folder of the driver's own machine would be missing on the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="kerbline-")
        spark.sparkContext.setCheckpointDir(current)
        _drop_at_exit(spark, current)
    return current


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def run_dir(spark: SparkSession) -> str:
    """One folder per application below the shared one; removed when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/kerbline-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and continue from the table.

    Like ``cut_lineage``, but columnar and compressed, so that later readers prune columns.
    """
    path = f"{run_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table made by ``materialise`` that nothing will read again."""
    base = run_dir(spark)
    for file in df.inputFiles():
        folder = file.rpartition("/")[0]
        if folder.rpartition("/")[0].split(":")[-1].lstrip("/") == base.split(":")[-1].lstrip("/"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return
