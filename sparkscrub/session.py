"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparkscrub", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE stays on: it coalesces small shuffles, splits skewed join partitions and
    turns joins into broadcasts only when the measured size allows it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Intermediate tables of this process lie in one folder, which ``release`` deletes.
_RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir``).

    Only a plain local master without that setting gets a fresh local folder; where executors are
    processes of their own, a machine-local folder would lose data, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = tempfile.mkdtemp(prefix="sparkscrub-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sparkscrub/run-{_RUN}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below this run's part of the shared folder."""
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this run. What was read from them can no longer be computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts lineage like a checkpoint, and keeps column pruning for what reads it next.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
