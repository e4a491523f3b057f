"""Session construction and shared-storage scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def _is_local(master: str) -> bool:
    """One JVM (``local``, ``local[n]``); ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def _submitted() -> dict[str, str]:
    """What spark-submit, defaults files or a running context have already set."""
    if SparkContext._active_spark_context is not None:
        return dict(SparkContext._active_spark_context.getConf().getAll())
    if "PYSPARK_GATEWAY_PORT" in os.environ:   # started by spark-submit: the JVM holds its --conf values
        return dict(SparkConf().getAll())
    return {}


def get_session(master: str | None = None, partitions: int | None = None, app: str = "equilens",
                extra: dict | None = None) -> SparkSession:
    """Session for the audit plans.

    On a cluster pass ``master=None`` and let spark-submit decide: nothing
    that was submitted is overridden. Only values passed by the caller
    (``partitions``, ``extra``) are set there; the laptop defaults below apply
    to a local master alone, and only where the value is still unset.

    Sizing on a cluster: ``spark.sql.files.maxPartitionBytes`` at 128-256 MB
    per scan task, ``spark.sql.shuffle.partitions`` near shuffle bytes /
    128 MB; AQE coalesces small partitions and splits skewed join partitions.
    """
    submitted = _submitted()
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf: dict[str, str] = {}
    if _is_local(master or submitted.get("spark.master", "local[*]")):
        defaults = {
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
            "spark.sql.session.timeZone": "UTC",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("EQUILENS_DRIVER_MEMORY", "16g"),
        }
        conf = {k: v for k, v in defaults.items() if k not in submitted}
    if partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if _is_local(spark.sparkContext.master):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only when unset.

    ``spark.checkpoint.dir`` names storage that driver and executors share and
    is left as it is. Where it is unset, a local master gets a fresh folder
    under /tmp; on a cluster a machine-local folder would lose the executors'
    files, so this raises.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not d and not current.isEmpty():
        return current.get()
    if not d:
        if not _is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="equilens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if current.isEmpty():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def write_once(df, name: str):
    """Write ``df`` under the shared checkpoint folder and read it back: later
    uses share one evaluation, its lineage is cut, and Spark knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
