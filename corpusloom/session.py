"""Session construction and the shared folder for materialised intermediates."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster; sizes of executors are the cluster's business.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults. `conf` keys use `__` for dots and win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Where the cluster names none, a local session gets a temporary folder. A session on several
    machines must name one, because a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if at:
            return at
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(_remove_local, named)
        spark.sparkContext.setCheckpointDir(named)
    return named


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def release(spark: SparkSession) -> None:
    """Delete what `materialize` wrote in this session; frames that read it are unusable afterwards."""
    for s, path in [x for x in _written if x[0] is spark]:
        hpath = s._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(s._jsc.hadoopConfiguration()).delete(hpath, True)
        _written.remove((s, path))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)))


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores, where its files give fewer than half as many partitions as there are cores; larger scans stay as they are.

    For scans only: the number of partitions of a plan with shuffles is known after running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
