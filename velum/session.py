"""Session defaults and durable staging of intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # no Python stack captured for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "velum", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a local one is made only where none is named and there is one machine."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"name a folder that all executors share in spark.checkpoint.dir; master is {master}")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="velum-stage-")
    return _local_dir


_staged: list[str] = []


def drop_stages(spark: SparkSession) -> None:
    """Delete the tables staged by this process, once no result built on them is needed."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(hadoop).delete(path, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Used where several later steps need the same expensive result (detection) or
    need it frozen (row positions). The written table survives executor loss and
    cuts the lineage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _staged.append(path)
    df.write.mode("errorifexists").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def release(*staged: DataFrame) -> None:
    """Delete tables made by ``stage`` while a job goes on.

    Only once all that was computed from them has been staged itself: a lost executor's
    work is done again from the tables it read.
    """
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path in _staged:
            _staged.remove(path)
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def stage_small(df: DataFrame, name: str = "stage") -> tuple[DataFrame, bool]:
    """Stage ``df`` and tell whether its written size is within the broadcast limit.

    Within it, Spark plans a broadcast join from the file sizes by itself.
    """
    spark = df.sparkSession
    staged = stage(df, name)
    limit = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for file in staged.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(hadoop).getFileStatus(path).getLen()
        if total > limit:
            return staged, False
    return staged, True


def _bytes(text: str) -> int:
    text = text.strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text[:-1]) * units[text[-1]] if text[-1:] in units else int(text)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has, for costly steps on rows of few or large files.

    A file is read by no more tasks than it has row groups, so without this the longest task
    of such a step grows with the table.
    """
    return df.repartition(parallelism(df.sparkSession))
