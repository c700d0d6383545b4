"""Session construction and the few session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kbspark", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the zone pinned to UTC.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    submitter decides both and adaptive execution coalesces.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a private one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = tempfile.mkdtemp(prefix="kbspark-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


_SCRATCH: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read back by columns, and independent of executors that go."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> int:
    """Removes the tables that ``cut_lineage`` has written in this process; call it when their results have been used. Returns how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = len(_SCRATCH)
    while _SCRATCH:
        target = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        target.getFileSystem(conf).delete(target, True)
    return done


def stream_state_dir(spark: SparkSession, name: str) -> str:
    """Fresh checkpoint location of one streaming query under the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
