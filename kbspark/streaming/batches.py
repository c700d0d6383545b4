"""Running streams to their end: arriving files, append sinks, and sinks that apply a batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kbspark.plans.ingest import run_ingest
from kbspark.session import stream_state_dir

Step = Callable[[DataFrame, int], None]


def run_available(stream: DataFrame, step: Step, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Feed everything available to ``step`` batch by batch and wait for the end."""
    q = (stream.writeStream.foreachBatch(step).trigger(availableNow=True)
         .option("checkpointLocation", checkpoint or stream_state_dir(stream.sparkSession, name)).start())
    q.awaitTermination()
    return q


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available to the Parquet folder ``path``; the sink's log takes each batch once."""
    q = (stream.writeStream.format("parquet").option("path", path).outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", checkpoint).start())
    q.awaitTermination()
    return q


def arrive(df: DataFrame, path: str, order: str, parts: int, run: Callable[[DataFrame], None]) -> None:
    """Rows of ``df`` arrive as files in ``parts`` portions by ``order``; after each one ``run`` gets the stream of the folder.

    Each run ends and the next one starts anew, so a query with one checkpoint is restarted between the portions.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[order]
    number = F.col(order).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    portion = F.coalesce(sum((F.when(number > c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0))
    for i in range(parts):
        df.filter(portion == i).write.mode("append").parquet(path)
        run(spark.readStream.schema(df.schema).parquet(path))


def ingest_step(out_path: str, max_size: int = 50 << 20, **chunking) -> Step:
    """Ingest each batch of uploads into folders of its own; a repeated batch overwrites them."""
    def step(batch: DataFrame, batch_id: int) -> None:
        run_ingest(batch, f"{out_path}/chunks/batch={batch_id}", f"{out_path}/status/batch={batch_id}", max_size, **chunking)

    return step


def totals_step(out_path: str) -> Step:
    """Changed totals of an update-mode aggregation, one folder per batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return step


def latest_totals(df: DataFrame, key: str) -> DataFrame:
    values = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(key, "v.*")


class Ledger:
    """Increments of a stream, each batch applied once: one folder a batch, named by its id, and totals that a fold sums up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _written(self, batch_id: int) -> bool:
        """Whether the batch's folder has been committed."""
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch_id}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def apply(self, increments: DataFrame, batch_id: int) -> bool:
        """Writes the increments unless the batch has been applied; half a folder of a failed try is overwritten."""
        if self._written(batch_id):
            return False
        increments.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")
