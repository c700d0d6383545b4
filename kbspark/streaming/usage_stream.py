"""Continuous usage accumulation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from kbspark.functions.predicates import billable
from kbspark.operators import usage as U
from kbspark.streaming.batches import Ledger


def fold_batches(batches: Iterable[DataFrame]) -> DataFrame:
    """Summary after folding usage batches one after the other."""
    return reduce(U.accumulate_summary, [U.usage_increments(b) for b in batches])


def running_summary(stream: DataFrame) -> DataFrame:
    """Totals per key of a usage stream; state holds one row per key."""
    priced = U.with_cost(stream.filter(billable()))
    return priced.groupBy("api_key_id").agg(
        F.count(F.lit(1)).alias("total_calls"), *[F.sum(c).alias(c) for c in (*U.TOKEN_COLUMNS, *U.COST_COLUMNS)],
        F.max("created_time").alias("last_used_at"))


def two_sinks(keys: Ledger, sessions: Ledger) -> Callable[[DataFrame, int], None]:
    """One step for two sinks: increments of each key and of each session. A sink that has the batch already skips it, so a batch that failed between the two is completed."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            keys.apply(U.usage_increments(batch), batch_id)
            sessions.apply(U.session_usage(batch), batch_id)
        finally:
            batch.unpersist()

    return step
