"""Token usage, exact cost and quota accounting.

Money is an integer number of 1e-8 units, so sums are exact in any order.
Input cost covers uncached tokens only; the three costs are disjoint.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kbspark.functions.predicates import billable
from kbspark.operators import ordered

# 1e-8 units per token as (input, output, cached input); unknown models cost nothing.
MODEL_PRICES: dict[str, tuple[int, int, int]] = {
    "deepseek-v4.1-flash": (200, 800, 20),
    "deepseek-v4-flash-0731": (300, 900, 30),
    "glm-5.3-flash": (80, 280, 23),
    "ernie-4.5-turbo-20260402": (80, 320, 20),
    "ernie-4.5-turbo-128k": (80, 320, 20),
}
COST_COLUMNS = ("input_cost_e8", "output_cost_e8", "cache_cost_e8")
TOKEN_COLUMNS = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_tokens")


def _price(model: str, position: int, prices: Mapping[str, tuple[int, int, int]]) -> Column:
    m = F.lower(F.coalesce(F.col(model), F.lit("")))
    out = F.lit(0).cast("bigint")
    for name, triple in prices.items():
        out = F.when(m == name, F.lit(triple[position]).cast("bigint")).otherwise(out)
    return out


def with_cost(usage: DataFrame, prices: Mapping[str, tuple[int, int, int]] = MODEL_PRICES, model: str = "model",
              prompt: str = "prompt_tokens", completion: str = "completion_tokens",
              cache: str = "cache_tokens") -> DataFrame:
    """Adds the three disjoint costs and their sum."""
    p, c, k = (F.coalesce(F.col(x), F.lit(0)).cast("bigint") for x in (prompt, completion, cache))
    return usage.withColumns({
        "input_cost_e8": F.greatest(p - k, F.lit(0)) * _price(model, 0, prices),
        "output_cost_e8": c * _price(model, 1, prices),
        "cache_cost_e8": k * _price(model, 2, prices),
    }).withColumn("total_cost_e8", F.col("input_cost_e8") + F.col("output_cost_e8") + F.col("cache_cost_e8"))


def e8_to_decimal(c: str) -> Column:
    return (F.col(c).cast("decimal(28,0)") / F.lit(100000000).cast("decimal(9,0)")).cast("decimal(20,8)")


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)


def usage_increments(usage: DataFrame, prices: Mapping[str, tuple[int, int, int]] = MODEL_PRICES) -> DataFrame:
    """Summary rows of a set of usage events; invalid events are dropped."""
    return (with_cost(usage.filter(billable()), prices).groupBy("api_key_id")
            .agg(F.count(F.lit(1)).alias("total_calls"), *[_sum0(c) for c in (*TOKEN_COLUMNS, *COST_COLUMNS)],
                 F.max("created_time").alias("last_used_at")))


def rebuild_summary(usage: DataFrame, keys: DataFrame,
                    prices: Mapping[str, tuple[int, int, int]] = MODEL_PRICES) -> DataFrame:
    """Summary of existing keys from the detail rows; the key test runs on the aggregated rows."""
    return usage_increments(usage, prices).join(keys.select(F.col("id").alias("api_key_id")), "api_key_id", "left_semi")


def accumulate_summary(summary: DataFrame, increments: DataFrame) -> DataFrame:
    """Upsert-accumulate: counts add up, last use is the later one."""
    both = summary.unionByName(increments)
    return both.groupBy("api_key_id").agg(
        *[_sum0(c) for c in ("total_calls", *TOKEN_COLUMNS, *COST_COLUMNS)], F.max("last_used_at").alias("last_used_at"))


def session_usage(usage: DataFrame, prices: Mapping[str, tuple[int, int, int]] = MODEL_PRICES) -> DataFrame:
    """Accumulated usage per session."""
    return (with_cost(usage, prices).groupBy("session_id")
            .agg(F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("chat_count"),
                 F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"),
                 F.sum("cache_tokens").alias("cache_tokens"),
                 F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
                 *[F.sum(c).alias(c) for c in (*COST_COLUMNS, "total_cost_e8")],
                 F.min("created_time").alias("created_time"), F.max("created_time").alias("updated_time")))


def accumulate_sessions(current: DataFrame, increments: DataFrame) -> DataFrame:
    return sum_sessions(current.unionByName(increments))


def sum_sessions(parts: DataFrame) -> DataFrame:
    """Totals of each session from any number of increments."""
    sums = ("chat_count", "input_tokens", "output_tokens", "cache_tokens", "total_tokens", *COST_COLUMNS, "total_cost_e8")
    return parts.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), *[F.sum(c).alias(c) for c in sums],
        F.min("created_time").alias("created_time"), F.max("updated_time").alias("updated_time"))


def usage_overview(keys: DataFrame, summary: DataFrame) -> DataFrame:
    """Every key with its totals, zero where unused."""
    zero = ("total_calls", *TOKEN_COLUMNS, *COST_COLUMNS)
    return (keys.join(summary, keys.id == summary.api_key_id, "left")
            .select(*[keys[c] for c in keys.columns], *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero],
                    "last_used_at"))


def overview_order() -> list[Column]:
    return [F.col("total_tokens").desc(), F.col("id").asc()]


def existing_key_summary(summary: DataFrame, keys: DataFrame) -> DataFrame:
    return summary.join(keys.select(F.col("id").alias("api_key_id")), "api_key_id", "left_semi")


def global_totals(summary: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of totals over existing keys, zeros when there are none."""
    return existing_key_summary(summary, keys).agg(*[_sum0(c) for c in ("total_calls", *TOKEN_COLUMNS, *COST_COLUMNS)])


def chat_usage_totals(sessions: DataFrame) -> DataFrame:
    return (sessions.agg(F.count(F.lit(1)).alias("total_calls"), _sum0("input_tokens"), _sum0("output_tokens"),
                         _sum0("total_tokens"), _sum0("cache_tokens"), *[_sum0(c) for c in COST_COLUMNS])
            .withColumn("total_cost_e8", sum((F.col(c) for c in COST_COLUMNS), F.lit(0).cast("bigint"))))


def key_counts(keys: DataFrame) -> DataFrame:
    return keys.agg(F.count_if(~F.col("is_delete")).alias("active_keys"), F.count_if("is_delete").alias("deleted_keys"))


def key_summary(ids: DataFrame, summary: DataFrame) -> DataFrame:
    """Totals of the asked keys, zeros for keys without a summary row."""
    cols = ("total_calls", *TOKEN_COLUMNS)
    return (ids.select("api_key_id").join(summary, "api_key_id", "left")
            .select("api_key_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols]))


def used_quota(keys: DataFrame, summary: DataFrame) -> DataFrame:
    """used := sum of the three costs, 0 for unused keys."""
    cost = summary.select("api_key_id", sum((F.col(c) for c in COST_COLUMNS), F.lit(0).cast("bigint")).alias("used_e8"))
    return (keys.join(cost, keys.id == cost.api_key_id, "left")
            .select(*[keys[c] for c in keys.columns], F.coalesce("used_e8", F.lit(0)).alias("used_e8")))


def backfill_cache_cost(sessions: DataFrame, records: DataFrame,
                        prices: Mapping[str, tuple[int, int, int]] = MODEL_PRICES) -> DataFrame:
    """Cached cost of sessions that have cached tokens but no cost, priced by the first listed model they used."""
    m = F.lower("model")
    tests = [("deepseek-v4.1-flash", m == "deepseek-v4.1-flash"), ("deepseek-v4-flash-0731", m == "deepseek-v4-flash-0731"),
             ("glm-5.3-flash", m == "glm-5.3-flash"), ("ernie-4.5-turbo-128k", m.like("ernie%"))]
    flags = records.groupBy("session_id").agg(*[F.max(t).alias(f"__f{i}") for i, (_, t) in enumerate(tests)])
    price = F.lit(0).cast("bigint")
    for i, (name, _) in reversed(list(enumerate(tests))):
        price = F.when(F.coalesce(F.col(f"__f{i}"), F.lit(False)), prices[name][2]).otherwise(price)
    todo = (F.col("cache_cost_e8") == 0) & (F.col("cache_tokens") > 0)
    return (sessions.join(flags, "session_id", "left")
            .withColumn("cache_cost_e8", F.when(todo, F.col("cache_tokens") * price).otherwise(F.col("cache_cost_e8")))
            .select(*sessions.columns))


def admit_calls(calls: DataFrame, keys: DataFrame, order: list[str]) -> DataFrame:
    """A call is admitted while the key's cost so far is below its quota (negative: unlimited).

    ``calls`` needs api_key_id, created_time and total_cost_e8.
    """
    run = ordered.running_sum(calls, ["api_key_id"], order, {"used_before_e8": F.col("total_cost_e8")}, inclusive=False)
    quota = keys.select(F.col("id").alias("api_key_id"), "quota_e8")
    return (run.join(quota, "api_key_id", "left")
            .withColumn("admitted", F.when(F.coalesce("quota_e8", F.lit(-1)) < 0, F.lit(True))
                        .otherwise(F.col("used_before_e8") < F.col("quota_e8"))))


def quota_ledger(log: DataFrame) -> DataFrame:
    """Outcome of each quota change in time order.

    SET replaces the balance (any value from -1 up); ADD needs a positive
    amount and a limited balance, else it is rejected and leaves it as it was.
    """
    amount = F.col("amount_cents")
    is_set, is_add = (F.col("type") == "SET") & (amount >= -1), (F.col("type") == "ADD") & (amount > 0)

    def advance(df: DataFrame, w: WindowSpec) -> DataFrame:
        """Balance after each change: what the last SET gave, and what was added since where that is limited; at first it is unlimited."""
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("__added", F.coalesce(F.sum(F.when(is_add, amount)).over(upto), F.lit(0)))
        df = df.withColumn("__set", F.last(F.when(is_set, F.struct(amount.alias("to"), F.col("__added").alias("by"))), ignorenulls=True).over(upto))
        to = F.coalesce("__set.to", F.lit(-1))
        return df.withColumn("balance_cents", F.when(to < 0, to).otherwise(to + F.col("__added") - F.col("__set.by")))

    # a stretch with a SET sets the balance that it ends with, one without adds what it adds
    has_set = F.col("__set").isNotNull()
    step = {"type": F.when(has_set, "SET").otherwise("ADD"), "amount_cents": F.when(has_set, F.col("balance_cents")).otherwise(F.col("__added"))}
    entry = {"type": F.lit("SET"), "amount_cents": F.col("balance_cents")}
    done = ordered.scan(log, ["api_key_id"], ["created_time", "id"], advance, step, entry)
    accepted = is_set | (is_add & (F.coalesce("__set.to", F.lit(-1)) >= 0))
    return done.withColumn("accepted", accepted).select(*log.columns, "accepted", "balance_cents")


def ledger_page(ledger: DataFrame, key_id: int, size: int, before: tuple | None = None) -> DataFrame:
    """Changes of one key, newest first; ``before`` is (created_time, id) of the last row of the page before."""
    rows = ledger.filter(F.col("api_key_id") == key_id)
    if before is not None:
        rows = rows.filter((F.col("created_time") < F.lit(before[0])) | ((F.col("created_time") == F.lit(before[0])) & (F.col("id") < before[1])))
    return rows.orderBy(F.desc("created_time"), F.desc("id")).limit(size)


def ensure_summary(summary: DataFrame, usage: DataFrame, keys: DataFrame) -> DataFrame:
    """The summary as it is, or rebuilt from detail when it has no row."""
    return rebuild_summary(usage, keys) if summary.isEmpty() else summary
