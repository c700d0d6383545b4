"""Stateful stream operators on Spark's own keyed state: event-time timers, expiry, restart from a checkpoint.

State lives in Spark's state store and is versioned with the checkpoint, so a restarted query goes on where it ended and a repeated micro-batch starts
from the same state. Keys are dealt over ``CELLS`` cells by their hash; a cell is one row of the store and one call of Python a micro-batch, whatever the
number of its keys, since a call costs more than the rows of a small key. Keys don't meet: each has its own entry in its cell's state. A key's rows of one
micro-batch are put in order first; across batches they count as they arrive. What one task holds at a time are the rows and entries of a cell, which
is bounded by the files a micro-batch takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_MS = 3600 * 1000
#: Cells that keys are dealt over; a checkpoint is good for the number it was begun with.
CELLS = 1024
NEVER = 1 << 62
Handler = Callable[[tuple, Iterable[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]


def _in_cells(df: DataFrame, key: str) -> GroupedData:
    """``df`` grouped by cell, with the key as ``__id``; rows without a key have a cell of their own, where ``__id`` is an empty value."""
    none = F.lit("" if dict(df.dtypes)[key] == "string" else 0).cast(dict(df.dtypes)[key])
    cell = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(CELLS))).cast("int")
    return df.withColumns({"__cell": cell, "__id": F.coalesce(F.col(key), none)}).drop(key).groupBy("__cell")


def _named(cell: tuple, ids: list) -> list:
    """The keys of the ``__id`` values of a cell."""
    return ids if cell[0] >= 0 else [None] * len(ids)


def _ordered(parts: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    found = list(parts)
    return pd.concat(found).sort_values(order, kind="stable") if found else pd.DataFrame()


def stuck_alerts(events: DataFrame, limit_hours: int = 2, delay_hours: int = 1, forget_hours: int | None = None) -> DataFrame:
    """(doc_code, stuck_since_ms): documents left in PROCESSING for more than the limit, each once.

    ``events``: doc_code, ts, event_id, status. PROCESSING arms a document's timer, SUCCESS or FAILED clears it. An alert is due when the finishing event lies beyond
    the limit, or when the event clock (latest time less the delay) reaches it first, whether or not the document has an event then. A
    cleared document leaves no state. An alerted one leaves a mark, for ``forget_hours`` of event time or for good.
    """
    late, forget = limit_hours * HOUR_MS, None if forget_hours is None else forget_hours * HOUR_MS

    def handler(cell: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each document when it was armed, else -1, and when the mark of its alert expires: -1 without one, NEVER for good
        kept = {d: (a, u) for d, a, u in zip(*state.get)} if state.exists else {}
        clock, due, met = state.getCurrentWatermarkMs(), {}, set()
        rows = _ordered(parts, ["ms", "event_id"])
        if len(rows):
            # an event without a time arms nothing and is never late
            for doc, ms, status in zip(rows["__id"].tolist(), rows["ms"].fillna(-1).astype(np.int64).tolist(), rows["status"].tolist()):
                armed, until = kept.get(doc, (-1, -1))
                if status == "PROCESSING":
                    armed = ms if armed < 0 else armed
                else:
                    if armed >= 0 and ms > armed + late and until < 0:
                        due.setdefault(doc, armed)
                    armed = -1
                kept[doc] = armed, until
                met.add(doc)
        left = {}
        for doc, (armed, until) in kept.items():
            if until < 0 and armed >= 0 and armed + late <= clock:
                due.setdefault(doc, armed)
            if doc in due or until >= 0 and doc in met:
                left[doc] = -1, NEVER if forget is None else max(clock, 0) + forget
            elif until >= clock and until >= 0 or until < 0 and armed >= 0:
                left[doc] = armed, until
        if due:
            yield pd.DataFrame({"doc_code": _named(cell, list(due)), "stuck_since_ms": list(due.values())})
        if left:
            state.update(([*left], [a for a, _ in left.values()], [u for _, u in left.values()]))
            # a timer fires when the clock has passed it
            timers = min(a + late - 1 if u < 0 else u for a, u in left.values())
            if timers < NEVER:
                state.setTimeoutTimestamp(timers)
        elif state.exists:
            state.remove()

    timed = (events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"{delay_hours} hours")
             .select("doc_code", "at", F.unix_millis("at").alias("ms"), "event_id", "status"))
    return _in_cells(timed, "doc_code").applyInPandasWithState(handler, "doc_code string, stuck_since_ms bigint", "docs array<string>, armed array<bigint>, until array<bigint>",
                                                               "append", GroupStateTimeout.EventTimeTimeout)


def summary_trigger(messages: DataFrame, every: int = 10) -> DataFrame:
    """(session_id, id, at_count): the message that completes each further ``every`` messages of its session. ``messages``: session_id, id, create_time."""
    def handler(cell: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*state.get)) if state.exists else {}
        rows = _ordered(parts, ["create_time", "id"])
        code, ids = pd.factorize(rows["__id"])
        before = np.array([counts.get(i, 0) for i in ids.tolist()], np.int64)
        at = before[code] + rows.groupby(code).cumcount().to_numpy() + 1
        counts.update(zip(ids.tolist(), (before + np.bincount(code, minlength=len(ids))).tolist()))
        state.update(([*counts], [*counts.values()]))
        hit = at % every == 0
        if hit.any():
            yield pd.DataFrame({"session_id": _named(cell, rows["__id"][hit].tolist()), "id": rows["id"].to_numpy()[hit], "at_count": at[hit]})

    return _in_cells(messages.select("session_id", "id", "create_time"), "session_id").applyInPandasWithState(
        handler, "session_id string, id bigint, at_count bigint", "sessions array<string>, message_counts array<bigint>", "append", GroupStateTimeout.NoTimeout)


def admit_stream(calls: DataFrame, keys: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``used_before_e8`` and ``admitted`` of each call: admitted while its key's cost so far is below the quota (negative or none: unlimited)."""
    quota = keys.select(F.col("id").alias("api_key_id"), F.col("quota_e8").alias("__quota"))
    rows = (calls.select("api_key_id", *dict.fromkeys([*keep, *order, "total_cost_e8"])).join(quota, "api_key_id", "left")
            .withColumns({"__quota": F.coalesce(F.col("__quota"), F.lit(-1)).cast("bigint"), "__cost": F.coalesce(F.col("total_cost_e8"), F.lit(0)).cast("bigint")}))
    kinds = dict(rows.dtypes)

    def handler(cell: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = dict(zip(*state.get)) if state.exists else {}
        rows = _ordered(parts, order)
        code, ids = pd.factorize(rows["__id"])
        together = np.argsort(code, kind="stable")
        rows, code = rows.iloc[together], code[together]
        cost = rows["__cost"].to_numpy(np.int64)
        total, last = np.cumsum(cost), np.flatnonzero(np.append(code[1:] != code[:-1], True))
        # what a key had used before, less what the keys ahead of it in this batch add up to
        start = np.array([used.get(i, 0) for i in ids.tolist()], np.int64) - np.concatenate([[0], total[last][:-1]])
        total += start[code]
        used.update(zip(ids.tolist(), total[last].tolist()))
        state.update(([*used], [*used.values()]))
        yield pd.DataFrame({"api_key_id": _named(cell, rows["__id"].tolist()), **{c: rows[c].to_numpy() for c in keep}, "used_before_e8": total - cost, "quota": rows["__quota"].to_numpy()})

    out = f"api_key_id bigint, {', '.join(f'{c} {kinds[c]}' for c in keep)}, used_before_e8 bigint, quota bigint"
    run = _in_cells(rows, "api_key_id").applyInPandasWithState(handler, out, "keys array<bigint>, used_e8 array<bigint>", "append", GroupStateTimeout.NoTimeout)
    return run.select("api_key_id", *keep, "used_before_e8", ((F.col("quota") < 0) | (F.col("used_before_e8") < F.col("quota"))).alias("admitted"))


def delta_stream(fragments: DataFrame) -> DataFrame:
    """(session_id, seq, delta): the new suffix of each cumulative text, where it grew. ``fragments``: session_id, seq, text.

    The state holds number and text of each last fragment. A fragment that comes later than one of a higher number is covered by that one's text and gives nothing.
    """
    kind = dict(fragments.dtypes)["session_id"]

    def handler(cell: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {i: (last, text) for i, last, text in zip(*state.get)} if state.exists else {}
        out = []
        rows = _ordered(parts, ["seq"])
        for key, seq, new in zip(rows["__id"].tolist(), rows["seq"].tolist(), rows["text"].tolist()):
            last, text = kept.get(key, (None, ""))
            if last is not None and seq <= last:
                continue
            if new is not None and len(new) > len(text or ""):
                out.append((key, seq, new[len(text or ""):]))
            kept[key] = seq, new
        state.update(([*kept], [last for last, _ in kept.values()], [text for _, text in kept.values()]))
        if out:
            keys, numbers, deltas = map(list, zip(*out))
            yield pd.DataFrame({"session_id": _named(cell, keys), "seq": numbers, "delta": deltas})

    return _in_cells(fragments.select("session_id", "seq", "text"), "session_id").applyInPandasWithState(
        handler, f"session_id {kind}, seq bigint, delta string", f"sessions array<{kind}>, seqs array<bigint>, texts array<string>", "append", GroupStateTimeout.NoTimeout)
