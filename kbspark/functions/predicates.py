"""Visibility and request predicates as pushable Column expressions."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL_TENANT = "0"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def visible_for_retrieval(tenant: str | Column, system: str | Column, scope: str = "strict",
                          prefix: str = "") -> Column:
    """Chunks a question may recall: enabled, finished, own or global tenant, same system.

    ``scope='admin_all'`` lets tenant '0' search every tenant of its system.
    ``tenant`` and ``system`` are values or columns.
    """
    t = F.lit(tenant) if isinstance(tenant, str) else tenant
    s = F.lit(system) if isinstance(system, str) else system
    own = (F.col(prefix + "tenant_code") == t) | (F.col(prefix + "tenant_code") == GLOBAL_TENANT)
    if scope == "admin_all":
        own = own | (t == GLOBAL_TENANT)
    return (F.col(prefix + "enabled") & (F.col(prefix + "status") == "SUCCESS") & own
            & (F.col(prefix + "system_type") == s))


def visible_in_graph(tenant: str | Column, system: str | Column) -> Column:
    """Graph rule: global documents of any system pass; ``enabled`` always checked."""
    t = F.lit(tenant) if isinstance(tenant, str) else tenant
    s = F.lit(system) if isinstance(system, str) else system
    return F.col("enabled") & ((t == GLOBAL_TENANT)
                               | ((F.col("tenant_code") == t) & (F.col("system_type") == s))
                               | (F.col("tenant_code") == GLOBAL_TENANT))


def visible_in_graph_view(tenant: str | None, system: str | None) -> Column:
    """Graph-view rule: no tenant or '0' sees everything; the system filter is optional."""
    cond = F.lit(True)
    if tenant is not None and tenant != GLOBAL_TENANT:
        cond = (F.col("tenant_code") == tenant) | (F.col("tenant_code") == GLOBAL_TENANT)
    if system is not None:
        cond = cond & (F.col("system_type") == system)
    return cond


def snake_case(name: str) -> str:
    """camelCase property to snake_case column name."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


# Request properties never turned into conditions.
SKIPPED_KEYS = frozenset({"extend", "createdTime", "updatedTime", "creator"})


def _conditions(params: Mapping[str, Any], skip: Collection[str]):
    for key, value in params.items():
        if key in SKIPPED_KEYS or key in skip or value is None:
            continue
        if isinstance(value, (str, list, tuple, set, frozenset)) and not value:
            continue
        yield F.col(snake_case(key)), value


def _all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def bind_filter(params: Mapping[str, Any], skip: Collection[str] = ()) -> Column:
    """AND of string LIKE (the value is the pattern), collection IN, anything else equal."""
    out = []
    for c, v in _conditions(params, skip):
        if isinstance(v, str):
            out.append(c.ilike(v))
        elif isinstance(v, (list, tuple, set, frozenset)):
            out.append(c.isin(*v))
        else:
            out.append(c == v)
    return _all_of(out)


def criteria_filter(params: Mapping[str, Any], skip: Collection[str] = ()) -> Column:
    """AND of case-insensitive string prefix match, collection IN, anything else equal."""
    out = []
    for c, v in _conditions(params, skip):
        if isinstance(v, str):
            out.append(c.ilike(v + "%"))
        elif isinstance(v, (list, tuple, set, frozenset)):
            out.append(c.isin(*v))
        else:
            out.append(c == v)
    return _all_of(out)


def contains_ci(c: str | Column, keyword: str | None) -> Column:
    """Case-insensitive containment; blank keyword passes all rows."""
    return F.lit(True) if not keyword else F.contains(F.lower(_col(c)), F.lit(keyword.lower()))


def document_list_filter(tenant: str | None = None, system: str | None = None, status: str | None = None,
                         keyword: str | None = None, tenant0_is_all: bool = False) -> Column:
    conds = []
    if tenant and not (tenant0_is_all and tenant == GLOBAL_TENANT):
        conds.append(F.lower("tenant_code") == tenant.lower())
    if system:
        conds.append(F.lower("system_type") == system.lower())
    if status:
        conds.append(F.lower("status") == status.lower())
    if keyword:
        conds.append(contains_ci("file_name", keyword) | contains_ci("title", keyword))
    return _all_of(conds)


def session_filter(user_id: str, tenant: str | None = None, system: str | None = None,
                   api_key_id: int | None = None) -> Column:
    if not user_id:
        raise ValueError("user_id is required")
    conds = [F.col("user_id") == user_id]
    if tenant:
        conds.append(F.col("tenant_code") == tenant)
    if system:
        conds.append(F.col("system_type") == system)
    if api_key_id is not None:
        conds.append(F.col("api_key_id") == api_key_id)
    return _all_of(conds)


def in_time_range(start: str | Column, end: str | Column, tenant: str | None = None,
                  ts: str = "create_time") -> Column:
    """Half-open range plus optional tenant; bounds are timestamps in text or columns."""
    lo = F.lit(start).cast("timestamp") if isinstance(start, str) else start
    hi = F.lit(end).cast("timestamp") if isinstance(end, str) else end
    cond = (F.col(ts) >= lo) & (F.col(ts) < hi)
    return cond & (F.col("tenant_code") == tenant) if tenant else cond


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def parse_time_text(c: str | Column) -> Column:
    """'yyyy-MM-dd' when at most ten characters, else 'yyyy-MM-dd HH:mm:ss'; null when malformed."""
    t = F.trim(_col(c))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
                  F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(F.length(t) <= 10, day).otherwise(full)


def range_defaults(start: str | Column, end: str | Column, now: str | Column) -> tuple[Column, Column]:
    """End defaults to now and start to seven days before end, also when malformed."""
    e = F.coalesce(parse_time_text(end), _col(now))
    return F.coalesce(parse_time_text(start), e - F.expr("INTERVAL 7 DAYS")), e


def parse_id_list(c: str | Column) -> Column:
    """Comma text to an array of ids; anything that is not an integer is dropped."""
    parts = F.transform(F.split(_col(c), ","), lambda x: F.trim(x))
    ok = F.filter(parts, lambda x: x.rlike(r"^[+-]?\d{1,19}$"))
    return F.filter(F.transform(ok, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def is_stuck(as_of: str | Column, hours: int = 2) -> Column:
    """Still PROCESSING, created before the threshold and not retried yet."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return ((F.col("status") == "PROCESSING") & (F.col("created_time") < now - F.expr(f"INTERVAL {hours} HOURS"))
            & (F.coalesce(F.col("retry_count"), F.lit(0)) == 0))


def has_quota(quota: str | Column = "quota_e8", used: str | Column = "used_e8") -> Column:
    q, u = F.coalesce(_col(quota), F.lit(-1)), F.coalesce(_col(used), F.lit(0))
    return F.when(q < 0, F.lit(True)).otherwise(u < q)


def contains_any(c: str | Column, markers: Collection[str]) -> Column:
    """True when the text holds one of the markers; null or empty text never does."""
    text = F.coalesce(_col(c), F.lit(""))
    return reduce(lambda a, m: a | F.contains(text, F.lit(m)), markers, F.lit(False))


def is_unanswered(flag: str | Column, n_sources: Column, answer: str | Column, markers: Collection[str]) -> Column:
    """Flagged by the caller, or the answer cites sources yet says nothing was found."""
    return F.coalesce(_col(flag), F.lit(False)) | ((n_sources > 0) & contains_any(answer, markers))


def billable(key: str = "api_key_id", total: str = "total_tokens") -> Column:
    return F.col(key).isNotNull() & (F.coalesce(F.col(total), F.lit(0)) > 0)
