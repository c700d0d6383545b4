"""Explicit schemas of the knowledge-base tables and additive evolution of older rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SOURCE = ("struct<file_name:string,title:string,doc_code:string,tenant_code:string,chunk_index:int,page_number:string,"
          "title_hierarchy:string,content:string,deleted:boolean>")

TABLES: dict[str, str] = {
    "document_info": "id bigint, document_id string, doc_code string, tenant_code string, system_type string, file_name string, "
                     "stored_file_name string, title string, description string, file_size bigint, file_path string, status string, "
                     "error_message string, chunk_count int, enabled boolean, user_id string, created_time timestamp, "
                     "updated_time timestamp, retry_count int",
    "chunks": "chunk_id string, document_id string, doc_code string, tenant_code string, system_type string, enabled boolean, status string, "
              "error_message string, file_name string, user_id string, content string, chunk_index int, page_number string, chunk_type string, "
              "parent_chunk_id string, prev_chunk_id string, next_chunk_id string, title_hierarchy string, token_size int, "
              "metadata map<string,string>, embedding array<float>",
    "entities": "name string, type string",
    "mentions": "chunk_id string, entity_name string",
    "relations": "src string, dst string, type string",
    "chat_message": "id bigint, user_id string, session_id string, title string, question string, answer string, reasoning string, "
                    f"sources array<{SOURCE}>, tenant_code string, system_type string, api_key_id bigint, create_time timestamp",
    "chat_session": "id bigint, user_id string, session_id string, title string, api_key_id bigint, tenant_code string, system_type string, "
                    "create_time timestamp, update_time timestamp",
    "chat_session_summary": "id bigint, session_id string, summary string, last_message_count int, created_time timestamp, updated_time timestamp",
    "unanswered_question": "id bigint, question string, user_id string, session_id string, tenant_code string, system_type string, status string, "
                           "answer string, reasoning string, sources string, create_time timestamp",
    "api_key": "id bigint, name string, key_prefix string, key_hash string, tenant_code string, system_type string, enabled boolean, "
               "is_delete boolean, quota_e8 bigint, used_e8 bigint, created_by string, created_time timestamp",
    "api_key_usage": "id bigint, api_key_id bigint, user_id string, session_id string, model string, prompt_tokens int, completion_tokens int, "
                     "total_tokens int, cache_tokens int, created_time timestamp",
    "api_key_usage_summary": "api_key_id bigint, total_calls bigint, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, "
                             "cache_tokens bigint, input_cost_e8 bigint, output_cost_e8 bigint, cache_cost_e8 bigint, last_used_at timestamp",
    "api_key_quota_log": "id bigint, api_key_id bigint, type string, amount_cents bigint, balance_cents bigint, remark string, created_time timestamp",
    "chat_usage_record": "id bigint, user_id string, session_id string, model string, input_tokens int, output_tokens int, reasoning_tokens int, "
                         "cache_tokens int, created_time timestamp",
    "chat_session_usage": "session_id string, user_id string, title string, chat_count bigint, input_tokens bigint, output_tokens bigint, "
                          "reasoning_tokens bigint, cache_tokens bigint, total_tokens bigint, input_cost_e8 bigint, output_cost_e8 bigint, "
                          "cache_cost_e8 bigint, total_cost_e8 bigint, created_time timestamp, updated_time timestamp",
    "tenant_config": "id bigint, tenant_code string, tenant_name string, enabled boolean, created_time timestamp",
}

# Values of columns that older rows lack or hold as null.
DEFAULTS: dict[str, dict[str, object]] = {
    "document_info": {"status": "PROCESSING", "chunk_count": 0, "enabled": True, "file_size": 0, "retry_count": 0},
    "chunks": {"enabled": True, "status": "PROCESSING", "page_number": "1"},
    "unanswered_question": {"status": "OPEN"},
    "api_key": {"enabled": True, "is_delete": False, "quota_e8": -1, "used_e8": 0},
    "api_key_usage": {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0, "cache_tokens": 0},
    "api_key_usage_summary": {"cache_tokens": 0, "cache_cost_e8": 0},
    "chat_session_usage": {"cache_tokens": 0, "cache_cost_e8": 0, "reasoning_tokens": 0},
    "tenant_config": {"enabled": True},
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type: missing ones added, nulls defaulted, unknown ones kept out.

    Chunk rows keep unknown columns as text in ``metadata``.
    """
    have, defaults = set(df.columns), DEFAULTS.get(table, {})

    def column(name: str, kind) -> Column:
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if table == "chunks" and name == "metadata":
            extra = sorted(have - set(schema(table).names))
            pairs = [x for e in extra for x in (F.lit(e), F.col(e).cast("string"))]
            return F.coalesce(c, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else c)
        return F.coalesce(c, F.lit(defaults[name]).cast(kind)) if name in defaults else c

    return df.select(*[column(f.name, f.dataType).alias(f.name) for f in schema(table).fields])
