"""Logical tables of the engine, as Spark schemas in DDL text. Catalogue and log tables also carry AUDIT."""

AUDIT = "id long, created_at timestamp, updated_at timestamp, created_by string, updated_by string, is_deleted short"

TABLES = {
    "datasource_connection": "name string, type string, sub_type string, status string, jdbc_connection_config string, description string",
    "database_schema": "connection_id long, schema_name string, description string",
    "table_info": "database_schema_id long, table_name string, table_comment string, table_custom_comment string",
    "column_info": "table_id long, column_name string, data_type string, column_comment string, column_custom_comment string",
    "api_schema": "connection_id long, name string, url string, method string, config string",
    "api_field": "api_schema_id long, original_name string, display_name string, json_path string, field_type string, description string",
    "agent_session": "session_id string, user_id string, agent_id string, agent_version int, status string, metadata string, sandbox_id string, title string, last_active_at timestamp",
    "execution_round": "round_id string, session_id string, run_id string, round_number int, input string, output string, status string, replayed_from_round_id string",
    "run_trace": "trace_id string, span_id string, parent_span_id string, round_id string, span_name string, span_kind string, status string, start_time timestamp, end_time timestamp, duration_ms long, input_tokens int, output_tokens int, model_name string, estimated_cost decimal(12,6), tool_name string, tool_input string, tool_output string, attributes string",
    "chat_event": "event_id string, session_id string, round_id string, event_type string, payload string, sequence_num long",
    "agent_definition": "agent_id string, name string, description string, archived boolean, archived_at timestamp, latest_version int",
    "agent_version": "version_id string, agent_id string, version_number int, name string, description string, system string, model_profile_id string, skill_ids string, knowledge_base_ids string, data_source_ids string",
    "model_profile": "profile_id string, display_name string, description string, api_format string, api_endpoint_url string, model_name string, encrypted_credential string, model_series string, context_window_input int, context_window_output int, tool_call_rounds int, model_type int, vector_dimension int, status string",
    "skill_resource": "skill_id string, version_number int, name string, description string, skill_type short, storage_type string, storage_key string, content_sha256 string, content_size long, status string",
}

SIGNAL = "session_id string, round_id string, seq long, ts timestamp, type string, text string, block_id string, tool_call_id string, tool_name string, tool_state string, result_text string, input_tokens int, output_tokens int, model_name string"

#: Signals that mean something to the fold; others are dropped. INTERRUPT and DISCONNECT are control rows.
SIGNALS = (
    "START", "THINKING_DELTA", "THINKING_END", "TEXT_DELTA", "TEXT_END", "TOOL_CALL_START", "TOOL_CALL_DELTA", "TOOL_CALL_END",
    "TOOL_RESULT_TEXT_DELTA", "TOOL_RESULT_END", "MODEL_CALL_START", "MODEL_CALL_END", "AGENT_RESULT", "AGENT_END", "EXCEED_MAX_ITERS",
    "INTERRUPT", "DISCONNECT", "ERROR",
)


def table_schema(name: str) -> str:
    return f"{TABLES[name]}, {AUDIT}"
