"""The star schema: a frozen set of lazy DataFrames, and its tables' column layouts."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

TOKEN_TYPES = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "server_tool_use")
REQUESTS_TYPE = "server_tool_use"  # counts requests, not tokens
CONTEXT_TYPES = ("cache_read", "cache_write_5m", "cache_write_1h")
SYNTHETIC_MODEL = "<synthetic>"
UNATTRIBUTED, NO_VALUE = "(unattributed)", "-"

SCHEMAS = {
    "sessions": "session_id string, start_date string, project string, cwd string, git_branch string",
    "prompts": "session_id string, prompt_id string, prompt_index bigint, timestamp string, project string, cwd string, "
    "git_branch string, mode string, entrypoint string, version string, model string, char_count bigint, "
    "assistant_turns bigint, tool_calls bigint, final_stop_reason string, prompt_preview string",
    "tokens": "session_id string, prompt_id string, model string, token_type string, is_sidechain int, token_count bigint",
    "requests": "session_id string, prompt_id string, request_index bigint, timestamp string, model string, "
    "stop_reason string, is_sidechain int, post_compact int, input_tokens bigint, output_tokens bigint, "
    "cache_read_tokens bigint, cache_write_5m_tokens bigint, cache_write_1h_tokens bigint, server_tool_use_requests bigint",
    "categories": "prompt_id string, category string, complexity string, classifier_model string, classified_at string",
    "quota_log": "snapshot_at string, field string, utilization_pct double, resets_at string",
    "output_files": "prompt_id string, path string, language string, kind string, edits bigint, lines_added bigint, lines_deleted bigint",
    "output_tokens": "prompt_id string, output_prose_tokens bigint, output_code_tokens bigint",
    "context_sources": "session_id string, source string, language string, path string, tokens bigint, items bigint",
    "context_cost": "session_id string, source string, language string, path string, model string, "
    "rent_read_tokens bigint, load_write_5m_tokens bigint, load_write_1h_tokens bigint",
    "tasks": "task_id string, session_id string, name string, origin string, prompts bigint, first_timestamp string, last_timestamp string",
    "task_prompts": "task_id string, prompt_id string",
    "prompts_text": "prompt_id string, prompt_text string",
    "card": "provider string, kind string, key string, token_type string, rate bigint",
    "plans": "plan string, label string, kind string, monthly_units bigint, included_units bigint",
    "models": "model string",
}


@dataclass(frozen=True)
class Dataset:
    """One DataFrame for each table of SCHEMAS; a missing table is an empty one."""

    sessions: DataFrame
    prompts: DataFrame
    tokens: DataFrame
    requests: DataFrame
    categories: DataFrame
    quota_log: DataFrame
    output_files: DataFrame
    output_tokens: DataFrame
    context_sources: DataFrame
    context_cost: DataFrame
    tasks: DataFrame
    task_prompts: DataFrame
    prompts_text: DataFrame
    card: DataFrame
    plans: DataFrame
    models: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Dataset:
        """A dataset of the given tables; the others are empty.

        ``models`` names all models that tokens, requests and context_cost have, and may name more. Prices are resolved for it
        alone, so that no fact is read for its few names; where no such dimension is given, the facts' names are gathered.
        """
        missing = {f.name: spark.createDataFrame([], SCHEMAS[f.name]) for f in fields(cls) if f.name not in tables and f.name != "models"}
        if "models" not in tables:
            named = [tables[t].select("model") for t in ("tokens", "requests", "context_cost") if t in tables]
            names = spark.createDataFrame([], SCHEMAS["models"])
            for rows in named:
                names = names.unionByName(rows)
            missing["models"] = names.distinct()
        return cls(**tables, **missing)

    def with_(self, **tables: DataFrame) -> Dataset:
        return replace(self, **tables)
