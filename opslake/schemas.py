"""Schemas of inputs and stored tables, as DDL."""

SYSJOBS = "job_id string, name string, enabled tinyint, description string"
SYSJOBSERVERS = "job_id string, server_id int, last_run_date int, last_run_time int"
SYSJOBACTIVITY = (
    "job_id string, session_id int, start_execution_date timestamp_ntz, stop_execution_date timestamp_ntz, "
    "next_scheduled_run_date timestamp_ntz"
)
SYSSESSIONS = "session_id int"
SYSJOBHISTORY = (
    "instance_id bigint, job_id string, step_id int, step_name string, run_status int, run_date int, "
    "run_time int, run_duration int, message string"
)

DAG = (
    "struct<dag_id:string, dag_display_name:string, description:string, is_paused:boolean, is_active:boolean, "
    "owners:array<string>, tags:array<struct<name:string>>, next_dagrun:timestamp>"
)
DAG_RUN = (
    "struct<dag_id:string, dag_run_id:string, state:string, run_type:string, logical_date:timestamp, "
    "execution_date:timestamp, start_date:timestamp, end_date:timestamp, updated_at:timestamp, note:string>"
)
DAG_PAGE = f"dags array<{DAG}>, total_entries int"
DAG_RUN_PAGE = f"dag_runs array<{DAG_RUN}>, total_entries int"

JOB = (
    "native_id string, native_name string, description string, is_active boolean, declared_owner string, "
    "tags array<string>, last_run_at timestamp, next_run_at timestamp"
)
RUN = (
    "native_job_id string, native_run_id string, started_at timestamp, ended_at timestamp, status string, "
    "error_text string"
)

COLUMNS = "array<struct<name:string, type:string, nullable:boolean, max_length:int>>"
SPEC = (
    "path string, feed_id string, owner string, landing_prefix string, file_mask string, window_start int, "
    f"window_end int, schema_name string, columns {COLUMNS}, read_error string"
)

# Stored tables: key columns and schema. A table is a log of row versions; the last one counts.
TABLES = {
    "source": (["source_id"], "source_id int, type string, name string, config string"),
    "source_state": (["source_id"], "source_id int, watermark string, last_heartbeat timestamp"),
    "job": (
        ["source_id", "native_id"],
        "source_id int, native_id string, job_id string, name string, is_active boolean, first_seen timestamp, "
        "last_seen timestamp, bound_at timestamp",
    ),
    "binding": (
        ["source_id", "native_key", "valid_from", "recorded_at"],
        "source_id int, native_key string, valid_from timestamp, recorded_at timestamp, native_id string, "
        "job_id string, command_id string",
    ),
    "command": (
        ["command_id"],
        "command_id string, job_id string, source_id int, native_id string, native_name string, at timestamp, "
        "who string, recorded_at timestamp, outcome string",
    ),
    "ownership": (
        ["job_id", "sync_id"],
        "source_id int, job_id string, sync_id bigint, team_id string, parsed_from string, raw_evidence string",
    ),
    "run": (
        ["source_id", "native_run_id"],
        "source_id int, native_run_id string, job_id string, started_at timestamp, ended_at timestamp, "
        "status string, error_text string, fingerprint string",
    ),
    "sync": (
        ["source_id", "sync_id"],
        "sync_id bigint, source_id int, started_at timestamp, completed_at timestamp, status string, "
        "job_count bigint, unowned_count bigint, error_text string",
    ),
    "alert": (
        ["dedup_key"],
        "dedup_key string, type string, status string, routed_to string, message string, first_seen timestamp, "
        "last_occurrence timestamp, occurrences bigint, acked_by string, acked_at timestamp",
    ),
    "arrival": (
        ["arrival_id"],
        "arrival_id string, feed_name string, key string, size_bytes bigint, arrived_at timestamp, disposition string",
    ),
    "move": (
        ["arrival_id", "arrived_at"],
        "arrival_id string, arrived_at timestamp, from_path string, to_path string, intended_at timestamp, "
        "done_at timestamp, outcome string",
    ),
    "validation": (
        ["arrival_id", "version"],
        "arrival_id string, version bigint, result string, "
        "findings array<struct<check:string, column_name:string, occurrences:bigint>>, ran_at timestamp",
    ),
    "edge": (["upstream", "downstream"], "upstream string, downstream string, declared_by string, declared_at timestamp"),
    "reach": (["upstream", "downstream"], "upstream string, downstream string, depth int"),
    "reached": (["downstream", "upstream"], "downstream string, upstream string, depth int"),
    "landing_state": (["root"], "root string, judged_to timestamp"),
    "feed": (["feed_name"], "feed_name string, team_id string, landing_prefix string, is_active boolean"),
    "contract_version": (
        ["feed_id", "version"],
        "feed_id string, version bigint, spec_hash string, spec_json string, effective_from timestamp",
    ),
}

# Tables that are looked up by a part of their key, which their files are then sliced and indexed by.
LOOKED_UP_BY = {"edge": ["upstream"], "reach": ["upstream"], "reached": ["downstream"]}


def lookup_keys(table: str) -> list[str]:
    return LOOKED_UP_BY.get(table, TABLES[table][0])
