"""Vocabularies and limits. Stored rows and alert keys depend on them."""

# Run status
QUEUED = "Queued"
RUNNING = "Running"
SUCCEEDED = "Succeeded"
FAILED = "Failed"
CANCELLED = "Cancelled"
RETRY = "Retry"
UNKNOWN = "Unknown"
TERMINAL = (SUCCEEDED, FAILED, CANCELLED)

# Agent run_status codes and DAG run states
AGENT_STATUS = {0: FAILED, 1: SUCCEEDED, 2: RETRY, 3: CANCELLED, 4: RUNNING}
DAG_STATE = {"success": SUCCEEDED, "failed": FAILED, "running": RUNNING, "queued": QUEUED}

# Sync status (Running, Failed are shared with run status)
COMPLETED = "Completed"

# Alert status and types
FIRING = "Firing"
ACKNOWLEDGED = "Acknowledged"
RESOLVED = "Resolved"
ZERO_ROWS = "CollectorZeroRows"
SHARP_DROP = "CollectorSharpDrop"
PURGE_GAP = "SqlAgentHistoryPurgeGap"
STALE = "CollectorStale"
JOB_FAILED = "JobFailed"
FEED_LATE = "FeedLate"
SCHEMA_DRIFT = "SchemaDrift"

# Where an owner was found
FROM_OWNER = "Owner"
FROM_DESCRIPTION = "Description"
FROM_TICKET = "Ticket"
FROM_TAGS = "Tags"
FROM_NONE = "None"

# Text that schedulers put where nothing was declared
PLACEHOLDER_DESCRIPTION = "No description available."
DEFAULT_DAG_OWNER = "airflow"

# Arrival disposition and validation result
PENDING = "Pending"
VALIDATED = "Validated"
QUARANTINED = "Quarantined"
MISSING = "Missing"
LATE = "Late"
PASSED = "Passed"
ERROR = "Error"

# Contract violations
V_LATE = "LateArrival"
V_MISSING = "MissingFile"
V_MASK = "MaskDrift"
V_RENAMED = "SchemaDriftRenamedColumn"
V_ADDED = "SchemaDriftAddedColumn"
V_REMOVED = "SchemaDriftRemovedColumn"
V_NULL = "NullInNotNullColumn"
V_TYPE = "DataTypeMismatch"
V_LENGTH = "TruncatedData"
V_DUPLICATE = "DuplicateRows"
V_RAGGED = "RaggedRows"
V_EXTRA = "ExtraFile"

# Sharp-drop baseline
BASELINE_SYNCS = 5
BASELINE_MIN_SAMPLES = 3
SHARP_DROP_FRACTION = 0.5

DATE_TOKEN = "{yyyyMMdd}"
LATE_SUFFIX = ".late"

# Fixed-width field widths by declared type; strings use their max length or the default
TYPE_WIDTH = {"date": 10, "decimal": 12, "int": 10}
DEFAULT_WIDTH = 20
