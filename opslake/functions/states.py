"""Scheduler states onto the common run vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslake import vocab


def _lookup(value: Column, table: dict, default: str) -> Column:
    result = F.lit(default)
    for key, name in table.items():
        result = F.when(value == F.lit(key), F.lit(name)).otherwise(result)
    return result


def agent_status(code: Column) -> Column:
    return _lookup(code, vocab.AGENT_STATUS, vocab.UNKNOWN)


def dag_state(state: Column) -> Column:
    return _lookup(state, vocab.DAG_STATE, vocab.UNKNOWN)


def is_terminal(status: Column) -> Column:
    return status.isin(*vocab.TERMINAL)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)\A\s*\z")


def describe_dag_failure(dag_id: Column, run_type: Column, note: Column) -> Column:
    """Failure text of a DAG run. The run id is left out, so failures group by DAG."""
    head = F.concat(
        F.lit("Airflow DAG "), dag_id, F.lit(" run failed ("), F.coalesce(run_type, F.lit("unknown trigger")), F.lit(")")
    )
    return F.when(is_blank(note), head).otherwise(F.concat(head, F.lit(": "), note))
