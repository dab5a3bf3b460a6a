"""The derived catalogue: jobs, bindings, ownership, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake import vocab
from opslake.functions import identity, time
from opslake.functions.owner import declared_dag_owner, decide_ownership, evidence_text, first_tag_owner, parse_owner
from opslake.functions.states import is_blank
from opslake.operators import runs as run_ops
from opslake.operators import scan


def agent_jobs(
    jobs: DataFrame, servers: DataFrame, activity: DataFrame, sessions: DataFrame, zone: str = "UTC"
) -> DataFrame:
    """Agent job catalogue: last run from the local server's row, next run from the newest session."""
    local = servers.filter(F.col("server_id") == 0).select("job_id", "last_run_date", "last_run_time")
    current = run_ops.latest_session(activity, sessions).select("job_id", "next_scheduled_run_date")
    return (
        jobs.join(local, "job_id", "left")
        .join(current, "job_id", "left")
        .select(
            F.lower("job_id").alias("native_id"),
            F.col("name").alias("native_name"),
            F.coalesce("description", F.lit("")).alias("description"),
            (F.col("enabled") == 1).alias("is_active"),
            F.lit(None).cast("string").alias("declared_owner"),
            F.array().cast("array<string>").alias("tags"),
            time.packed_to_utc(F.col("last_run_date"), F.col("last_run_time"), zone).alias("last_run_at"),
            time.local_to_utc(F.col("next_scheduled_run_date"), zone).alias("next_run_at"),
        )
    )


def dag_jobs(dags: DataFrame) -> DataFrame:
    """DAG listing to jobs; a DAG that is paused or gone stays as an inactive job."""
    tags = F.filter(
        F.transform(F.coalesce("tags", F.array()), lambda t: t["name"]), lambda n: ~is_blank(n)
    )
    return dags.select(
        F.col("dag_id").alias("native_id"),
        F.when(is_blank(F.col("dag_display_name")), F.col("dag_id"))
        .otherwise(F.col("dag_display_name")).alias("native_name"),
        F.coalesce("description", F.lit("")).alias("description"),
        (F.coalesce("is_active", F.lit(True)) & ~F.coalesce("is_paused", F.lit(False))).alias("is_active"),
        declared_dag_owner(F.coalesce("owners", F.array())).alias("declared_owner"),
        tags.alias("tags"),
        F.lit(None).cast("timestamp").alias("last_run_at"),
        F.col("next_dagrun").alias("next_run_at"),
    )


def active_bindings(bindings: DataFrame, source_id: int | None = None) -> DataFrame:
    active = bindings.filter(F.col("unbound_at").isNull())
    return active if source_id is None else active.filter(F.col("source_id") == source_id)


def with_ownership(jobs: DataFrame) -> DataFrame:
    """Add team_id, parsed_from, raw_evidence.

    In steps, so that each text is parsed once, and through a generator at the end, so that a filter
    on the result is not copied with all the parsing in it to the other side of it.
    """
    decided = decide_ownership(F.col("declared_owner"), F.col("__text"), F.col("__hit"), F.col("__tag"))
    return (
        jobs.withColumn("__text", evidence_text(F.col("description")))
        .withColumns({"__hit": parse_owner(F.col("__text")), "__tag": first_tag_owner(F.col("tags"))})
        .select(*jobs.columns, F.inline_outer(F.array(decided)))
    )


def one_per_native_id(rows: DataFrame) -> DataFrame:
    """One row for each (source_id, native_id), whose ids compare without case: the last by ``place``.

    ``place`` says where a row stands in its listing. Without it, the row with the greatest id and name
    counts, so that the choice is the same each time.
    """
    order = ["place"] if "place" in rows.columns else []
    values = [c for c in rows.columns if c != "source_id"]
    chosen = F.max_by(F.struct(*values), F.struct(*order, "native_id", "native_name")).alias("v")
    one = rows.groupBy("source_id", F.lower("native_id").alias("__key")).agg(chosen)
    return one.select("source_id", "v.*").select(*rows.columns)


def merge_jobs(known: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Next state of the bound jobs of the sources in ``batch``.

    ``known``: source_id, native_id, job_id, name, is_active, first_seen, last_seen, bound_at.
    ``batch``: source_id, native_id, native_name, is_active. Native ids compare without case. Known
    jobs get name, state and last-seen refreshed; new ones get an id; absent ones stay as they are. Rows
    of one id in the batch are one job (see ``one_per_native_id``).
    """
    new = one_per_native_id(batch).select(
        F.col("source_id").alias("b_source"), F.lower("native_id").alias("b_key"), F.col("native_id").alias("b_native"),
        F.col("native_name").alias("b_name"), F.col("is_active").alias("b_active"),
    )
    joined = known.join(
        new, (F.col("source_id") == F.col("b_source")) & (F.lower("native_id") == F.col("b_key")), "full"
    )
    seen = F.col("b_key").isNotNull()
    minted = identity.canonical_job_id(F.col("b_source"), F.col("b_native"), now)
    return joined.select(
        F.coalesce("source_id", "b_source").alias("source_id"),
        F.coalesce("native_id", "b_native").alias("native_id"),
        F.coalesce("job_id", minted).alias("job_id"),
        F.when(seen, F.col("b_name")).otherwise(F.col("name")).alias("name"),
        F.when(seen, F.col("b_active")).otherwise(F.col("is_active")).alias("is_active"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("bound_at", now).alias("bound_at"),
    )


def rebind(bindings: DataFrame, commands: DataFrame) -> DataFrame:
    """Deliberate moves: close the job's active bindings, open the one the command names.

    ``commands``: job_id, source_id, native_id, native_name, at; one per job. A command whose target is
    bound to a job that stays is not carried out, as a native id has one active binding at most.
    """
    moves = commands.select("job_id", F.col("at").alias("__at"))
    taken = bindings.join(
        commands.select(F.col("source_id").alias("__s"), F.lower("native_id").alias("__n"), F.col("job_id").alias("__j")),
        (F.col("source_id") == F.col("__s")) & (F.lower("native_id") == F.col("__n")) & (F.col("job_id") != F.col("__j")),
    ).filter("unbound_at is null")
    # a target that another job holds is not opened, unless that job moves as well
    held = taken.join(moves, "job_id", "left_anti").select(F.col("__j").alias("job_id"))
    commands = commands.join(held, "job_id", "left_anti")
    moves = commands.select("job_id", F.col("at").alias("__at"))
    closed = (
        bindings.join(moves, "job_id", "left")
        .withColumn("unbound_at", F.coalesce("unbound_at", "__at"))
        .select(*bindings.columns)
    )
    opened = commands.select(
        "job_id", "source_id", "native_id", "native_name", F.col("at").alias("bound_at"),
        F.lit(None).cast("timestamp").alias("unbound_at"),
    )
    return closed.select(*opened.columns).unionByName(opened)


def register_sources(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Find or create sources by (type, name); the descriptor is refreshed.

    ``known``: source_id, type, name, config. ``wanted``: type, name, config. New ids go on from the
    highest one in the order of type and name.
    """
    w = wanted.select(F.col("type").alias("w_type"), F.col("name").alias("w_name"), F.col("config").alias("w_config"))
    same = (F.col("type") == F.col("w_type")) & (F.col("name") == F.col("w_name"))
    kept = known.join(w, same, "left").select(
        "source_id", "type", "name", F.coalesce("w_config", "config").alias("config")
    )
    top = known.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("top")).scalar()
    fresh = scan.numbered(w.join(known, same, "left_anti"), ["w_type", "w_name"], "n").select(
        (top + F.col("n")).cast("int").alias("source_id"),
        F.col("w_type").alias("type"), F.col("w_name").alias("name"), F.col("w_config").alias("config"),
    )
    return kept.unionByName(fresh)


def ownership_counts(ownership: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs and unowned jobs per group: "N of M unowned"."""
    return ownership.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("team_id").isNull()).alias("unowned")
    )


def latest_completed_sync(syncs: DataFrame) -> DataFrame:
    """Latest completed sync of every source."""
    return (
        syncs.filter(F.col("status") == vocab.COMPLETED)
        .groupBy("source_id")
        .agg(F.max_by("sync_id", F.struct("started_at", "sync_id")).alias("sync_id"))
    )


def gap_list(ownership: DataFrame, syncs: DataFrame) -> DataFrame:
    """Jobs without an owner in the latest completed sync of their source."""
    return ownership.filter(F.col("team_id").isNull()).join(
        latest_completed_sync(syncs), ["source_id", "sync_id"], "left_semi"
    )


def ownership_changes(ownership: DataFrame, chunk: Column) -> DataFrame:
    """Rows at which a job's team differs from its previous snapshot, the first one included."""
    marked = scan.numbered_changes(ownership, ["job_id"], ["sync_id"], chunk, F.col("team_id"))
    return marked.filter("changed").select(*ownership.columns, F.col("previous").alias("previous_team"))


def current_ownership(ownership: DataFrame) -> DataFrame:
    row = F.struct("team_id", "parsed_from", "sync_id")
    return ownership.groupBy("job_id").agg(F.max_by(row, F.col("sync_id")).alias("o")).select("job_id", "o.*")


def replay_ownership(ownership: DataFrame) -> DataFrame:
    """Parse the kept evidence again; shows where today's parser would decide otherwise."""
    again = parse_owner(F.col("raw_evidence"))["owner"]
    replayed = F.when(F.col("parsed_from") == vocab.FROM_OWNER, F.col("team_id")).otherwise(again)
    return ownership.withColumn("replayed_team", replayed).withColumn(
        "changed", ~F.col("replayed_team").eqNullSafe(F.col("team_id"))
    )


def route(alerts: DataFrame, job_owners: DataFrame, feed_owners: DataFrame) -> DataFrame:
    """Where an alert goes: the job's team, else the feed's.

    ``alerts`` has job_id and feed_name, either may be null.
    """
    teams = job_owners.select("job_id", F.col("team_id").alias("job_team"))
    feeds = feed_owners.select("feed_name", F.col("team_id").alias("feed_team"))
    return (
        alerts.join(teams, "job_id", "left")
        .join(feeds, "feed_name", "left")
        .withColumn("routed_to", F.coalesce("job_team", "feed_team"))
        .drop("job_team", "feed_team")
    )


def bound_at_start(runs: DataFrame, bindings: DataFrame, chunk_seconds: int = scan.CHUNK_SECONDS) -> DataFrame:
    """Attach to each run the binding of its native id that was valid when it started.

    Bindings of one (source, native id) never overlap, so the valid one is the last opened before
    the start, if it had not been closed by then. That makes the interval join one running value
    over runs and bindings together, without pairing every run with every binding.
    """
    opened = bindings.select(
        "source_id", F.lower("native_id").alias("native_key"), F.col("bound_at").alias("at"),
        F.lit(0).alias("kind"), F.col("job_id").alias("tie"),
        F.struct("job_id", "unbound_at").alias("binding"), F.lit(None).alias("run"),
    )
    started = runs.select(
        "source_id", F.lower("native_job_id").alias("native_key"), F.col("started_at").alias("at"),
        F.lit(1).alias("kind"), F.col("native_run_id").alias("tie"),
        F.lit(None).alias("binding"), F.struct(*runs.columns).alias("run"),
    )
    both = opened.unionByName(started)
    found = scan.running(
        both, ["source_id", "native_key"], ["at", "kind", "tie"], scan.time_chunk("at", chunk_seconds),
        {"held": scan.last(F.col("binding"))},
    ).filter(F.col("kind") == 1)
    valid = F.col("held").isNotNull() & (
        F.col("held.unbound_at").isNull() | (F.col("at") < F.col("held.unbound_at"))
    )
    return found.withColumn("job_id", F.when(valid, F.col("held.job_id"))).select("run.*", "job_id")
