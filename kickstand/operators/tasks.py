"""Tasks: candidates from events, workload, timeline, SLA, priority, cost and linkage."""

from functools import reduce

from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.operators.status import expected_rate, observed_against, with_sla

#: Stand-ins for missing keys: many more than partitions, so that these get even shares.
NULL_KEY_SLOTS = 1 << 20


def with_workload(events, demand, time_col, out="workload_trips_hour"):
    """Add the trips of the event's day, hour, area and vendor; 0 when there were none.

    One equi-join with the demand table, which has one row per key. A key with very many events is a
    skewed left partition, which AQE splits.
    """
    # an event table may bring the column that is about to be worked out
    events = events.drop(out)
    keyed = events.withColumns({"_day": F.to_date(time_col), "_hour": F.hour(time_col)})
    load = demand.groupBy(
        F.col("day").alias("_day"), F.col("hour").alias("_hour"), "service_area_id", "vendor"
    ).agg(X.total("trips").alias(out))
    joined = keyed.join(load, ["_day", "_hour", "service_area_id", "vendor"], "left")
    return joined.select(*events.columns, F.coalesce(out, F.lit(0)).cast("bigint").alias(out))


def task_candidates(incidents=None, status=None, incident_time="occurred_at", status_time=None):
    """Task per incident or status event that calls for one, with the id of its cause.

    Either table may be absent.
    """

    def candidates(events, kind, calls_for, time_col, id_col, link):
        ids = {name: F.lit(None).cast("bigint") for name in ("linked_incident_id", "linked_event_id")}
        ids[link] = F.col(id_col)
        return events.filter(F.col(kind).isin(*calls_for) & X.keys_known(time_col)).select(
            X.lookup(kind, calls_for).alias("task_type"),
            "vendor",
            "service_area_id",
            F.col(time_col).alias("occurred_at"),
            *[value.alias(name) for name, value in ids.items()],
            F.lit(C.LINKED_SOURCE).alias("source"),
        )

    parts = []
    if incidents is not None:
        parts.append(
            candidates(incidents, "incident_type", C.INCIDENT_TASKS, incident_time, "incident_id", "linked_incident_id")
        )
    if status is not None:
        parts.append(candidates(status, "event_type", C.STATUS_TASKS, X.time_column(status, status_time), "event_id", "linked_event_id"))
    if not parts:
        raise ValueError("task candidates need incidents or status events")
    return reduce(lambda a, b: a.unionByName(b), parts)


def task_timeline(tasks, cancel_minutes_col=None):
    """Add assignment, completion and deadline times; minutes a task has not reached become NULL.

    A canceled task ends `cancel_minutes_col` after its assignment when that column is given.
    """
    started = F.col("status").isin(*C.STARTED_STATUSES)
    done = F.col("status") == "done"
    assigned = X.add_minutes("created_at", "response_minutes")
    completed = F.when(done, X.add_minutes(assigned, "work_minutes"))
    if cancel_minutes_col:
        completed = completed.when(F.col("status") == "canceled", X.add_minutes(assigned, cancel_minutes_col))
    return tasks.withColumns(
        {
            "assigned_at": F.when(started, assigned),
            "completed_at": completed,
            "deadline_at": X.add_minutes("created_at", X.lookup("task_type", C.TASK_SLA_MINUTES)),
            "total_minutes": F.when(done, F.col("response_minutes") + F.col("work_minutes")),
            "response_minutes": F.when(started, F.col("response_minutes")),
            "work_minutes": F.when(done, F.col("work_minutes")),
        }
    )


def task_sla(tasks):
    """Add the SLA target and result; only done tasks have a result."""
    timed = tasks.withColumn("_total", F.col("response_minutes") + F.col("work_minutes"))
    done = F.col("status") == "done"
    return with_sla(timed, "task_type", "_total", C.TASK_SLA_MINUTES, done, "sla_target_min").drop("_total")


def task_priority(tasks, band=None):
    """Add priority, 1 highest: by type, and repairs of the evening and night come first."""
    band = X.hour_band(F.hour("created_at")) if band is None else band
    base = X.lookup("task_type", C.TASK_PRIORITY, C.DEFAULT_TASK_PRIORITY)
    late_repair = (F.col("task_type") == "repair") & band.isin("evening", "night")
    return tasks.withColumn("priority", F.when(late_repair, 1).otherwise(base))


def task_cost(tasks, km_col="move_km"):
    """Add ops cost: a fixed part by type plus a part per km moved."""
    fixed = X.lookup("task_type", {k: a for k, (a, _) in C.TASK_COST.items()}, C.DEFAULT_TASK_COST)
    per_km = X.lookup("task_type", {k: b for k, (_, b) in C.TASK_COST.items()}, 0.0)
    return tasks.withColumn("cost_usd", F.round(fixed + per_km * F.col(km_col), 2))


def expected_tasks(demand):
    """Expected tasks per demand row and type."""
    return expected_rate(demand, C.TASK_RATE_PER_1K, C.TASK_BAND_MULT, C.TASK_AREA_MULT, type_out="task_type")


def tasks_vs_expected(tasks, demand, time_col="created_at"):
    """Observed and expected tasks with their ratio, by vendor, month and type."""
    return observed_against(expected_tasks(demand), tasks, "task_type", time_col)


def _with_cause(tasks, causes, key, cause_id, how):
    """Join with the row of `causes` whose id is the task's `key`; tasks without a key meet none.

    An outer join sends every NULL key to one task, so rows without a key are spread by a stand-in made of their id.
    The stand-in only deals the rows out: `key` itself must match as well. (A slot that is 0 on the other side would
    not do: Catalyst takes a constant out of the join's keys.)
    """
    stand_in = F.pmod(F.xxhash64("task_id"), F.lit(NULL_KEY_SLOTS)).cast(tasks.schema[key].dataType)
    keyed = tasks.select(key, *[c for c in tasks.columns if c != key], F.coalesce(key, stand_in).alias("_dealt_by"))
    causes = causes.withColumnRenamed(cause_id, "_cause_id")
    same = (F.col("_dealt_by") == F.col("_cause_id")) & (F.col(key) == F.col("_cause_id"))
    return keyed.join(causes, same, how).drop("_dealt_by", "_cause_id")


def task_linkage(tasks, incidents, status=None, status_time=None):
    """Every task with its cause and the minutes from the cause to the task; NULL without a cause."""
    causes = incidents.select("incident_id", "incident_type", F.col("occurred_at").alias("cause_at"))
    linked = _with_cause(tasks, causes, "linked_incident_id", "incident_id", "left")
    cause_at = F.col("cause_at")
    if status is not None and "linked_event_id" in tasks.columns:
        events = status.select("event_id", "event_type", F.col(X.time_column(status, status_time)).alias("_event_at"))
        linked = _with_cause(linked, events, "linked_event_id", "event_id", "left")
        cause_at = F.coalesce(cause_at, "_event_at")
    linked = linked.withColumn("cause_at", cause_at).drop("_event_at")
    return linked.withColumn("minutes_to_task", X.minutes_between("cause_at", "created_at"))


def linked_tasks(tasks, incidents):
    """Tasks whose incident exists."""
    causes = incidents.select(F.col("incident_id").alias("linked_incident_id"))
    return tasks.filter(X.keys_known("linked_incident_id")).join(causes, "linked_incident_id", "left_semi")


def unlinked_tasks(tasks, incidents):
    """Tasks without an incident, or whose incident is not there."""
    unlinked = _with_cause(tasks, incidents.select("incident_id"), "linked_incident_id", "incident_id", "left_anti")
    return unlinked.select(*tasks.columns)
