"""Report measures. Facts are aggregated to report keys first; only the aggregates are merged or joined."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.functions import groups as G
from kickstand.operators.incidents import incident_features
from kickstand.operators.status import status_sla
from kickstand.operators.tasks import task_sla
from kickstand.operators.trips import with_area_type


# --- building blocks --------------------------------------------------------------


def count_by(df, keys, name):
    """Row count by key columns; `keys` maps output names to columns."""
    return df.groupBy(*[X.as_col(c).alias(k) for k, c in keys.items()]).agg(F.count("*").alias(name))


def vendor_month(time_col):
    return {"vendor": "vendor", "month": X.month_start(F.to_date(time_col))}


def trips_by(demand, *keys):
    return demand.groupBy(*keys).agg(X.total("trips").alias("trips"))


def monthly_trips(demand):
    return demand.groupBy("vendor", X.month_start("day").alias("month")).agg(X.total("trips").alias("trips"))


def per_unit(num, den, keys, scale, name):
    """Rate of two aggregates on common keys; keys of either side are kept, NULL on a zero denominator."""
    (num_col,) = [c for c in num.columns if c not in keys]
    (den_col,) = [c for c in den.columns if c not in keys]
    return G.merge_measures(keys, num, den).withColumn(name, X.ratio(num_col, den_col, 4, scale))


def by_area_type(counts, areas, keys, sums):
    """Roll area-level sums up to the area type: the dimension meets aggregates, not facts."""
    typed = with_area_type(counts, areas)
    return typed.groupBy(*keys, "area_type").agg(*[F.sum(s).cast(counts.schema[s].dataType).alias(s) for s in sums])


def measures_cube(df, dims, measures):
    """Additive measures over every combination of dimensions, with a flag per rolled-up dimension.

    Rows are summed at the full grain before the cube multiplies them.
    """
    base = df.groupBy(*dims).agg(*[expr.alias(name) for name, expr in measures.items()])
    flags = [F.grouping(d).cast("int").alias(f"{d}_all") for d in dims]
    kinds = {name: base.schema[name].dataType for name in measures}
    sums = [F.sum(name).cast(kinds[name]).alias(name) for name in measures]
    return base.cube(*dims).agg(*flags, *sums)


# --- demand -----------------------------------------------------------------------


def trips_by_vendor_month(demand):
    totals = G.with_totals(monthly_trips(demand), "trips", _month=["month"])
    return totals.select("month", "vendor", "trips", X.exact_ratio("trips", "_month", 4).alias("vendor_share"))


def trips_heatmap(demand, areas):
    """Trips by hour and area type, scaled by the busiest hour of the area type."""
    cells = by_area_type(trips_by(demand, "hour", "service_area_id"), areas, ["hour"], ["trips"])
    peak = F.max("trips").over(Window.partitionBy("area_type"))
    return cells.withColumn("share_of_peak", X.exact_ratio("trips", peak, 4))


def trips_heatmap_wide(demand, areas):
    """The heatmap with a column per area type."""
    cells = by_area_type(trips_by(demand, "hour", "service_area_id"), areas, ["hour"], ["trips"])
    wide = cells.groupBy("hour").pivot("area_type", list(C.AREA_TYPES)).agg(F.sum("trips").cast("bigint"))
    return wide.na.fill(0, list(C.AREA_TYPES))


# --- rates ------------------------------------------------------------------------


def incidents_per_1k_trips(incidents, demand):
    counts = count_by(incidents, vendor_month("occurred_at"), "incidents")
    return per_unit(counts, monthly_trips(demand), ["vendor", "month"], 1000, "incidents_per_1k")


def tasks_per_1k_trips(tasks, demand):
    counts = count_by(tasks, vendor_month("created_at"), "tasks")
    return per_unit(counts, monthly_trips(demand), ["vendor", "month"], 1000, "tasks_per_1k")


def _km_by_vehicle(vehicles, incidents):
    per_vehicle = incidents.filter(X.keys_known("vehicle_id")).groupBy("vehicle_id").agg(
        F.count("*").alias("incidents")
    )
    return vehicles.join(per_vehicle, "vehicle_id", "left")


def incidents_per_10k_km(incidents, vehicles):
    """Incidents per 10,000 km by vendor and battery size, over all vehicles."""
    rows = _km_by_vehicle(vehicles.select("vehicle_id", "vendor", "battery_wh", "odometer_km"), incidents)
    sums = rows.groupBy("vendor", "battery_wh").agg(
        F.count("*").alias("vehicles"),
        X.total("odometer_km").alias("km"),
        F.coalesce(X.total("incidents"), F.lit(0)).cast("bigint").alias("incidents"),
    )
    return sums.withColumn("incidents_per_10k_km", X.ratio("incidents", "km", 4, 10000))


# --- SLA --------------------------------------------------------------------------


def sla_pct_tasks(tasks):
    """Share of tasks with an SLA result that met it, by vendor and task type."""
    return task_sla(tasks).groupBy("vendor", "task_type").agg(
        F.count("sla_met_int").alias("rated_tasks"),
        X.exact_ratio(X.total("sla_met_int"), F.count("sla_met_int"), 4).alias("sla_pct"),
    )


def sla_pct_status(status, time_col=None):
    return status_sla(status, time_col=time_col).groupBy("event_type").agg(
        F.count("*").alias("events"),
        X.exact_ratio(X.total("sla_met_int"), F.count("sla_met_int"), 4).alias("sla_pct"),
        X.exact_ratio(X.total("handle_minutes"), F.count("handle_minutes"), 2).alias("avg_handle_minutes"),
    )


def sla_matrix(tasks, status, areas):
    """SLA share of tasks and mean handling minutes of status events, by vendor and area type."""
    keys = ["vendor", "service_area_id"]
    rated = task_sla(tasks).groupBy(*keys).agg(
        F.count("sla_met_int").alias("_rated"), F.coalesce(X.total("sla_met_int"), F.lit(0)).alias("_met")
    )
    handled = status.groupBy(*keys).agg(
        F.count("handle_minutes").alias("_handled"),
        F.coalesce(X.total("handle_minutes"), F.lit(0)).alias("_minutes"),
    )
    merged = G.merge_measures(keys, rated, handled)
    cells = by_area_type(merged, areas, ["vendor"], ["_rated", "_met", "_handled", "_minutes"])
    return cells.select(
        "vendor",
        "area_type",
        F.col("_rated").alias("rated_tasks"),
        X.exact_ratio("_met", "_rated", 4).alias("sla_pct"),
        X.exact_ratio("_minutes", "_handled", 2).alias("avg_handle_minutes"),
    )


# --- money ------------------------------------------------------------------------


def task_cost_total(tasks):
    """Ops and parts cost of tasks by vendor and month, from their cost columns."""
    return tasks.groupBy(*[X.as_col(c).alias(k) for k, c in vendor_month("created_at").items()]).agg(
        F.round(F.sum("cost_usd"), 2).alias("ops_cost"),
        F.round(F.sum(F.col("parts_cost_usd").cast("double")), 2).alias("parts_cost"),
        F.round(F.sum(F.col("cost_usd") + F.col("parts_cost_usd")), 2).alias("task_cost"),
    )


def risk_vs_spend(incidents, tasks, demand):
    """Incidents and task cost per 1,000 trips by vendor."""
    merged = G.merge_measures(
        ["vendor"],
        trips_by(demand, "vendor"),
        count_by(incidents, {"vendor": "vendor"}, "incidents"),
        tasks.groupBy("vendor").agg(F.sum(F.col("cost_usd") + F.col("parts_cost_usd")).alias("task_cost")),
    )
    return merged.select(
        "vendor",
        "trips",
        "incidents",
        F.round("task_cost", 2).alias("task_cost"),
        X.ratio("incidents", "trips", 4, 1000).alias("incidents_per_1k"),
        X.ratio(F.round("task_cost", 2), "trips", 4, 1000).alias("cost_per_1k"),
    )


def area_rates(incidents, tasks, demand):
    """Incidents and task cost per 1,000 trips by vendor and area; NULL rates where there were no trips."""
    cents = F.round((F.col("cost_usd") + F.col("parts_cost_usd")) * 100).cast("bigint")
    merged = G.merge_measures(
        ["vendor", "service_area_id"],
        trips_by(demand, "vendor", "service_area_id"),
        count_by(incidents, {"vendor": "vendor", "service_area_id": "service_area_id"}, "incidents"),
        tasks.groupBy("vendor", "service_area_id").agg(F.coalesce(X.total(cents), F.lit(0)).alias("task_cents")),
    )
    return merged.select(
        "vendor",
        "service_area_id",
        "trips",
        X.exact_ratio(F.col("incidents") * 1000, "trips", 4).alias("incidents_per_1k"),
        X.exact_ratio(F.col("task_cents") * 10, "trips", 4).alias("cost_per_1k"),
    )


def cost_heatmap(incidents, tasks, areas):
    """Task and incident cost by hour and area type."""
    task_side = tasks.groupBy(F.hour("created_at").alias("hour"), "service_area_id").agg(
        F.sum(F.col("cost_usd") + F.col("parts_cost_usd")).alias("cost_tasks")
    )
    incident_side = incidents.groupBy(F.hour("occurred_at").alias("hour"), "service_area_id").agg(
        F.sum(F.col("cost_usd").cast("double")).alias("cost_incidents")
    )
    merged = G.merge_measures(["hour", "service_area_id"], task_side, incident_side)
    cells = by_area_type(merged, areas, ["hour"], ["cost_tasks", "cost_incidents"])
    return cells.select(
        "hour",
        "area_type",
        F.round("cost_tasks", 2).alias("cost_tasks"),
        F.round("cost_incidents", 2).alias("cost_incidents"),
        F.round(F.col("cost_tasks") + F.col("cost_incidents"), 2).alias("cost_total"),
    )


def cost_waterfall(incidents):
    """Incident cost by type, largest first, with the running total."""
    costs = incidents.groupBy("incident_type").agg(
        F.count("*").alias("incidents"), F.sum(F.col("cost_usd").cast("double")).alias("cost_usd")
    )
    # one row per incident type is left here
    order = Window.orderBy(F.desc("cost_usd"), "incident_type").rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("running_cost", F.round(F.sum("cost_usd").over(order), 2)).withColumn(
        "cost_usd", F.round("cost_usd", 2)
    )


def vendor_monthly(demand, incidents, tasks):
    """Trips, incident cost and task cost per month and vendor: the materialised monthly view."""
    incident_side = incidents.groupBy(*[X.as_col(c).alias(k) for k, c in vendor_month("occurred_at").items()]).agg(
        F.sum(F.col("cost_usd").cast("double")).alias("cost_incidents")
    )
    task_side = tasks.groupBy(*[X.as_col(c).alias(k) for k, c in vendor_month("created_at").items()]).agg(
        F.sum(F.col("cost_usd") + F.col("parts_cost_usd")).alias("cost_tasks")
    )
    merged = G.merge_measures(["month", "vendor"], monthly_trips(demand), incident_side, task_side)
    return merged.withColumns(
        {"cost_incidents": F.round("cost_incidents", 2), "cost_tasks": F.round("cost_tasks", 2)}
    )


# --- operations -------------------------------------------------------------------


def incident_summary(incidents):
    """Incidents, resolution-time percentiles and cost by type and vendor.

    Incidents are counted per whole minute of resolution time before they are ranked.
    """
    keys = ["incident_type", "vendor"]
    counted = incident_features(incidents).groupBy(*keys, "resolve_minutes").agg(
        F.count("*").alias("n"), F.sum(F.col("cost_usd").cast("double")).alias("_cost")
    )
    timed = F.col("resolve_minutes").isNotNull()
    ranked = G.rank_values(counted.filter(timed), keys, "resolve_minutes")
    untimed = counted.filter(~timed).withColumns(
        {"below": F.lit(None).cast("bigint"), "group_rows": F.lit(None).cast("bigint")}
    )
    return ranked.unionByName(untimed).groupBy(*keys).agg(
        X.total("n").alias("incidents"),
        G.percentile_of("resolve_minutes", 5, 1).alias("p50_resolve_minutes"),
        G.percentile_of("resolve_minutes", 9, 1).alias("p90_resolve_minutes"),
        F.round(F.sum("_cost"), 2).alias("cost_usd"),
    )


def load_vs_handle(events, demand, time_col=None, minutes_col="handle_minutes"):
    """Mean trips per hour around an event and mean handling minutes, by vendor and area.

    Events are counted per demand key first, so the join is one row to one row whatever the skew.
    """
    keys = ["day", "hour", "service_area_id", "vendor"]
    time_col = X.time_column(events, time_col)
    counts = events.groupBy(
        F.to_date(time_col).alias("day"), F.hour(time_col).alias("hour"), "service_area_id", "vendor"
    ).agg(
        F.count("*").alias("_events"),
        F.count(minutes_col).alias("_handled"),
        F.coalesce(X.total(minutes_col), F.lit(0)).alias("_minutes"),
    )
    joined = counts.join(demand.groupBy(*keys).agg(X.total("trips").alias("_trips")), keys, "left")
    sums = joined.groupBy("vendor", "service_area_id").agg(
        X.total("_events").alias("events"),
        # trips times events outgrow bigint on a large fleet
        F.sum(F.coalesce("_trips", F.lit(0)).cast("decimal(19,0)") * F.col("_events").cast("decimal(18,0)")).alias("_load"),
        X.total("_minutes").alias("_minutes"),
        X.total("_handled").alias("_handled"),
    )
    return sums.select(
        "vendor",
        "service_area_id",
        "events",
        X.exact_ratio("_load", "events", 4, wide=True).alias("avg_workload"),
        X.exact_ratio("_minutes", "_handled", 4).alias("avg_handle_minutes"),
    )


def task_funnel(tasks):
    """Tasks by stage with mean response and mean cost, by type and vendor."""
    status, started = F.col("status"), F.col("status").isin(*C.STARTED_STATUSES)
    cost_cents = F.round((F.col("cost_usd") + F.col("parts_cost_usd")) * 100).cast("bigint")
    return tasks.groupBy("task_type", "vendor").agg(
        F.count("*").alias("created"),
        F.count_if(status == "open").alias("open"),
        F.count_if(started).alias("assigned"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "canceled").alias("canceled"),
        X.exact_ratio(
            X.total(F.when(started, F.col("response_minutes"))),
            F.count(F.when(started, F.col("response_minutes"))),
            2,
        ).alias("avg_response_minutes"),
        X.exact_ratio(X.total(cost_cents), F.count(cost_cents) * 100, 2).alias("avg_cost"),
    )


def events_count(incidents, status, tasks, status_time=None):
    """Incidents, status events and tasks per day and vendor."""
    status_time = X.time_column(status, status_time)

    def per_day(df, time_col, name):
        return count_by(df, {"day": F.to_date(time_col), "vendor": "vendor"}, name)

    return G.merge_measures(
        ["day", "vendor"],
        per_day(incidents, "occurred_at", "incidents"),
        per_day(status, status_time, "status_events"),
        per_day(tasks, "created_at", "tasks"),
    )


# --- fleet ------------------------------------------------------------------------


def fleet_mix(vehicles):
    """Vehicles by vendor, status and battery size with the share of the vendor's fleet."""
    counts = vehicles.groupBy("vendor", "status", "battery_wh").agg(F.count("*").alias("vehicles"))
    totals = G.with_totals(counts, "vehicles", _fleet=["vendor"])
    return totals.select("vendor", "status", "battery_wh", "vehicles", X.exact_ratio("vehicles", "_fleet", 4).alias("share"))


def odometer_distribution(vehicles, bucket_km=1000):
    """Vehicles per odometer bucket and vendor."""
    bucket = (F.floor(F.col("odometer_km") / bucket_km) * bucket_km).cast("int")
    return vehicles.groupBy("vendor", bucket.alias("bucket_km")).agg(F.count("*").alias("vehicles"))


def vehicle_drill_through(vehicles, incidents, status, status_time=None):
    """Incidents, status events, handling minutes and last event per vehicle; idle vehicles have zeros."""
    status_time = X.time_column(status, status_time)
    incident_side = incidents.filter(X.keys_known("vehicle_id")).groupBy("vehicle_id").agg(
        F.count("*").alias("incidents"), F.max("occurred_at").alias("_last_incident")
    )
    status_side = status.filter(X.keys_known("vehicle_id")).groupBy("vehicle_id").agg(
        F.count("*").alias("status_events"),
        X.total("handle_minutes").alias("handled_minutes"),
        F.max(status_time).alias("_last_status"),
    )
    joined = (
        vehicles.select("vehicle_id", "vendor", "status")
        .join(incident_side, "vehicle_id", "left")
        .join(status_side, "vehicle_id", "left")
    )
    counts = ["incidents", "status_events", "handled_minutes"]
    return joined.select(
        "vehicle_id",
        "vendor",
        "status",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.greatest("_last_incident", "_last_status").alias("last_event_at"),
    )


def task_measures_cube(tasks):
    """Task count, SLA results and parts cost over vendor and task type, with grand totals."""
    measures = {
        "tasks": F.count("*"),
        "rated_tasks": F.count("sla_met_int"),
        "sla_met": F.coalesce(X.total("sla_met_int"), F.lit(0)),
        "parts_cost": F.coalesce(X.total("parts_cost_usd"), F.lit(0)),
    }
    return measures_cube(task_sla(tasks), ["vendor", "task_type"], measures)
