"""Every query of the engine on the driver's tables, by name."""

from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.functions import groups as G
from kickstand.operators import absences as AB
from kickstand.operators import calibration as CA
from kickstand.operators import fleet as FL
from kickstand.operators import incidents as I
from kickstand.operators import insights as IN
from kickstand.operators import intervals as IV
from kickstand.operators import maintenance as M
from kickstand.operators import rollups as RU
from kickstand.operators import status as ST
from kickstand.operators import tasks as TK
from kickstand.operators import trips as TR
from kickstand.plans import kpi as K
from kickstand.plans.monthly_view import MonthlyView
from kickstand.sources import readers as R
from kickstand.sources.fixtures import Fleet
from kickstand.sources.sinks import new_folder, stored

#: Status events that tasks of the test tables are linked to; some of these ids have no event.
EVENT_IDS = 1500


# --- inputs shared by several queries ---------------------------------------------


def _demand(t):
    return TR.trips_hourly(t.trips_canon)


def _demand_rows(t):
    return TR.demand_rows(t.trips_canon)


def _typed_demand(t):
    return TR.with_area_type(_demand(t), t.service_areas)


def _canon(t):
    return R.trips_canon(t.trips_raw)


def _costed(t):
    return TK.task_cost(t.tasks)


def _catalog(t):
    return CA.area_catalog(None, t.service_areas)


# --- queries that round, aggregate or project an operator's output ----------------


def _trips_canon(t):
    return _canon(t).groupBy("vendor", "day", "hour", "area_name", "distance_m").agg(F.count("*").alias("trips"))


def _vendor_canon(t):
    names = t.trips_raw.groupBy("provider_name").agg(F.count("*").alias("trips"))
    return names.withColumn("vendor", X.vendor_canon("provider_name"))


def _canon_hourly(t):
    # the raw text is parsed once; catalog and demand are drawn from its counts
    counts = stored(TR.canon_counts(_canon(t)))
    return TR.canon_hourly(counts, CA.area_catalog(counts))


def _demand_shares(t):
    return TR.demand_shares(_demand(t))


def _time_features(t):
    return X.time_features(t.incidents.select("incident_id", "occurred_at"), "occurred_at").drop("occurred_at")


def _vendor_month_mix(t):
    return CA.vendor_month_mix(_demand_rows(t)).select(
        "month", "vendor", F.round("raw", 12).alias("raw"), F.round("share", 12).alias("share")
    )


def _normalize_with_floors(t):
    """Vendor shares per area type, by trips."""
    weights = K.by_area_type(
        K.trips_by(_demand_rows(t), "vendor", "service_area_id"), t.service_areas, ["vendor"], ["trips"]
    )
    shares = G.normalize_with_floors(weights, ["area_type"], "vendor", "trips", C.VENDOR_SHARE_FLOORS)
    return shares.withColumn("share", F.round("share", 12))


def _rounded(df, places, *cols):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _against(rows):
    """Observed against expected: rates are short decimals, whose sums tie at few places."""
    return _rounded(_rounded(rows, 12, "expected"), 6, "observed_ratio")


def _expected_demand(t):
    spine = CA.expected_demand(_demand(t), _catalog(t))
    return spine.groupBy(X.month_start("day").alias("month"), "hour", "vendor").agg(
        F.count("*").alias("cells"), F.round(F.sum("expected_trips"), 4).alias("expected_trips")
    )


def _demand_vs_expected(t):
    demand = stored(_demand(t))
    rows = CA.demand_vs_expected(demand, demand, _catalog(t), floor_total=1)
    return _rounded(_rounded(rows, 10, "expected_trips"), 6, "observed_ratio")


def _incident_type_mix(t):
    """The mix per vendor, area type, month of the year and hour, over all demand rows."""
    rows = I.incident_type_mix(_typed_demand(t))
    return rows.groupBy("vendor", "area_type", F.month("day").alias("month"), "hour", "incident_type").agg(
        F.count("*").alias("demand_rows"), F.round(F.avg("probability"), 8).alias("probability")
    )


def _expected_incidents(t):
    rows = I.expected_incidents(_typed_demand(t))
    return rows.groupBy("day", "vendor", "incident_type").agg(
        F.round(F.sum("expected_incidents"), 10).alias("expected_incidents")
    )


def _status_sla(t):
    return ST.status_sla(t.status_changes).select(
        "event_id", "event_type", "handle_minutes", "sla_minutes", "sla_met_int", "handled_at"
    )


def _status_flags(t):
    return ST.status_flags(t.status_changes).select("event_id", "event_type", "offline_minutes", "compliance_flag")


def _active(t):
    rows = ST.with_active(_demand(t), t.vehicles)
    return rows.groupBy("vendor", "service_area_id").agg(
        F.max("active_vehicles").alias("active_vehicles"), F.count("*").alias("demand_rows")
    )


def _expected_status(t):
    rows = ST.expected_status_events(_typed_demand(t), t.vehicles)
    return rows.groupBy("day", "vendor", "event_type").agg(F.round(F.sum("expected"), 12).alias("expected"))


def _expected_tasks(t):
    rows = TK.expected_tasks(_typed_demand(t))
    return rows.groupBy("day", "vendor", "task_type").agg(F.round(F.sum("expected"), 12).alias("expected"))


def _workload(t):
    rows = TK.with_workload(t.incidents, _demand_rows(t), "occurred_at")
    return rows.select("incident_id", "vendor", "service_area_id", "workload_trips_hour")


def _task_workload(t):
    rows = TK.with_workload(t.tasks, _demand_rows(t), "created_at")
    return rows.select("task_id", "vendor", "service_area_id", "workload_trips_hour")


def _task_timeline(t):
    return TK.task_timeline(t.tasks).select(
        "task_id", "status", "assigned_at", "completed_at", "deadline_at", "response_minutes", "work_minutes",
        "total_minutes",
    )


def _task_sla(t):
    return TK.task_sla(t.tasks).select("task_id", "task_type", "status", "sla_target_min", "sla_met_int")


def _task_priority(t):
    return TK.task_priority(t.tasks).select("task_id", "task_type", "priority")


def _task_cost(t):
    return TK.task_cost(t.tasks).select("task_id", "task_type", "move_km", "cost_usd")


def _task_linkage(t):
    """Tasks with both kinds of cause: a third of those without an incident come from a status event."""
    event = F.when(F.col("linked_incident_id").isNull() & (F.col("task_id") % 3 == 0), F.col("task_id") % EVENT_IDS)
    tasks = t.tasks.withColumn("linked_event_id", event)
    return TK.task_linkage(tasks, t.incidents, t.status_changes).select(
        "task_id", "linked_incident_id", "incident_type", "linked_event_id", "event_type", "cause_at", "minutes_to_task"
    )


def _vehicle_features(t):
    trips = t.trips_canon
    rows = FL.vehicle_features(
        t.vehicles, trips.agg(F.max(F.to_date("started_at"))).scalar(), CA.avg_trip_km(trips).scalar()
    )
    return rows.select(
        "vehicle_id", "days_in_service", F.round("est_trips", 4).alias("est_trips"), "est_daily_energy_wh",
        "battery_cycles_est",
    )


def _trip_cost(t):
    priced = FL.trip_cost(t.trips_canon, t.pricing)
    return priced.select(
        "trip_id", "vendor", "started_at", "duration_s", "distance_m", F.round("trip_cost", 6).alias("trip_cost")
    )


def _monthly_view(t):
    """The stored monthly view after two refreshes: each table arrives in two drops, and most months are in both."""
    root = new_folder(t.spark, "monthly")
    tables = {"trips": (t.trips_canon, "trip_id"), "incidents": (t.incidents, "incident_id"), "tasks": (_costed(t), "task_id")}

    def reader(schema):
        return lambda spark, files: spark.read.schema(schema).parquet(*files)

    view = MonthlyView(t.spark, f"{root}/view", {name: reader(df.schema) for name, (df, _) in tables.items()})
    for drop in range(2):
        for name, (df, key) in tables.items():
            df.filter(F.col(key) % 2 == drop).write.mode("append").parquet(f"{root}/{name}")
        view.refresh(**{name: f"{root}/{name}" for name in tables})
    return view.read()


def _service_distinct(t):
    """Vehicles taken out of service per day, week and month, from the stored sketches of the days."""
    out = t.status_changes.filter(F.col("event_type") == C.PICKUP_EVENT)
    states = stored(RU.daily_states(out, "event_time", distinct=["vehicle_id"]))
    rows = RU.distinct_by_grain(out, states, "event_time", "vehicle_id")
    return rows.select("grain", "start", F.col("rows").alias("events"), F.col("exact").alias("vehicles"), "within_error")


def _distance_quantiles(t):
    """Median and 90th percentile of trip distance per vendor and month from stored sketches, ranked among the trips."""
    trips = t.trips_canon.filter(X.keys_known("started_at", "distance_m")).withColumn("month", X.month_start(F.to_date("started_at")))
    states = stored(RU.daily_states(trips, "started_at", ["vendor"], quantiles=["distance_m"]))
    rolled = RU.roll_up(states, "month", ["vendor"]).withColumnRenamed("start", "month")
    wanted = {"p50": 0.5, "p90": 0.9}
    estimates = rolled.withColumns({name: RU.quantile_estimate("distance_m", rank) for name, rank in wanted.items()})
    ranks = RU.quantile_ranks(trips, estimates, ["month", "vendor"], "distance_m", list(wanted))
    holds = [RU.rank_holds(name, rank).alias(f"{name}_rank_holds") for name, rank in wanted.items()]
    return ranks.select("month", "vendor", F.col("n").alias("trips"), *holds)


def _incidents_cube(t):
    return RU.cube_of(
        I.incident_features(t.incidents),
        ["vendor", "incident_type", "severity"],
        additive={"incidents": F.count("*"), "cost_usd": X.total("cost_usd")},
        ratios={"avg_cost_usd": (X.total("cost_usd"), F.count("cost_usd"), 2)},
        distinct={"vehicles": "vehicle_id"},
        percentiles={"p50_resolve_minutes": ("resolve_minutes", 5, 1), "p90_resolve_minutes": ("resolve_minutes", 9, 1)},
    )


def _policies(t):
    """Policies that overlap and never end: a vendor's open one, those of two months in three, and promotions in them."""
    monthly = t.pricing.filter(F.month("start_date") % 3 != 0)
    opened = t.pricing.groupBy("vendor").agg(F.min("start_date").alias("start_date")).select(
        "vendor", "start_date", F.lit(None).cast("date").alias("end_date"), F.lit(0.5).alias("base_fare"), F.lit(0.25).alias("per_minute"), F.lit(0.125).alias("per_km")
    )
    promotions = t.pricing.filter(F.month("start_date") % 2 == 0).select(
        "vendor",
        F.date_add("start_date", 9).alias("start_date"),
        F.date_add("start_date", 45).alias("end_date"),
        F.lit(2.0).alias("base_fare"),
        F.lit(0.0).alias("per_minute"),
        F.lit(0.0).alias("per_km"),
    )
    return monthly.unionByName(opened).unionByName(promotions)


def _rate_points(t):
    """Incidents and task cost per 1,000 trips by vendor and area."""
    return K.area_rates(t.incidents, _costed(t), _demand_rows(t))


def _demand_alerts(t):
    demand = stored(_demand(t))
    return IN.demand_alerts(_rounded(CA.demand_vs_expected(demand, demand, _catalog(t), floor_total=1), 10, "expected_trips"))


EXTRACTS = {
    "daily_trips_by_vendor": lambda t: TR.daily_trips_by_vendor(t.trips_canon),
    "avg_trips_by_vendor": lambda t: TR.avg_trips_by_vendor(t.trips_canon),
    "hourly_demand_by_vendor": lambda t: TR.hourly_demand_by_vendor(t.trips_canon),
    "service_events_per_day": lambda t: M.service_events_per_day(t.status_changes),
    "avg_downtime_per_vehicle": lambda t: M.avg_downtime_per_vehicle(t.status_changes),
    "weekly_fleet_maintenance_percent": lambda t: M.weekly_fleet_maintenance_percent(t.status_changes, t.vehicles),
    "incidents_by_type": lambda t: I.incidents_by_type(t.incidents),
}

CALIBRATION = {
    "trips_canon": _trips_canon,
    "vendor_canon": _vendor_canon,
    "area_catalog": lambda t: CA.area_catalog(_canon(t)),
    "trips_hourly": _demand,
    "canon_hourly": _canon_hourly,
    "demand_shares": _demand_shares,
    "with_area_type": _typed_demand,
    "time_features": _time_features,
    "vendor_month_mix": _vendor_month_mix,
    "normalize_with_floors": _normalize_with_floors,
    "hour_shape": lambda t: _rounded(CA.hour_shape(_demand_rows(t)), 8, "weight"),
    "area_weights": lambda t: _rounded(CA.area_weights(_demand_rows(t), _catalog(t)), 8, "weight"),
    "vendor_area_mix": lambda t: _rounded(CA.vendor_area_mix(_demand_rows(t), _catalog(t)), 8, "weight"),
    "daily_median": lambda t: CA.daily_median(_demand_rows(t)),
    "month_multiplier": lambda t: _rounded(CA.month_multiplier(_demand_rows(t)), 8, "multiplier"),
    "weekend_boost": lambda t: _rounded(CA.weekend_boost(_demand_rows(t)), 8, "weekend_boost"),
    "vendor_daily_avg": lambda t: _rounded(CA.vendor_daily_avg(_demand_rows(t)), 6, "daily_avg"),
    "fleet_sizing": lambda t: _rounded(CA.fleet_sizing(CA.vendor_daily_avg(_demand_rows(t))), 6, "daily_avg"),
    "avg_trip_km": lambda t: _rounded(CA.avg_trip_km(t.trips_canon), 6, "avg_trip_km"),
    "expected_demand": _expected_demand,
    "demand_vs_expected": _demand_vs_expected,
}

OPERATIONS = {
    "incident_features": lambda t: I.incident_features(t.incidents),
    "incident_type_mix": _incident_type_mix,
    "expected_incidents": _expected_incidents,
    "incidents_vs_expected": lambda t: _rounded(
        _rounded(I.incidents_vs_expected(t.incidents, _typed_demand(t)), 10, "expected_incidents"), 6, "observed_ratio"
    ),
    "status_sla": _status_sla,
    "status_flags": _status_flags,
    "active_by_vendor_area": _active,
    "expected_status_events": _expected_status,
    "workload_trips_hour": _workload,
    "task_workload": _task_workload,
    "task_candidates": lambda t: TK.task_candidates(t.incidents, t.status_changes),
    "task_timeline": _task_timeline,
    "task_sla": _task_sla,
    "task_priority": _task_priority,
    "task_cost": _task_cost,
    "expected_tasks": _expected_tasks,
    "task_linkage": _task_linkage,
    "linked_tasks": lambda t: TK.linked_tasks(t.tasks, t.incidents).select("task_id", "task_type", "vendor"),
    "unlinked_tasks": lambda t: TK.unlinked_tasks(t.tasks, t.incidents).select("task_id", "task_type", "vendor"),
    "vehicle_features": _vehicle_features,
    "trip_cost": _trip_cost,
    "trip_cost_by_vendor_month": lambda t: _rounded(
        FL.trip_cost_by_vendor_month(t.trips_canon, t.pricing), 6, "revenue"
    ),
}

MEASURES = {
    "trips_by_vendor_month": lambda t: K.trips_by_vendor_month(_demand_rows(t)),
    "incidents_per_1k_trips": lambda t: K.incidents_per_1k_trips(t.incidents, _demand_rows(t)),
    "tasks_per_1k_trips": lambda t: K.tasks_per_1k_trips(t.tasks, _demand_rows(t)),
    "sla_pct_tasks": lambda t: K.sla_pct_tasks(t.tasks),
    "sla_pct_status": lambda t: K.sla_pct_status(t.status_changes),
    "sla_matrix": lambda t: K.sla_matrix(t.tasks, t.status_changes, t.service_areas),
    "task_cost_total": lambda t: K.task_cost_total(_costed(t)),
    "risk_vs_spend": lambda t: K.risk_vs_spend(t.incidents, _costed(t), _demand_rows(t)),
    "cost_heatmap": lambda t: K.cost_heatmap(t.incidents, _costed(t), t.service_areas),
    "trips_heatmap": lambda t: K.trips_heatmap(_demand_rows(t), t.service_areas),
    "trips_heatmap_wide": lambda t: K.trips_heatmap_wide(_demand_rows(t), t.service_areas),
    "incident_summary": lambda t: K.incident_summary(t.incidents),
    "cost_waterfall": lambda t: K.cost_waterfall(t.incidents),
    "load_vs_handle": lambda t: K.load_vs_handle(t.status_changes, _demand_rows(t)),
    "load_vs_resolution": lambda t: K.load_vs_handle(
        I.incident_features(t.incidents), _demand_rows(t), "occurred_at", "resolve_minutes"
    ),
    "vendor_monthly": lambda t: K.vendor_monthly(_demand_rows(t), t.incidents, _costed(t)),
    "task_funnel": lambda t: K.task_funnel(_costed(t)),
    "measures_cube": lambda t: K.task_measures_cube(t.tasks),
    "fleet_mix": lambda t: K.fleet_mix(t.vehicles),
    "odometer_distribution": lambda t: K.odometer_distribution(t.vehicles),
    "incidents_per_10k_km": lambda t: K.incidents_per_10k_km(t.incidents, t.vehicles),
    "vehicle_drill_through": lambda t: K.vehicle_drill_through(t.vehicles, t.incidents, t.status_changes),
    "events_count": lambda t: K.events_count(t.incidents, t.status_changes, t.tasks),
}

INSIGHTS = {
    "monthly_view_refreshed": _monthly_view,
    "service_distinct_rollup": _service_distinct,
    "distance_quantile_rollup": _distance_quantiles,
    "incidents_cube": _incidents_cube,
    "revenue_by_precedence": lambda t: _rounded(IV.revenue_by_vendor_month(t.trips_canon, _policies(t)), 8, "revenue"),
    "handle_trend": lambda t: IN.trend(
        K.load_vs_handle(t.status_changes, _demand_rows(t)), "avg_workload", "avg_handle_minutes", ["vendor"]
    ),
    "best_in_class": lambda t: IN.skyline(_rate_points(t), "incidents_per_1k", "cost_per_1k"),
    "demand_alerts": _demand_alerts,
    "vehicles_out_by_hour": lambda t: AB.vehicles_out_by_hour(t.status_changes),
    "status_vs_expected": lambda t: _against(ST.status_vs_expected(t.status_changes, _typed_demand(t), t.vehicles)),
    "tasks_vs_expected": lambda t: _against(TK.tasks_vs_expected(t.tasks, _typed_demand(t))),
}

QUERIES = {**EXTRACTS, **CALIBRATION, **OPERATIONS, **MEASURES, **INSIGHTS}


def all_queries():
    def bind(build):
        return lambda spark, sf_dir: build(Fleet(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
