"""Table layouts of the fleet data model."""

from pyspark.sql import types as T


TYPES = {
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def table_schema(text):
    """Schema from `name type` pairs; unlike a DDL string it needs no running session."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


HOURLY_DEMAND = table_schema(
    "day date, hour int, service_area_id int, community_area_name string, vendor string, trips bigint, "
    "dayhour_total bigint, share_within_day double, vendor_day_total bigint, share_within_vendor_day double"
)
INCIDENTS = table_schema(
    "incident_id bigint, vendor string, vehicle_id string, occurred_at timestamp_ntz, incident_type string, "
    "severity int, service_area_id int, community_area_name string, area_type string, report_source string, "
    "resolved_at timestamp_ntz, resolution string, cost_usd double, trip_related boolean, day date, hour int"
)
STATUS_CHANGES = table_schema(
    "event_id bigint, vendor string, vehicle_id string, event_type string, event_subtype string, "
    "occurred_at timestamp_ntz, handled_at timestamp_ntz, handle_minutes int, sla_minutes int, sla_met_int int, "
    "service_area_id int, community_area_name string, area_type string, hour_band string, weekday int, "
    "move_km_est double, battery_pct_before int, battery_pct_after int, offline_minutes int, ops_team string, "
    "compliance_flag boolean, cost_usd double, workload_trips_hour double, day date, hour int"
)
TASKS = table_schema(
    "task_id bigint, vendor string, task_type string, task_subtype string, priority int, status string, "
    "created_at timestamp_ntz, assigned_at timestamp_ntz, completed_at timestamp_ntz, response_minutes int, "
    "work_minutes int, total_minutes int, sla_target_min int, sla_met_int int, deadline_at timestamp_ntz, "
    "service_area_id int, community_area_name string, area_type string, hour_band string, weekday int, "
    "assigned_to string, team string, source string, linked_incident_id bigint, linked_event_id bigint, "
    "cost_usd double, parts_cost_usd double, workload_trips_hour double, day date, hour int"
)
VEHICLES = table_schema(
    "vehicle_id string, vendor string, form_factor string, model string, battery_wh int, battery_swappable boolean, "
    "service_area_id_home int, community_area_name_home string, area_type_home string, in_service_since date, "
    "decommissioned_at date, status string, firmware_version string, iot_modem string, odometer_km int, "
    "est_daily_trips_target double, est_daily_energy_wh int, battery_cycles_est int"
)
SERVICE_AREAS = table_schema("service_area_id int, community_area_name string, area_type string")
PRICING_POLICIES = table_schema(
    "vendor string, start_date date, end_date date, base_fare double, per_minute double, per_km double"
)
TRIPS_CANON = table_schema("vendor string, started_at timestamp_ntz, duration_s int, distance_m int, service_area_id int")

TABLES = {
    "hourly_demand_by_vendor": HOURLY_DEMAND,
    "incidents": INCIDENTS,
    "status_changes": STATUS_CHANGES,
    "tasks": TASKS,
    "vehicles": VEHICLES,
    "service_areas": SERVICE_AREAS,
    "pricing_policies": PRICING_POLICIES,
    "trips_canon": TRIPS_CANON,
}
