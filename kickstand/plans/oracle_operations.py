"""Oracle SQL of the incident, status, task and fleet queries."""

from kickstand import constants as C
from kickstand.plans.oracle_parts import band, case_of, num, rate_case, with_fleet


def stacked(kinds, name, select):
    """One SELECT per type, put under each other; `select(kind)` gives the value columns."""
    return " union all ".join(f"select *, {kind!r} as {name}, {select(kind)} from typed" for kind in kinds)


def incident_weight(kind):
    months = dict(enumerate(C.INCIDENT_MONTH_MULT[kind], start=1))
    return (
        f"{num(C.INCIDENT_RATE_PER_1K[kind])} * {case_of(band('hour'), C.INCIDENT_BAND_MULT[kind])}"
        f" * {case_of('area_type', C.INCIDENT_AREA_MULT[kind], 1.0)}"
        f" * {case_of('extract(month from day)', months)} * {case_of('vendor', C.VENDOR_INTENSITY, 1.0)}"
    )


MIX = f""", weights as ({stacked(C.INCIDENT_RATE_PER_1K, 'incident_type', lambda k: incident_weight(k) + ' as w')}),
      mix as (select *, w / sum(w) over (partition by day, hour, service_area_id, vendor) as p from weights)"""
BASE_RATE = num(sum(C.INCIDENT_RATE_PER_1K.values()) / 1000.0)

ACTIVE = """
    select d.*, coalesce(n, greatest(3, trips // 20)) as active_vehicles
    from typed d left join (select vendor, service_area_id_home as service_area_id, count(*) as n from vehicles
                            group by 1, 2) v using (vendor, service_area_id)"""


def status_mean(kind):
    if kind in C.STATUS_RATE_PER_1K:
        rate = num(C.STATUS_RATE_PER_1K[kind] / 1000.0)
        return f"trips * {rate} * {rate_case(kind, C.STATUS_BAND_MULT, C.STATUS_AREA_MULT)}"
    if kind in C.STATUS_RATE_PER_VEHICLE_HOUR:
        rate = num(C.STATUS_RATE_PER_VEHICLE_HOUR[kind])
        return f"active_vehicles * {rate} * {rate_case(kind, C.STATUS_BAND_MULT, C.STATUS_AREA_MULT)}"
    if kind == "deployment":
        return (
            "case when hour between 6 and 9 then active_vehicles * 0.015e0"
            " when hour = 10 then active_vehicles * 0.015e0 * 0.8e0 else 0e0 end"
        )
    return "case when hour >= 21 or hour <= 1 then active_vehicles * 0.02e0 else 0e0 end"


STATUS_KINDS = [*C.STATUS_RATE_PER_1K, *C.STATUS_RATE_PER_VEHICLE_HOUR, "deployment", "retrieval"]
STATUS_STACK = " union all ".join(
    f"select day, vendor, {k!r} as event_type, {status_mean(k)} as expected from active" for k in STATUS_KINDS
)
TASK_STACK = " union all ".join(
    f"select day, vendor, {k!r} as task_type,"
    f" trips * {num(rate / 1000.0)} * {rate_case(k, C.TASK_BAND_MULT, C.TASK_AREA_MULT)} as expected from typed"
    for k, rate in C.TASK_RATE_PER_1K.items()
)
TASK_TARGET = "case task_type when 'battery_swap' then 120 when 'rebalance' then 180 when 'pickup_illegal_parking' then 90 when 'repair' then 1440 end"
STATUS_TARGET = "case event_type when 'battery_low' then 120 when 'rebalance' then 180 when 'offline' then 60 when 'maintenance' then 480 end"
LOAD = """cast(coalesce((select sum(trips) from demand d where d.day = cast({time} as date)
      and d.hour = extract(hour from {time}) and d.service_area_id = e.service_area_id and d.vendor = e.vendor), 0)
      as bigint) as workload_trips_hour"""

OPERATIONS = {
    "incident_features": with_fleet(
        ["incidents"],
        f"""select *, cast(occurred_at as date) as day, cast(extract(hour from occurred_at) as int) as hour,
              {band('extract(hour from occurred_at)')} as hour_band, cast(isodow(occurred_at) - 1 as int) as weekday,
              cast(date_trunc('month', occurred_at) as date) as month,
              cast((epoch_us(resolved_at) - epoch_us(occurred_at)) // 60000000 as int) as resolve_minutes,
              incident_type in ('crash', 'complaint') as trip_related
            from incidents""",
    ),
    "incident_type_mix": with_fleet(
        ["typed"],
        f"""{MIX} select vendor, area_type, cast(extract(month from day) as int) as month, hour, incident_type,
              count(*) as demand_rows, round(avg(p), 8) as probability
            from mix group by 1, 2, 3, 4, 5""",
    ),
    "expected_incidents": with_fleet(
        ["typed"],
        f"""{MIX} select day, vendor, incident_type, round(sum(trips * {BASE_RATE} * p), 10) as expected_incidents
            from mix group by 1, 2, 3""",
    ),
    "incidents_vs_expected": with_fleet(
        ["typed", "incidents"],
        f"""{MIX}, e as (select vendor, cast(date_trunc('month', day) as date) as month, incident_type,
                          sum(trips * {BASE_RATE} * p) as x from mix group by 1, 2, 3),
            o as (select vendor, cast(date_trunc('month', occurred_at) as date) as month, incident_type, count(*) as n
                  from incidents group by 1, 2, 3)
            select vendor, month, incident_type, coalesce(n, 0) as incidents, round(coalesce(x, 0), 10) as expected_incidents,
              round(coalesce(n, 0) / nullif(x, 0), 6) as observed_ratio
            from e full join o using (vendor, month, incident_type)""",
    ),
    "status_sla": with_fleet(
        ["status_changes"],
        f"""select event_id, event_type, handle_minutes, {STATUS_TARGET} as sla_minutes,
              case when handle_minutes <= {STATUS_TARGET} then 1 when handle_minutes > {STATUS_TARGET} then 0 end
                as sla_met_int,
              event_time + interval '1' minute * handle_minutes as handled_at
            from status_changes""",
    ),
    "status_flags": with_fleet(
        ["status_changes"],
        """select event_id, event_type,
             case when event_type in ('offline', 'maintenance') then handle_minutes end as offline_minutes,
             coalesce(event_subtype = 'clear_footpath', false) and event_type = 'rebalance' or event_type = 'retrieval'
               as compliance_flag
           from status_changes""",
    ),
    "active_by_vendor_area": with_fleet(
        ["typed", "vehicles"],
        f""", active as ({ACTIVE})
            select vendor, service_area_id, max(active_vehicles) as active_vehicles, count(*) as demand_rows
            from active group by 1, 2""",
    ),
    "expected_status_events": with_fleet(
        ["typed", "vehicles"],
        f""", active as ({ACTIVE}), means as ({STATUS_STACK})
            select day, vendor, event_type, round(sum(expected), 12) as expected from means group by 1, 2, 3""",
    ),
    "workload_trips_hour": with_fleet(
        ["demand", "incidents"],
        f"select incident_id, vendor, service_area_id, {LOAD.format(time='occurred_at')} from incidents e",
    ),
    "task_workload": with_fleet(
        ["demand", "tasks"],
        f"select task_id, vendor, service_area_id, {LOAD.format(time='created_at')} from tasks e",
    ),
    "task_candidates": with_fleet(
        ["incidents", "status_changes"],
        """select 'pickup_illegal_parking' as task_type, vendor, service_area_id, occurred_at,
             incident_id as linked_incident_id, cast(null as bigint) as linked_event_id, 'incident_link' as source
           from incidents where incident_type = 'illegal_parking'
           union all
           select 'repair', vendor, service_area_id, occurred_at, incident_id, null, 'incident_link'
           from incidents where incident_type in ('crash', 'vandalism')
           union all
           select 'battery_swap', vendor, service_area_id, event_time, null, event_id, 'incident_link'
           from status_changes where event_type = 'battery_low'
           union all
           select 'rebalance', vendor, service_area_id, event_time, null, event_id, 'incident_link'
           from status_changes where event_type = 'rebalance'""",
    ),
    "task_timeline": with_fleet(
        ["tasks"],
        f"""select task_id, status,
              case when status <> 'open' then created_at + interval '1' minute * response_minutes end as assigned_at,
              case when status = 'done' then created_at + interval '1' minute * (response_minutes + work_minutes) end
                as completed_at,
              created_at + interval '1' minute * ({TASK_TARGET}) as deadline_at,
              case when status <> 'open' then response_minutes end as response_minutes,
              case when status = 'done' then work_minutes end as work_minutes,
              case when status = 'done' then response_minutes + work_minutes end as total_minutes
            from tasks""",
    ),
    "task_sla": with_fleet(
        ["tasks"],
        f"""select task_id, task_type, status, {TASK_TARGET} as sla_target_min,
              case when status = 'done' then case when response_minutes + work_minutes <= {TASK_TARGET} then 1 else 0 end
              end as sla_met_int
            from tasks""",
    ),
    "task_priority": with_fleet(
        ["tasks"],
        """select task_id, task_type, case when task_type = 'pickup_illegal_parking' then 1
             when task_type = 'repair' and extract(hour from created_at) >= 16 then 1 else 2 end as priority
           from tasks""",
    ),
    "task_cost": with_fleet(
        ["tasks"],
        """select task_id, task_type, move_km, case task_type when 'battery_swap' then (60 + 8*move_km)/10e0
             when 'rebalance' then (50 + 6*move_km)/10e0 when 'pickup_illegal_parking' then (70 + 10*move_km)/10e0
             when 'repair' then (80 + 5*move_km)/10e0 else 3e0 end as cost_usd
           from tasks""",
    ),
    "expected_tasks": with_fleet(
        ["typed"],
        f""", means as ({TASK_STACK})
            select day, vendor, task_type, round(sum(expected), 12) as expected from means group by 1, 2, 3""",
    ),
    "task_linkage": with_fleet(
        ["tasks", "incidents", "status_changes"],
        """, caused as (
              select *, case when linked_incident_id is null and task_id % 3 = 0 then task_id % 1500 end as linked_event_id from tasks)
           select task_id, linked_incident_id, incident_type, linked_event_id, event_type,
             coalesce(occurred_at, event_time) as cause_at,
             cast(floor((epoch_us(created_at) - epoch_us(coalesce(occurred_at, event_time))) / 60000000e0) as int) as minutes_to_task
           from caused left join incidents on linked_incident_id = incident_id left join status_changes on linked_event_id = event_id""",
    ),
    "linked_tasks": with_fleet(
        ["tasks", "incidents"],
        """select task_id, task_type, vendor from tasks
           where linked_incident_id in (select incident_id from incidents)""",
    ),
    "unlinked_tasks": with_fleet(
        ["tasks", "incidents"],
        """select task_id, task_type, vendor from tasks
           where not exists (select 1 from incidents where incident_id = linked_incident_id)""",
    ),
    "vehicle_features": with_fleet(
        ["vehicles", "trips_canon"],
        f""", w as (select cast(max(started_at) as date) as last_day, avg(distance_m)/1000 as km from trips_canon),
            v as (select *, greatest(1, cast(coalesce(decommissioned_at, last_day) - in_service_since as int)) as d,
                    odometer_km / km as n, {case_of('vendor', C.ENERGY_PER_TRIP_WH, C.DEFAULT_ENERGY_PER_TRIP_WH)} as wh
                  from vehicles cross join w)
            select vehicle_id, d as days_in_service, round(n, 4) as est_trips,
              cast(floor(n / d * wh) as int) as est_daily_energy_wh,
              cast(floor(n * wh / greatest(1, battery_wh)) as int) as battery_cycles_est
            from v""",
    ),
    "trip_cost": with_fleet(
        ["trips_canon", "pricing"],
        """select trip_id, t.vendor, started_at, duration_s, distance_m,
             round(base_fare + per_minute * duration_s / 60 + per_km * distance_m / 1000, 6) as trip_cost
           from trips_canon t left join pricing p
             on t.vendor = p.vendor and cast(started_at as date) between start_date and end_date""",
    ),
    "trip_cost_by_vendor_month": with_fleet(
        ["trips_canon", "pricing"],
        """select t.vendor, cast(date_trunc('month', started_at) as date) as month, count(base_fare) as trips,
             count(*) - count(base_fare) as unpriced_trips,
             round(sum(base_fare + per_minute * duration_s / 60 + per_km * distance_m / 1000), 6) as revenue
           from trips_canon t left join pricing p
             on t.vendor = p.vendor and cast(started_at as date) between start_date and end_date
           where started_at is not null and t.vendor is not null and duration_s is not null and distance_m is not null group by 1, 2""",
    ),
}
