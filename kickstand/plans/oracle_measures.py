"""Oracle SQL of the report measures."""

from kickstand.plans.oracle_operations import STATUS_TARGET, TASK_TARGET
from kickstand.plans.oracle_parts import half_up, with_fleet

TRIPS = """
    select vendor, cast(date_trunc('month', day) as date) as month, cast(sum(trips) as bigint) as trips
    from demand group by 1, 2"""
COSTED = """
    select *, case task_type when 'battery_swap' then 60 + 8*move_km when 'rebalance' then 50 + 6*move_km
        when 'pickup_illegal_parking' then 70 + 10*move_km when 'repair' then 80 + 5*move_km else 30 end as ops_tenths,
      cast(date_trunc('month', created_at) as date) as month, cast(extract(hour from created_at) as int) as hour
    from tasks"""
RATED = f"""
    select *, case when status = 'done' then case when response_minutes + work_minutes <= {TASK_TARGET} then 1 else 0 end
      end as met from tasks"""
COST = "sum(ops_tenths + 10*parts_cost_usd)/10e0"


def rate(num, den, scale):
    return f"round(cast({num} as double)/nullif({den}, 0)*{scale}, 4)"


def per_1k(table, time, name):
    return with_fleet(
        ["demand", table],
        f""", t as ({TRIPS}),
            n as (select vendor, cast(date_trunc('month', {time}) as date) as month, count(*) as n from {table} group by 1, 2)
            select vendor, month, coalesce(n, 0) as {name}s, coalesce(trips, 0) as trips,
              {rate('coalesce(n, 0)', 'trips', 1000)} as {name}s_per_1k
            from t full join n using (vendor, month)""",
    )


def load_by_area(table, id_col, time, minutes):
    return with_fleet(
        ["demand", table],
        f""", e as (select x.vendor, x.service_area_id, {minutes} as m, coalesce(trips, 0) as load
                   from {table} x left join demand d on d.day = cast({time} as date)
                     and d.hour = extract(hour from {time}) and d.service_area_id = x.service_area_id
                     and d.vendor = x.vendor)
            select vendor, service_area_id, count(*) as events, {half_up('sum(load)', 1, 'count(*)', 4)} as avg_workload,
              {half_up('sum(m)', 1, 'count(m)', 4)} as avg_handle_minutes
            from e group by 1, 2""",
    )


HEAT = """
    select hour, area_type, cast(sum(trips) as bigint) as trips from typed group by 1, 2"""

MEASURES = {
    "trips_by_vendor_month": with_fleet(
        ["demand"],
        f""", t as ({TRIPS})
            select month, vendor, trips,
              round(cast(trips as double)/sum(trips) over (partition by month), 4) as vendor_share from t""",
    ),
    "incidents_per_1k_trips": per_1k("incidents", "occurred_at", "incident"),
    "tasks_per_1k_trips": per_1k("tasks", "created_at", "task"),
    "sla_pct_tasks": with_fleet(
        ["tasks"],
        f""", r as ({RATED})
            select vendor, task_type, count(met) as rated_tasks, round(avg(met), 4) as sla_pct from r group by 1, 2""",
    ),
    "sla_pct_status": with_fleet(
        ["status_changes"],
        f"""select event_type, count(*) as events,
              round(avg(case when handle_minutes <= {STATUS_TARGET} then 1 when handle_minutes > {STATUS_TARGET} then 0 end), 4)
                as sla_pct,
              {half_up('sum(handle_minutes)', 1, 'count(handle_minutes)')} as avg_handle_minutes
            from status_changes group by 1""",
    ),
    "sla_matrix": with_fleet(
        ["tasks", "status_changes", "service_areas"],
        f""", r as ({RATED}),
            t as (select vendor, area_type, count(met) as n, sum(met) as met
                  from r left join service_areas using (service_area_id) group by 1, 2),
            s as (select vendor, area_type, count(handle_minutes) as n, sum(handle_minutes) as m
                  from status_changes left join service_areas using (service_area_id) group by 1, 2)
            select vendor, area_type, coalesce(t.n, 0) as rated_tasks, round(cast(t.met as double)/nullif(t.n, 0), 4) as sla_pct,
              {half_up('s.m', 1, 's.n')} as avg_handle_minutes
            from t full join s using (vendor, area_type)""",
    ),
    "task_cost_total": with_fleet(
        ["tasks"],
        f""", c as ({COSTED})
            select vendor, month, sum(ops_tenths)/10e0 as ops_cost, cast(sum(parts_cost_usd) as double) as parts_cost,
              {COST} as task_cost from c group by 1, 2""",
    ),
    "risk_vs_spend": with_fleet(
        ["demand", "incidents", "tasks"],
        f""", c as ({COSTED}), t as (select vendor, cast(sum(trips) as bigint) as trips from demand group by 1),
            i as (select vendor, count(*) as incidents from incidents group by 1),
            k as (select vendor, {COST} as task_cost from c group by 1)
            select vendor, trips, incidents, task_cost, {rate('incidents', 'trips', 1000)} as incidents_per_1k,
              {rate('task_cost', 'trips', 1000)} as cost_per_1k
            from t join i using (vendor) join k using (vendor)""",
    ),
    "cost_heatmap": with_fleet(
        ["incidents", "tasks", "service_areas"],
        f""", c as ({COSTED}),
            k as (select hour, area_type, {COST} as x from c left join service_areas using (service_area_id) group by 1, 2),
            i as (select cast(extract(hour from occurred_at) as int) as hour, area_type, cast(sum(cost_usd) as double) as x
                  from incidents left join service_areas using (service_area_id) group by 1, 2)
            select hour, area_type, coalesce(k.x, 0) as cost_tasks, coalesce(i.x, 0) as cost_incidents,
              round(coalesce(k.x, 0) + coalesce(i.x, 0), 2) as cost_total
            from k full join i using (hour, area_type)""",
    ),
    "trips_heatmap": with_fleet(
        ["typed"],
        f""", h as ({HEAT})
            select hour, area_type, trips,
              round(cast(trips as double)/max(trips) over (partition by area_type), 4) as share_of_peak from h""",
    ),
    "trips_heatmap_wide": with_fleet(
        ["typed"],
        "select hour, "
        + ", ".join(
            f"cast(coalesce(sum(trips) filter (area_type = '{a}'), 0) as bigint) as {a}"
            for a in ("downtown", "campus", "industrial", "residential")
        )
        + " from typed group by 1",
    ),
    "incident_summary": with_fleet(
        ["incidents"],
        """, m as (select *, (epoch_us(resolved_at) - epoch_us(occurred_at)) // 60000000 as minutes from incidents)
           select incident_type, vendor, count(*) as incidents, round(quantile_cont(minutes, 0.5), 4) as p50_resolve_minutes,
             round(quantile_cont(minutes, 0.9), 4) as p90_resolve_minutes, cast(sum(cost_usd) as double) as cost_usd
           from m group by 1, 2""",
    ),
    "cost_waterfall": with_fleet(
        ["incidents"],
        """, c as (select incident_type, count(*) as incidents, sum(cost_usd) as x from incidents group by 1)
           select incident_type, incidents, cast(x as double) as cost_usd,
             cast(sum(x) over (order by x desc, incident_type rows unbounded preceding) as double) as running_cost from c""",
    ),
    "load_vs_handle": load_by_area("status_changes", "event_id", "event_time", "handle_minutes"),
    "load_vs_resolution": load_by_area(
        "incidents", "incident_id", "occurred_at", "(epoch_us(resolved_at) - epoch_us(occurred_at)) // 60000000"
    ),
    "vendor_monthly": with_fleet(
        ["demand", "incidents", "tasks"],
        f""", c as ({COSTED}), t as ({TRIPS}),
            i as (select vendor, cast(date_trunc('month', occurred_at) as date) as month, sum(cost_usd) as x
                  from incidents group by 1, 2),
            k as (select vendor, month, {COST} as x from c group by 1, 2)
            select month, vendor, coalesce(trips, 0) as trips, cast(coalesce(i.x, 0) as double) as cost_incidents,
              coalesce(k.x, 0) as cost_tasks
            from t full join i using (vendor, month) full join k using (vendor, month)""",
    ),
    "task_funnel": with_fleet(
        ["tasks"],
        f""", c as ({COSTED})
            select task_type, vendor, count(*) as created, count(*) filter (status = 'open') as open,
              count(*) filter (status <> 'open') as assigned, count(*) filter (status = 'done') as done,
              count(*) filter (status = 'canceled') as canceled,
              {half_up("sum(response_minutes) filter (status <> 'open')", 1, "count(*) filter (status <> 'open')")}
                as avg_response_minutes,
              {half_up('sum(ops_tenths + 10*parts_cost_usd)', 10, 'count(*)')} as avg_cost
            from c group by 1, 2""",
    ),
    "measures_cube": with_fleet(
        ["tasks"],
        f""", r as ({RATED})
            select vendor, task_type, cast(grouping(vendor) as int) as vendor_all, cast(grouping(task_type) as int) as task_type_all,
              count(*) as tasks, count(met) as rated_tasks, cast(coalesce(sum(met), 0) as bigint) as sla_met,
              cast(sum(parts_cost_usd) as bigint) as parts_cost
            from r group by cube (vendor, task_type)""",
    ),
    "fleet_mix": with_fleet(
        ["vehicles"],
        """, c as (select vendor, status, battery_wh, count(*) as vehicles from vehicles group by 1, 2, 3)
           select *, round(cast(vehicles as double)/sum(vehicles) over (partition by vendor), 4) as share from c""",
    ),
    "odometer_distribution": with_fleet(
        ["vehicles"],
        "select vendor, odometer_km // 1000 * 1000 as bucket_km, count(*) as vehicles from vehicles group by 1, 2",
    ),
    "incidents_per_10k_km": with_fleet(
        ["vehicles", "incidents"],
        f""", i as (select vehicle_id, count(*) as n from incidents group by 1)
            select vendor, battery_wh, count(*) as vehicles, cast(sum(odometer_km) as bigint) as km,
              cast(coalesce(sum(n), 0) as bigint) as incidents,
              {rate('coalesce(sum(n), 0)', 'sum(odometer_km)', 10000)} as incidents_per_10k_km
            from vehicles left join i using (vehicle_id) group by 1, 2""",
    ),
    "vehicle_drill_through": with_fleet(
        ["vehicles", "incidents", "status_changes"],
        """, i as (select vehicle_id, count(*) as n, max(occurred_at) as last from incidents group by 1),
           s as (select vehicle_id, count(*) as n, sum(handle_minutes) as m, max(event_time) as last
                 from status_changes group by 1)
           select vehicle_id, vendor, status, coalesce(i.n, 0) as incidents, coalesce(s.n, 0) as status_events,
             cast(coalesce(m, 0) as bigint) as handled_minutes, greatest(i.last, s.last) as last_event_at
           from vehicles left join i using (vehicle_id) left join s using (vehicle_id)""",
    ),
    "events_count": with_fleet(
        ["incidents", "status_changes", "tasks"],
        """, u as (select cast(occurred_at as date) as day, vendor, 'i' as k from incidents
                   union all select cast(event_time as date), vendor, 's' from status_changes
                   union all select cast(created_at as date), vendor, 't' from tasks)
           select day, vendor, count(*) filter (k = 'i') as incidents, count(*) filter (k = 's') as status_events,
             count(*) filter (k = 't') as tasks
           from u group by 1, 2""",
    ),
}
