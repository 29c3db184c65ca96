"""Oracle SQL of stored views, states that roll up, trends, best-in-class sets and alerts."""

from kickstand.plans.oracle_calibration import CALIBRATION
from kickstand.plans.oracle_measures import COSTED, MEASURES
from kickstand.plans.oracle_operations import ACTIVE, STATUS_STACK, TASK_STACK
from kickstand.plans.oracle_parts import band, half_up, with_fleet

MONTH = "cast(date_trunc('month', {}) as date)"


def observed(table, stack, kind, time, needs):
    active = f", active as ({ACTIVE})" if "vehicles" in needs else ""
    return with_fleet(
        ["typed", table, *needs],
        f"""{active}, means as ({stack}),
            e as (select vendor, {MONTH.format('day')} as month, {kind}, sum(expected) as x from means group by 1, 2, 3),
            o as (select vendor, {MONTH.format(time)} as month, {kind}, count(*) as n from {table} group by 1, 2, 3)
            select vendor, month, {kind}, coalesce(n, 0) as events, round(coalesce(x, 0), 12) as expected,
              round(coalesce(n, 0) / nullif(x, 0), 6) as observed_ratio
            from e full join o using (vendor, month, {kind})""",
    )


INSIGHTS = {
    "monthly_view_refreshed": with_fleet(
        ["demand", "incidents", "tasks"],
        f""", rows as (
              select {MONTH.format('day')} as month, vendor, trips, 0 as i, 0 as ic, 0 as k, 0 as kc from demand
              union all
              select {MONTH.format('occurred_at')}, vendor, 0, 1, cost_usd, 0, 0 from incidents
              union all
              select month, vendor, 0, 0, 0, 1, ops_tenths + 10*parts_cost_usd from ({COSTED}))
            select month, vendor, cast(sum(trips) as bigint) as trips, cast(sum(i) as bigint) as incidents,
              cast(sum(ic) as double) as cost_incidents, cast(sum(k) as bigint) as tasks, sum(kc)/10e0 as cost_tasks
            from rows group by 1, 2""",
    ),
    "service_distinct_rollup": with_fleet(
        ["status_changes"],
        """, e as (select cast(event_time as date) as day, vehicle_id from status_changes where event_type = 'maintenance_pickup'),
            g as (select 'day' as grain, day as start, vehicle_id from e
                  union all select 'week', day - cast(isodow(day) - 1 as int), vehicle_id from e
                  union all select 'month', cast(date_trunc('month', day) as date), vehicle_id from e)
           select grain, start, count(*) as events, count(distinct vehicle_id) as vehicles, true as within_error
           from g group by 1, 2""",
    ),
    "distance_quantile_rollup": with_fleet(
        ["trips_canon"],
        f"""select {MONTH.format('started_at')} as month, vendor, count(*) as trips, true as p50_rank_holds, true as p90_rank_holds
            from trips_canon where started_at is not null and distance_m is not null group by 1, 2""",
    ),
    "incidents_cube": with_fleet(
        ["incidents"],
        f""", timed as (select *, cast(floor((epoch_us(resolved_at) - epoch_us(occurred_at)) / 60000000e0) as int) as m from incidents)
            select vendor, incident_type, severity, cast(grouping(vendor) as int) as vendor_all,
              cast(grouping(incident_type) as int) as incident_type_all, cast(grouping(severity) as int) as severity_all,
              count(*) as incidents, cast(sum(cost_usd) as bigint) as cost_usd,
              {half_up('sum(cost_usd)', 1, 'count(cost_usd)')} as avg_cost_usd, count(distinct vehicle_id) as vehicles,
              round(quantile_cont(m, 0.5), 4) as p50_resolve_minutes, round(quantile_cont(m, 0.9), 4) as p90_resolve_minutes
            from timed group by cube (vendor, incident_type, severity)""",
    ),
    "revenue_by_precedence": with_fleet(
        ["trips_canon", "pricing"],
        f""", policies as (
              select vendor, start_date, end_date, base_fare, per_minute, per_km from pricing where extract(month from start_date) % 3 <> 0
              union all
              select vendor, min(start_date), null, 0.5e0, 0.25e0, 0.125e0 from pricing group by vendor
              union all
              select vendor, cast(start_date + interval '9' day as date), cast(start_date + interval '45' day as date), 2e0, 0e0, 0e0
              from pricing where extract(month from start_date) % 2 = 0),
            daily as (select vendor, cast(started_at as date) as day, count(*) as n, sum(duration_s) as s, sum(distance_m) as m
                      from trips_canon
                      where started_at is not null and vendor is not null and duration_s is not null and distance_m is not null
                      group by 1, 2),
            priced as (select d.*, base_fare, per_minute, per_km
                       from daily d left join policies p on d.vendor = p.vendor and day >= start_date and day <= coalesce(end_date, date '2100-12-31')
                       qualify row_number() over (partition by d.vendor, day order by start_date desc, end_date nulls last, base_fare) = 1)
            select vendor, {MONTH.format('day')} as month, cast(coalesce(sum(n) filter (base_fare is not null), 0) as bigint) as trips,
              cast(coalesce(sum(n) filter (base_fare is null), 0) as bigint) as unpriced_trips,
              round(sum(base_fare*n + per_minute*s/60 + per_km*m/1000), 8) as revenue
            from priced group by 1, 2""",
    ),
    # the normal equations of each vendor's points, in whole ten-thousandths
    "handle_trend": f"""
        with points as ({MEASURES['load_vs_handle']}),
        whole as (select *, cast(round(avg_workload*10000) as hugeint) as x, cast(round(avg_handle_minutes*10000) as hugeint) as y
                  from points),
        sums as (select vendor, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x*x) as sxx, sum(x*y) as sxy, sum(y*y) as syy
                 from whole where x is not null and y is not null group by vendor),
        lines as (select vendor, n, sx, sy, cast(n*sxx - sx*sx as double) as dx, cast(n*sxy - sx*sy as double) as dxy,
                    cast(n*syy - sy*sy as double) as dy from sums where n >= 3),
        fitted as (select *, dxy / nullif(dx, 0) as slope from lines),
        drawn as (select *, (sy - slope*sx)/n/10000 as intercept, sqrt(greatest(0, dy - slope*dxy)/n/(n - 2)) as sigma from fitted)
        select p.vendor, service_area_id, events, avg_workload, avg_handle_minutes, round(slope, 6) as slope,
          round(intercept, 4) as intercept, round(avg_handle_minutes - (intercept + slope*avg_workload), 4) as residual,
          coalesce((avg_handle_minutes - (intercept + slope*avg_workload))*10000 > 2*sigma, false) as above_trend
        from points p left join drawn d on p.vendor is not distinct from d.vendor""",
    "best_in_class": with_fleet(
        ["demand", "incidents", "tasks"],
        f""", sums as (
              select vendor, service_area_id, cast(sum(trips) as bigint) as trips, sum(i) as i, sum(c) as c
              from (select vendor, service_area_id, trips, 0 as i, 0 as c from demand
                    union all select vendor, service_area_id, 0, 1, 0 from incidents
                    union all select vendor, service_area_id, 0, 0, 10*ops_tenths + 100*parts_cost_usd from ({COSTED}))
              group by 1, 2),
            p as (select vendor, service_area_id, trips, {half_up('1000*i', 1, 'trips', 4)} as incidents_per_1k,
                    {half_up('10*c', 1, 'trips', 4)} as cost_per_1k from sums)
            select * from p
            where incidents_per_1k is not null and cost_per_1k is not null and not exists (
              select 1 from p q where q.incidents_per_1k <= p.incidents_per_1k and q.cost_per_1k <= p.cost_per_1k
                and (q.incidents_per_1k < p.incidents_per_1k or q.cost_per_1k < p.cost_per_1k))""",
    ),
    "demand_alerts": f"""
        with compared as ({CALIBRATION['demand_vs_expected']}),
        gaps as (select *, {band('hour')} as band, trips*10000 - cast(round(expected_trips*10000) as bigint) as gap
                 from compared where expected_trips is not null),
        middle as (select vendor, band, cast(2*median(gap) as bigint) as m from gaps group by 1, 2),
        away as (select vendor, band, cast(2*median(abs(2*gap - m)) as bigint) as d from gaps join middle using (vendor, band) group by 1, 2)
        select day, hour, service_area_id, vendor, trips, round(expected_trips, 4) as expected_trips, m/20000e0 as median_gap,
          d/40000e0 as median_distance
        from gaps join middle using (vendor, band) join away using (vendor, band)
        where (2*gap - m)*20000 > 3*14826*d""",
    "vehicles_out_by_hour": with_fleet(
        ["status_changes"],
        """, moves as (
              select event_time as moved, event_type = 'maintenance_pickup' as leaves,
                lag(event_type = 'maintenance_pickup') over (partition by vehicle_id order by event_time, event_id) as left_before
              from status_changes
              where event_type in ('maintenance_pickup', 'maintenance_dropoff') and vehicle_id is not null),
            edges as (select cast(moved as date) as day, cast(extract(hour from moved) as int) as hour, leaves from moves
                      where leaves and not coalesce(left_before, false) or not leaves and left_before),
            hours as (select day, hour, count(*) filter (leaves) as o, count(*) filter (not leaves) as b from edges group by 1, 2),
            spine as (select cast(unnest(generate_series(min(day), max(day), interval '1' day)) as date) as day from edges),
            grid as (select day, cast(unnest(range(24)) as int) as hour from spine),
            swept as (select g.day, g.hour, coalesce(o, 0) as o, coalesce(b, 0) as b,
                        sum(coalesce(o, 0) - coalesce(b, 0)) over (order by g.day, g.hour) as out
                      from grid g left join hours h on g.day = h.day and g.hour = h.hour)
           select day, hour, cast(out - o + b as bigint) as out_at_start, o as went_out, b as came_back, cast(out as bigint) as out_at_end
           from swept""",
    ),
    "status_vs_expected": observed("status_changes", STATUS_STACK, "event_type", "event_time", ["vehicles"]),
    "tasks_vs_expected": observed("tasks", TASK_STACK, "task_type", "created_at", []),
}
