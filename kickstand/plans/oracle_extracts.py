"""Oracle SQL of the trip, maintenance and incident extracts, written from what their columns mean."""

from kickstand.plans.oracle_parts import half_up, with_fleet

QUALITY = """duration_s is not null and duration_s > 60 and distance_m is not null and distance_m > 0
    and distance_m <= 20000 and 36*cast(distance_m as bigint)
      between 10*{lo}*cast(duration_s as bigint) and 10*{hi}*cast(duration_s as bigint)"""


EXTRACTS = {
    # one pass of grouping sets gives the vendor rows and, with the vendor rolled up, the day's total
    "daily_trips_by_vendor": with_fleet(
        ["trips_canon"],
        """, sums as (
             select cast(started_at as date) as day, vendor, grouping(vendor) as whole_day, count(*) as trips
             from trips_canon where started_at is not null and vendor is not null
             group by grouping sets ((1, vendor), (1)))
           select part.day, part.vendor, part.trips, whole.trips as total_trips,
             round(cast(part.trips as double) / whole.trips, 4) as vendor_share
           from sums part, sums whole
           where part.day = whole.day and part.whole_day = 0 and whole.whole_day = 1""",
    ),
    "avg_trips_by_vendor": with_fleet(
        ["trips_canon"],
        f""", clean as (select vendor, cast(started_at as date) as day, duration_s, distance_m from trips_canon
                        where {QUALITY.format(lo=3, hi=35)})
            select vendor, day, count(*) as trips,
              {half_up('sum(duration_s)', 60, 'count(*)')} as avg_duration_min,
              {half_up('sum(distance_m)', 1000, 'count(*)')} as avg_distance_km,
              round(quantile_cont(distance_m/1000.0, 0.5), 4) as p50_km,
              round(quantile_cont(distance_m/1000.0, 0.9), 4) as p90_km
            from clean group by vendor, day""",
    ),
    # windows over the hourly rows; the total of the day also has the trips without a vendor
    "hourly_demand_by_vendor": with_fleet(
        ["trips_canon"],
        f""", hours as (
              select cast(started_at as date) as day, vendor, cast(date_part('hour', started_at) as int) as hour,
                count(*) as trips
              from trips_canon where {QUALITY.format(lo=5, hi=30)} group by all),
            summed as (
              select *, cast(sum(trips) over (partition by day, vendor) as bigint) as vendor_day_total,
                cast(sum(trips) over (partition by day) as bigint) as day_total
              from hours)
            select day, vendor, hour, trips, vendor_day_total, day_total,
              round(cast(trips as double) / vendor_day_total, 4) as share_within_vendor_day,
              round(cast(trips as double) / day_total, 4) as share_within_day
            from summed where day is not null and vendor is not null""",
    ),
    "service_events_per_day": with_fleet(
        ["status_changes"],
        """select cast(event_time as date) as day, count(*) as maintenance_events,
             count(distinct vehicle_id) as unique_vehicles
           from status_changes where event_type = 'maintenance_pickup' group by 1""",
    ),
    # a pickup's successor is the smallest (time, id) of its vehicle that is larger than its own
    "avg_downtime_per_vehicle": with_fleet(
        ["status_changes"],
        f""", moves as (
              select vehicle_id, event_type = 'maintenance_pickup' as leaves,
                struct_pack(at := event_time, id := event_id, leaves := event_type = 'maintenance_pickup') as step
              from status_changes
              where event_type in ('maintenance_pickup', 'maintenance_dropoff') and vehicle_id is not null),
            followed as (
              select step.at as left_at,
                min(step) over (partition by vehicle_id order by step.at, step.id
                                rows between 1 following and unbounded following) as back, leaves
              from moves),
            absences as (
              select cast(left_at as date) as day, epoch_us(back.at) - epoch_us(left_at) as us from followed
              where leaves and not back.leaves and back.at > left_at)
            select day, count(*) as maint_pairs,
              {half_up('sum(us)', 3600000000, 'count(*)')} as avg_downtime_h,
              round(quantile_cont(us/3600000000.0, 0.5), 4) as p50_downtime_h,
              round(quantile_cont(us/3600000000.0, 0.9), 4) as p90_downtime_h
            from absences group by day""",
    ),
    "weekly_fleet_maintenance_percent": with_fleet(
        ["status_changes", "vehicles"],
        """select monday as week_start, n as vehicles_in_maintenance, size as fleet_size,
             round(cast(n as double) / size * 100, 2) as pct_fleet_maintenance
           from (select count(distinct vehicle_id) as size from vehicles),
                (select cast(event_time as date) - cast(isodow(event_time) - 1 as int) as monday,
                   count(distinct vehicle_id) as n
                 from status_changes where event_type = 'maintenance_pickup' group by 1)""",
    ),
    "incidents_by_type": with_fleet(
        ["incidents"],
        """select cast(occurred_at as date) as day, incident_type, count(*) as incidents
           from incidents group by 1, 2""",
    ),
}
