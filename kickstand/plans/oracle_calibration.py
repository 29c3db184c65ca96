"""Oracle SQL of the cleaning and calibration queries."""

from kickstand import constants as C
from kickstand.plans.oracle_parts import band, case_of, floor_of, with_fleet

# every vendor of every key with its trips, and the floored share of `w` within the key
FLOORED = """(f + (1 - sum(f) over (partition by {key}))
      * (w / sum(w) over (partition by {key})))"""

MONTH_MIX = f"""
    select month, vendor, coalesce(n, 0) / cast(sum(n) over (partition by month) as double) as w, {floor_of()} as f
    from (select distinct date_trunc('month', day)::date as month from demand) m cross join vendors
    left join (select date_trunc('month', day)::date as month, vendor, sum(trips) as n from demand group by 1, 2) c
      using (month, vendor)"""

HOUR_SHAPE = """
    select hour, coalesce(n, 0) as trips,
      coalesce(n / cast(sum(n) over () as double), 1/24e0)
        / sum(coalesce(n / cast((select sum(trips) from demand) as double), 1/24e0)) over () as weight
    from (select cast(unnest(range(24)) as int) as hour) h
    left join (select hour, sum(trips) as n from demand group by 1) c using (hour)"""

AREA_WEIGHTS = """
    select service_area_id, area_type, coalesce(n, 0) as trips,
      (coalesce(n, 0) + 0.5e0) / sum(coalesce(n, 0) + 0.5e0) over () as weight
    from service_areas left join (select service_area_id, sum(trips) as n from demand group by 1) c using (service_area_id)"""

MONTH_LEVEL = """
    select month, coalesce(n, 0) / avg(n) over () as multiplier
    from (select cast(unnest(range(1, 13)) as int) as month) m
    left join (select cast(extract(month from day) as int) as month, cast(sum(trips) as double) as n
               from demand group by 1) c using (month)"""

BOOST = """
    select (max(case when d = 6 then n else 1 end) + max(case when d = 7 then n else 1 end)) / 2
        / (sum(case when d <= 5 then n end) / 5) as weekend_boost
    from (select isodow(day) as d, cast(sum(trips) as double) as n from demand group by 1)"""

BIAS = (
    "(case vendor "
    + " ".join(f"when {v!r} then {case_of(band('hour'), table)}" for v, table in C.VENDOR_BAND_BIAS.items())
    + " end)"
)
AREA_BIAS = (
    "(case vendor "
    + " ".join(f"when {v!r} then {case_of('area_type', table, 1.0)}" for v, table in C.VENDOR_AREA_BIAS.items())
    + " else 1e0 end)"
)


def expected_steps(least):
    """CTEs up to the shares per month, hour, area type and vendor and the total per day."""
    return f""", mix0 as ({MONTH_MIX}),
      mix as (select month, vendor, {FLOORED.format(key='month')} as share from mix0),
      shape as ({HOUR_SHAPE}), areas as ({AREA_WEIGHTS}), levels as ({MONTH_LEVEL}), boost as ({BOOST}),
      days as (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from demand),
      med as (select median(n) as m from (select sum(trips) as n from demand group by day)),
      totals as (
        select day, cast(date_trunc('month', day) as date) as month, greatest({least}, cast(floor(
            (select m from med) * multiplier
            * case when isodow(day) >= 6 then (select weekend_boost from boost) else 1e0 end) as bigint)) as day_total
        from days join levels on levels.month = extract(month from day)),
      raw as (
        select t.month, h.hour, k.area_type, vendor, coalesce(mix.share, {floor_of()}) * {BIAS} * {AREA_BIAS} as w,
          {floor_of()} as f
        from (select distinct month from totals) t cross join (select hour from shape) h
        cross join (select distinct area_type from service_areas) k cross join vendors
        left join mix using (month, vendor)),
      shares as (select month, hour, area_type, vendor, {FLOORED.format(key='month, hour, area_type')} as share from raw)"""


CALIBRATION = {
    "trips_canon": with_fleet(
        ["canon"],
        """select vendor, cast(started_at as date) as day, cast(extract(hour from started_at) as int) as hour, area_name,
             distance_m, count(*) as trips from canon group by 1, 2, 3, 4, 5""",
    ),
    "vendor_canon": with_fleet(
        ["trips_raw"],
        """select provider_name, count(*) as trips,
             case provider_name when 'LYFT' then 'Lyft' when ' lime ' then 'Lime' when 'Spin' then 'Spin'
               when 'Super-Pedestrian' then 'Spin' else 'Coco' end as vendor
           from trips_raw group by 1""",
    ),
    "area_catalog": with_fleet(
        ["canon"],
        """select cast(row_number() over (order by area_name) as int) as service_area_id, area_name as community_area_name,
             'residential' as area_type, lower(area_name) as area_key, area_name || ', Chicago, IL, USA' as map_location
           from (select distinct area_name from canon where area_name is not null)""",
    ),
    "trips_hourly": with_fleet(["demand"], "select * from demand"),
    "canon_hourly": with_fleet(
        ["canon"],
        """, ids as (select area_name, cast(row_number() over (order by area_name) as int) as service_area_id
                     from (select distinct area_name from canon where area_name is not null))
           select cast(started_at as date) as day, cast(extract(hour from started_at) as int) as hour, service_area_id,
             area_name as community_area_name, vendor, count(*) as trips
           from canon left join ids using (area_name) group by 1, 2, 3, 4, 5""",
    ),
    "demand_shares": with_fleet(
        ["demand"],
        """, h as (select day, hour, cast(sum(trips) as bigint) as dayhour_total from demand group by 1, 2),
           v as (select day, vendor, cast(sum(trips) as bigint) as vendor_day_total from demand group by 1, 2)
           select d.*, dayhour_total, vendor_day_total, cast(trips as double)/dayhour_total as share_within_day_hour,
             cast(trips as double)/vendor_day_total as share_within_vendor_day
           from demand d join h using (day, hour) join v using (day, vendor)""",
    ),
    "with_area_type": with_fleet(["typed"], "select * from typed"),
    "time_features": with_fleet(
        ["incidents"],
        f"""select incident_id, cast(occurred_at as date) as day, cast(extract(hour from occurred_at) as int) as hour,
              {band('extract(hour from occurred_at)')} as hour_band, cast(isodow(occurred_at) - 1 as int) as weekday,
              cast(date_trunc('month', occurred_at) as date) as month
            from incidents""",
    ),
    "vendor_month_mix": with_fleet(
        ["demand", "vendors"],
        f""", m as ({MONTH_MIX})
            select month, vendor, round(w, 12) as raw, round({FLOORED.format(key='month')}, 12) as share from m""",
    ),
    "normalize_with_floors": with_fleet(
        ["typed"],
        f""", m as (select vendor, area_type, cast(sum(trips) as bigint) as trips, cast(sum(trips) as double) as w,
                      {floor_of()} as f from typed group by 1, 2)
            select vendor, area_type, trips, round({FLOORED.format(key='area_type')}, 12) as share from m""",
    ),
    "hour_shape": with_fleet(
        ["demand"],
        f""", s as ({HOUR_SHAPE})
            select hour, cast(trips as bigint) as trips, round(weight, 8) as weight from s""",
    ),
    "area_weights": with_fleet(
        ["demand", "service_areas"],
        f""", w as ({AREA_WEIGHTS})
            select service_area_id, cast(trips as bigint) as trips, round(weight, 8) as weight from w""",
    ),
    "vendor_area_mix": with_fleet(
        ["demand", "service_areas", "vendors"],
        """select service_area_id, vendor, cast(coalesce(n, 0) as bigint) as trips,
             round((coalesce(n, 0) + 0.5e0) / sum(coalesce(n, 0) + 0.5e0) over (partition by vendor), 8) as weight
           from service_areas cross join vendors
           left join (select service_area_id, vendor, sum(trips) as n from demand group by 1, 2) c
             using (service_area_id, vendor)""",
    ),
    "daily_median": with_fleet(
        ["demand"],
        """select cast(coalesce(median(n), 50000) as double) as daily_median
           from (select sum(trips) as n from demand group by day)""",
    ),
    "month_multiplier": with_fleet(
        ["demand"], f", l as ({MONTH_LEVEL}) select month, round(multiplier, 8) as multiplier from l"
    ),
    "weekend_boost": with_fleet(
        ["demand"], f", b as ({BOOST}) select round(weekend_boost, 8) as weekend_boost from b"
    ),
    "vendor_daily_avg": with_fleet(
        ["demand", "vendors"],
        """select vendor, round(coalesce(a, 0e0), 6) as daily_avg from vendors left join
             (select vendor, cast(sum(trips) as double)/count(distinct day) as a from demand group by 1) using (vendor)""",
    ),
    "fleet_sizing": with_fleet(
        ["demand", "vendors"],
        f""", a as (select vendor, cast(sum(trips) as double)/count(distinct day) as a from demand group by 1),
            s as (select vendor, coalesce(a, 0e0) as a, greatest(case when coalesce(a, 0e0) > 0 then 60 else 0 end,
                    cast(ceil(coalesce(a, 0e0) / {case_of('vendor', C.TRIPS_PER_VEHICLE_DAY)}) as bigint)) as n
                  from vendors left join a using (vendor))
            select vendor, round(a, 6) as daily_avg, n as fleet_size,
              case vendor when 'Lyft' then 'LY' when 'Lime' then 'LI' when 'Spin' then 'SP' else 'CO' end
                || lpad(cast(n as varchar), 5, '0') as last_vehicle_id
            from s""",
    ),
    "avg_trip_km": with_fleet(
        ["trips_canon"], "select round(coalesce(avg(distance_m)/1000, 1.9e0), 6) as avg_trip_km from trips_canon"
    ),
    "expected_demand": with_fleet(
        ["demand", "service_areas", "vendors"],
        f"""{expected_steps(C.MIN_CITY_TRIPS)}
            select month, hour, vendor, count(*) as cells,
              round(sum(day_total * areas.weight * shape.weight * share), 4) as expected_trips
            from totals cross join areas cross join shape join shares using (month, hour, area_type)
            group by month, hour, vendor""",
    ),
    "demand_vs_expected": with_fleet(
        ["demand", "service_areas", "vendors"],
        f"""{expected_steps(1)}
            select d.day, d.hour, d.service_area_id, d.vendor, d.trips,
              round(day_total * areas.weight * shape.weight * share, 10) as expected_trips,
              round(d.trips / (day_total * areas.weight * shape.weight * share), 6) as observed_ratio
            from demand d join totals using (day) join areas using (service_area_id) join shape using (hour)
            join shares on shares.month = totals.month and shares.hour = d.hour
              and shares.area_type = areas.area_type and shares.vendor = d.vendor""",
    ),
}
