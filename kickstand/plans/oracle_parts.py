"""SQL pieces shared by the oracles: fleet tables as CTEs, demand, lookups as CASE expressions."""

from kickstand import constants as C
from kickstand.sources.fixtures import PRICING_SQL, SELECTS

DEMAND = """
    select cast(started_at as date) as day, cast(extract(hour from started_at) as int) as hour, service_area_id,
      coalesce(vendor, 'Coco') as vendor, count(*) as trips
    from trips_canon where started_at is not null group by 1, 2, 3, 4"""

TYPED = """
    select d.*, a.community_area_name, a.area_type from demand d left join service_areas a using (service_area_id)"""

CANON = """
    select case lower(regexp_replace(coalesce(provider_name, ''), '[^A-Za-z0-9]', '', 'g'))
             when 'lyft' then 'Lyft' when 'lime' then 'Lime' when 'spin' then 'Spin' when 'superpedestrian' then 'Spin'
             else 'Coco' end as vendor,
      try_cast(start_time as timestamp) as started_at,
      case when trim(coalesce(start_community_area_name, '')) <> '' then trim(start_community_area_name)
           when trim(coalesce(end_community_area_name, '')) <> '' then trim(end_community_area_name) end as area_name,
      cast(trip_distance as int) as distance_m
    from trips_raw where try_cast(start_time as timestamp) is not null"""

DERIVED = {
    "demand": (["trips_canon"], DEMAND),
    "typed": (["demand", "service_areas"], TYPED),
    "canon": (["trips_raw"], CANON),
    "pricing": (["incidents"], PRICING_SQL),
    "vendors": ([], "select unnest(['Lyft', 'Lime', 'Spin', 'Coco']) as vendor"),
}


def with_fleet(tables, body):
    """SQL with the named tables as CTEs; a body that starts with a comma adds CTEs of its own."""
    ordered = {}

    def add(name):
        needs, text = DERIVED.get(name, ([], None))
        for need in needs:
            add(need)
        ordered.setdefault(name, text or SELECTS[name])

    for table in tables:
        add(table)
    return "with " + ",\n".join(f"{n} as ({text})" for n, text in ordered.items()) + "\n" + body


def num(value):
    """A number as a DOUBLE literal."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def case_of(col, table, default=None):
    whens = " ".join(
        f"when {key if isinstance(key, int) else repr(key)} then {num(value)}" for key, value in table.items()
    )
    return f"(case {col} {whens}" + (f" else {num(default)}" if default is not None else "") + " end)"


def band(hour):
    return (
        f"(case when {hour} <= 5 then 'late_night' when {hour} <= 9 then 'morning' when {hour} <= 15 then 'midday'"
        f" when {hour} <= 19 then 'evening' else 'night' end)"
    )


def rate_case(kind, band_mult, area_mult):
    """Band, area-type and vendor multiplier of one type on a demand row."""
    return (
        f"{case_of(band('hour'), band_mult[kind])} * {case_of('area_type', area_mult[kind], 1.0)}"
        f" * {case_of('vendor', C.VENDOR_INTENSITY, 1.0)}"
    )


def floor_of(vendor="vendor"):
    return case_of(vendor, C.VENDOR_SHARE_FLOORS, 0.0)


def half_up(total, unit, rows, places=2):
    """total / (unit * rows) at `places`, half up, in integers."""
    power = 10**places
    return (
        f"(cast((2*{power}*cast({total} as hugeint) + {unit}*cast({rows} as hugeint))"
        f" // nullif(2*{unit}*cast({rows} as hugeint), 0) as double)/{power})"
    )
