"""Scalar Column expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from kickstand import constants as C


def as_col(value):
    return value if isinstance(value, Column) else F.col(value)


# --- lookups ----------------------------------------------------------------------


def _literal(value):
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def lookup(key, table, default=None):
    """Value of a small fixed table for a key column; `default` for an unknown or NULL key."""
    # one literal map, which Catalyst folds; as text it costs one call instead of one per entry
    literal = F.expr("map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items()) + ")")
    found = F.try_element_at(literal, as_col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def month_lookup(month, values):
    """Value for a month number 1..12 from a January-to-December list."""
    return lookup(month, dict(enumerate(values, start=1)), 1.0)


# --- text -------------------------------------------------------------------------


def norm_text(text):
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(as_col(text)), r"[^\p{L}\p{N}]", "")


def blank_to_null(text):
    trimmed = F.trim(as_col(text))
    return F.nullif(trimmed, F.lit(""))


def first_text(*texts):
    """First argument that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def vendor_canon(vendor, vendor_map=None, fallback=C.FALLBACK_VENDOR):
    """Canonical vendor name; unknown and NULL names become `fallback`.

    Most names are canonical already or differ by case and blanks; only the rest pays for a regular
    expression.
    """
    vendor, aliases = as_col(vendor), vendor_map or C.VENDOR_ALIASES
    canonical = sorted({name for name in aliases.values() if aliases.get(name.lower()) == name})
    found = F.coalesce(lookup(F.lower(F.trim(vendor)), aliases), lookup(norm_text(vendor), aliases, fallback))
    return F.when(vendor.isin(*canonical), vendor).otherwise(found) if canonical else found


def vendor_code(vendor):
    """Two-letter code of a vendor; its first two letters when it is not a known one."""
    vendor = as_col(vendor)
    return F.coalesce(lookup(vendor, C.VENDOR_CODES), F.upper(F.substring(vendor, 1, 2)))


def vehicle_code(vendor, number):
    return F.concat(vendor_code(vendor), F.format_string("%05d", as_col(number)))


def map_location(area_name):
    return F.concat(as_col(area_name), F.lit(C.LOCATION_SUFFIX))


# --- time -------------------------------------------------------------------------


def parse_time(text):
    """Naive timestamp from text in ISO or US month-first form; NULL when it is neither."""
    text = F.trim(as_col(text))
    # one letter reads one or two digits, so 7/1/2024 8:05 and 07/01/2024 08:05 are the same time
    us_forms = ["M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy"]
    parsed = [F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz") for form in us_forms]
    return F.coalesce(text.try_cast("timestamp_ntz"), *parsed)


def time_column(df, given=None, names=("occurred_at", "event_time")):
    """Name of the time column of an event table: the given one, else the first of `names` that it has."""
    if given is not None:
        return given
    found = [n for n in names if n in df.columns]
    if not found:
        raise ValueError(f"no time column: none of {list(names)} among {df.columns}")
    return found[0]


def week_start(day):
    """Monday of the week."""
    day = as_col(day)
    return F.date_sub(day, F.weekday(day))


def month_start(day):
    return F.trunc(as_col(day), "month")


def month_key(day):
    return F.date_format(as_col(day), "yyyy-MM")


def hour_band(hour):
    hour = as_col(hour)
    band = None
    for name, last in C.HOUR_BANDS.items():
        band = F.when(hour <= last, name) if band is None else band.when(hour <= last, name)
    return band


def is_weekend(day):
    return F.weekday(as_col(day)) >= 5


def micros_between(start, end):
    """Whole microseconds between two timestamp columns, independent of the session time zone."""
    gap = f"(`{end}` - `{start}`)"
    hours = f"extract(DAY FROM {gap}) * 24L + extract(HOUR FROM {gap})"
    minutes = f"({hours}) * 60 + extract(MINUTE FROM {gap})"
    return F.expr(f"({minutes}) * 60000000 + CAST(extract(SECOND FROM {gap}) * 1000000 AS BIGINT)")


def minutes_between(start, end):
    """Whole minutes between two timestamp columns, rounded down."""
    return F.floor(micros_between(start, end) / F.lit(60_000_000)).cast("int")


def add_minutes(time, minutes):
    return as_col(time) + F.make_dt_interval(mins=as_col(minutes).cast("int"))


def time_features(df, time_col):
    """Add day, hour, hour_band, weekday (Monday is 0) and month."""
    time = F.col(time_col)
    return df.withColumns(
        {
            "day": F.to_date(time),
            "hour": F.hour(time),
            "hour_band": hour_band(F.hour(time)),
            "weekday": F.weekday(time),
            "month": month_start(F.to_date(time)),
        }
    )


# --- numbers ----------------------------------------------------------------------


def ratio(num, den, places=None, scale=1):
    """num / den * scale; NULL on a zero denominator."""
    value = F.try_divide(as_col(num).cast("double"), as_col(den).cast("double")) * F.lit(float(scale))
    return value if places is None else F.round(value, places)


def exact_ratio(num, den, places, wide=False):
    """num / den for non-negative integers, rounded half up at `places` without float error.

    `wide` takes the whole part and the remainder apart in decimal(38,0), for sums that outgrow bigint.
    """
    if wide:
        kind = "decimal(38,0)"
        num, den = as_col(num).cast(kind), F.nullif(as_col(den).cast(kind), F.lit(0).cast(kind))
        part = ((num % den).cast(kind) * F.lit(2 * 10**places).cast("decimal(10,0)") + den).cast(kind)
        part = F.call_function("div", part, (den * F.lit(2).cast("decimal(1,0)")).cast(kind))
        scaled = F.call_function("div", num, den).cast("decimal(20,0)") * F.lit(10**places).cast("decimal(10,0)") + part
        return scaled.cast("double") / F.lit(float(10**places))
    kind = "bigint"
    num, den = as_col(num).cast(kind), F.nullif(as_col(den).cast(kind), F.lit(0).cast(kind))
    doubled = num * F.lit(2 * 10**places).cast(kind) + den
    return F.call_function("div", doubled, den * F.lit(2).cast(kind)).cast("double") / F.lit(float(10**places))


def total(col):
    """Sum of integers as bigint."""
    return F.sum(as_col(col)).cast("bigint")


def keys_known(*cols):
    test = None
    for col in cols:
        test = as_col(col).isNotNull() if test is None else test & as_col(col).isNotNull()
    return test
