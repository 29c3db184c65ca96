"""Trip extracts and the hourly demand table."""

from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.functions import groups as G


def quality(trips, speed_lo, speed_hi, min_s=60, max_km=20):
    """Plausible trips: longer than `min_s`, 0 < distance <= `max_km`, speed within closed limits.

    The speed test is a product of integers (km/h = 3.6 * m / s), so a trip at exactly a limit is kept
    and no row can divide by zero. Limits are whole km/h.
    """
    seconds, metres = F.col("duration_s").cast("bigint"), F.col("distance_m").cast("bigint")
    return trips.filter(
        (F.col("duration_s") > min_s)
        & (F.col("distance_m") > 0)
        & (F.col("distance_m") <= max_km * 1000)
        & (36 * metres).between(seconds * (10 * speed_lo), seconds * (10 * speed_hi))
    )


def daily_trips_by_vendor(trips, start=None, end=None):
    """Trips per day and vendor with the vendor's share; optional half-open range [start, end)."""
    rows = trips.filter(X.keys_known("started_at", "vendor"))
    if start is not None:
        rows = rows.filter(F.col("started_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("started_at") < F.lit(end).cast("timestamp_ntz"))
    counts = rows.groupBy(F.to_date("started_at").alias("day"), "vendor").agg(F.count("*").alias("trips"))
    # placed by day range, the rows need no further shuffle for the day total or for the final order
    return (
        G.with_totals(counts.repartitionByRange("day"), "trips", total_trips=["day"])
        .withColumn("vendor_share", X.exact_ratio("trips", "total_trips", 4))
        .select("day", "vendor", "trips", "total_trips", "vendor_share")
        .orderBy("day", "vendor")
    )


def avg_trips_by_vendor(trips, speed_lo=3, speed_hi=35):
    """Mean duration and distance with exact distance percentiles per vendor and day.

    Trips are first counted per distinct distance: whole metres up to the quality limit, so even a
    vendor-day with a third of all trips brings at most 20,000 rows into its ranking window.
    """
    keys = ["vendor", "day"]
    counted = (
        quality(trips, speed_lo, speed_hi)
        .groupBy("vendor", F.to_date("started_at").alias("day"), "distance_m")
        .agg(F.count("*").alias("n"), X.total("duration_s").alias("seconds"))
    )
    order = [F.col("day").asc_nulls_last(), F.col("vendor").asc_nulls_last()]
    # one range shuffle serves the ranking, the aggregate per vendor and day, and the final order
    ranked = G.rank_values(counted.repartitionByRange(*order), keys, "distance_m")
    out = ranked.groupBy(*keys).agg(
        X.total("n").alias("trips"),
        X.total("seconds").alias("_seconds"),
        X.total(F.col("distance_m").cast("bigint") * F.col("n")).alias("_metres"),
        G.percentile_of("distance_m", 5, 1000).alias("p50_km"),
        G.percentile_of("distance_m", 9, 1000).alias("p90_km"),
    )
    return out.select(
        "vendor",
        "day",
        "trips",
        X.exact_ratio("_seconds", F.col("trips") * 60, 2).alias("avg_duration_min"),
        X.exact_ratio("_metres", F.col("trips") * 1000, 2).alias("avg_distance_km"),
        "p50_km",
        "p90_km",
    ).orderBy(*order)


def hourly_demand_by_vendor(trips, speed_lo=5, speed_hi=30):
    """Hour-of-day profile per vendor and day with its share of the vendor's day and of the day.

    Trips without a vendor still count in `day_total`; their own rows are dropped at the end.
    """
    counts = (
        quality(trips, speed_lo, speed_hi)
        .groupBy(F.to_date("started_at").alias("day"), "vendor", F.hour("started_at").alias("hour"))
        .agg(F.count("*").alias("trips"))
    )
    # placed by day range, the rows need no further shuffle for either total or for the final order
    totals = G.with_totals(counts.repartitionByRange("day"), "trips", vendor_day_total=["day", "vendor"])
    totals = G.with_totals(totals, "trips", day_total=["day"])
    return (
        totals.filter(X.keys_known("day", "vendor"))
        .select(
            "day",
            "vendor",
            "hour",
            "trips",
            "vendor_day_total",
            "day_total",
            X.exact_ratio("trips", "vendor_day_total", 4).alias("share_within_vendor_day"),
            X.exact_ratio("trips", "day_total", 4).alias("share_within_day"),
        )
        .orderBy("day", "vendor", "hour")
    )


def demand_rows(trips, vendor_map=None, fallback=C.FALLBACK_VENDOR):
    """One demand row per trip: the demand table before it is summed up.

    A measure that sums demand once by its own keys takes these rows: partial aggregation reduces them
    before its only shuffle. Work that reads demand several times takes `trips_hourly`.
    """
    return trips.filter(X.keys_known("started_at")).select(
        F.to_date("started_at").alias("day"),
        F.hour("started_at").alias("hour"),
        "service_area_id",
        X.vendor_canon("vendor", vendor_map, fallback).alias("vendor"),
        F.lit(1).cast("bigint").alias("trips"),
    )


def trips_hourly(trips, vendor_map=None, fallback=C.FALLBACK_VENDOR):
    """Demand table: trips per day, hour, area and canonical vendor.

    Every calibration and rate below starts from this table; its size is set by the calendar, the areas
    and the vendors, not by the number of trips.
    """
    rows = demand_rows(trips, vendor_map, fallback)
    return rows.groupBy("day", "hour", "service_area_id", "vendor").agg(F.count("*").alias("trips"))


def canon_counts(canon):
    """Canonical trips counted per day, hour, vendor and area as written: what catalog and demand table both need."""
    return canon.groupBy("day", "hour", "vendor", "area_name", "area_num").agg(F.count("*").alias("trips"))


def canon_hourly(canon, catalog):
    """Demand table of canonical raw trips, or of their `canon_counts`, matched to the area catalog by name or number.

    Trips are counted per area text first, so the catalog joins the counts and not the trips.
    """
    named = F.lower(F.trim("area_name"))
    trips = X.total("trips") if "trips" in canon.columns else F.count("*")
    counts = canon.groupBy("day", "hour", "vendor", named.alias("_area"), "area_num").agg(trips.alias("trips"))
    areas = unique_areas(catalog.select("service_area_id", "community_area_name", F.col("area_key").alias("_area")), ["_area"])
    by_number = F.format_string("ca %02d", F.col("area_num"))
    joined = counts.withColumn("_area", F.coalesce("_area", F.when(F.col("area_num").isNotNull(), by_number))).join(
        areas, "_area", "left"
    )
    return joined.groupBy("day", "hour", "service_area_id", "community_area_name", "vendor").agg(
        X.total("trips").alias("trips")
    )


def demand_shares(hourly):
    """Add the day-hour and vendor-day totals and the unrounded shares of each demand row."""
    # both totals lie inside a day, so one placement by day serves them; a day has hours x areas x vendors rows
    totals = G.with_totals(hourly.repartition("day"), "trips", vendor_day_total=["day", "vendor"])
    totals = G.with_totals(totals, "trips", dayhour_total=["day", "hour"])
    return totals.withColumns(
        {
            "share_within_day_hour": X.ratio("trips", "dayhour_total"),
            "share_within_vendor_day": X.ratio("trips", "vendor_day_total"),
        }
    )


def unique_areas(areas, keys=("service_area_id",)):
    """The dimension with one row per key: joining it can never multiply fact rows.

    Repeated equal rows count once. Different rows of one key are an error when they are read, since no rule
    says which of them holds.
    """
    rest = [c for c in areas.columns if c not in keys]
    if not rest:
        return areas.distinct()
    held = areas.distinct().groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])

    def checked(c):
        clash = F.raise_error(F.concat(F.lit("several rows of area "), named)).cast(areas.schema[c].dataType)
        return F.when(F.col("_n") > 1, clash).otherwise(F.col(c)).alias(c)

    return held.select(*keys, *[checked(c) for c in rest])


def with_area_type(df, areas, keys=("service_area_id",)):
    """Left join the area dimension; an unknown area keeps NULL columns."""
    wanted = [*keys, *[c for c in ("community_area_name", "area_type") if c not in keys and c not in df.columns]]
    return df.join(unique_areas(areas.select(*wanted), keys), list(keys), "left")
