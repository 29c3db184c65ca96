"""Calibration measures and the noise-free demand baseline.

Everything starts from the demand table (trips per day, hour, area and vendor), and every result here
has a size set by the calendar, the areas and the vendors. Scalars are joined in as scalar subqueries
and fixed-size tables as arrays, so nothing is collected by the caller.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.functions import groups as G
from kickstand.operators.trips import unique_areas
from kickstand.sources.sinks import stored

OTHER_AREA = "other"


# --- areas ------------------------------------------------------------------------


def area_catalog(canon, areas=None):
    """Area ids, names, types and match keys: the given areas, else the distinct areas of the trips.

    Areas found in trips are numbered in name order and count as residential. The ordering window
    runs over the distinct names only, after the trips were reduced to one row per name.
    """
    if areas is not None:
        kind = F.col("area_type") if "area_type" in areas.columns else F.lit(C.DEFAULT_AREA_TYPE)
        listed = areas.select("service_area_id", "community_area_name", kind.alias("area_type"))
    else:
        names = canon.filter(X.keys_known("area_name")).select(F.col("area_name").alias("community_area_name"))
        numbers = canon.filter(X.keys_known("area_num")).select(F.col("area_num").alias("service_area_id"))
        numbered = numbers.distinct().withColumn("community_area_name", F.format_string("CA %02d", "service_area_id"))
        order = Window.orderBy("community_area_name")
        # one area per match key: of names that differ in case or blanks, the first in order stands for all
        key = F.lower(F.trim("community_area_name"))
        named = names.groupBy(key.alias("_key")).agg(F.min("community_area_name").alias("community_area_name")).drop("_key")
        named = named.withColumn("service_area_id", F.row_number().over(order))
        listed = named.unionByName(numbered).withColumn("area_type", F.lit(C.DEFAULT_AREA_TYPE))
    return listed.withColumns(
        {
            "area_key": F.lower(F.trim("community_area_name")),
            "map_location": X.map_location("community_area_name"),
        }
    ).select("service_area_id", "community_area_name", "area_type", "area_key", "map_location")


def area_weights(demand, catalog, by=(), alpha=0.5):
    """Share of trips per catalog area, smoothed by `alpha`; `by=['vendor']` gives a mix per vendor."""
    by = list(by)
    spine = unique_areas(catalog.select("service_area_id", "area_type")).select("service_area_id")
    if by:
        spine = spine.withColumn("vendor", F.explode(_vendor_list(demand)))
    counts = demand.groupBy("service_area_id", *by).agg(X.total("trips").alias("trips"))
    joined = spine.join(counts, ["service_area_id", *by], "left").withColumn(
        "trips", F.coalesce("trips", F.lit(0).cast("bigint"))
    )
    group = Window.partitionBy(*(by or [F.lit(1)]))
    smoothed = F.col("trips") + F.lit(alpha)
    return joined.withColumn("weight", smoothed / F.sum(smoothed).over(group))


def _vendor_list(demand):
    """All vendors as one array: the canonical ones and whatever others the demand names."""
    seen = demand.agg(F.array_sort(F.collect_set("vendor"))).scalar()
    return F.array_union(F.array(*[F.lit(v) for v in C.VENDORS]), seen)


def vendor_area_mix(demand, catalog, alpha=0.5):
    return area_weights(demand, catalog, ["vendor"], alpha)


# --- calendar shapes --------------------------------------------------------------


def _vendor_counts(demand, *keys, vendors):
    """One row per key with a trips column per vendor."""
    return demand.groupBy(*keys).agg(
        *[F.coalesce(X.total(F.when(F.col("vendor") == v, F.col("trips"))), F.lit(0)).alias(v) for v in vendors],
        X.total("trips").alias("_all"),
    )


def vendor_month_mix(demand, floors=None):
    """Vendor share per month, lifted by the vendors' floors; every vendor is listed in every month."""
    counts = demand.groupBy(X.month_start("day").alias("month"), "vendor").agg(X.total("trips").alias("trips"))
    known = F.when(F.col("vendor").isNotNull(), F.struct("vendor", "trips"))
    # a month has one entry per vendor
    monthly = counts.groupBy("month").agg(
        X.total("trips").alias("_all"), F.map_from_entries(F.collect_list(known)).alias("_by")
    )
    others = F.flatten(F.collect_list(F.map_keys("_by")).over(Window.partitionBy(F.lit(1))))
    listed = F.array_union(F.array(*[F.lit(v) for v in C.VENDORS]), F.array_sort(F.array_distinct(others)))
    rows = monthly.withColumn("_vendors", listed).select("month", "_all", "_by", F.explode("_vendors").alias("vendor"))
    raw = F.coalesce(F.element_at("_by", F.col("vendor")), F.lit(0)) / F.col("_all")
    rows = rows.select("month", "vendor", raw.alias("raw"))
    return G.normalize_with_floors(rows, ["month"], "vendor", "raw", floors or C.VENDOR_SHARE_FLOORS)


def hour_shape(demand):
    """Share of trips per hour 0-23; an hour without trips weighs 1/24 before renormalising."""
    counts = demand.groupBy("hour").agg(X.total("trips").alias("trips"))
    hours = demand.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    whole = Window.partitionBy(F.lit(1))
    joined = hours.join(counts, "hour", "left").withColumn(
        "raw", F.coalesce(F.col("trips") / F.sum("trips").over(whole), F.lit(1.0 / 24))
    )
    return joined.select(
        "hour",
        F.coalesce("trips", F.lit(0)).cast("bigint").alias("trips"),
        (F.col("raw") / F.sum("raw").over(whole)).alias("weight"),
    )


def day_totals(demand):
    return demand.groupBy("day").agg(X.total("trips").alias("trips"))


def daily_median(demand):
    """Median trips per day; a fixed volume when there are no trips."""
    return day_totals(demand).agg(F.coalesce(F.median("trips"), F.lit(C.DEFAULT_DAILY_TRIPS)).alias("daily_median"))


def month_multiplier(demand):
    """Trips per month of the year over the mean of the months present; a fixed table without trips."""
    counts = demand.groupBy(F.month("day").alias("month")).agg(X.total("trips").alias("trips"))
    months = demand.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    mean = F.avg("trips").over(Window.partitionBy(F.lit(1)))
    scaled = F.coalesce("trips", F.lit(0)) / mean
    return months.join(counts, "month", "left").select(
        "month", F.coalesce(scaled, X.lookup("month", C.DEFAULT_MONTH_MULTIPLIER)).alias("multiplier")
    )


def weekend_boost(demand):
    """Mean Saturday and Sunday total over mean Monday to Friday total; a missing weekday counts as 1."""
    weekday = F.weekday("day")
    per_day = [
        F.coalesce(X.total(F.when(weekday == i, F.col("trips"))), F.lit(1)).cast("double").alias(f"_{i}")
        for i in range(7)
    ]
    sums = demand.agg(F.count("*").alias("_rows"), *per_day)
    work = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(5)]) / 5
    weekend = (F.col("_5") + F.col("_6")) / 2
    boost = F.when(F.col("_rows") > 0, F.try_divide(weekend, work))
    return sums.select(F.coalesce(boost, F.lit(C.DEFAULT_WEEKEND_BOOST)).alias("weekend_boost"))


# --- fleet ------------------------------------------------------------------------


def vendor_daily_avg(demand):
    """Mean trips per active day for every vendor; 0 for a vendor without trips."""
    per_day = demand.groupBy("vendor", "day").agg(X.total("trips").alias("trips"))
    averages = per_day.groupBy("vendor").agg(F.avg("trips").alias("daily_avg"))
    # canonical vendors without trips are listed, and so is every other vendor that has some
    listed = demand.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in C.VENDORS])).alias("vendor"))
    return listed.join(averages.filter(X.keys_known("vendor")), "vendor", "full").select(
        "vendor", F.coalesce("daily_avg", F.lit(0.0)).alias("daily_avg")
    )


def fleet_sizing(daily_avg, targets=None, min_fleet=C.MIN_FLEET):
    """Vehicles each vendor needs for its daily trips, with the code of the last vehicle."""
    target = X.lookup("vendor", targets or C.TRIPS_PER_VEHICLE_DAY, C.DEFAULT_TRIPS_PER_VEHICLE_DAY)
    lowest = F.when(F.col("daily_avg") > 0, F.lit(min_fleet)).otherwise(F.lit(0))
    needed = F.ceil(F.col("daily_avg") / F.greatest(F.lit(1e-6), target))
    sized = daily_avg.withColumn("fleet_size", F.greatest(lowest.cast("bigint"), needed.cast("bigint")))
    return sized.withColumn("last_vehicle_id", X.vehicle_code("vendor", "fleet_size"))


def avg_trip_km(trips, km_col=None, m_col="distance_m"):
    """Mean trip length in km from a km column, else from metres, else a fixed length."""
    mean = F.avg(km_col) if km_col else F.avg(m_col) / 1000 if m_col else F.lit(None).cast("double")
    return trips.agg(F.coalesce(mean, F.lit(C.DEFAULT_TRIP_KM)).alias("avg_trip_km"))


# --- expected demand --------------------------------------------------------------


def calibration_base(demand):
    """Trips per day, hour and vendor, and trips per area: the two small tables that every factor is drawn from.

    Both come from one pass over the demand and are stored together; their size is set by the calendar, the vendors and
    the areas.
    """
    keys = ["day", "hour", "vendor"]
    both = demand.groupingSets([keys, ["service_area_id"]], *keys, "service_area_id").agg(
        F.grouping("day").alias("_by_area"), X.total("trips").alias("trips")
    )
    both = stored(both)
    by_time = both.filter(F.col("_by_area") == 0).select(*keys, "trips")
    return by_time, both.filter(F.col("_by_area") == 1).select("service_area_id", "trips")


def _day_factors(daily, floor_total, scale):
    """One row per calendar day from the first to the last trip, with its month and city total.

    `daily` has the trips per day; all day-level calibration is drawn from it.
    """
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last")).filter(X.keys_known("first"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    levels = month_multiplier(daily).select(F.col("month").alias("_month_no"), "multiplier")
    boost = F.when(X.is_weekend("day"), weekend_boost(daily).scalar()).otherwise(F.lit(1.0))
    city = daily_median(daily).scalar() * F.col("multiplier") * boost * F.lit(scale)
    return (
        days.select("day", X.month_start("day").alias("month"), F.month("day").alias("_month_no"))
        .join(F.broadcast(levels), "_month_no")  # twelve rows by construction
        .select("day", "month", F.greatest(F.lit(floor_total), F.floor(city)).cast("bigint").alias("day_total"))
    )


def _bias(key, biases, vendor):
    """Factor of a vendor by band or area type; 1 where none is given."""
    table = biases.get(vendor)
    return X.lookup(key, table, 1.0) if table else F.lit(1.0)


def _share_table(demand, days, floors, vendors):
    """Per month and area type: an array with one share per hour and vendor.

    The array has 24 entries per vendor whatever the data, so a demand row or a spine row finds its shares
    with one lookup instead of a join that fans out.
    """
    monthly = _vendor_counts(demand, X.month_start("day").alias("_m"), vendors=vendors)
    lifted = G.floored_shares({v: F.col(v) / F.col("_all") for v in vendors}, floors)
    mixes = monthly.select("_m", *[lifted[v].alias(f"_mix_{v}") for v in vendors])
    kinds = F.explode(F.array(*[F.lit(k) for k in (*C.AREA_TYPES, OTHER_AREA)])).alias("area_kind")
    months = days.select("month").distinct().join(mixes, F.col("month") == F.col("_m"), "left")
    grid = months.select(
        "month", *[F.coalesce(F.col(f"_mix_{v}"), F.lit(floors.get(v, 0.0))).alias(f"_mix_{v}") for v in vendors], kinds
    )
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    band = X.hour_band("hour")
    biased = {
        v: F.col(f"_mix_{v}")
        * _bias(band, C.VENDOR_BAND_BIAS, v)
        * _bias("area_kind", C.VENDOR_AREA_BIAS, v)
        for v in vendors
    }
    grid = grid.select("month", "area_kind", "hour", *[b.alias(f"_raw_{v}") for v, b in biased.items()])
    shares = G.floored_shares({v: F.col(f"_raw_{v}") for v in vendors}, floors)
    return grid.select("month", "area_kind", "hour", *[shares[v].alias(v) for v in vendors])


def spine_tasks(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _area_kind(area_type):
    kind = F.lower(F.coalesce(area_type, F.lit(C.DEFAULT_AREA_TYPE)))
    return F.when(kind.isin(*C.AREA_TYPES), kind).otherwise(F.lit(OTHER_AREA))


def _weighted_areas(demand, catalog):
    return (
        area_weights(demand, catalog)
        .join(unique_areas(catalog.select("service_area_id", "area_type")), "service_area_id")
        .select("service_area_id", F.col("weight").alias("_area_weight"), _area_kind(F.col("area_type")).alias("area_kind"))
    )


def expected_demand(demand, catalog, floor_total=C.MIN_CITY_TRIPS, scale=1.0, floors=None, vendors=None):
    """Expected trips per day, hour, area and vendor over the full calendar, without noise.

    City total of the day, times the weight of the hour, the weight of the area, and the vendor's
    share for that month, hour and area type. The spine grows from (day, area) rows that are spread
    over tasks first; each row brings its hours and vendors as one array of 24 entries per vendor, found by
    month and area type. `vendors` replaces the canonical names where a vendor map keeps others.
    """
    floors, vendors = floors or C.VENDOR_SHARE_FLOORS, list(vendors or C.VENDORS)
    by_time, by_area = calibration_base(demand)
    daily = day_totals(by_time)
    days = _day_factors(daily, floor_total, scale)
    hours = hour_shape(by_time).select("hour", F.col("weight").alias("_hour_weight"))
    # hour has 24 rows by construction
    grid = _share_table(by_time, days, floors, vendors).join(F.broadcast(hours), "hour")
    weight = {v: F.col("_hour_weight") * F.col(v) for v in vendors}
    each = F.array(*[F.struct("hour", F.lit(v).alias("vendor"), w.alias("_weight")) for v, w in weight.items()])
    cells = grid.select("month", "area_kind", F.explode(each).alias("_cell"))
    cells = cells.groupBy("month", "area_kind").agg(F.collect_list("_cell").alias("_cells"))
    areas = _weighted_areas(by_area, catalog)
    first, last = [daily.agg(edge("day")).scalar() for edge in (F.min, F.max)]
    spread = (
        areas.withColumn("day", F.explode(F.sequence(first, last)))
        # each row is about to bring 96 rows: spread them, while they are thin, by a fixed number that AQE keeps
        .repartition(spine_tasks(demand.sparkSession), "service_area_id", "day")
        .join(days, "day")
        .join(cells, ["month", "area_kind"])
    )
    expected = F.col("day_total") * F.col("_area_weight") * F.col("_weight")
    spine = spread.select("day", "service_area_id", "day_total", "_area_weight", F.inline("_cells"))
    return spine.select("day", "hour", "service_area_id", "vendor", expected.alias("expected_trips"))


def demand_vs_expected(demand, history, catalog, floor_total=C.MIN_CITY_TRIPS, scale=1.0, floors=None, vendors=None):
    """Observed demand rows with the trips expected from `history` and the ratio of the two.

    Factors are looked up per observed row, so the full spine is never built. Rows outside the days of
    the history, in an area the catalog lacks, or of a vendor outside `vendors` (the canonical names unless
    given), have no expectation.
    """
    floors, vendors = floors or C.VENDOR_SHARE_FLOORS, list(vendors or C.VENDORS)
    by_time, by_area = calibration_base(history)
    days = _day_factors(day_totals(by_time), floor_total, scale)
    shares = _share_table(by_time, days, floors, vendors)
    each = F.array(*[F.struct(F.lit(v).alias("vendor"), F.col(v).alias("_share")) for v in vendors])
    shares = shares.select("month", "area_kind", "hour", F.inline(each))
    hours = hour_shape(by_time).select("hour", F.col("weight").alias("_hour_weight"))
    joined = (
        demand.join(F.broadcast(hours), "hour")  # 24 rows by construction
        .join(days, "day", "left")
        .join(_weighted_areas(by_area, catalog), "service_area_id", "left")
        .join(shares, ["month", "area_kind", "hour", "vendor"], "left")
    )
    expected = F.col("day_total") * F.col("_area_weight") * (F.col("_hour_weight") * F.col("_share"))
    return joined.select("day", "hour", "service_area_id", "vendor", "trips", expected.alias("expected_trips")).withColumn(
        "observed_ratio", X.ratio("trips", "expected_trips")
    )
