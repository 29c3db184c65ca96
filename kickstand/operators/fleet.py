"""Vehicle features and trip pricing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X


#: Last day of a pricing policy that has no end.
OPEN_END = "2100-12-31"


def vehicle_features(vehicles, window_end, avg_trip_km=C.DEFAULT_TRIP_KM):
    """Add days in service, estimated trips, daily energy and battery cycles.

    A vehicle serves until it was decommissioned, else to `window_end`, and at least one day. Its trips
    are estimated from its odometer and the mean trip length. Both arguments may be scalar columns.
    """
    end = window_end if not isinstance(window_end, str) else F.lit(window_end).cast("date")
    km = avg_trip_km if not isinstance(avg_trip_km, (int, float)) else F.lit(float(avg_trip_km))
    energy = X.lookup("vendor", C.ENERGY_PER_TRIP_WH, C.DEFAULT_ENERGY_PER_TRIP_WH)
    days = F.greatest(F.lit(1), F.datediff(F.coalesce("decommissioned_at", end), "in_service_since"))
    timed = vehicles.withColumns({"days_in_service": days, "est_trips": F.col("odometer_km") / km})
    return timed.withColumns(
        {
            "est_daily_energy_wh": F.floor(F.col("est_trips") / F.col("days_in_service") * energy).cast("int"),
            "battery_cycles_est": F.floor(
                F.col("est_trips") * energy / F.greatest(F.lit(1), F.col("battery_wh"))
            ).cast("int"),
        }
    )


def policy_months(pricing):
    """Pricing policies with one row per month they touch, so that a range join becomes an equi-join.

    A policy without an end runs to OPEN_END. Policies of one vendor that overlap are an error when the rows
    are read: a day with two prices has none.
    """
    closed = pricing.withColumn("end_date", F.coalesce("end_date", F.lit(OPEN_END).cast("date")))
    valid = closed.filter(F.col("start_date") <= F.col("end_date"))
    earlier = Window.partitionBy("vendor").orderBy("start_date", "end_date").rowsBetween(Window.unboundedPreceding, -1)
    clash = F.raise_error(F.concat(F.lit("overlapping pricing policies of "), F.coalesce("vendor", F.lit("null")))).cast("date")
    checked = valid.withColumn("_end", F.max("end_date").over(earlier)).withColumn(
        "start_date", F.when(F.col("start_date") <= F.col("_end"), clash).otherwise(F.col("start_date"))
    )
    months = F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("interval 1 month"))
    return checked.drop("_end").withColumn("policy_month", F.explode(months))


def overlapping_policies(pricing):
    """Policies that start before an earlier one of the vendor has ended; trips there would count twice."""
    earlier = Window.partitionBy("vendor").orderBy("start_date", "end_date").rowsBetween(Window.unboundedPreceding, -1)
    closed = pricing.withColumn("end_date", F.coalesce("end_date", F.lit(OPEN_END).cast("date")))
    return closed.withColumn("_end", F.max("end_date").over(earlier)).filter(
        F.col("start_date") <= F.col("_end")
    ).drop("_end")


def with_policy(df, pricing, day_col):
    """Join the policy in force for the vendor on the day; end dates are inclusive. Rows without one keep NULL prices."""
    policies = policy_months(pricing).withColumnRenamed("vendor", "_vendor")
    match = (
        (F.col("vendor") == F.col("_vendor"))
        & (X.month_start(day_col) == F.col("policy_month"))
        & F.col(day_col).between(F.col("start_date"), F.col("end_date"))
    )
    return df.join(policies, match, "left").drop("_vendor", "policy_month", "start_date", "end_date")


def trip_cost(trips, pricing):
    """Priced trips: base fare plus the price per minute and per km; NULL for a trip without a policy."""
    priced = with_policy(trips.withColumn("_day", F.to_date("started_at")), pricing, "_day").drop("_day")
    cost = (
        F.col("base_fare")
        + F.col("per_minute") * F.col("duration_s") / 60
        + F.col("per_km") * F.col("distance_m") / 1000
    )
    return priced.withColumn("trip_cost", cost).drop("base_fare", "per_minute", "per_km")


def trip_cost_by_vendor_month(trips, pricing):
    """Priced and unpriced trips and revenue per vendor and month.

    The price is linear in minutes and km, so trips are summed per vendor and day first and only the
    sums meet the policies.
    """
    daily = (
        trips.filter(X.keys_known("started_at", "vendor", "duration_s", "distance_m"))
        .groupBy("vendor", F.to_date("started_at").alias("day"))
        .agg(
            F.count("*").alias("trips"),
            X.total("duration_s").alias("_seconds"),
            X.total("distance_m").alias("_metres"),
        )
    )
    revenue = (
        F.col("base_fare") * F.col("trips")
        + F.col("per_minute") * F.col("_seconds") / 60
        + F.col("per_km") * F.col("_metres") / 1000
    )
    priced = F.col("base_fare").isNotNull()
    return (
        with_policy(daily, pricing, "day")
        .groupBy("vendor", X.month_start("day").alias("month"))
        .agg(
            F.coalesce(X.total(F.when(priced, F.col("trips"))), F.lit(0)).alias("trips"),
            F.coalesce(X.total(F.when(~priced, F.col("trips"))), F.lit(0)).alias("unpriced_trips"),
            F.sum(revenue).alias("revenue"),
        )
    )
