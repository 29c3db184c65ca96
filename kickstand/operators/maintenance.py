"""Maintenance extracts from status events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.functions import groups as G

MICROS_PER_HOUR = 3_600_000_000
RANK_BUCKET_MICROS = 10_000_000


def service_events_per_day(status, out_type=C.PICKUP_EVENT, time_col="event_time"):
    """Vehicles taken out of service per day: events and distinct vehicles.

    Events are first counted per day and vehicle, so a busy day is spread over its vehicles.
    """
    per_vehicle = (
        status.filter(F.col("event_type") == out_type)
        .groupBy(F.to_date(time_col).alias("day"), "vehicle_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_vehicle.groupBy("day")
        .agg(X.total("n").alias("maintenance_events"), F.count("vehicle_id").alias("unique_vehicles"))
        .orderBy(F.col("day").asc_nulls_last())
    )


def next_event(events, key, time_col, tiebreak, carry):
    """Add `next_time` and `next_<carry>`: the following event of the same key in time order.

    A key may hold a large part of all events, so its history is cut by day. The first event of each
    day is copied to the end of the key's previous active day, from a table with one row per key and
    active day; after that `lead` inside a key-day sees every successor, and the copies are dropped.
    """
    event = [time_col, tiebreak, carry]
    sliced = events.filter(F.col(time_col).isNotNull()).select(key, *event, F.to_date(time_col).alias("_day"))
    firsts = sliced.groupBy(key, "_day").agg(F.min(F.struct(*event)).alias("_first"))
    days_of_key = Window.partitionBy(key).orderBy("_day")
    copies = firsts.withColumn("_day", F.lag("_day").over(days_of_key)).filter(F.col("_day").isNotNull())
    copies = copies.select(key, "_first.*", "_day", F.lit(True).alias("_copy"))
    within = Window.partitionBy(key, "_day").orderBy(time_col, tiebreak)
    merged = sliced.withColumn("_copy", F.lit(False)).unionByName(copies)
    follower = merged.withColumns(
        {"next_time": F.lead(time_col).over(within), f"next_{carry}": F.lead(carry).over(within)}
    )
    return follower.filter(~F.col("_copy")).drop("_day", "_copy")


def downtime_pairs(
    status,
    out_type=C.PICKUP_EVENT,
    in_type=C.DROPOFF_EVENT,
    time_col="event_time",
    tiebreak="event_id",
):
    """Pickup directly followed by a later dropoff of the same vehicle."""
    moves = status.filter(F.col("event_type").isin(out_type, in_type))
    paired = next_event(moves, "vehicle_id", time_col, tiebreak, "event_type")
    return paired.filter(
        (F.col("event_type") == out_type)
        & (F.col("next_event_type") == in_type)
        & (F.col("next_time") > F.col(time_col))
    ).select(
        "vehicle_id",
        F.col(time_col).alias("pickup_time"),
        F.col("next_time").alias("dropoff_time"),
        X.micros_between(time_col, "next_time").alias("downtime_us"),
    )


def avg_downtime_per_vehicle(status, **kwargs):
    """Downtime hours per pickup day: pairs, mean and exact percentiles."""
    counted = (
        downtime_pairs(status, **kwargs)
        .groupBy(F.to_date("pickup_time").alias("day"), "downtime_us")
        .agg(F.count("*").alias("n"))
    )
    ranked = G.rank_values(counted, ["day"], "downtime_us", bucket=RANK_BUCKET_MICROS)
    out = ranked.groupBy("day").agg(
        X.total("n").alias("maint_pairs"),
        F.sum(F.col("downtime_us").cast("decimal(19,0)") * F.col("n").cast("decimal(10,0)")).alias("_us"),
        G.percentile_of("downtime_us", 5, MICROS_PER_HOUR).alias("p50_downtime_h"),
        G.percentile_of("downtime_us", 9, MICROS_PER_HOUR).alias("p90_downtime_h"),
    )
    hours = F.col("maint_pairs").cast("decimal(20,0)") * F.lit(MICROS_PER_HOUR).cast("decimal(11,0)")
    return out.select(
        "day",
        "maint_pairs",
        X.exact_ratio("_us", hours, 2, wide=True).alias("avg_downtime_h"),
        "p50_downtime_h",
        "p90_downtime_h",
    ).orderBy("day")


def weekly_fleet_maintenance_percent(status, vehicles, out_type=C.PICKUP_EVENT, time_col="event_time"):
    """Share of the whole fleet that went into maintenance, per week starting Monday."""
    weekly = (
        status.filter(F.col("event_type") == out_type)
        .select(X.week_start(F.to_date(time_col)).alias("week_start"), "vehicle_id")
        .distinct()
        .groupBy("week_start")
        .agg(F.count("vehicle_id").alias("vehicles_in_maintenance"))
    )
    # distinct and count, not one count-distinct, so that the ids are spread over tasks
    fleet = (
        vehicles.select("vehicle_id")
        .filter(F.col("vehicle_id").isNotNull())
        .distinct()
        .agg(F.count("*").alias("fleet_size"))
    )
    return (
        weekly.withColumn("fleet_size", fleet.scalar())
        .withColumn(
            "pct_fleet_maintenance", X.exact_ratio(F.col("vehicles_in_maintenance") * 100, F.col("fleet_size"), 2)
        )
        .orderBy(F.col("week_start").asc_nulls_last())
    )
