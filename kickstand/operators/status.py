"""SLA, flags and expected counts of status events."""

from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.functions import groups as G


def with_sla(df, type_col, minutes_col, targets, done=None, target_out="sla_minutes"):
    """Add the SLA target of the type and whether it was met (1, 0, or NULL).

    NULL when the type has no target, when there are no minutes, or when `done` does not hold.
    """
    target = X.lookup(type_col, targets)
    met = F.when(F.col(minutes_col) <= target, 1).when(F.col(minutes_col) > target, 0)
    return df.withColumns({target_out: target, "sla_met_int": met if done is None else F.when(done, met)})


def status_sla(status, type_col="event_type", minutes_col="handle_minutes", time_col=None):
    """Add SLA target, SLA result and the time the event was handled."""
    time_col = X.time_column(status, time_col)
    timed = with_sla(status, type_col, minutes_col, C.STATUS_SLA_MINUTES)
    return timed.withColumn("handled_at", X.add_minutes(time_col, minutes_col))


def status_flags(status, type_col="event_type", subtype_col="event_subtype", minutes_col="handle_minutes"):
    """Add offline minutes (for events that take a vehicle offline) and the compliance flag."""
    kind = F.col(type_col)
    cleared = (kind == "rebalance") & (F.col(subtype_col) == "clear_footpath")
    return status.withColumns(
        {
            "offline_minutes": F.when(kind.isin(*C.OFFLINE_EVENTS), F.col(minutes_col)),
            "compliance_flag": F.coalesce(cleared | (kind == "retrieval"), F.lit(False)),
        }
    )


def active_by_vendor_area(vehicles, area_col="service_area_id_home"):
    """Vehicles per vendor and home area."""
    return vehicles.groupBy("vendor", F.col(area_col).alias("service_area_id")).agg(
        F.count("*").alias("active_vehicles")
    )


def with_active(demand, vehicles=None):
    """Add the active vehicles of the vendor in the area; without vehicles, one per 20 trips, at least 3."""
    guess = F.greatest(F.lit(3).cast("bigint"), F.floor(F.col("trips") / 20).cast("bigint"))
    if vehicles is None:
        return demand.withColumn("active_vehicles", guess)
    joined = demand.join(active_by_vendor_area(vehicles), ["vendor", "service_area_id"], "left")
    return joined.withColumn("active_vehicles", F.coalesce("active_vehicles", guess))


def rate_factor(kind, band_mult, area_mult, vendor_mult):
    """Product of the hour-band, area-type and vendor multipliers of one event type."""
    return (
        X.lookup(X.hour_band("hour"), band_mult[kind])
        * X.lookup(F.lower(F.col("area_type")), area_mult[kind], 1.0)
        * X.lookup("vendor", vendor_mult, 1.0)
    )


def trip_means(rates_per_1k, band_mult, area_mult, vendor_mult):
    """{type: expected events of a demand row}, driven by its trips."""
    return {
        kind: F.col("trips") * F.lit(rate / 1000.0) * rate_factor(kind, band_mult, area_mult, vendor_mult)
        for kind, rate in rates_per_1k.items()
    }


def fleet_means(rates_per_vehicle_hour, band_mult, area_mult, vendor_mult):
    """{type: expected events of a demand row}, driven by its active vehicles."""
    return {
        kind: F.col("active_vehicles") * F.lit(rate) * rate_factor(kind, band_mult, area_mult, vendor_mult)
        for kind, rate in rates_per_vehicle_hour.items()
    }


def sweep_means():
    """Deployments in the morning push (6-10h) and retrievals in the late sweep (21-1h)."""
    hour, vehicles = F.col("hour"), F.col("active_vehicles")
    push = F.when(X.hour_band("hour") == "morning", 1.0).otherwise(0.8)
    return {
        "deployment": F.when(hour.between(6, 10), vehicles * F.lit(C.DEPLOY_PER_ACTIVE) * push).otherwise(0.0),
        "retrieval": F.when((hour >= 21) | (hour <= 1), vehicles * F.lit(C.RETRIEVE_PER_ACTIVE)).otherwise(0.0),
    }


def one_row_per_type(df, type_out, means):
    """Expand each row in place into one row per type with its `expected` count; no shuffle."""
    each = F.array(*[F.struct(F.lit(k).alias(type_out), mean.alias("expected")) for k, mean in means.items()])
    return df.select(*df.columns, F.inline(each))


def expected_rate(demand, rates_per_1k, band_mult, area_mult, vendor_mult=None, type_out="event_type"):
    """Expected events per demand row and type, driven by trips."""
    return one_row_per_type(
        demand, type_out, trip_means(rates_per_1k, band_mult, area_mult, vendor_mult or C.VENDOR_INTENSITY)
    )


def expected_fleet_rate(active, rates_per_vehicle_hour, band_mult, area_mult, vendor_mult=None):
    """Expected events per demand row and type, driven by the active fleet."""
    return one_row_per_type(
        active, "event_type", fleet_means(rates_per_vehicle_hour, band_mult, area_mult, vendor_mult or C.VENDOR_INTENSITY)
    )


def expected_status_events(demand, vehicles=None):
    """Expected status events per demand row and type: trip-driven, fleet-driven, and sweeps.

    All means are computed on the one row they belong to, so demand is read once.
    """
    mults = (C.STATUS_BAND_MULT, C.STATUS_AREA_MULT, C.VENDOR_INTENSITY)
    means = trip_means(C.STATUS_RATE_PER_1K, *mults) | fleet_means(C.STATUS_RATE_PER_VEHICLE_HOUR, *mults)
    return one_row_per_type(with_active(demand, vehicles), "event_type", means | sweep_means())


def observed_against(expected, events, type_col, time_col):
    """Events counted and `expected` (day, vendor, type, expected) summed by vendor, month and type, and their ratio."""
    keys = ["vendor", "month", type_col]
    counted = events.groupBy("vendor", X.month_start(F.to_date(time_col)).alias("month"), type_col).agg(F.count("*").alias("events"))
    summed = expected.groupBy("vendor", X.month_start("day").alias("month"), type_col).agg(F.sum("expected").alias("expected"))
    return G.merge_measures(keys, counted, summed).withColumn("observed_ratio", X.ratio("events", "expected"))


def status_vs_expected(status, demand, vehicles=None, time_col=None):
    """Observed and expected status events with their ratio, by vendor, month and type."""
    return observed_against(expected_status_events(demand, vehicles), status, "event_type", X.time_column(status, time_col))
