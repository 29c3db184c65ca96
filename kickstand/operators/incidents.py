"""Incident extract, derived incident columns and expected incident counts."""

from functools import reduce

from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.functions import groups as G


def incidents_by_type(incidents, time_col="occurred_at"):
    """Incidents per day and type."""
    return (
        incidents.groupBy(F.to_date(time_col).alias("day"), "incident_type")
        .agg(F.count("*").alias("incidents"))
        .orderBy(F.col("day").asc_nulls_last(), F.col("incident_type").asc_nulls_last())
    )


def incident_features(incidents, time_col="occurred_at", resolved_col="resolved_at"):
    """Add resolution minutes, the trip-related flag and the time columns."""
    return X.time_features(incidents, time_col).withColumns(
        {
            "resolve_minutes": X.minutes_between(time_col, resolved_col),
            "trip_related": F.col("incident_type").isin(*C.TRIP_RELATED_INCIDENTS),
        }
    )


def incident_type_mix(demand):
    """One row per demand row and incident type with the type's relative probability.

    Needs `day`, `hour`, `area_type` and `vendor`. The weights of all types are expressions on one
    row, so the mix is normalised in place: no shuffle, and no window over the expanded rows.
    """
    band, month = X.hour_band("hour"), F.month("day")
    area = F.lower(F.col("area_type"))
    weights = {
        kind: F.lit(rate)
        * X.lookup(band, C.INCIDENT_BAND_MULT[kind])
        * X.lookup(area, C.INCIDENT_AREA_MULT[kind], 1.0)
        * X.month_lookup(month, C.INCIDENT_MONTH_MULT[kind])
        * X.lookup("vendor", C.VENDOR_INTENSITY, 1.0)
        for kind, rate in C.INCIDENT_RATE_PER_1K.items()
    }
    weighed = demand.withColumns({f"_w_{kind}": weight for kind, weight in weights.items()})
    weight_sum = reduce(lambda a, b: a + b, [F.col(f"_w_{kind}") for kind in weights])
    weighed = weighed.withColumn("_sum", weight_sum)
    mix = F.array(
        *[
            F.struct(F.lit(kind).alias("incident_type"), (F.col(f"_w_{kind}") / F.col("_sum")).alias("probability"))
            for kind in weights
        ]
    )
    return weighed.select(*demand.columns, F.inline(mix))


def expected_incidents(demand):
    """Expected incidents per demand row and type: trips at the overall base rate, split by the mix."""
    base_rate = sum(C.INCIDENT_RATE_PER_1K.values()) / 1000.0
    return incident_type_mix(demand).withColumn(
        "expected_incidents", F.col("trips") * F.lit(base_rate) * F.col("probability")
    )


def incidents_vs_expected(incidents, demand):
    """Observed and expected incidents with their ratio, by vendor, month and type."""
    keys = ["vendor", "month", "incident_type"]
    observed = incidents.groupBy("vendor", X.month_start(F.to_date("occurred_at")).alias("month"), "incident_type").agg(
        F.count("*").alias("incidents")
    )
    expected = (
        expected_incidents(demand)
        .groupBy("vendor", X.month_start("day").alias("month"), "incident_type")
        .agg(F.sum("expected_incidents").alias("expected_incidents"))
    )
    merged = G.merge_measures(keys, observed, expected)
    return merged.withColumn("observed_ratio", X.ratio("incidents", "expected_incidents"))
