"""Vehicles out of service by hour, from events that do not always pair up.

A vehicle is out from a pickup on, until its next dropoff, however many pickups come between and however many weeks
pass; a pickup without a dropoff leaves it out to the end. Dropoffs of a vehicle that is in count for nothing.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from kickstand.operators.maintenance import next_event


def absence_edges(status, out_type=C.PICKUP_EVENT, in_type=C.DROPOFF_EVENT, time_col="event_time", tiebreak="event_id"):
    """Times at which vehicles go out (`change` 1) and come back (-1): the ends of merged runs of equal events.

    A run of pickups is one absence. Only neighbours in a vehicle's history decide, and `next_event` finds them without
    holding a vehicle's history in one task.
    """
    moves = status.filter(F.col("event_type").isin(out_type, in_type) & X.keys_known("vehicle_id", time_col))
    followed = next_event(moves, "vehicle_id", time_col, tiebreak, "event_type")
    turns = followed.filter(F.col("event_type") != F.col("next_event_type")).select(
        "vehicle_id", F.col("next_time").alias("at"), F.when(F.col("next_event_type") == out_type, 1).otherwise(-1).alias("change")
    )
    # the first event of a vehicle follows none
    first = moves.groupBy("vehicle_id").agg(F.min(F.struct(time_col, tiebreak, "event_type")).alias("_first"))
    opening = first.filter(F.col("_first.event_type") == out_type).select(
        "vehicle_id", F.col(f"_first.{time_col}").alias("at"), F.lit(1).alias("change")
    )
    return turns.unionByName(opening)


def vehicles_out_by_hour(status, **kwargs):
    """Per hour from the first to the last change: vehicles out at its start, gone out, come back, out at its end.

    A sweep over the changes in two steps: a day's changes are summed up and carried from day to day, and every day
    is swept on its own from what was carried in. The windows hold one row per day, and 24 rows of a day.
    """
    edges = absence_edges(status, **kwargs)
    hourly = edges.groupBy(F.to_date("at").alias("day"), F.hour("at").alias("hour")).agg(
        F.count_if(F.col("change") > 0).alias("went_out"), F.count_if(F.col("change") < 0).alias("came_back")
    )
    days = hourly.agg(F.min("day").alias("first"), F.max("day").alias("last")).filter(X.keys_known("first"))
    hours = days.select(F.explode(F.sequence("first", "last")).alias("day")).select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    rows = hours.join(hourly, ["day", "hour"], "left").fillna(0, ["went_out", "came_back"])
    net = F.col("went_out") - F.col("came_back")
    daily = rows.groupBy("day").agg(X.total(net).alias("_net"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select("day", F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_carried"))
    upto = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.join(carried, "day").withColumn("out_at_end", (F.col("_carried") + F.sum(net).over(upto)).cast("bigint"))
    return swept.select(
        "day",
        "hour",
        (F.col("out_at_end") - net).alias("out_at_start"),
        "went_out",
        "came_back",
        "out_at_end",
    )
