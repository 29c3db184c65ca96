"""Points in closed day intervals, by dyadic bins: any bounds, open ends, and a rule for overlaps.

An interval of n days is the union of at most 2 log2(n) bins of 2**k days that start at multiples of their size. A day
lies in one bin of each size. So the question which intervals hold a day is an equi-join on (key, size, bin), whatever the
length of the intervals, and an interval without an end costs a few rows.
"""

from pyspark.sql import functions as F

from kickstand.functions import columns as X
from kickstand.operators.fleet import OPEN_END

#: Sizes of bins are 2**0 .. 2**LEVELS days: 2**22 days reach beyond the year 9999.
LEVELS = 22
EPOCH = "0001-01-01"


def _day_number(column):
    """Days since EPOCH, never negative for a date that SQL can hold."""
    return F.date_diff(X.as_col(column).cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")


def dyadic_bins(start, end):
    """Array of (level, bin) that cover the days start .. end (day numbers) exactly, each day once.

    At level k the bins from ceil(start / 2**k) to end // 2**k lie inside; of these only the outermost are not
    part of a bin of the next level: an odd one at the left, an even one at the right.
    """

    def level(k):
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        first = F.call_function("div", start + size - 1, size)
        # the first day behind the interval, in whole bins
        last = F.call_function("div", end + 1, size) - 1
        left = F.when((first <= last) & (first % 2 == 1), F.array(first)).otherwise(F.array().cast("array<bigint>"))
        right = F.when((first <= last) & (last % 2 == 0), F.array(last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.array_distinct(F.concat(left, right)), lambda b: F.struct(k.cast("int").alias("level"), b.alias("bin")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level))


def bins_of(intervals, key, start_col="start_date", end_col="end_date"):
    """`intervals` with one row per bin; a missing end is OPEN_END, and an interval that ends before it starts is none."""
    closed = intervals.withColumn(end_col, F.coalesce(F.col(end_col), F.lit(OPEN_END).cast("date")))
    held = closed.filter(X.keys_known(key, start_col) & (F.col(start_col) <= F.col(end_col)))
    return held.select("*", F.inline(dyadic_bins(_day_number(start_col), _day_number(end_col))))


def in_force(points, intervals, key, day_col, start_col="start_date", end_col="end_date"):
    """The interval in force at each distinct (key, day) of `points`, as one row with the interval's columns.

    Of several, the one that starts last holds, then the one that ends first, then the least in its other columns:
    the narrower rule goes before the wider one. Days that no interval holds give no row.
    """
    days = points.filter(X.keys_known(key, day_col)).select(key, day_col).distinct()
    number = _day_number(day_col)
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.cast("int").alias("level"), F.call_function("shiftright", number, k).alias("bin"))
    )
    binned = days.select(key, day_col, F.inline(levels))
    found = binned.join(bins_of(intervals, key, start_col, end_col), [key, "level", "bin"])
    rest = [c for c in intervals.columns if c not in (key, start_col, end_col)]
    # least by (days before the point at which it starts, days after it at which it ends, the rest)
    order = F.struct(
        F.date_diff(F.col(day_col), F.col(start_col)).alias("_age"), F.date_diff(F.col(end_col), F.col(day_col)).alias("_left"), *rest, start_col, end_col
    )
    best = found.groupBy(key, day_col).agg(F.min(order).alias("_best"))
    return best.select(key, day_col, *[F.col(f"_best.{c}").alias(c) for c in (start_col, end_col, *rest)])


def revenue_by_vendor_month(trips, pricing):
    """Priced and unpriced trips and revenue per vendor and month under policies that may overlap or never end.

    Trips are summed per vendor and day, and only days meet policies.
    """
    daily = (
        trips.filter(X.keys_known("started_at", "vendor", "duration_s", "distance_m"))
        .groupBy("vendor", F.to_date("started_at").alias("day"))
        .agg(F.count("*").alias("trips"), X.total("duration_s").alias("_seconds"), X.total("distance_m").alias("_metres"))
    )
    prices = in_force(daily, pricing, "vendor", "day").select("vendor", "day", "base_fare", "per_minute", "per_km")
    priced = F.col("base_fare").isNotNull()
    revenue = F.col("base_fare") * F.col("trips") + F.col("per_minute") * F.col("_seconds") / 60 + F.col("per_km") * F.col("_metres") / 1000
    return (
        daily.join(prices, ["vendor", "day"], "left")
        .groupBy("vendor", X.month_start("day").alias("month"))
        .agg(
            F.coalesce(X.total(F.when(priced, F.col("trips"))), F.lit(0)).alias("trips"),
            F.coalesce(X.total(F.when(~priced, F.col("trips"))), F.lit(0)).alias("unpriced_trips"),
            F.sum(revenue).alias("revenue"),
        )
    )
