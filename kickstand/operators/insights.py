"""What stands out: trends and the points above them, best-in-class sets, alerts on demand.

Points are report rows, one per key. Sums that decide a result are taken in integers, so they do not depend on how rows
are dealt to tasks.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.functions import columns as X
from kickstand.functions import groups as G

#: Values are compared as whole ten-thousandths, the places that report measures have.
UNIT = 10_000
#: Tasks that find local skylines before they meet.
SKYLINE_TASKS = 64
#: Fixed value: a normal distribution's standard deviation over its median absolute deviation, in ten-thousandths.
MAD_TO_SIGMA = 14_826


def _whole(column):
    return F.round(X.as_col(column) * UNIT).cast("decimal(18,0)")


# --- trend ------------------------------------------------------------------------


def trend(points, x, y, by=(), sigmas=2):
    """Least squares of y on x per group, the residual of every point, and the points far above their line.

    The moments n, sum x, sum y, sum xy, sum x^2 and sum y^2 are kept as decimals: they merge in any order to the same
    numbers, and partial sums come before the shuffle. A group with fewer than three points, or with one x for all, has no line.
    """
    by = list(by)
    px, py = _whole(x), _whole(y)
    known = points.filter(X.keys_known(x, y))
    moments = {"_n": F.lit(1).cast("decimal(18,0)"), "_x": px, "_y": py, "_xx": px * px, "_xy": px * py, "_yy": py * py}
    wide = "decimal(38,0)"
    sums = known.groupBy(*by).agg(*[F.sum(m.cast(wide)).cast(wide).alias(name) for name, m in moments.items()])
    # centred moments times n, exact
    spread = (F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")).cast("double")
    joint = (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")).cast("double")
    height = (F.col("_n") * F.col("_yy") - F.col("_y") * F.col("_y")).cast("double")
    n = F.col("_n").cast("double")
    slope = F.when(n >= 3, F.try_divide(joint, spread))
    lines = sums.select(
        *[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)],
        slope.alias("_slope"),
        ((F.col("_y").cast("double") - slope * F.col("_x").cast("double")) / n / UNIT).alias("_intercept"),
        # residual variance: what the line leaves of the height, over n - 2 degrees of freedom
        F.sqrt(F.greatest(F.lit(0.0), height - slope * joint) / n / (n - 2)).alias("_sigma"),
    )
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_by{i}"))
    joined = points.join(lines, same, "left")
    residual = F.col(y) - (F.col("_intercept") + F.col("_slope") * F.col(x))
    above = residual * UNIT > F.lit(float(sigmas)) * F.col("_sigma")
    return joined.select(
        *points.columns,
        F.round("_slope", 6).alias("slope"),
        F.round("_intercept", 4).alias("intercept"),
        F.round(residual, 4).alias("residual"),
        F.coalesce(above, F.lit(False)).alias("above_trend"),
    )


# --- best in class ----------------------------------------------------------------


def skyline(points, x, y, by=(), tasks=SKYLINE_TASKS):
    """Points that no other point of their group beats: none has both x and y as low and one of them lower.

    Each of `tasks` random parts of a group keeps its own skyline first; a point that is beaten inside its part is beaten
    in the whole. What is left of all parts, a thin line of points, is compared once more.
    """
    held = points.filter(X.keys_known(x, y)).withColumns({"_x": _whole(x).cast("bigint"), "_y": _whole(y).cast("bigint")})
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(tasks))
    held = _unbeaten(held.withColumn("_part", salt), [*by, "_part"])
    return _unbeaten(held, list(by)).select(*points.columns)


def _unbeaten(points, group):
    first = Window.unboundedPreceding
    by_x = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_x")
    # the lowest y among smaller x, and among x that are no larger
    marked = points.withColumns(
        {"_left": F.min("_y").over(by_x.rangeBetween(first, -1)), "_upto": F.min("_y").over(by_x.rangeBetween(first, 0))}
    )
    beaten = (F.col("_left") <= F.col("_y")) | (F.col("_upto") < F.col("_y"))
    return marked.filter(~F.coalesce(beaten, F.lit(False))).drop("_left", "_upto")


# --- alerts -----------------------------------------------------------------------


def demand_alerts(compared, sigmas=3):
    """Demand rows far above what was expected of them, by limits that outliers do not move.

    `compared` has observed and expected trips per day, hour, area and vendor. The gap between them is taken per vendor and
    hour band: its exact median, the exact median of the distances from it, and as limit the median plus `sigmas`
    times the standard deviation that this distance stands for. Gaps are counted per value first, and ranked in
    value buckets, so no task holds a vendor's rows.
    """
    keys = ["vendor", "hour_band"]
    gap = F.col("trips").cast("bigint") * UNIT - F.round(F.col("expected_trips") * UNIT).cast("bigint")
    rows = compared.filter(F.col("expected_trips").isNotNull()).withColumns({"hour_band": X.hour_band("hour"), "_gap": gap})
    counted = rows.groupBy(*keys, "_gap").agg(F.count("*").alias("n"))
    # medians as twice their value, which is whole
    middle = _median_twice(counted, keys, "_gap").withColumnRenamed("_twice", "_middle")
    away = F.abs(2 * F.col("_gap") - F.col("_middle"))
    spread = counted.join(middle, keys).groupBy(*keys, away.alias("_away")).agg(X.total("n").alias("n"))
    limits = middle.join(_median_twice(spread, keys, "_away").withColumnRenamed("_twice", "_mad"), keys)
    judged = rows.join(limits, keys)
    # gap - median > sigmas * 1.4826 * mad, all in whole numbers: the median is doubled once, the distance twice
    over = (2 * F.col("_gap") - F.col("_middle")) * 2 * 10_000 > F.lit(sigmas * MAD_TO_SIGMA) * F.col("_mad")
    return judged.filter(over).select(
        "day",
        "hour",
        "service_area_id",
        "vendor",
        "trips",
        F.round("expected_trips", 4).alias("expected_trips"),
        (F.col("_middle") / (2 * UNIT)).alias("median_gap"),
        (F.col("_mad") / (4 * UNIT)).alias("median_distance"),
    )


def _median_twice(counted, keys, value, bucket=UNIT * 10):
    """Twice the median of counted integers per group, a whole number."""
    ranked = G.rank_values(counted, keys, value, bucket=bucket)
    return ranked.groupBy(*keys).agg(G.percentile_of(value, 5, 1, places=1).alias("_m")).select(
        *keys, (F.col("_m") * 2).cast("bigint").alias("_twice")
    )
