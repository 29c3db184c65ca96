"""Grouped helpers: exact percentiles, floored shares, smoothed weights, merged measures.

Windows here always run over rows that were aggregated first, so one partition of a window holds
distinct keys or values, never the raw rows of a hot group.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand import constants as C


def _frames(ordered):
    """Running frame and whole frame of one ordered window; sharing the order, they take one pass."""
    first = Window.unboundedPreceding
    return ordered.rowsBetween(first, 0), ordered.rowsBetween(first, Window.unboundedFollowing)


def rank_values(counted, keys, value, weight="n", bucket=None):
    """Add `below` (rows under this value in its group) and `group_rows` to counted distinct values.

    `counted` has one row per keys + integer value, with its row count in `weight`. Without `bucket`
    a group is ranked in one window over its distinct values, for values with a small domain.
    With `bucket` (a width) ranking is split in two: totals per bucket are accumulated over the group,
    then each bucket ranks its own values on top of one offset row that carries the total of the buckets
    before it. Neither window grows with all distinct values of the group.
    """
    if bucket is None:
        upto, whole = _frames(Window.partitionBy(*keys).orderBy(value))
        return counted.withColumns(
            {"below": F.sum(weight).over(upto) - F.col(weight), "group_rows": F.sum(weight).over(whole)}
        )

    bucketed = counted.withColumn("_bucket", F.call_function("div", F.col(value), F.lit(bucket)))
    upto, whole = _frames(Window.partitionBy(*keys).orderBy("_bucket"))
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum(weight).alias("_size"))
        .select(
            *keys,
            "_bucket",
            (F.sum("_size").over(upto) - F.col("_size")).alias(weight),
            F.sum("_size").over(whole).alias("_all"),
        )
    )
    merged = bucketed.unionByName(offsets, allowMissingColumns=True)
    # the offset row has no value and sorts first, so every running frame of its bucket includes it
    running, _ = _frames(Window.partitionBy(*keys, "_bucket").orderBy(F.col(value).asc_nulls_first()))
    ranked = merged.withColumns(
        {"below": F.sum(weight).over(running) - F.col(weight), "group_rows": F.max("_all").over(running)}
    )
    return ranked.filter(F.col(value).isNotNull()).drop("_bucket", "_all")


def percentile_of(value, tenths, unit, places=4, weight="n"):
    """Aggregate for rows made by `rank_values`: the linear percentile tenths/10, divided by `unit`.

    Works on integers: the position is tenths * (rows - 1) / 10, so the result is exact before
    the final division.
    """
    position = f"(group_rows - 1) * {tenths}"
    low, part = f"({position} div 10)", f"({position} % 10)"
    high = f"({low} + if({part} > 0, 1, 0))"

    def at(rank):
        return f"max(case when below <= {rank} and {rank} < below + `{weight}` then `{value}` end)"

    mixed = f"{at(low)} * (10 - max({part})) + {at(high)} * max({part})"
    return F.expr(f"round(cast({mixed} as double) / {10.0 * unit!r}D, {places})")


def normalize_with_floors(df, group_cols, key_col, weight_col, floors=None, out_col="share"):
    """Share per key within each group, lifted so that no key falls below its floor.

    The floors of the keys present are handed out first and the rest of the unit is split by weight;
    the result is scaled to sum to 1. A group holds one row per key.
    """
    group = Window.partitionBy(*(group_cols or [F.lit(1)]))
    floor = F.lit(0.0)
    for key, value in (C.VENDOR_SHARE_FLOORS if floors is None else floors).items():
        floor = F.when(F.col(key_col) == key, F.lit(value)).otherwise(floor)
    weight = F.greatest(F.lit(0.0), F.col(weight_col).cast("double"))
    step = df.withColumns({"_floor": floor, "_weight": weight})
    step = step.withColumns(
        {
            "_floors": F.sum("_floor").over(group),
            "_weights": F.sum("_weight").over(group),
        }
    )
    spread = F.coalesce(F.try_divide(F.col("_weight"), F.col("_weights")), F.lit(0.0))
    step = step.withColumn("_lifted", F.col("_floor") + (1 - F.col("_floors")) * spread)
    lifted = F.sum("_lifted").over(group)
    step = step.withColumn(out_col, F.coalesce(F.try_divide(F.col("_lifted"), lifted), F.lit(0.0)))
    return step.drop("_floor", "_weight", "_floors", "_weights", "_lifted")


def floored_shares(weights, floors):
    """Expression form for a fixed set of keys: {key: weight Column} -> {key: share Column}."""
    positive = {k: F.greatest(F.lit(0.0), w) for k, w in weights.items()}
    weight_sum = reduce(lambda a, b: a + b, positive.values())
    rest = 1 - sum(floors.get(k, 0.0) for k in weights)
    lifted = {
        k: F.lit(floors.get(k, 0.0)) + F.lit(rest) * F.coalesce(F.try_divide(w, weight_sum), F.lit(0.0))
        for k, w in positive.items()
    }
    lifted_sum = reduce(lambda a, b: a + b, lifted.values())
    return {k: F.try_divide(v, lifted_sum) for k, v in lifted.items()}


def with_totals(df, value, **totals):
    """Add group totals of an aggregated column next to each row: name=[key columns]."""
    return df.withColumns(
        {name: F.sum(value).over(Window.partitionBy(*keys)).cast("bigint") for name, keys in totals.items()}
    )


def merge_measures(keys, *aggregated):
    """Full outer merge of aggregated tables on `keys`; a measure missing for a key is 0.

    A union and one more aggregate: NULL keys meet each other, and no side has to fit in memory.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggregated)
    measures = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(
        *[F.coalesce(F.sum(m), F.lit(0)).cast(merged.schema[m].dataType).alias(m) for m in measures]
    )
