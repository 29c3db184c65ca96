"""Measures that do not add up, kept as states that do: distinct sketches, quantile sketches, cubes of any measure.

A sketch of a day is a few kilobytes whatever the day's rows. Days are merged to weeks and months, areas and vendors
to the whole, without reading an event again; the stored states are all that a report needs.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from kickstand.functions import columns as X
from kickstand.functions import groups as G

#: Sizes of the sketches, and the relative error of a distinct count and the rank error of a quantile they promise.
LG_DISTINCT, QUANTILE_K = 14, 800
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.01
GRAINS = {"day": X.as_col, "week": X.week_start, "month": X.month_start}


# --- sketches ---------------------------------------------------------------------


def daily_states(events, time_col, keys=(), distinct=(), quantiles=()):
    """Per day and `keys`: `rows`, a distinct sketch per column of `distinct` (`d_<name>`), and a quantile sketch
    per integer column of `quantiles` (`q_<name>`). Sketches are merged before the shuffle, so a hot day is no hot task."""
    sketches = [F.hll_sketch_agg(F.col(c), F.lit(LG_DISTINCT)).alias(f"d_{c}") for c in distinct]
    sketches += [F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), F.lit(QUANTILE_K)).alias(f"q_{c}") for c in quantiles]
    return events.groupBy(F.to_date(time_col).alias("day"), *keys).agg(F.count("*").alias("rows"), *sketches)


def roll_up(states, grain="day", keys=()):
    """States of a coarser grain from stored ones: `start` of the day, week or month, and fewer keys."""
    merged = [F.hll_union_agg(c).alias(c) for c in states.columns if c.startswith("d_")]
    merged += [F.kll_merge_agg_bigint(c).alias(c) for c in states.columns if c.startswith("q_")]
    return states.groupBy(GRAINS[grain](F.col("day")).alias("start"), *keys).agg(X.total("rows").alias("rows"), *merged)


def distinct_estimate(name):
    return F.hll_sketch_estimate(f"d_{name}")


def quantile_estimate(name, rank):
    return F.kll_sketch_get_quantile_bigint(F.col(f"q_{name}"), F.lit(float(rank)))


def distinct_by_grain(events, states, time_col, id_col):
    """Distinct ids per day, week and month: the exact count, the estimate of the rolled-up states, and whether
    they differ by no more than DISTINCT_ERROR."""
    out = None
    for grain, start_of in GRAINS.items():
        # distinct and count, so that the ids of a busy month are spread over tasks
        ids = events.select(start_of(F.to_date(time_col)).alias("start"), id_col).distinct()
        exact = ids.groupBy("start").agg(F.count(id_col).alias("exact"))
        rolled = roll_up(states, grain).select("start", "rows", distinct_estimate(id_col).alias("estimate"))
        part = G.merge_measures(["start"], rolled, exact).withColumn("grain", F.lit(grain))
        out = part if out is None else out.unionByName(part)
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * F.lit(DISTINCT_ERROR))
    return out.select("grain", "start", "rows", "exact", "estimate", close.alias("within_error"))


def quantile_ranks(events, estimates, keys, value, names):
    """How estimates of quantiles rank among the values: per key `n`, and for each estimate (a column name) the
    values below it and up to it."""
    counted = events.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    held = [f"_key{i}" for i in range(len(keys))]
    named = estimates.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], *names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, held, strict=True)])
    joined = counted.join(named, same)
    sides = []
    for name in names:
        sides += [
            F.coalesce(X.total(F.when(F.col(value) < F.col(name), F.col("_n"))), F.lit(0)).alias(f"{name}_below"),
            F.coalesce(X.total(F.when(F.col(value) <= F.col(name), F.col("_n"))), F.lit(0)).alias(f"{name}_upto"),
        ]
    return joined.groupBy(*keys).agg(X.total("_n").alias("n"), *sides, *[F.first(n).alias(n) for n in names])


def rank_holds(name, rank, error=RANK_ERROR):
    """Whether the rank of an estimate lies within `error` of the wanted one."""
    low, high = F.col(f"{name}_below") / F.col("n"), F.col(f"{name}_upto") / F.col("n")
    return (low <= F.lit(rank + error)) & (high >= F.lit(rank - error))


# --- cubes ------------------------------------------------------------------------


def cube_of(df, dims, additive=None, ratios=None, distinct=None, percentiles=None):
    """Any measures over every combination of dimensions, exactly, with a flag per rolled-up dimension.

    additive: name -> aggregate that sums up; ratios: name -> (numerator, denominator, places) of such aggregates;
    distinct: name -> id column; percentiles: name -> (integer column, tenths, unit).

    Each measure is carried as a state that adds up: sums as they are, distinct ids as the set of (dimensions, id),
    percentiles as counts per value. The state meets the grouping sets after it was aggregated at the full grain, ids and
    values stay grouping keys until the last step, and so neither the grand total nor a hot cell is one task.
    """
    additive, ratios = dict(additive or {}), dict(ratios or {})
    flags = [f"{d}_all" for d in dims]
    keys = [*dims, *flags]
    sums = dict(additive)
    for name, (top, bottom, _) in ratios.items():
        sums |= {f"_{name}_top": top, f"_{name}_bottom": bottom}
    parts = []
    if sums:
        base = df.groupBy(*dims).agg(*[expr.alias(name) for name, expr in sums.items()])
        parts.append(_over_cube(base, dims, [], [F.sum(n).cast(base.schema[n].dataType).alias(n) for n in sums]))
    for name, column in (distinct or {}).items():
        held = df.filter(F.col(column).isNotNull()).select(*dims, F.col(column).alias("_id")).distinct()
        parts.append(_over_cube(held, dims, ["_id"], []).groupBy(*keys).agg(F.count("*").alias(name)))
    for column, wanted in _by_value(percentiles or {}).items():
        counted = df.filter(F.col(column).isNotNull()).groupBy(*dims, F.col(column).alias("_value")).agg(F.count("*").alias("n"))
        ranked = G.rank_values(_over_cube(counted, dims, ["_value"], [X.total("n").alias("n")]), keys, "_value")
        parts.append(ranked.groupBy(*keys).agg(*[G.percentile_of("_value", tenths, unit).alias(n) for n, tenths, unit in wanted]))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = merged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in merged.columns if c not in keys])
    found = [F.coalesce(n, F.lit(0)).cast(merged.schema[n].dataType).alias(n) for n in [*additive, *(distinct or {})]]
    found += [X.exact_ratio(f"_{n}_top", f"_{n}_bottom", places).alias(n) for n, (_, _, places) in ratios.items()]
    return merged.select(*keys, *found, *(percentiles or {}))


def _by_value(percentiles):
    out = {}
    for name, (column, tenths, unit) in percentiles.items():
        out.setdefault(column, []).append((name, tenths, unit))
    return out


def _over_cube(df, dims, kept, aggregates):
    """`df` over all subsets of `dims`; the columns `kept` stay keys in each of them."""
    sets = [[*some, *kept] for size in range(len(dims) + 1) for some in combinations(dims, size)]
    flags = [F.grouping(d).cast("int").alias(f"{d}_all") for d in dims]
    return df.groupingSets(sets, *dims, *kept).agg(*flags, *aggregates)
