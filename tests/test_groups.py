import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickstand.functions import groups as G
from tests.conftest import tuples


@pytest.mark.parametrize("bucket", [None, 10, 1000])
def test_percentiles_match_sorting(rows, bucket):
    rng = random.Random(7)
    # group "hot" holds most rows; "one" has a single row; a NULL group counts like any other
    data = [("hot", rng.randrange(5000)) for _ in range(3000)]
    data += [("few", rng.randrange(50)) for _ in range(31)] + [("one", 42)] + [(None, 5), (None, 6)]
    counted = rows("g string, v bigint", *data).groupBy("g", "v").agg(F.count("*").alias("n"))
    ranked = G.rank_values(counted, ["g"], "v", bucket=bucket)
    got = ranked.groupBy("g").agg(
        F.sum("n").alias("rows"), G.percentile_of("v", 5, 10).alias("p50"), G.percentile_of("v", 9, 10).alias("p90")
    )
    want = {}
    for group in {g for g, _ in data}:
        values = np.array([v for g, v in data if g == group]) / 10
        want[group] = (len(values), *[round(float(np.percentile(values, p)), 4) for p in (50, 90)])
    assert {r[0]: tuple(r[1:]) for r in tuples(got)} == want


def test_bucketed_percentiles_keep_other_sums(rows):
    counted = rows("g string, v bigint, n bigint, extra bigint", ("a", 5, 2, 7), ("a", 25, 1, 1))
    ranked = G.rank_values(counted, ["g"], "v", bucket=10)
    assert sorted(tuples(ranked, "v", "n", "extra", "below", "group_rows")) == [(5, 2, 7, 0, 3), (25, 1, 1, 2, 3)]


FLOORS = {"a": 0.3, "b": 0.2}


def test_floors_lift_and_sum_to_one(rows):
    df = rows("g int, k string, w double", (1, "a", 0.0), (1, "b", 3.0), (1, "c", 1.0), (2, "a", 5.0), (3, "a", 0.0),
              (3, "b", 0.0), (4, "a", -2.0), (4, "c", 4.0))
    got = {(g, k): s for g, k, _, s in tuples(G.normalize_with_floors(df, ["g"], "k", "w", FLOORS))}
    assert got[1, "a"] == pytest.approx(0.3)
    assert got[1, "b"] == pytest.approx(0.2 + 0.5 * 0.75)
    assert got[1, "c"] == pytest.approx(0.5 * 0.25)
    assert got[2, "a"] == pytest.approx(1.0)
    # no weight at all: the floors alone are scaled up
    assert got[3, "a"] == pytest.approx(0.6)
    assert got[3, "b"] == pytest.approx(0.4)
    # negative weights count as zero
    assert got[4, "a"] == pytest.approx(0.3)
    for group in (1, 2, 3, 4):
        assert sum(s for (g, _), s in got.items() if g == group) == pytest.approx(1.0)


def test_floored_shares_agree_with_rows(rows):
    shares = G.floored_shares({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, FLOORS)
    df = rows("a double, b double, c double", (0.0, 3.0, 1.0), (0.0, 0.0, 0.0))
    first, empty = tuples(df.select(*[shares[k] for k in "abc"]))
    assert first == pytest.approx((0.3, 0.575, 0.125))
    assert empty == pytest.approx((0.6, 0.4, 0.0))


def test_merge_measures_meets_null_keys(rows):
    left = rows("k string, x bigint", ("a", 1), (None, 2))
    right = rows("k string, y double", ("b", 0.5), (None, 1.5))
    assert sorted(tuples(G.merge_measures(["k"], left, right)), key=str) == sorted(
        [("a", 1, 0.0), ("b", 0, 0.5), (None, 2, 1.5)], key=str
    )
