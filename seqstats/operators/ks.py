"""Two-sample Kolmogorov–Smirnov statistics as counts, running sums and joins.

Distribution functions are compared as integers: with running counts ``a`` of ``n`` and
``b`` of ``m`` the difference is ``a*m - b*n`` over ``n*m``. The statistic and the sign
therefore do not depend on rounding or on the order of summation.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seqstats.operators.distributions import metric_values
from seqstats.operators.filters import check_choice
from seqstats.operators.shaping import METRICS

# Tasks get the p-value function itself, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

# A running sum is taken within value ranges of one group and the ranges' totals are added. A range has about so many values.
RANGE_ROWS = 65_536
# Ranges that a group is cut into at most, a square.
MOST_RANGES = 2_304
# Ranks of the bounds are right to one part in so many.
RANK_PARTS = 10_000
# Fixed value, the default of a parameter: samples up to this size get the exact p-value under ``auto``.
EXACT_LIMIT = 10_000
# Numbers of lattice points that are advanced together.
LATTICE_POINTS = 16_384
# A test with more points within reach of the diagonal is advanced alone, and so are fewer tests than these.
WIDE_POINTS, FEW_TESTS = 512, 8
# What stands for a share of 1 there, so that no share that counts is too small for a whole number of digits.
WHOLE = 2.0**1000
# Smaller numbers become 0 every so many steps: below 1e-500 of a path, and slow to reckon with if they go on shrinking.
NEGLIGIBLE, SWEEP = 1e-200, 32


def ranged(counts: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The rows with the number of their value range within their group, ascending with the value; NULL goes to the first.

    Every group has a quantile sketch of its own, made per task and merged, and is cut into as many ranges of equal
    weight as its size asks for: a small group is one range, a hot one at most ``MOST_RANGES``, each of about ``RANGE_ROWS``
    rows or a thousandth part of it at most. What is broadcast are the bounds of large groups: one number for ``RANGE_ROWS``
    values, so eight bytes for half a megabyte of them, and no more than ``MOST_RANGES`` a group. Results are the same for any cut. Values are those with a count in ``cols``; reading the
    counts lets the sketches share the shuffle of the counts.
    """
    shares = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    present = F.when(sum(F.col(c) for c in cols) > 0, F.col("value"))
    large = counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.count(present).alias("_size"), F.percentile_approx(present, shares, RANK_PARTS).alias("_all")
    ).where(F.col("_size") > RANGE_ROWS)
    # Every so many bounds, so that there are as many ranges as the size asks for.
    step = F.greatest(F.lit(1), F.floor(MOST_RANGES * float(RANGE_ROWS) / F.col("_size"))).cast("int")
    large = large.withColumn("_bounds", F.filter("_all", lambda b, i: (i + 1) % step == 0)).drop("_all", "_size")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    number = F.when(F.col("value").isNull() | F.col("_bounds").isNull(), 0).otherwise(_bounds_below("_bounds", F.col("value")))
    joined = counts.join(F.broadcast(large), same, "left").withColumn("_range", number)
    return joined.drop("_bounds", *[f"_k_{k}" for k in keys])


def _bounds_below(bounds: str, value: Column) -> Column:
    """How many of the ascending bounds are below a value: first whole blocks of them, then within one block."""
    width = int(MOST_RANGES**0.5)
    lasts = F.filter(F.col(bounds), lambda b, i: (i + 1) % width == 0)
    blocks = F.size(F.filter(lasts, lambda b: b < value))
    inside = F.slice(F.col(bounds), blocks * width + 1, F.lit(width))
    return blocks * width + F.size(F.filter(inside, lambda b: b < value))


def running_counts(counts: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Add running sums ``{c}_cum`` by ``value`` and totals ``{c}_total`` to counts per value.

    Each group is cut into value ranges, so no task sorts a hot group alone.
    """
    counts = ranged(counts, keys, cols)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    per_range = counts.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    per_range = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in cols],
        *[F.sum(f"_{c}").over(group).alias(f"{c}_total") for c in cols],
    )
    within = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inner = counts.withColumns({f"_{c}_within": F.sum(c).over(within) for c in cols})
    added = {f"{c}_cum": F.col(f"_{c}_before") + F.col(f"_{c}_within") for c in cols}
    helpers = ["_range"] + [f"_{c}_{part}" for c in cols for part in ("before", "within")]
    return inner.join(per_range, [*keys, "_range"]).withColumns(added).drop(*helpers)


def _statistic(df: DataFrame, keys: list[str], above: Column, below: Column, n: str, m: str) -> DataFrame:
    """Statistic and sign from the differences above and below, as integers over n*m."""
    peaks = df.groupBy(*keys).agg(
        F.max(above).alias("_above"), F.max(below).alias("_below"), F.max(n).alias("n"), F.max(m).alias("m")
    )
    larger = F.greatest("_above", "_below")
    tested = (F.col("n") > 0) & (F.col("m") > 0)
    return peaks.select(
        *keys,
        "n",
        "m",
        F.when(tested, larger / (F.col("n").cast("double") * F.col("m"))).alias("stat"),
        F.when(tested, F.when(F.col("_below") > F.col("_above"), -1).otherwise(1)).alias("sign"),
    )


def ks_two_sample(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Statistic and sign per key for two samples; NULL where one of them is empty.

    The sign is +1 where the first sample's distribution function is above the second's
    at the largest difference (also in a tie), else -1.
    """
    both = a.select(*keys, F.col(value).alias("value"), F.lit(1).alias("_a")).unionByName(
        b.select(*keys, F.col(value).alias("value"), F.lit(0).alias("_a"))
    )
    present = F.col("value").isNotNull()
    counts = both.groupBy(*keys, "value").agg(
        F.count_if(present & (F.col("_a") == 1)).alias("a"), F.count_if(present & (F.col("_a") == 0)).alias("b")
    )
    running = running_counts(counts, keys, ["a", "b"])
    difference = F.col("a_cum") * F.col("b_total") - F.col("b_cum") * F.col("a_total")
    return _statistic(running, keys, difference, -difference, "a_total", "b_total")


def ks_subset(df: DataFrame, keys: list[str], group: str, value: str = "value") -> DataFrame:
    """Each group's sample against the whole it is part of, per key.

    Rows without a group count for the whole only. The largest difference lies at one of
    the group's own values or just before it, so the two running counts are compared there:
    both are taken within value ranges of a key, and the counts of the ranges below are added.
    """
    # Rows without a key have no test. They go first and all at once, and the joins below compare keys null-safely: a filter on
    # a single key, which Spark infers from a plain comparison, would tell the counts' uses apart, and each would count anew.
    df = df.dropna(subset=keys)
    counts = df.groupBy(*keys, group, F.col(value).alias("value")).agg(F.count(value).alias("s"))
    counts = ranged(counts, keys, ["s"])

    cells = counts.groupBy(*keys, group, "_range").agg(F.sum("s").alias("_cell"))
    whole = Window.partitionBy(*keys)
    part = Window.partitionBy(*keys, group)
    ranges_below = (Window.unboundedPreceding, -1)
    below = cells.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(group).alias("_group"),
        F.col("_range").alias("_below"),
        F.coalesce(F.sum("_cell").over(whole.orderBy("_range").rangeBetween(*ranges_below)), F.lit(0)).alias("_f_below"),
        F.coalesce(F.sum("_cell").over(part.orderBy("_range").rangeBetween(*ranges_below)), F.lit(0)).alias("_s_below"),
        F.sum("_cell").over(whole).alias("m"),
        F.sum("_cell").over(part).alias("n"),
    )

    in_range = Window.partitionBy(*keys, "_range")
    counts = counts.withColumns(
        {
            "_f_within": F.sum("s").over(in_range.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)),
            "_f_at": F.sum("s").over(Window.partitionBy(*keys, "_range", "value")),
            "_s_within": F.sum("s").over(
                Window.partitionBy(*keys, "_range", group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    ).where(F.col(group).isNotNull())
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    at = counts.join(below, [*same, F.col(group) == F.col("_group"), F.col("_range") == F.col("_below")])
    f, s = F.col("_f_below") + F.col("_f_within"), F.col("_s_below") + F.col("_s_within")
    above = s * F.col("m") - f * F.col("n")
    under = (f - F.col("_f_at")) * F.col("n") - (s - F.col("s")) * F.col("m")
    return _statistic(at, [*keys, group], above, under, "n", "m")


def ks_pvalue(d: Column, n: Column, m: Column, method: str = "auto", exact_limit: int = EXACT_LIMIT) -> Column:
    """Two-sided p-value of statistic ``d`` for samples of ``n`` and ``m`` values.

    ``auto`` is ``exact`` for samples of up to ``exact_limit`` values and ``finite`` beyond it, ``asymp`` is the limit
    for large samples. Every test with a statistic and two samples has a p-value by every method.
    """
    check_choice("method", method, ("auto", "exact", "finite", "asymp"))
    n, m = n.cast("double"), m.cast("double")
    pooled = n * m / (n + m)
    if method == "asymp":
        return F.when(d.isNotNull(), _limit_tail(d * F.sqrt(pooled)))
    if method == "exact":
        return _exact_tail(d, n, m)
    finite = F.when(d.isNotNull(), _finite_tail(d, F.rint(pooled)))
    if method == "finite":
        return finite
    small = F.greatest(n, m) <= exact_limit
    return F.when(small, _exact_tail(F.when(small, d), n, m)).otherwise(finite)


def _series(first: int, last: int, term) -> Column:
    return F.aggregate(
        F.sequence(F.lit(first), F.lit(last)), F.lit(0.0), lambda total, k: total + term(k.cast("double"))
    )


def _limit_tail(z: Column) -> Column:
    """Tail of Kolmogorov's limit distribution.

    Below 0.2 it is 1 to twelve digits; from there on the terms after the 25th are below 1e-20.
    """
    total = _series(1, 25, lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z))
    return F.when(z < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def _finite_tail(d: Column, size: Column) -> Column:
    """Tail of the one-sample statistic for ``size`` values.

    Pelz and Good's expansion in the body, the one-sided asymptotic tail doubled beyond it
    (both as given by Simard and L'Ecuyer, 2011).
    """
    z = d * F.sqrt(size)
    pi2 = float(np.pi**2)
    z2 = z * z

    def half(term) -> Column:
        """Sum over k + 1/2 for all whole k; ``q`` is the square of pi*(k + 1/2)."""

        def at(k: Column) -> Column:
            q = F.pow(k - 0.5, F.lit(2.0)) * pi2
            return 2.0 * term(q) * F.exp(-q / (2 * z2))

        return _series(1, 12, at)

    def whole(term) -> Column:
        def at(k: Column) -> Column:
            q = k * k * pi2
            return 2.0 * term(q) * F.exp(-q / (2 * z2))

        return _series(1, 12, at)

    root = float(np.sqrt(np.pi / 2))
    z4, z6, z8 = z2 * z2, z2 * z2 * z2, z2 * z2 * z2 * z2
    k0 = 2 * root / z * half(lambda q: F.lit(0.5))
    k1 = root / (6 * z4) * half(lambda q: q - z2)
    k2 = root / (72 * z6 * z) * half(
        lambda q: 6 * z6 + 2 * z4 + (2 * z4 - 5 * z2) * q + (1 - 2 * z2) * q * q
    ) - root / (36 * z2 * z) * whole(lambda q: q)
    k3 = root / (6480 * z8 * z2) * half(
        lambda q: (5 - 30 * z2) * q * q * q + (212 * z4 - 60 * z2) * q * q + (135 * z4 - 96 * z6) * q - 30 * z6 - 90 * z8
    ) + root / (108 * z6) * whole(lambda q: 3 * z2 * q - q * q)
    body = 1.0 - (k0 + k1 / F.sqrt(size) + k2 / size + k3 / (size * F.sqrt(size)))
    far = 2.0 * F.exp(-F.pow(6 * size * d + 1, F.lit(2.0)) / (18 * size))
    tail = F.when(z < 0.2, F.lit(1.0)).when(z2 > 9.0, far).otherwise(body)
    return F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))


@F.pandas_udf(DoubleType())
def _exact_tail(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    tests = pd.DataFrame({"d": d, "n": n, "m": m}).dropna()
    tests = tests[(tests["n"] > 0) & (tests["m"] > 0)]
    tails = pd.Series(np.nan, index=d.index).astype(object)
    tails[:] = None
    if len(tests):
        kinds, of = np.unique(tests.to_numpy(float), axis=0, return_inverse=True)
        tails[tests.index] = lattice_tails(*kinds.T)[of.ravel()]
    return tails


def lattice_tails(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shares of the orderings of ``n`` and ``m`` values whose statistic is at least ``d``, many tests at once.

    An ordering is a lattice path from (0, 0) to (n, m), and its statistic reaches ``d`` if it touches a point that is far
    enough off the diagonal. Of all paths to a point, the share that already did is the mean of the shares at the two
    points before it, weighted by how many paths come from each; shares never leave 0..1, so no size is too large.
    """
    n, m = np.minimum(n, m).astype(np.int64), np.maximum(n, m).astype(np.int64)
    reach = np.rint(d * n * m).astype(np.int64)
    tails = np.ones(len(d))
    open_tests = np.flatnonzero(reach > 0)
    order = open_tests[np.lexsort((n[open_tests], m[open_tests]))]
    # the points within reach of the diagonal are the ones to advance
    wide = np.minimum(2 * reach // (n + m) + 3, n + 1) > WIDE_POINTS
    for test in order[wide[order]]:
        tails[test] = _advanced_alone(int(n[test]), int(m[test]), int(reach[test]))
    order = order[~wide[order]]
    start = 0
    while start < len(order):
        width = np.minimum(2 * reach[order[start:]] // (n + m)[order[start:]] + 3, n[order[start:]] + 1)
        size = max(1, int(np.searchsorted(np.maximum.accumulate(width) * np.arange(1, len(width) + 1), LATTICE_POINTS)))
        block = order[start : start + size]
        if len(block) < FEW_TESTS:
            tails[block] = [_advanced_alone(int(n[i]), int(m[i]), int(reach[i])) for i in block]
        else:
            tails[block] = _advanced(n[block], m[block], reach[block])
        start += size
    return tails


def _advanced(n: np.ndarray, m: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The shares at (n, m) of a block of tests, advanced by one step of all paths at a time."""
    both, most = n + m, int(n.max())
    tails = np.empty(len(n))
    i = np.arange(most + 1)
    offsets = i[None, :] * both[:, None]
    hit = np.ones((len(n), most + 1))  # beyond the reach every path has touched
    hit[:, 0] = 0.0
    for step in range(1, int(both.max()) + 1):
        low = max(0, int(((step * n - reach) // both).min()))
        high = min(most, step, int(((step * n + reach) // both).max()) + 1)
        here = slice(low, high + 1)
        moved = hit[:, here] * ((step - i[here]) / step)
        before = slice(max(low, 1) - 1, high)
        moved[:, (low == 0) :] += hit[:, before] * (i[max(low, 1) : high + 1] / step)
        moved[np.abs(offsets[:, here] - step * n[:, None]) >= reach[:, None]] = 1.0
        hit[:, here] = moved
        if low:
            hit[:, low - 1] = 1.0
        if (done := both == step).any():
            tails[done] = hit[done, n[done]]
    return np.minimum(tails, 1.0)


def _advanced_alone(n: int, m: int, reach: int) -> float:
    """The share at (n, m) of one test: only the points between the two lines that it must touch, each step in place."""
    both = n + m
    if _vanishes(n, m, reach):
        return 0.0
    hit = np.full(n + 2, WHOLE)
    hit[0] = 0.0
    moved, up, down = np.empty(n + 1), np.arange(n + 1.0), np.arange(both, -1.0, -1.0)
    for step in range(1, both + 1):
        low = max(0, step - m, (step * n - reach) // both + 1)
        high = min(n, step, (step * n + reach - 1) // both)
        here, other = hit[low : high + 1], moved[: high + 1 - low]
        if low:
            np.multiply(hit[low - 1 : high], up[low : high + 1], out=other)
        else:
            other[0] = 0.0
            np.multiply(hit[:high], up[1 : high + 1], out=other[1:])
        here *= down[both - step + low : both - step + high + 1]
        here += other
        here *= 1.0 / step
        if low:
            hit[low - 1] = WHOLE
        if step % SWEEP == 0:
            here[here < NEGLIGIBLE] = 0.0
    return min(hit[n] / WHOLE, 1.0)


def _vanishes(n: int, m: int, reach: int) -> bool:
    """Whether the share is 0 as a number of double precision, by a bound: what passes through each point of the two lines, in sum."""
    both = n + m
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, both + 1)))])

    def ways(total: np.ndarray | int, part: np.ndarray) -> np.ndarray:
        return logs[total] - logs[part] - logs[total - part]

    step = np.arange(both + 1)
    most = -np.inf
    for line in ((step * n + reach - 1) // both + 1, (step * n - reach) // both):
        there = (line >= 0) & (line <= n) & (step - line >= 0) & (step - line <= m)
        if there.any():
            through = ways(n, line[there]) + ways(m, (step - line)[there]) - ways(both, step[there])
            most = max(most, float(through.max()))
    # the least number above 0 is e^-744.4; the logs are right to far less than the rest
    return most + np.log(2.0 * both) < -760


def with_pvalue(tested: DataFrame, method: str = "auto", exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Tests with their ``p_value``.

    Exact p-values are little data and much work: they are dealt over all cores by the test itself, so equal tests meet in
    one task and are worked out once, and a task's tests are put in the order of their sizes, so that neighbours are
    advanced together. There are several tasks a core, since a few large tests may be all there is: they seldom share a task.
    """
    p_value = ks_pvalue(F.col("stat"), F.col("n"), F.col("m"), method, exact_limit)
    if method not in ("auto", "exact"):
        return tested.withColumn("p_value", p_value)
    tasks = 8 * tested.sparkSession.sparkContext.defaultParallelism
    return tested.repartition(tasks, "stat", "n", "m").sortWithinPartitions("m", "n", "stat").withColumn("p_value", p_value)


def ks_test(df: DataFrame, method: str = "auto", exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Every country's players against all players, per opening and metric.

    One row per opening and country with ``{metric}_stat``, ``_p_value`` and ``_sign``.
    """
    tested = ks_subset(metric_values(df, ["matched_id", "country"]), ["matched_id", "metric"], "country")
    tested = with_pvalue(tested, method, exact_limit)
    wide = []
    for metric in METRICS:
        for part in ("stat", "p_value", "sign"):
            wide.append(F.max(F.when(F.col("metric") == metric, F.col(part))).alias(f"{metric}_{part}"))
    return tested.groupBy("matched_id", "country").agg(*wide)
