"""Kolmogorov–Smirnov statistics and p-values against brute force."""

import functools
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from seqstats.catalog import queries
from seqstats.catalog.fixture import Inputs
from seqstats.catalog.queries import QUERIES
from seqstats.operators import ks
from seqstats.operators.counts import COUNTS
from seqstats.operators.distributions import distribution_arrays, distributions, metric_values
from seqstats.operators.ks import ks_pvalue, ks_subset, ks_test, ks_two_sample, lattice_tails, ranged, with_pvalue
from seqstats.operators.probabilities import player_probabilities
from seqstats.operators.shaping import METRICS


def brute(a, b):
    """Statistic and sign, with exact fractions."""
    if not a or not b:
        return None, None
    gaps = [Fraction(sum(x <= v for x in a), len(a)) - Fraction(sum(x <= v for x in b), len(b)) for v in {*a, *b}]
    high, low = max(gaps), -min(gaps)
    return float(max(high, low, 0)), -1 if low > high else 1


def close(found, wanted):
    return found == wanted or (found is not None and wanted is not None and abs(found - wanted) < 1e-12)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(11)
    draw = lambda: rng.choice([0.0, 1.0, 0.5, None, rng.random(), rng.random() ** 4, rng.randrange(9) / 8, -3.0, 7.5])
    table = [(f"k{i % 3}", rng.choice(["x", "y", None]), draw()) for i in range(600)]
    return table + [("hot", "x", 0.25)] * 300 + [("hot", None, 0.25)] * 10 + [("empty", "x", None), ("empty", None, 0.5)]


def test_subset_against_brute_force(spark, values):
    df = spark.createDataFrame(values, "k STRING, g STRING, value DOUBLE")
    found = {(r["k"], r["g"]): r for r in ks_subset(df, ["k"], "g").collect()}
    assert set(found) == {(k, g) for k, g, _ in values if g}
    for (key, group), row in found.items():
        part = [v for k, g, v in values if k == key and g == group and v is not None]
        whole = [v for k, _, v in values if k == key and v is not None]
        stat, sign = brute(part, whole)
        assert (row["n"], row["m"], row["sign"]) == (len(part), len(whole), sign)
        assert close(row["stat"], stat)


def test_two_sample_against_brute_force(spark, values):
    df = spark.createDataFrame(values, "k STRING, g STRING, value DOUBLE")
    found = ks_two_sample(df.where("g = 'x'"), df.where("g = 'y'"), ["k"])
    for row in found.collect():
        a, b = ([v for k, g, v in values if k == row["k"] and g == s and v is not None] for s in "xy")
        stat, sign = brute(a, b)
        assert row["sign"] == sign and close(row["stat"], stat)


def test_tie_is_positive(spark):
    a = spark.createDataFrame([("k", 0.1), ("k", 0.9)], "k STRING, value DOUBLE")
    b = spark.createDataFrame([("k", 0.5), ("k", 0.5)], "k STRING, value DOUBLE")
    row = ks_two_sample(a, b, ["k"]).first()
    assert (row["stat"], row["sign"]) == (0.5, 1)


def share_at_least(n, m, reach):
    """Share of all orderings whose largest |i*m - j*n| is at least ``reach``."""
    hits = total = 0
    for ups in itertools.combinations(range(n + m), n):
        i = j = largest = 0
        for step in range(n + m):
            i, j = (i + 1, j) if step in ups else (i, j + 1)
            largest = max(largest, abs(i * m - j * n))
        hits, total = hits + (largest >= reach), total + 1
    return hits / total


def test_exact_pvalue_counts_orderings(spark):
    cases = [(n, m, k) for n, m in ((1, 1), (1, 5), (3, 4), (4, 3), (5, 5), (6, 2)) for k in range(n * m + 1)]
    df = spark.createDataFrame([(k / (n * m), n, m) for n, m, k in cases] + [(None, 3, 4)], "d DOUBLE, n BIGINT, m BIGINT")
    tail = ks_pvalue(F.col("d"), F.col("n"), F.col("m"), "exact")
    found = [r[0] for r in df.select(tail).collect()]
    for (n, m, k), p in zip(cases, found):
        assert p == pytest.approx(share_at_least(n, m, k), abs=1e-12)
    assert found[-1] is None


def diagonal_tail(n, m, reach):
    """The same share by recursion over the diagonals, each point a mean of its predecessors."""
    i = np.arange(n + 1)
    hit = np.zeros(n + 1)
    for step in range(1, n + m + 1):
        moved = hit * (step - i) / step
        moved[1:] += hit[:-1] * i[1:] / step
        moved[np.abs(i * m - (step - i) * n) >= reach] = 1.0
        hit = moved
    return hit[n]


def test_exact_pvalue_of_larger_samples(spark):
    rng = random.Random(1)
    cases = [(n, m, rng.uniform(0.3, 2.5) * math.sqrt((n + m) / (n * m))) for n, m in ((40, 1500), (300, 300), (77, 901)) for _ in range(9)]
    df = spark.createDataFrame([(d, n, m) for n, m, d in cases], "d DOUBLE, n BIGINT, m BIGINT")
    found = [r[0] for r in df.select(ks_pvalue(F.col("d"), F.col("n"), F.col("m"), "exact")).collect()]
    for (n, m, d), p in zip(cases, found):
        assert p == pytest.approx(diagonal_tail(n, m, round(d * n * m)), rel=1e-8)


def matrix_tail(size, d):
    """Exact one-sample tail by the matrix power of Marsaglia, Tsang and Wang."""
    k = int(size * d) + 1
    width, h = 2 * k - 1, k - size * d
    table = np.array([[float(i - j + 1 >= 0) for j in range(width)] for i in range(width)])
    for i in range(width):
        table[i, 0] -= h ** (i + 1)
        table[width - 1, i] -= h ** (width - i)
    table[width - 1, 0] += max(2 * h - 1, 0.0) ** width
    for i, j in itertools.product(range(width), repeat=2):
        if i - j + 1 > 0:
            table[i, j] /= math.factorial(i - j + 1)
    value = np.linalg.matrix_power(table / math.e, size)[k - 1, k - 1]
    return 1 - value * math.exp(math.lgamma(size + 1) - size * math.log(size) + size)


def test_finite_pvalue(spark):
    cases = [(400, z / 20) for z in (0.5, 0.8, 1.2, 1.6, 1.9)]
    df = spark.createDataFrame([(d, 2 * n, 2 * n) for n, d in cases], "d DOUBLE, n BIGINT, m BIGINT")
    found = [r[0] for r in df.select(ks_pvalue(F.col("d"), F.col("n"), F.col("m"), "finite")).collect()]
    for (n, d), p in zip(cases, found):
        assert p == pytest.approx(matrix_tail(n, d), abs=2e-6)


def test_auto_switches_at_the_limit(spark):
    df = spark.createDataFrame([(0.05, 10_000, 300), (0.05, 10_001, 300)], "d DOUBLE, n BIGINT, m BIGINT")
    d, n, m = F.col("d"), F.col("n"), F.col("m")
    p = df.select(*[ks_pvalue(d, n, m, k) for k in ("auto", "exact", "finite")]).collect()
    assert p[0][0] == p[0][1] and p[1][0] == p[1][2]
    assert p[0][1] == pytest.approx(p[0][2], abs=0.02)


def test_large_sample_limit(spark):
    """Known points of the limit distribution."""
    df = spark.createDataFrame([(1.3581,), (1.6276,), (0.05,), (9.0,)], "z DOUBLE")
    tail = ks_pvalue(F.col("z") / 1000, F.lit(2_000_000), F.lit(2_000_000), "asymp")
    assert [r[0] for r in df.select(tail).collect()] == pytest.approx([0.05, 0.01, 1.0, 0.0], abs=1e-5)


@pytest.mark.parametrize("method", ["auto", "exact", "finite", "asymp"])
def test_no_statistic_no_pvalue(spark, method):
    df = spark.createDataFrame([(None, 0, 7), (None, None, 7)], "d DOUBLE, n BIGINT, m BIGINT")
    assert [r[0] for r in df.select(ks_pvalue(F.col("d"), F.col("n"), F.col("m"), method)).collect()] == [None, None]


def test_unknown_method():
    with pytest.raises(ValueError):
        ks_pvalue(None, None, None, "best")


def players(spark):
    rng = random.Random(5)
    table = [
        (f"p{i}", rng.choice("ab"), rng.choice(["AA", "BB", None]), rng.random(), rng.random(), rng.choice([None, 0.5]), None)
        for i in range(400)
    ]
    return spark.createDataFrame(
        table, "id STRING, matched_id STRING, country STRING, p_w DOUBLE, p_b DOUBLE, p_won_w DOUBLE, p_won_b DOUBLE"
    )


def test_ks_test_columns(spark):
    found = ks_test(players(spark))
    assert found.count() == 4
    for row in found.collect():
        assert row["p_won_b_stat"] is None and row["p_won_b_p_value"] is None and row["p_won_b_sign"] is None
        assert row["p_won_w_stat"] == 0 and row["p_won_w_p_value"] == 1
        assert 0 < row["p_w_stat"] < 1 and 0 < row["p_w_p_value"] <= 1


@pytest.mark.parametrize("parts", [1, 7])
def test_distributions_are_whole(spark, parts):
    df = players(spark)
    arrays = distribution_arrays(df, ["matched_id"], "d", parts)
    assert arrays.count() == 2 * parts
    values = arrays.select("matched_id", F.explode("p_w_d").alias("v"))
    assert rows(values) == rows(df, "matched_id", "p_w")
    assert arrays.where(F.size("p_won_b_d") > 0).count() == 0
    counted = distributions(df, ["matched_id"])
    again = counted.where("metric = 'p_w'").select("matched_id", F.explode(F.array_repeat("value", F.col("players").cast("int"))).alias("v"))
    assert rows(again) == rows(df, "matched_id", "p_w")


def test_a_hot_group_of_any_scale_is_cut_into_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ks, "RANGE_ROWS", 300)
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 50.0 + 1).alias("value"), F.lit(1).alias("n"))
    cut = ranged(df, ["k"], ["n"]).groupBy(F.col("_range").alias("r")).agg(F.count("*").alias("n"), F.min("value"), F.max("value")).orderBy("r").collect()
    assert len(cut) >= 48 and max(r["n"] for r in cut) < 2_000
    assert all(a[3] < b[2] for a, b in zip(cut, cut[1:]))


def test_shares_of_very_different_tests_in_one_batch(spark):
    """Long and short tests advanced together, also where path counts are beyond a double's range."""
    rng = random.Random(6)
    cases = [(rng.randint(1, 60), rng.randint(1, 400), rng.uniform(0.01, 1)) for _ in range(60)] + [(3000, 5000, 0.05), (900, 900, 0.6), (1, 1, 0.0)]
    found = lattice_tails(*(np.array([c[k] for c in cases], float) for k in (2, 0, 1)))
    for (n, m, d), p in zip(cases, found):
        n, m = min(n, m), max(n, m)
        reach = round(d * n * m)
        assert p == pytest.approx(diagonal_tail(n, m, reach) if reach else 1.0, rel=1e-9)
    assert 0 < found[-2] < 1e-100


def test_short_limit_series_equals_the_long_one(spark):
    z = [0.2 + 0.02 * k for k in range(200)]
    df = spark.createDataFrame([(x,) for x in z], "z DOUBLE")
    found = [r[0] for r in df.select(ks_pvalue(F.col("z") / 1000, F.lit(2_000_000), F.lit(2_000_000), "asymp")).collect()]
    for x, p in zip(z, found):
        long = math.fsum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
        assert p == pytest.approx(min(max(long, 0), 1), rel=1e-9, abs=1e-12)


def test_equal_tests_share_one_p_value(spark):
    df = spark.createDataFrame([("a", 0.5, 4, 6), ("b", 0.5, 4, 6), ("c", None, 0, 6), ("d", 0.5, 30, 60)], "k STRING, stat DOUBLE, n BIGINT, m BIGINT")
    found = {r["k"]: r["p_value"] for r in with_pvalue(df, "auto", exact_limit=10).collect()}
    assert found["a"] == found["b"] == pytest.approx(share_at_least(4, 6, 12)) and found["c"] is None
    finite = df.select(ks_pvalue(F.col("stat"), F.col("n"), F.col("m"), "finite").alias("p")).collect()
    assert found["d"] == finite[3]["p"]


def test_ranges_follow_the_group(spark, monkeypatch):
    """A hot group is cut into ranges of a thousandth part at most, a small one not at all, and order is kept."""
    hot = spark.range(60_000).select(F.lit("hot").alias("k"), (F.pow(F.rand(1), F.lit(6.0)) * 100).alias("value"), F.lit(1).alias("n"))
    small = spark.range(300).select(F.lit("small").alias("k"), (F.col("id") / 7.0).alias("value"), F.lit(1).alias("n"))
    middle = spark.range(2_000).select(F.lit("middle").alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 800 + 0.5).alias("value"), F.lit(1).alias("n"))
    counts = hot.unionByName(small).unionByName(middle).persist()
    monkeypatch.setattr(ks, "RANGE_ROWS", 500)
    found = ks.ranged(counts, ["k"], ["n"])
    sizes = found.where("value IS NOT NULL").groupBy("k", "_range").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    by_key = {k: sorted((r["_range"], r["n"], r["low"], r["high"]) for r in sizes if r["k"] == k) for k in ("hot", "middle", "small")}
    assert len(by_key["small"]) == 1 and 3 <= len(by_key["middle"]) <= 5 and 100 <= len(by_key["hot"]) <= 130
    for ranges in by_key.values():
        assert all(a[3] < b[2] for a, b in zip(ranges, ranges[1:]))
    monkeypatch.setattr(ks, "RANGE_ROWS", 1)
    most = ks.ranged(counts.where("k = 'hot'"), ["k"], ["n"]).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert most <= 60_000 / 1_000
    counts.unpersist()


def test_statistics_do_not_depend_on_the_cut(spark, monkeypatch):
    df = spark.range(4_000).select((F.col("id") % 2).alias("k"), F.concat(F.lit("g"), F.col("id") % 5).alias("g"), F.floor(F.rand(3) * 500).cast("double").alias("value"))
    df = df.persist()
    whole = rows(ks.ks_subset(df, ["k"], "g"))
    halves = df.where("g < 'g2'"), df.where("g >= 'g2'")
    both = rows(ks.ks_two_sample(*halves, ["k"]))
    for size in (1, 90):
        monkeypatch.setattr(ks, "RANGE_ROWS", size)
        assert rows(ks.ks_subset(df, ["k"], "g")) == whole and rows(ks.ks_two_sample(*halves, ["k"])) == both
    df.unpersist()


def test_tests_are_read_once_and_equal_ones_worked_out_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ks, "lattice_tails", lambda d, n, m: calls.append(len(d)) or d * 0 + 0.5)
    import pandas as pd

    found = ks._exact_tail.func(pd.Series([0.5, 0.5, None, 0.25]), pd.Series([4.0, 4.0, 4.0, 4.0]), pd.Series([6.0, 6.0, 6.0, 8.0]))
    assert calls == [2] and found.tolist()[:2] == [0.5, 0.5] and found.tolist()[2] is None
    tested = spark.createDataFrame([("a", 0.5, 4, 6)], "k STRING, stat DOUBLE, n LONG, m LONG").groupBy("k", "n", "m").agg({"stat": "max"}).withColumnRenamed("max(stat)", "stat")
    plan = ks.with_pvalue(tested, "exact")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@functools.cache
def counted_tail(n, m, reach):
    """The share by counting, in whole numbers, the lattice paths that stay within reach."""
    inside = [0] * (m + 1)
    for i in range(n + 1):
        for j in range(m + 1):
            before = (inside[j] if i else 0) + (inside[j - 1] if j else 0) or int(i == j == 0)
            inside[j] = before if abs(i * m - j * n) < reach else 0
    return 1 - Fraction(inside[m], math.comb(n + m, n))


def test_the_jobs_own_form_against_brute_force(spark):
    """``ks_test_auto`` over the whole smallest tables: statistic, sign and counted p-value of every test."""
    folder = "/root/testdata/sf0.001"
    values = Inputs(spark, folder).counted().select("matched_id", "country", *METRICS).collect()
    by_opening = {}
    for r in values:
        by_opening.setdefault(r.matched_id, []).append(r)
    found = QUERIES["ks_test_auto"](spark, folder).collect()
    assert {(r.matched_id, r.country) for r in found} == {(r.matched_id, r.country) for r in values if r.country is not None}
    for r in found:
        for metric in METRICS:
            every = [x[metric] for x in by_opening[r.matched_id] if x[metric] is not None]
            own = [x[metric] for x in by_opening[r.matched_id] if x.country == r.country and x[metric] is not None]
            stat, sign = brute(own, every)
            assert r[f"{metric}_sign"] == sign
            if stat is None:
                assert r[f"{metric}_stat"] is None and r[f"{metric}_p_value"] is None
                continue
            n, m = sorted((len(own), len(every)))
            assert r[f"{metric}_stat"] == pytest.approx(stat, abs=1e-6)
            assert r[f"{metric}_p_value"] == pytest.approx(float(counted_tail(n, m, round(stat * n * m))), abs=1e-6)


def test_counts_of_a_subset_test_share_one_shuffle(spark, tmp_path):
    """The bounds, the sums below and the running sums read one shuffle of the counts; rows without a key have no test."""
    table = [(f"p{i}", "xyz"[(i + k) % 3] if (i + k) % 10 else None, *[i % 9 + k + 1] * 8) for i in range(200) for k in range(2)]
    counts = spark.createDataFrame(table, "id STRING, matched_id STRING, " + ", ".join(f"{c} BIGINT" for c in COUNTS))
    counts.write.parquet(str(tmp_path / "counts"))
    profiles = spark.createDataFrame([(f"p{i}", "AB"[i // 2 % 2]) for i in range(200) if i % 5], "id STRING, country STRING")
    profiles.write.parquet(str(tmp_path / "profiles"))
    players = player_probabilities(*(spark.read.parquet(str(tmp_path / name)) for name in ("counts", "profiles")))
    tests = ks_subset(metric_values(players, ["matched_id", "country"]), ["matched_id", "metric"], "country")
    found = tests.collect()
    assert {(r["matched_id"], r["metric"], r["country"]) for r in found} == {(o, m, c) for o in "xyz" for m in METRICS for c in "AB"}
    again = ks_subset(metric_values(players, ["matched_id", "country"]), ["matched_id", "metric"], "country")

    def shuffles(plan):
        own = [plan.canonicalized()] if plan.getClass().getSimpleName() == "ShuffleExchangeExec" and "value#" in plan.outputPartitioning().toString() else []
        children = [plan.children().apply(k) for k in range(plan.children().size())]
        return own + [s for child in children for s in shuffles(child)]

    counted = shuffles(again._jdf.queryExecution().executedPlan().initialPlan())
    assert len(counted) > 1 and all(s.equals(counted[0]) for s in counted)


def test_wide_tests_are_advanced_alone_and_exactly(monkeypatch):
    """Few or wide tests never meet as a block, whose points span all their diagonals; closed form for equal sizes."""
    monkeypatch.setattr(ks, "_advanced", None)
    n = 3_000
    for reach in (60, 200, 900, 1_400):
        long = Fraction(0)
        for k in range(1, n // reach + 1):
            long += 2 * (-1) ** (k - 1) * Fraction(math.comb(2 * n, n - k * reach), math.comb(2 * n, n))
        assert ks.lattice_tails(np.array([reach / n]), np.array([n]), np.array([n]))[0] == pytest.approx(float(long), rel=1e-10)
    sizes = [(40, 1_500), (700, 901), (300, 300), (77, 901), (1_200, 40)]
    d = [round(1.4 * math.sqrt((n + m) * n * m)) / (n * m) for n, m in sizes]
    found = ks.lattice_tails(np.array(d), *np.array(sizes).T)
    for (n, m), x, p in zip(sizes, d, found):
        assert p == pytest.approx(diagonal_tail(n, m, round(x * n * m)), rel=1e-10)
    # far below the least number there is: told by the bound, without advancing anything
    assert ks.lattice_tails(np.array([0.5]), np.array([100_000]), np.array([100_000])).tolist() == [0.0]


def test_few_large_tests_are_dealt_to_tasks_of_their_own(spark):
    df = spark.createDataFrame([(0.5, n, n) for n in range(10, 18)], "stat DOUBLE, n BIGINT, m BIGINT")
    assert with_pvalue(df, "exact").rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def write_tables(spark, folder):
    """Small tables of games: 60 players of 4 countries, 12 parts, 6,000 games."""
    tables = {
        "customer": (60, "id AS c_custkey, 'c' AS c_name, CAST(id % 4 AS INT) AS c_nationkey, 1.0D AS c_acctbal, 'AUTO' AS c_mktsegment"),
        "nation": (4, "CAST(id AS INT) AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey"),
        "part": (12, "id AS p_partkey, 'x y' AS p_name, concat('Brand#', id % 3) AS p_brand, concat('T', id % 2) AS p_type, 1 AS p_size, 1.0D AS p_retailprice"),
        "orders": (2_000, "id AS o_orderkey, id * id % 60 AS o_custkey, 'O' AS o_orderstatus, 1.0D AS o_totalprice, "
                   "TIMESTAMP_NTZ'1994-01-05' AS o_orderdate, '1-URGENT' AS o_orderpriority"),
        "lineitem": (6_000, "id % 2000 AS l_orderkey, id % 12 AS l_partkey, id % 7 AS l_suppkey, 1 AS l_linenumber, 1.0D AS l_quantity, 1.0D AS l_extendedprice, "
                     "0.0D AS l_discount, 0.0D AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP_NTZ'1994-01-05' AS l_shipdate"),
    }
    for name, (n, columns) in tables.items():
        spark.range(n).createOrReplaceTempView("numbered")
        spark.sql(f"SELECT {columns} FROM numbered").write.parquet(f"{folder}/{name}.parquet")


def test_shares_of_large_tables_are_counted_once(spark, tmp_path, monkeypatch):
    """The players' shares are read three times; the games behind them are not."""
    write_tables(spark, tmp_path)
    whole = rows(queries.share_tests(Inputs(spark, str(tmp_path))))
    monkeypatch.setattr(queries, "small_on_disk", lambda df: False, raising=False)
    large = queries.share_tests(Inputs(spark, str(tmp_path)))
    assert not any("lineitem" in name for name in large.inputFiles())
    assert rows(large) == whole and len(whole) > 1
