"""Months as a state: every change must end where summing all months would, whatever stops in between."""

import re

import pytest

from seqstats.operators.counts import COUNTS, merge_counts
from seqstats.sources import commits, ledger
from conftest import rows

SCHEMA = "month STRING, id STRING, matched_id STRING, " + ", ".join(f"{c} BIGINT" for c in COUNTS)


def made(spark, seed, months, players=40):
    out = []
    for m in months:
        for p in range(players):
            if (p * 7 + seed + int(m[-2:])) % 3:
                out.append((m, f"p{p}", f"o{(p * seed + int(m[-2:])) % 5}", *[(p * (k + 1) + seed) % 11 for k in range(len(COUNTS))]))
    return spark.createDataFrame(out, SCHEMA)


def sums(frames):
    return rows(merge_counts([f.drop("month") for f in frames]), "id", "matched_id", *COUNTS)


def held(spark, root, version=None):
    return rows(ledger.state(spark, root, version), "id", "matched_id", *COUNTS)


def test_added_replaced_and_withdrawn(spark, tmp_path):
    root = str(tmp_path / "ledger")
    a, b, c = (made(spark, s, [m]) for s, m in ((1, "2022-07"), (2, "2022-08"), (3, "2022-09")))
    assert held(spark, root) == [] and ledger.months(spark, root) == []
    ledger.put_months(spark, root, a.unionByName(b), ["2022-07", "2022-08"], buckets=4)
    assert held(spark, root) == sums([a, b])
    ledger.put_months(spark, root, c, ["2022-09"])
    assert held(spark, root) == sums([a, b, c])
    other = made(spark, 9, ["2022-08"], 15)
    ledger.put_months(spark, root, other, ["2022-08"])
    assert held(spark, root) == sums([a, other, c])
    ledger.withdraw_months(spark, root, ["2022-07", "1999-01"])
    assert held(spark, root) == sums([other, c]) and ledger.months(spark, root) == ["2022-08", "2022-09"]
    version = ledger.put_months(spark, root, other, ["2022-08"])
    assert held(spark, root) == sums([other, c]) and held(spark, root, version - 2) == sums([a, other, c])
    ledger.withdraw_months(spark, root, ["2022-08", "2022-09"])
    assert held(spark, root) == []


def test_months_behind_a_row_and_empty_months(spark, tmp_path):
    root = str(tmp_path / "ledger")
    zero = [0] * len(COUNTS)
    one = spark.createDataFrame([("2022-01", "a", "x", *zero), (("2022-02"), "a", "x", *zero), ("2022-02", None, "x", *zero)], SCHEMA)
    ledger.put_months(spark, root, one, ["2022-01", "2022-02", "2022-03"], buckets=2)
    assert rows(ledger.state(spark, root), "id", "matched_id", "months") == [("a", "x", 2)]
    assert ledger.months(spark, root) == ["2022-01", "2022-02", "2022-03"]
    ledger.withdraw_months(spark, root, ["2022-02", "2022-03"])
    assert rows(ledger.state(spark, root), "id", "matched_id", "months") == [("a", "x", 1)]
    with pytest.raises(ValueError, match="2022-05"):
        ledger.put_months(spark, root, made(spark, 1, ["2022-05"]), ["2022-06"])
    assert ledger.months(spark, root) == ["2022-01"]


def test_the_state_is_not_shuffled(spark, tmp_path):
    root = str(tmp_path / "ledger")
    ledger.put_months(spark, root, made(spark, 1, ["2022-07"]), ["2022-07"], buckets=4)
    change = ledger.difference(made(spark, 2, ["2022-08"]).selectExpr("*", "1 AS months"), [])
    with ledger._setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        plan = ledger.changed(ledger.state(spark, root), change)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    # The state's side of the join: from its scan up to the join there is a filter and a sort, no exchange.
    side = plan[plan.index("SortMergeJoin") :]
    scan = side.index("Bucketed: true")
    assert "Exchange" not in side[:scan] and "Exchange" in side[scan:]


@pytest.mark.parametrize("step", ["months", "state", "commit"])
def test_a_stopped_change_is_repeated(spark, tmp_path, monkeypatch, step):
    """A stop after the month's table, before the state or before the commit leaves the old state, and a repetition the new one."""
    root = str(tmp_path / "ledger")
    a, b = made(spark, 1, ["2022-07"]), made(spark, 2, ["2022-08"])
    ledger.put_months(spark, root, a, ["2022-07"], buckets=4)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(*{"months": (ledger, "difference"), "state": (ledger, "_write_bucketed"), "commit": (commits, "commit")}[step], stop)
        with pytest.raises(RuntimeError):
            ledger.put_months(spark, root, b, ["2022-08"])
    assert held(spark, root) == sums([a]) and ledger.months(spark, root) == ["2022-07"]
    ledger.put_months(spark, root, b, ["2022-08"])
    assert held(spark, root) == sums([a, b])
    left = ledger.vacuum(spark, root, keep=1)
    assert any(re.match("months-", x) for x in left) and held(spark, root) == sums([a, b])
    ledger.withdraw_months(spark, root, ["2022-07"])
    assert held(spark, root) == sums([b])


def test_one_of_two_writers_wins(spark, tmp_path):
    root = str(tmp_path / "log")
    assert commits.commit(spark, root, {"a": 1}, 0) == 1
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, {"a": 2}, 0)
    assert commits.read_commit(spark, root) == (1, {"a": 1})
    assert commits.commit(spark, root, {"a": "é"}, 1) == 2 and commits.read_commit(spark, root) == (2, {"a": "é"})
    assert not [x for x in commits.names(spark, f"{root}/_commits") if x.startswith("draft")]


def test_state_of_few_buckets_is_not_shuffled(spark, tmp_path):
    """Fewer buckets than shuffle partitions: still only the change moves."""
    root = str(tmp_path / "ledger")
    ledger.put_months(spark, root, made(spark, 1, ["2022-07"]), ["2022-07"], buckets=2)
    change = ledger.difference(made(spark, 2, ["2022-08"]).selectExpr("*", "1 AS months"), [])
    with ledger._setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"), ledger._setting(spark, "spark.sql.shuffle.partitions", "32"):
        plan = ledger.changed(ledger.state(spark, root), change, 2)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    scan = side.index("Bucketed: true")
    assert "Exchange" not in side[:scan] and "Exchange" in side[scan:]


@pytest.mark.parametrize("size", [0, 1 << 40])
def test_new_months_are_shuffled_once(spark, tmp_path, monkeypatch, size):
    """The first state is written as the months' table lies; a large one in as many buckets as there are parts, a small one in those asked for."""
    root, plans, write = str(tmp_path / "ledger"), [], ledger._write_bucketed

    def noted(df, path, buckets):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path, buckets)

    monkeypatch.setattr(ledger, "_write_bucketed", noted)
    monkeypatch.setattr(ledger, "BUCKET_BYTES", size, raising=False)
    # Rows that repeat are summed, those without a name or an opening left out.
    a, b = made(spark, 1, ["2022-07", "2022-08"]), made(spark, 2, ["2022-09"])
    twice = a.unionByName(a).unionByName(a.limit(3).selectExpr("month", "NULL AS id", "matched_id", *COUNTS))
    with ledger._setting(spark, "spark.sql.shuffle.partitions", "7"):
        ledger.put_months(spark, root, twice, ["2022-07", "2022-08"], buckets=2)
        assert "Exchange" not in plans[0] and "Bucketed: true" in plans[0]
        assert commits.read_commit(spark, root)[1]["buckets"] == (2 if size else 8)
        assert held(spark, root) == sums([a, a])
        ledger.put_months(spark, root, b, ["2022-09"])
        ledger.put_months(spark, root, a, ["2022-07", "2022-08"])
    assert plans[1].count("Exchange") == (1 if size else 0)
    assert held(spark, root) == sums([a, b])
    assert rows(ledger.month_rows(spark, root, "2022-09"), "id", "matched_id", *COUNTS) == sums([b])
    ledger.withdraw_months(spark, root, ["2022-09"])
    assert held(spark, root) == sums([a])
