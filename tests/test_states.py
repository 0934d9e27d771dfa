"""Stored sketches, snapshot differences, sessions, alerts and stream joins."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweft.operators import sketches, snapshots
from riskweft.streaming import keyed, monitor


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


# --- sketches ------------------------------------------------------------------------------------


def test_merged_sketches_answer_within_their_bounds(spark, policies, tmp_path):
    rows = spark.range(60_000).select(
        (F.col("id") % 7).alias("k"), (F.xxhash64("id") % 40_000).alias("who"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_000)) / 7).alias("x"),
        (F.lit("2015-01-15").cast("date") + (F.col("id") % 90).cast("int")).alias("day"),
    )
    for hll in (False, True):
        made = sketches.segment_sketches(rows, ["k"], ["who"], ["x"], month_of="day", hll=hll)
        sketches.save_sketches(made, str(tmp_path / f"s{hll}"))
        stored = sketches.load_sketches(spark, str(tmp_path / f"s{hll}"))
        for by in (["k"], ["month"], []):
            merged = sketches.sketch_estimates(sketches.merge_sketches(stored, by), [0.1, 0.5, 0.99])
            found = {tuple(r[c] for c in by): r for r in merged.collect()}
            with_month = rows.withColumn("month", F.trunc("day", "month"))
            want = with_month.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("who").alias("d"), F.sort_array(F.collect_list("x")).alias("xs"))
            for row in want.collect():
                got = found[tuple(row[c] for c in by)]
                assert got.rows == row.n and got.distinct_who_low <= row.d <= got.distinct_who_high
                for p, q in zip([0.1, 0.5, 0.99], got.quantiles_x):
                    below, upto = sum(x < q for x in row.xs) / row.n, sum(x <= q for x in row.xs) / row.n
                    assert below <= p + sketches.KLL_ERROR and upto >= p - sketches.KLL_ERROR
    # Merging months gives the distinct count that the rows themselves give.
    direct = sketches.sketch_estimates(sketches.segment_sketches(policies, ["Province"], ["PolicyID"])).collect()
    merged = sketches.sketch_estimates(sketches.merge_sketches(
        sketches.segment_sketches(policies, ["Province"], ["PolicyID"], month_of="TransactionMonth"), ["Province"])).collect()
    assert sorted(map(str, direct)) == sorted(map(str, merged))


def test_sketches_of_overlaps_nulls_and_nothing(spark):
    rows = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", None), ("b", 2), ("b", 3), ("b", 3), (None, 9)], "s string, v int"
    ).withColumn("x", F.lit(float("nan")))
    made = sketches.segment_sketches(rows, ["s"], ["v"], ["x"])
    ask = lambda op: tuple(sketches.compare_segments(made, "v", "s", "a", "b", op).first())
    assert ask("overlap") == (1, 1, 1) and ask("union") == (3, 3, 3) and ask("difference") == (1, 1, 1)
    got = {r.s: (r.rows, r.distinct_v, r.quantiles_x) for r in sketches.sketch_estimates(made).collect()}
    assert got == {"a": (3, 2, None), "b": (3, 2, None), None: (1, 1, None)}
    assert sketches.segment_sketches(rows.filter("v > 100"), ["s"], ["v"], ["x"]).count() == 0
    with pytest.raises(ValueError):
        sketches.compare_segments(made, "v", "s", "a", "b", "xor")
    with pytest.raises(ValueError):
        sketches.sketch_estimates(made, [1.5])


# --- snapshots -----------------------------------------------------------------------------------


def random_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([0.5, 1.5, None, float("nan")])) for _ in range(n)]


def test_rows_removed_and_kept_equal_except_and_intersect_all(spark):
    schema = "k int, s string, x double"
    old, new = (spark.createDataFrame(random_rows(i, 150), schema) for i in (1, 2))
    assert rows_of(snapshots.rows_removed(old, new)) == rows_of(old.exceptAll(new))
    assert rows_of(snapshots.rows_removed(new, old)) == rows_of(new.exceptAll(old))
    assert rows_of(snapshots.rows_kept(old, new)) == rows_of(old.intersectAll(new))
    assert snapshots.rows_removed(old, old).count() == 0 and snapshots.rows_kept(old, old.limit(0)).count() == 0


def test_changes_by_key(spark):
    schema = "id int, name string, paid double, note string"
    old = [(1, "a", 1.0, None), (2, "b", 2.0, "x"), (3, "c", 3.0, "x"), (4, "d", 4.0, None), (4, "d", 4.0, None), (None, "n", 1.0, "y"), (5, "e", 5.0, "z")]
    new = [(1, "a", 1.0, None), (2, "b", 2.5, None), (4, "d", 4.0, None), (4, "d", 4.0, None), (4, "d", 4.0, None), (None, "m", 1.0, "y"), (6, "f", 6.0, "z"), (5, "e", 5.0, "z")]
    got = snapshots.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["id"]).collect()
    seen = {r.id: (r.change, r.changed_columns, r.before and r.before.name, r.after and r.after.name) for r in got}
    assert len(got) == 5
    assert seen == {
        2: ("changed", ["paid", "note"], "b", "b"), 3: ("removed", None, "c", None), 4: ("inserted", None, None, "d"),
        None: ("changed", ["name"], "n", "m"), 6: ("inserted", None, None, "f"),
    }
    summary = snapshots.change_summary(snapshots.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["id"]))
    assert Counter({(r.change, r.column): r.rows for r in summary.collect()}) == {
        ("changed", None): 2, ("removed", None): 1, ("inserted", None): 2, ("changed", "paid"): 1, ("changed", "note"): 1, ("changed", "name"): 1,
    }
    with pytest.raises(ValueError):
        snapshots.row_counts(spark.createDataFrame(old, schema), spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(ValueError):
        snapshots.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), [])


# --- streams -------------------------------------------------------------------------------------

START = dt.datetime(2024, 1, 1)
SCHEMA = "user int, ts timestamp_ntz, kind string, value double"


def arrivals(seed, hours=60):
    """Events in the order of their times, and the same shuffled within two hours, in files."""
    rng = random.Random(seed)
    events = [(rng.randrange(4), START + dt.timedelta(minutes=rng.randrange(hours * 60), seconds=i % 60), rng.choice("pc"), rng.randrange(100) / 1.0) for i in range(500)]
    events.sort(key=lambda e: e[1])
    order = sorted(events, key=lambda e: e[1] + dt.timedelta(minutes=rng.randrange(110)))
    # Rows far ahead close everything before them.
    flush = [(9, START + dt.timedelta(days=30), "p", 1.0), (9, START + dt.timedelta(days=30), "c", 1.0)]
    return events, [order[i : i + 125] for i in range(0, 500, 125)] + [flush]


def replay(spark, folder, files, make):
    """What a query sends when it is stopped after every file and started again from its checkpoint."""
    for number, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        table = make(stream)
        monitor.write_windows(table, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.schema(table.schema).parquet(f"{folder}/out").filter("user <> 9")


def test_sessions_of_a_restarted_stream_equal_the_table(spark, tmp_path):
    events, files = arrivals(1)
    make = lambda rows: keyed.sessions(rows, ["user"], "ts", "30 minutes", late="2 hours", value="value")
    want = make(spark.createDataFrame(events, SCHEMA))
    assert rows_of(replay(spark, str(tmp_path), files, make)) == rows_of(want) and want.count() > 100


def test_alerts_of_a_restarted_stream_equal_the_table(spark, tmp_path):
    events, files = arrivals(2)
    make = lambda rows: keyed.alert_changes(rows, "user", "ts", "value", 80.0, 30.0, late="2 hours")
    want, on = [], {}
    for user, ts, _, value in sorted(events, key=lambda e: (e[0], e[1], e[3])):
        if value >= 80 and not on.get(user) or value <= 30 and on.get(user):
            on[user] = value >= 80
            want.append((user, ts, "raised" if on[user] else "cleared", value))
    assert rows_of(make(spark.createDataFrame(events, SCHEMA))) == sorted(map(str, want))
    assert rows_of(replay(spark, str(tmp_path), files, make)) == sorted(map(str, want)) and len(want) > 100
    odd = spark.createDataFrame([(None, START, "p", 99.0), (1, None, "p", 99.0), (1, START, "p", None), (1, START, "p", float("nan"))], SCHEMA)
    assert make(odd).count() == 0
    with pytest.raises(ValueError):
        keyed.alert_changes(odd, "user", "ts", "value", 1.0, 1.0)


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_stream_join_in_any_order_equals_the_table(spark, tmp_path, how):
    events, files = arrivals(3)

    def make(rows):
        premiums, claims = (rows.filter(F.col("kind") == k).select("user", "ts", "value") for k in "pc")
        return keyed.join_within(premiums, claims, ["user"], "ts", "ts", "20 MINUTES", late="2 hours", how=how).select(
            "user", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "next_value"
        )

    want = make(spark.createDataFrame(events, SCHEMA))
    assert rows_of(replay(spark, str(tmp_path), files, make)) == rows_of(want)
    assert (want.filter("next_value IS NULL").count() > 0) == (how == "left_outer")
