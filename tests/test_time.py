"""As-of and interval joins, moving frames, neighbours, tiles and metric levels against plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from riskweft.operators import levels, rolling, timejoins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) else (True, "", v) for v in r))


def made(seed, n, key_count=3, span=60):
    rng = random.Random(seed)
    hot = lambda: 0 if rng.random() < 0.5 else rng.choice([None, *range(key_count)])
    return [(i, hot(), rng.choice([None, *range(span)]) if rng.random() < 0.1 else rng.randrange(span)) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance, how", [(None, "left"), (4, "inner"), (0, "left")])
def test_asof_join(spark, direction, exact, tolerance, how):
    left, right = made(1, 300), made(2, 120)
    want = []
    for i, k, t in left:
        fits = []
        for j, kk, tt in right:
            if None in (k, t, tt) or k != kk:
                continue
            ahead = t - tt if direction == "backward" else tt - t
            if ahead > 0 or (ahead == 0 and exact):
                fits.append((ahead, -j if direction == "backward" else j, j, tt))
        best = min(fits, default=None)
        if best and tolerance is not None and best[0] > tolerance:
            best = None
        if best or how == "left":
            want.append((i, k, t, best[2] if best else None, best[3] if best else None))
    a = spark.createDataFrame(left, "id int, k int, t int")
    b = spark.createDataFrame(right, "id int, k int, t int")
    got = timejoins.asof_join(
        a, b, "t", "t", by=["k"], ties=["id"], direction=direction, exact=exact, how=how,
        tolerance=None if tolerance is None else F.lit(tolerance),
    )
    assert got.columns == ["id", "k", "t", "id_right", "t_right"]
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_asof_join_without_key_and_with_repeated_rows(spark):
    a = spark.createDataFrame([(5,), (5,), (9,), (1,)], "t int")
    b = spark.createDataFrame([(2, "x", [1]), (2, "y", [2]), (7, "z", None)], "t int, v string, l array<int>")
    got = timejoins.asof_join(a, b, "t", "t")
    assert sorted(map(str, got.collect())) == sorted(
        map(str, [*[(r.t, r.t_right, r.v, r.l) for r in []], *spark.createDataFrame(
            [(1, None, None, None), (5, 2, "y", [2]), (5, 2, "y", [2]), (9, 7, "z", None)],
            "t int, t_right int, v string, l array<int>").collect()])
    )
    nothing = timejoins.asof_join(a, b.filter("t > 100"), "t", "t")
    assert [r.v for r in nothing.collect()] == [None] * 4
    assert timejoins.asof_join(a.filter("t > 100"), b, "t", "t").count() == 0


def test_asof_join_keeps_a_hot_key_in_many_tasks(spark):
    a = spark.range(20_000).select((F.col("id") % 977).alias("t"), F.lit(1).alias("k"))
    b = spark.range(5_000).select((F.col("id") % 1_009).alias("t"), F.lit(1).alias("k"), "id")
    got = timejoins.asof_join(a, b, "t", "t", by=["k"], ties=["id"])
    assert got.filter("t_right <> t OR id IS NULL").count() == 0
    assert "CartesianProduct" not in plan(got)


@pytest.mark.parametrize("closed", ["left", "both"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_overlap_join(spark, closed, how):
    rng = random.Random(7)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.randrange(200)
            out.append((i, rng.choice([0, 0, 1, None]), a, rng.choice([a, a, a + 1, a + 3, a + 17, a + 150, a - 2, None])))
        return out

    def shares(a, b, c, d):
        if None in (a, b, c, d) or b < a or d < c:
            return False
        holds = lambda x, lo, hi: lo <= x <= hi if closed == "both" else lo <= x < hi or x == lo == hi
        return holds(a, c, d) if a >= c else holds(c, a, b)

    left, right = spans(150), spans(90)
    want = []
    for i, k, a, b in left:
        hits = [j for j, kk, c, d in right if k is not None and k == kk and shares(a, b, c, d)]
        want += [(i, j) for j in hits] or ([(i, None)] if how == "left" else [])
    x = spark.createDataFrame(left, "id int, k int, a int, b int")
    y = spark.createDataFrame(right, "id int, k int, a int, b int")
    got = timejoins.overlap_join(x, y, ("a", "b"), ("a", "b"), by=["k"], closed=closed, how=how)
    assert sorted(map(str, ((r.id, r.id_right) for r in got.collect()))) == sorted(map(str, want))
    text = plan(got)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_interval_join_of_times_without_key(spark):
    start = dt.datetime(2015, 3, 1)
    points = spark.createDataFrame([(i, start + dt.timedelta(hours=7 * i)) for i in range(60)], "i int, at timestamp")
    periods = spark.createDataFrame(
        [(j, start + dt.timedelta(days=j), start + dt.timedelta(days=j, hours=5 * (j % 4))) for j in range(15)],
        "j int, begins timestamp, ends timestamp",
    )
    got = timejoins.interval_join(points, periods, "at", ("begins", "ends"))
    want = [(p.i, q.j) for p in points.collect() for q in periods.collect() if q.begins <= p.at < q.ends or p.at == q.begins == q.ends]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("width, blocks", [(7, 16), (12, 4), (1, 16), (13, 5), (48, 16)])
def test_rolling(spark, width, blocks):
    rng = random.Random(3)
    rows = [(k, t, rng.choice([None, float("nan"), rng.randrange(100) / 4, rng.randrange(100) / 4])) for _, k, t in made(4, 400)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    got = rolling.rolling(
        df, "t", width, {"n": ("count", "v"), "s": ("sum", "v"), "m": ("mean", "v"), "lo": ("min", "v"), "hi": ("max", "v")},
        by=["k"], blocks=blocks,
    )
    want = []
    for k, t in {(k, t) for k, t, _ in rows if t is not None}:
        seen = [v for kk, tt, v in rows if kk == k and tt is not None and t - width <= tt <= t and v is not None and v == v]
        total = sum(seen) if seen else None
        want.append((k, t, len(seen), total, total / len(seen) if seen else None, min(seen, default=None), max(seen, default=None)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_rolling_over_timestamps_equals_a_frame(spark):
    df = spark.range(3_000).select(
        (F.col("id") * F.lit(977) % 86_400 + 1_400_000_000).cast("timestamp").alias("t"), (F.col("id") % 7 * 1.5).alias("v")
    )
    got = rolling.rolling(df, "t", 3_600_000_000, {"s": ("sum", "v")})
    df.createOrReplaceTempView("frame_rows")
    want = spark.sql("SELECT DISTINCT t, sum(v) OVER (ORDER BY t RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS s FROM frame_rows")
    assert rows_of(got) == rows_of(want)


def test_rolling_adds_each_row_to_a_frame_once(spark):
    # Frames that only grow at their end; one that only loses rows at its start is summed anew for every row.
    df = spark.range(2_000).select((F.col("id") % 900).alias("t"), (F.col("id") % 7 * 1.5).alias("v"))
    got = rolling.rolling(df, "t", 300, {"s": ("sum", "v"), "lo": ("min", "v")}, blocks=2)
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^)]+)\)", plan(got))
    assert frames and not [f for f in frames if "unboundedfollowing" in f[2]]
    df.createOrReplaceTempView("growing_rows")
    want = spark.sql(
        "SELECT DISTINCT t, sum(v) OVER w AS s, min(v) OVER w AS lo FROM growing_rows WINDOW w AS (ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)"
    )
    assert rows_of(got) == rows_of(want)


def test_neighbours_and_tiles(spark):
    rows = [(k, t, i) for i, k, t in made(6, 230)]
    df = spark.createDataFrame(rows, "k int, t int, i int")
    df.createOrReplaceTempView("neighbour_rows")
    got = rolling.neighbours(df, {"before": "i"}, ["t"], by=["k"], offset=2)
    got = rolling.neighbours(got, {"after": "t"}, ["t", "i"], by=["k"], offset=-1)
    got = rolling.tiles(got, 4, ["t", "i"], by=["k"])
    got = rolling.tiles(got, 7, ["t", "i"], name="overall")
    want = spark.sql(
        """SELECT k, t, i, lag(i, 2) OVER w AS before, lead(t) OVER w AS after, ntile(4) OVER w AS tile, ntile(7) OVER (ORDER BY t, i, k) AS overall
        FROM neighbour_rows WINDOW w AS (PARTITION BY k ORDER BY t, i)"""
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_levels_equal_single_groupings(spark, policies):
    keys = ["Province", "VehicleType", "Gender"]
    cube = levels.metrics_at_levels(policies, levels.cube_levels(keys))
    assert cube.filter("level = 'total'").count() == 1
    assert {r.level for r in cube.select("level").distinct().collect()} == {
        "total", "Province", "VehicleType", "Gender", "Province+VehicleType", "Province+Gender", "VehicleType+Gender", "Province+VehicleType+Gender",
    }
    from riskweft.operators.metrics import kpis, segment_totals

    one = {r.Province: r for r in cube.filter("level = 'Province'").collect()}
    assert None not in one
    for row in segment_totals(policies, ["Province"]).collect():
        found = one[row.Province]
        assert found.policy_count == row.policy_count
        assert found.total_claims == pytest.approx(row.total_claims)
        assert found.loss_ratio == pytest.approx(row.loss_ratio)
    for row in kpis(policies, "Province").collect():
        assert one[row.Group].claim_frequency == pytest.approx(row.ClaimFrequency)
        assert one[row.Group].claim_severity == pytest.approx(row.ClaimSeverity)
        assert one[row.Group].margin == pytest.approx(row.Margin)
    total = cube.filter("level = 'total'").first()
    assert total.policy_count == policies.count()  # rows without a province count here


def test_levels_read_rows_once_and_check_names(spark, tmp_path, policies):
    path = str(tmp_path / "policies")
    policies.write.parquet(path)
    rows = spark.read.parquet(path)
    text = plan(levels.metrics_at_levels(rows, levels.rollup_levels(["Province", "Gender"])))
    assert text.count("FileScan") == 1 and "Expand" in text
    assert levels.metrics_at_levels(rows.filter("PolicyID < 0"), [[]]).first().policy_count == 0
    with pytest.raises(ValueError):
        levels.metrics_at_levels(rows, [["Province"], ["Province", "Province"]])
    with pytest.raises(ValueError):
        levels.metrics_at_levels(rows, [["NoSuchColumn"]])
    with pytest.raises(ValueError):
        levels.cube_levels(list("abcdefghi"))


@pytest.mark.parametrize("closed", ["left", "both"])
def test_rows_without_a_partner_alone(spark, closed):
    rng = random.Random(5)
    x = [(rng.choice([1, 2, None]), rng.choice([None, *range(12)]), i % 40) for i in range(200)]
    y = [(rng.choice([1, 2, 3, None]), a, a + rng.choice([0, 0, 1, 4])) for a in (rng.randrange(14) for _ in range(5))]
    y.append((1, 3, None))
    left, right = spark.createDataFrame(x, "k int, t int, v int"), spark.createDataFrame(y, "k int, a int, b int")
    meets = lambda t, a, b: a <= t <= b if closed == "both" else a <= t < b or a == t == b
    full = [(k, a, b) for k, a, b in y if None not in (k, a, b)]
    want = [r for r in x if None in r[:2] or not any(r[0] == k and meets(r[1], a, b) for k, a, b in full)]
    got = timejoins.interval_join(left, right, "t", ("a", "b"), by=["k"], closed=closed, how="anti")
    assert got.columns == left.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    both = timejoins.interval_join(left, right, "t", ("a", "b"), by=["k"], closed=closed, how="left").filter("a IS NULL")
    assert sorted((tuple(r)[:3] for r in both.collect()), key=str) == sorted(want, key=str)
