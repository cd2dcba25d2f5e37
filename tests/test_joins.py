"""As-of joins, lookups, anti joins, global ranks and samples against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, joins, windows

T0 = datetime(2024, 1, 1)
LEFT = "id int, k string, c string, ts timestamp_ntz"
RIGHT = "k string, c string, at timestamp_ntz, lst string, price int"


def brute(left, right):
    out = {}
    for i, k, c, ts in left:
        fits = [
            r for r in right
            if k is not None and r[0] == k and r[1] == c and ts is not None and r[2] <= ts
        ]
        best = max(fits, key=lambda r: (r[2], r[3]), default=None)
        out[i] = None if best is None else (best[2], best[3], best[4])
    return out


@pytest.mark.parametrize("span", [None, (T0 + timedelta(days=10), T0 + timedelta(days=40))])
@pytest.mark.parametrize("salts", [1, 5])
@pytest.mark.parametrize("buckets", [1, 7])
def test_asof_equals_brute_force_with_a_hot_key(spark, span, salts, buckets):
    rng = random.Random(salts * 10 + buckets)

    def moment():
        return T0 + timedelta(hours=rng.randrange(24 * 50))

    keys = ["hot"] * 6 + ["a", "b", "none"]
    left = [
        (i, rng.choice([*keys, None]), rng.choice(["BRL", "USD"]), rng.choice([moment(), moment(), None]))
        for i in range(400)
    ]
    right = list({
        (k, c, at, lst): (k, c, at, lst, n)
        for n, (k, c, at, lst) in enumerate(
            (rng.choice(["hot", "hot", "a", "b"]), rng.choice(["BRL", "USD"]), moment(), rng.choice("xyz"))
            for _ in range(120)
        )
    }.values())
    got = joins.asof_left(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT),
        ["k", "c"], "ts", "at", ["at", "lst", "price"], ["lst"], span, buckets, salts,
    ).collect()
    assert len(got) == len(left)
    assert {r.id: None if r.at is None else (r.at, r.lst, r.price) for r in got} == brute(left, right)


def test_asof_is_inclusive_and_never_looks_ahead(spark):
    left = [(1, "k", "BRL", T0), (2, "k", "BRL", T0 - timedelta(seconds=1))]
    right = [("k", "BRL", T0, "x", 90)]
    got = joins.asof_left(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT),
        ["k", "c"], "ts", "at", ["price"],
    ).collect()
    assert {r.id: r.price for r in got} == {1: 90, 2: None}


def test_asof_never_broadcasts_the_prices_carried_into_slices(spark):
    """They are a row per key and slice; the byte statistics take them for as few as the prices."""
    left = spark.createDataFrame([(1, "k", "BRL", T0)], LEFT)
    right = spark.range(90, 91).selectExpr(  # of known size, unlike rows from Python
        "'k' k", "'BRL' c", "timestamp_ntz'2024-01-01' at", "'x' lst", "cast(id as int) price"
    )
    got = joins.asof_left(
        left, right, ["k", "c"], "ts", "at", ["price"], span=(T0 - timedelta(days=30), T0 + timedelta(days=30))
    )
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.price for r in got.collect()] == [90]


def test_asof_returns_the_left_columns_in_their_own_types(spark):
    """Keys and times of other types than on the right are compared, and come back as they were."""
    left = spark.sql("select 7 k, date'2024-01-02' ts, 'n' note union all select null, date'2024-01-02', 'm'")
    right = spark.sql("select 7L k, timestamp_ntz'2024-01-01' at, 90 price")
    got = joins.asof_left(left, right, ["k"], "ts", "at", ["price"], span=(T0, T0 + timedelta(days=30)))
    assert got.dtypes == [*left.dtypes, ("price", "int")]
    assert {(r.k, r.ts.day, r.note, r.price) for r in got.collect()} == {(7, 2, "n", 90), (None, 2, "m", None)}


def test_lookup_keeps_unknown_keys_in_a_lookup(spark):
    facts = spark.createDataFrame([("a",), ("zz",), (None,)], "code string")
    registry = spark.createDataFrame([("a", "Alpha", None), ("b", "Beta", "s")], "key string, name string, scope string")
    got = joins.lookup_join(
        facts, joins.Lookup(registry, "key"), "code", {"name": ("name", "?"), "scope": ("scope", None)}, "found"
    ).collect()
    assert {(r.code, r.name, r.scope, r.found) for r in got} == {
        ("a", "Alpha", None, 1), ("zz", "?", None, 0), (None, "?", None, 0),
    }


def test_anti_join_keeps_the_total_and_nulls_do_not_empty_it(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    row = joins.anti_with_total(left, right, [("k", "k")]).first()
    assert (row.total_rows, row.orphan_rows) == (3, 2)


def test_peers_are_kept_on_both_sides(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "item string, a int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "item string, b int")
    got = joins.full_peer_join(a, b, "item", "has_a", "has_b").collect()
    assert {(r.item, r.has_a, r.has_b) for r in got} == {("x", 1, 0), ("y", 1, 1), ("z", 0, 1)}


@pytest.mark.parametrize("n", [0, 3, 5, 17, 1000])
def test_global_ntile_equals_one_sorted_list(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randrange(20)) for i in range(n)]
    got = windows.ntile_global(
        spark.createDataFrame(rows, "id int, m int"), ["m", "id"], 5, "tile"
    ).collect()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    size, extra = divmod(n, 5)
    tiles = [t + 1 for t in range(5) for _ in range(size + (t < extra))]
    assert {r.id: r.tile for r in got} == {r[0]: t for r, t in zip(ordered, tiles)}


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_several_global_ranks_with_a_common_value_nulls_and_few_slices(spark, n):
    rng = random.Random(n)
    rows = [(f"k{i}", rng.choice([0, 0, 0, None, 1, 2]), rng.choice([0.5, None, -3.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, a int, b double")
    ranked = windows.global_ranks(df, {"ra": ["a", "id"], "rb": ["b", "id"]}, "total", slices=37)
    for col, at in (("ra", 1), ("rb", 2)):
        ordered = sorted(rows, key=lambda r: (r[at] is not None, r[at] or 0, r[0]))
        assert {r.id: r[col] for r in ranked.collect()} == {r[0]: i for i, r in enumerate(ordered)}
    assert {r.total for r in ranked.collect()} <= {n}


def test_a_value_of_a_third_of_all_rows_fills_many_slices(spark):
    df = spark.range(30_000).select(F.format_string("c%06d", "id").alias("id"), (F.col("id") % 3).alias("v"))
    cuts = windows._cuts(df, {"r": ["v", "id"]}, 256)
    sliced = windows.with_scalars(df, cuts).withColumn("s", windows._slice("_cuts_r", ["v", "id"]))
    sizes = [r["count"] for r in sliced.groupBy("s").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 600


def test_capped_sample_equals_plain_top_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.randrange(10)) for i in range(500)]
    got = windows.sample_per_group(
        spark.createDataFrame(rows, "g string, id int, v int"), ["g"],
        [F.col("v").asc(), F.col("id").asc()], 40, salts=7,
    ).collect()
    for group in "ab":
        expect = sorted((r for r in rows if r[0] == group), key=lambda r: (r[2], r[1]))[:40]
        assert sorted(r.id for r in got if r.g == group) == sorted(r[1] for r in expect)


def test_shares_follow_weight_and_fall_back_to_equal(spark):
    rows = [("a", 1, 30, 10), ("a", 2, 10, 10), ("a", 3, -5, 10), ("b", 1, 0, 6), ("b", 2, -1, 6)]
    df = spark.createDataFrame(rows, "item string, dc int, w int, amount int")
    got = {(r.item, r.dc): float(r.part) for r in aggregates.allocate(df, ["item"], "amount", "w", "part").collect()}
    assert got == {("a", 1): 7.5, ("a", 2): 2.5, ("a", 3): 0.0, ("b", 1): 3.0, ("b", 2): 3.0}


def test_preferred_value_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("c", "web"), ("c", "app"), ("d", "web"), ("d", "web"), ("d", "app")], "k string, v string")
    got = {r.k: r.v for r in aggregates.preferred_value(df, "k", "v", "v").collect()}
    assert got == {"c": "app", "d": "web"}


def test_sketch_quantiles_are_close(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    exact = {r.g: r.p for r in aggregates.quantiles(df, ["g"], "v", {"p": 0.9}).collect()}
    rough = {r.g: r.p for r in aggregates.quantiles(df, ["g"], "v", {"p": 0.9}, exact=False).collect()}
    assert all(abs(exact[g] - rough[g]) < 20 for g in exact)


def test_quantiles_of_a_hot_group_equal_percentile_and_no_task_holds_it(spark):
    rng = random.Random(7)
    rows = [("hot", int(rng.lognormvariate(6, 3))) for _ in range(20_000)] + [("few", 5), ("few", 8), ("one", -3), (None, 1), (None, 2), ("tie", 4), ("tie", 4), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    qs = {"q0": 0.0, "q1": 0.013, "q5": 0.5, "q9": 0.99, "q10": 1.0}
    got = {r[0]: list(r)[1:] for r in aggregates.quantiles(df, ["g"], "v", qs).collect()}
    expect = {r.g: list(r.q) for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs.values()])).alias("q")).collect()}
    assert {g: pytest.approx(v) for g, v in expect.items()} == got
    # the ordered part: slices that hold a wanted rank, each a small share of the group
    counted = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    distinct = counted.where("g = 'hot'").count()
    cuts = counted.where("g = 'hot'").agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], aggregates.SKETCH).alias("c"))
    sizes = counted.where("g = 'hot'").crossJoin(cuts).groupBy(F.size(F.filter("c", lambda c: c < F.col("v"))).alias("s")).count()
    assert sizes.agg(F.max("count")).first()[0] < distinct / 64


def test_quantiles_of_decimals_without_groups_and_of_nothing(spark):
    df = spark.range(11).select((F.col("id") / 4).cast("decimal(18,4)").alias("v"))
    assert [list(r) for r in aggregates.quantiles(df, [], "v", {"p": 0.25}).collect()] == [[0.625]]
    nothing = spark.createDataFrame([("a", None)], "g string, v long")
    assert aggregates.quantiles(nothing, ["g"], "v", {"p": 0.5}).collect() == []


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    right = spark.range(100).select(F.col("id").alias("r"))
    marked = joins.mark_missing(left, right, [("k", "r")])
    assert marked.columns == ["id", "k", "is_orphan"]
    assert marked.agg(F.sum("is_orphan")).first()[0] == 4000 - 50
    salts = joins.with_null_salt(left, ["k"]).where("k is null").groupBy("_salt").count()
    assert salts.count() > 1000 and salts.agg(F.max("count")).first()[0] < 10
