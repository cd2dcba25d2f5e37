"""Refresh modes: vanished groups, touched keys, versions, the refresh log."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.support import AS_OF, SMALL, ago, lake, lookups, only
from tidemark.contracts import CONTRACTS
from tidemark.operators import joins
from tidemark.operators.cdc import current_of, to_core
from tidemark.plans import quality, refresh, reports
from tidemark.plans.marts import sales, stock
from tidemark.session import scratch
from tidemark.sources.retail import RetailTables


def revenue_job(spark, **entities):
    a_lake = lake(spark, **entities)
    return lambda at, days: sales.revenue_by_bu_day(a_lake, lookups(a_lake), at, days)


def rows_of(spark, path, *cols):
    return sorted(tuple(r) for r in refresh.read_mart(spark, path).select(*cols).collect())


@pytest.mark.parametrize("grain", ["day", "month"])
def test_a_vanished_group_leaves_no_ghost_row(spark, grain):
    path = scratch(spark, "mart")
    first = {"order_id": "A", "channel": "web", "created_at": ago(2)}
    other = {"order_id": "OLD", "created_at": ago(90)}
    refresh.refresh_window(revenue_job(spark, order=[first, other]), path, AS_OF, 200, "order_date", grain)
    moved = [first, {**first, "channel": "app"}, other]
    refresh.refresh_window(revenue_job(spark, order=moved), path, AS_OF, 3, "order_date", grain)
    assert rows_of(spark, path, "order_channel", "orders") == [("app", 1), ("web", 1)]
    # the last order of the window is deleted: its partition goes as well
    gone = [*moved, {**first, "_op": "d"}]
    refresh.refresh_window(revenue_job(spark, order=gone), path, AS_OF, 3, "order_date", grain)
    assert rows_of(spark, path, "order_date") == [(ago(90).date(),)]


def test_only_the_window_is_recomputed_and_another_window_is_a_directed_refresh(spark):
    path = scratch(spark, "mart")
    orders = [{"order_id": str(d), "created_at": ago(d), "total_amount": 10} for d in (1, 100)]
    refresh.refresh_window(revenue_job(spark, order=orders), path, AS_OF, 200, "order_date")
    fixed = [*orders, *({**o, "total_amount": 99} for o in orders)]
    refresh.refresh_window(revenue_job(spark, order=fixed), path, AS_OF, 3, "order_date")
    assert sorted(float(r[0]) for r in rows_of(spark, path, "net_revenue")) == [10.0, 99.0]
    refresh.refresh_window(revenue_job(spark, order=fixed), path, AS_OF, 200, "order_date")
    assert sorted(float(r[0]) for r in rows_of(spark, path, "net_revenue")) == [99.0, 99.0]


def order_job(a_lake):
    return lambda keys: sales.order_360(a_lake, lookups(a_lake), AS_OF, None, keys)


def refresh_orders(spark, path, a_lake, ids):
    keys = spark.createDataFrame([(i,) for i in ids], "order_id string")
    return refresh.refresh_keys(order_job(a_lake), keys, path, "order_id", "order_created_at")


def test_late_items_complete_the_order_without_intervention(spark):
    path = scratch(spark, "mart")
    items = [{"order_id": "ORD-LATE-1", "item_seq": n, "quantity": q} for n, q in ((1, 1), (2, 2), (3, 4))]
    late2 = {"order_id": "ORD-LATE-2"}
    keep = {"order_id": "KEEP", "created_at": ago(70)}
    both = ["ORD-LATE-1", "ORD-LATE-2"]
    # refresh A: items of the first order without the order, second order without items
    refresh_orders(spark, path, lake(spark, order=[late2, keep], order_item=items), [*both, "KEEP"])
    got = {r.order_id: (r.has_items, r.items_count) for r in refresh.read_mart(spark, path).collect()}
    assert got == {"ORD-LATE-2": (0, 0), "KEEP": (0, 0)}
    # refresh B: everything has landed
    items += [{"order_id": "ORD-LATE-2", "item_seq": n} for n in (1, 2)]
    whole = lake(spark, order=[late2, keep, {"order_id": "ORD-LATE-1"}], order_item=items)
    refresh_orders(spark, path, whole, both)
    got = {r.order_id: (r.has_items, r.items_count, r.items_quantity) for r in refresh.read_mart(spark, path).collect()}
    assert got == {"ORD-LATE-1": (1, 3, 7), "ORD-LATE-2": (1, 2, 2), "KEEP": (0, 0, 0)}


def test_a_deleted_order_leaves_the_mart_and_its_month(spark):
    path = scratch(spark, "mart")
    orders = [{"order_id": "A", "created_at": ago(1)}, {"order_id": "B", "created_at": ago(1)}, {"order_id": "C", "created_at": ago(70)}]
    refresh_orders(spark, path, lake(spark, order=orders), "ABC")
    refresh_orders(spark, path, lake(spark, order=[*orders, *({**orders[i], "_op": "d"} for i in (0, 2))]), "AC")
    assert rows_of(spark, path, "order_id") == [("B",)]
    assert [r[0] for r in spark.read.parquet(path).select(refresh.PERIOD).distinct().collect()] == [202609]


def test_full_replacement_switches_versions_and_survives_a_failed_job(spark):
    root, log = scratch(spark, "mart"), scratch(spark, "log")
    mart = stock.stock_coverage(lake(spark, stock_position=[{"item_id": "A"}, {"item_id": "B"}]), AS_OF)
    refresh.run_logged(spark, log, "stock_coverage", ago(1), lambda: refresh.refresh_full(mart, root, "1"))
    broken = mart.withColumn("x", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception):
        refresh.run_logged(spark, log, "stock_coverage", AS_OF, lambda: refresh.refresh_full(broken, root, "2"))
    assert refresh.read_current(spark, root).count() == 2
    state = only(refresh.refresh_state(spark.read.parquet(log), AS_OF))
    assert (state.status, state.healthy, state.rows) == ("Failed", 0, None)
    # a legal empty result replaces the old rows
    refresh.run_logged(
        spark, log, "stock_coverage", AS_OF + timedelta(minutes=1),
        lambda: refresh.refresh_full(mart.limit(0), root, "3"))
    assert refresh.read_current(spark, root).count() == 0
    state = only(refresh.refresh_state(spark.read.parquet(log), AS_OF + timedelta(minutes=2)))
    assert (state.status, state.healthy, state.age_seconds) == ("Finished", 1, 60)
    checks = quality.refresh_checks(spark.read.parquet(log), AS_OF + timedelta(hours=2))
    assert {r.check_id: r.passed for r in checks.collect()} == {
        "marts.refresh_health": 0, "marts.refresh_duration": 1}
    late = only(refresh.refresh_state(spark.read.parquet(log), AS_OF + timedelta(hours=2)))
    assert late.healthy == 0


def test_second_order_copy_holds_the_same_rows_in_key_ranges(spark):
    a_lake = lake(spark, order=[{"order_id": str(n), "customer_id": f"C{n % 7}"} for n in range(40)])
    mart = sales.order_360(a_lake, lookups(a_lake), AS_OF, None)
    path = scratch(spark, "copy")
    refresh.write_second_order(mart, path, ["customer_id", "order_created_at"])
    copy = spark.read.parquet(path)
    assert copy.count() == 40
    newest = reports.customer_orders(copy, "C3", 2).collect()
    assert len(newest) == 2 and all(r.customer_id == "C3" for r in newest)


def test_window_is_stretched_to_whole_partitions():
    assert refresh.aligned_days(AS_OF, 3, "day") == 3
    assert refresh.aligned_days(AS_OF, 3, "month") == 12
    assert refresh.aligned_days(AS_OF, 20, "month") == 43


def test_a_point_read_opens_one_file_and_finds_every_key(spark):
    path = scratch(spark, "keyed")
    df = spark.range(2_000).select(F.format_string("é%d", "id").alias("k"), F.col("id").alias("v"))
    df = df.unionAll(spark.createDataFrame([(None, -1), ("", -2), ("é7", -3)], "k string, v bigint"))
    for parts in (3, 8):  # written again with other parts
        refresh.write_keyed(df, path, "k", parts)
    one = refresh.read_keyed(spark, path, df.schema, "k", "é7")
    assert sorted(r.v for r in one.collect()) == [-3, 7]
    assert len(one.inputFiles()) == 1
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(k,é7)" in plan.replace("In(k, [é7])", "EqualTo(k,é7)")
    several = refresh.read_keyed(spark, path, df.schema, "k", "é1", "é1999", "", "none")
    assert sorted(r.v for r in several.collect()) == [-2, 1, 1999]
    refresh.write_keyed(df.limit(0), path, "k", 8)
    assert refresh.read_keyed(spark, path, df.schema, "k", "é7").count() == 0


@pytest.mark.parametrize("lost_at", ["rows", "gone", "replaced"])
def test_the_next_refresh_finishes_one_that_was_cut_off(spark, lost_at, monkeypatch):
    path = scratch(spark, "mart")
    job = lambda *days: lambda at, span: spark.createDataFrame(
        [(ago(d).date(), d) for d in days], "day date, n int")
    refresh.refresh_window(job(1, 2, 100), path, AS_OF, 200, "day", "day")

    def lost(*args):
        raise ConnectionError

    with monkeypatch.context() as patch:
        if lost_at == "rows":  # staged, not yet decided
            patch.setattr(refresh.files, "partitions", lost)
        elif lost_at == "gone":  # decided, nothing replaced
            patch.setattr(refresh, "_finish", lost)
        else:  # replaced, the vanished day still there
            delete = refresh.files.delete
            patch.setattr(refresh.files, "delete", lambda s, p: lost() if f"{refresh.PERIOD}=" in p else delete(s, p))
        with pytest.raises(ConnectionError):
            refresh.refresh_window(job(2, 3), path, AS_OF, 3, "day", "day")
    assert refresh.files.exists(spark, f"{path}-staging")
    assert refresh.recover(spark, path) is (lost_at != "rows")
    assert rows_of(spark, path, "n") == ([(1,), (2,), (100,)] if lost_at == "rows" else [(2,), (3,), (100,)])
    assert not refresh.files.exists(spark, f"{path}-staging")
    assert refresh.recover(spark, path) is False


def test_recomputed_rows_are_staged_once_and_kept_rows_beside_them(spark, tmp_path, monkeypatch):
    path, finish, seen = str(tmp_path / "mart"), refresh._finish, []

    def look(session, where):
        seen.append({n: session.read.parquet(f"{where}-staging/{n}").count() for n in ("rows", "kept")
                     if refresh.files.exists(session, f"{where}-staging/{n}")})
        finish(session, where)

    def job(value):
        return lambda keys: keys.select("k", F.lit(value).alias("v"), F.lit(datetime(2024, 1, 5)).alias("at"))

    monkeypatch.setattr(refresh, "_finish", look)
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert refresh.refresh_keys(job(1), every, path, "k", "at") == 3
    assert refresh.refresh_keys(job(2), every.where("k = 'b'"), path, "k", "at") == 1
    assert seen == [{"rows": 3}, {"rows": 1, "kept": 2}]
    assert {(r.k, r.v) for r in refresh.read_mart(spark, path).collect()} == {("a", 1), ("b", 2), ("c", 1)}


def keyed_rows(value, *days):
    """A job that dates the key ``n`` by the n-th of ``days``."""
    dates = F.array(*[F.lit(datetime(2024, month, 5)) for month in days])
    return lambda keys: keys.select("k", F.lit(value).alias("v"), F.get(dates, F.col("k").cast("int")).alias("at"))


def mart_files(path):
    return sorted(str(f.relative_to(path)) for f in path.glob(f"{refresh.PERIOD}=*/*.parquet"))


def test_staged_files_become_the_mart_and_no_shuffle_is_left_behind(spark, tmp_path, monkeypatch):
    path, finish, staged_files = tmp_path / "mart", refresh._finish, []
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in disk.getAllBlocks().mkString("\n").split("\n") if b.startswith("shuffle_")}

    def look(session, where):
        stage = tmp_path / "mart-staging"
        staged_files.append(sorted(mart_files(stage / "rows") + mart_files(stage / "kept")))
        finish(session, where)

    monkeypatch.setattr(refresh, "_finish", look)
    every = spark.range(4).select(F.col("id").cast("string").alias("k"))
    refresh.refresh_keys(keyed_rows("a", 1, 1, 2, 2), every, str(path), "k", "at")
    assert mart_files(path) == staged_files[0] and len(staged_files[0]) == 2
    # a row leaves its month, another one is replaced, the third month is new
    refresh.refresh_keys(keyed_rows("b", 1, 3, 2, 2), every.where("k in ('1', '2')"), str(path), "k", "at")
    assert mart_files(path) == staged_files[1]
    assert rows_of(spark, str(path), "k", "v") == [("0", "a"), ("1", "b"), ("2", "b"), ("3", "a")]
    before = shuffled()
    rows = every.repartition(3).withColumn(refresh.PERIOD, F.lit("202401"))
    assert refresh._stage(rows, str(tmp_path / "other")).count() == 4
    # the count's own, and none of the staged write
    assert len({b.split("_")[1] for b in shuffled() - before}) <= 1


@pytest.mark.parametrize("gather", [True, False])
def test_rows_of_other_keys_are_kept_whatever_the_sieve_says(spark, monkeypatch, gather):
    monkeypatch.setattr(joins, "SIEVE_BITS", (1 << 12, 1 << 12))  # so few that many others pass
    old = spark.range(8_000).select(F.col("id").cast("string").alias("k"), F.lit("202401").alias(refresh.PERIOD))
    old = old.unionAll(old.limit(3)).unionAll(spark.createDataFrame([(None, "202401")], f"k string, {refresh.PERIOD} string"))
    keys = spark.range(0, 8_000, 4).select(F.col("id").cast("string").alias("k"))
    keys = keys.unionAll(spark.createDataFrame([(None,)], "k string"))
    kept = refresh._without(old, keys, joins.sieve(keys), gather)
    want = old.join(keys, "k", "left_anti")
    assert kept.count() == want.count() and kept.exceptAll(want).isEmpty()


def test_a_sieve_passes_every_key_and_few_others(spark):
    number = F.col("id").cast("string").alias("k")
    keys = spark.range(20_000).select(number)
    through = joins.sieve(keys)
    assert keys.where(~joins.passes(["k"], through)).isEmpty()
    assert spark.range(20_000, 40_000).select(number).where(joins.passes(["k"], through)).count() < 2_000
    none = joins.sieve(keys.limit(0))
    assert keys.where(joins.passes(["k"], none)).isEmpty()
    # a key of another type has other hashes
    assert joins.can_sieve(keys, keys) and not joins.can_sieve(spark.range(1).withColumnRenamed("id", "k"), keys)


def test_only_items_of_wanted_orders_are_shuffled(spark):
    """The filter stands below the join of the items with their orders, not above it."""
    tables = RetailTables(spark, SMALL)
    keys = spark.createDataFrame([("1",)], "order_id string")
    core = to_core(tables.landing("order_item"), CONTRACTS["order_item"])
    found = current_of(core, CONTRACTS["order_item"], keys, joins.sieve(keys))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = next(n for n, line in enumerate(plan) if "Join LeftOuter" in line)
    assert not any("getbit" in line for line in plan[:joined])
    assert any("getbit" in line for line in plan[joined:])
    assert found.exceptAll(current_of(core, CONTRACTS["order_item"], keys)).isEmpty() and not found.isEmpty()


def test_a_replacement_cut_off_at_any_step_is_finished(spark, tmp_path, monkeypatch):
    made = tmp_path / "made"
    write = lambda rows, to: refresh._write_periods(spark.createDataFrame(rows, f"k string, {refresh.PERIOD} string"), str(to))
    write([("old", "1"), ("old", "2"), ("old", "3"), ("stays", "4")], made / "mart")
    write([("new", "1"), ("new", "2"), ("new", "5")], made / "mart-staging" / "rows")
    write([("kept", "1"), ("kept", "6")], made / "mart-staging" / "kept")
    spark.createDataFrame([("3",)], "label string").write.parquet(str(made / "mart-staging" / "gone"))
    want = [("kept", 1), ("kept", 6), ("new", 1), ("new", 2), ("new", 5), ("stays", 4)]
    steps = {name: getattr(refresh.files, name) for name in ("move", "delete")}
    for cut in range(40):
        top = tmp_path / str(cut)
        shutil.copytree(made, top)
        left = [cut]

        def step(name):
            def one(session, *paths):
                left[0] -= 1
                if left[0] < 0:
                    raise ConnectionError
                steps[name](session, *paths)

            return one

        with monkeypatch.context() as patch:
            for name in steps:
                patch.setattr(refresh.files, name, step(name))
            try:
                refresh._finish(spark, str(top / "mart"))
                break
            except ConnectionError:
                pass
        refresh.recover(spark, str(top / "mart"))
        got = spark.read.parquet(str(top / "mart")).select("k", refresh.PERIOD).collect()
        assert sorted(tuple(r) for r in got) == want, cut
        assert not (top / "mart-staging").exists()
    assert cut > 10


def test_many_small_files_of_a_period_are_gathered(spark, tmp_path, monkeypatch):
    path = tmp_path / "mart"
    every = spark.range(3).select(F.col("id").cast("string").alias("k"))
    once = lambda value, *keys: refresh.refresh_keys(
        keyed_rows(value, 1, 1, 1), every.where(F.col("k").isin(*keys)), str(path), "k", "at")
    once("a", "0", "1", "2")
    once("b", "0")
    assert len(mart_files(path)) == 2
    monkeypatch.setattr(refresh, "MANY_FILES", 1)
    once("c", "1")
    assert len(mart_files(path)) == 2  # what is kept, and what is new
    assert rows_of(spark, str(path), "k", "v") == [("0", "b"), ("1", "c"), ("2", "a")]
