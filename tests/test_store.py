"""Stored core tables: the cost of a batch, folding, compaction, and reconciliation with landing."""

from pyspark.sql import functions as F

from tests.support import SMALL, ago, lake, only, records
from tidemark.contracts import CONTRACTS
from tidemark.operators import cdc
from tidemark.operators.cdc import Lake, to_core
from tidemark.operators.store import Store
from tidemark.plans import quality
from tidemark.plans.catalog import workspace
from tidemark.plans.workspace import Workspace
from tidemark.session import scratch
from tidemark.sources import files
from tests.support import AS_OF

ORDER = CONTRACTS["order"]


def core(spark, rows):
    return to_core(records(spark, "order", rows), ORDER)


def state(store):
    return sorted((r.order_id, r.order_status, r._cdc_seq, r._is_deleted) for r in store.table().collect())


def filled(spark, n=400, buckets=4):
    store = Store(spark, scratch(spark, "store"), ORDER, buckets)
    store.append(core(spark, [{"order_id": str(i), "_cdc_seq": 1} for i in range(n)]), "load", 0, one_per_key=True)
    return store


def test_a_batch_writes_its_own_rows_only(spark):
    store = filled(spark)
    assert all(p.folded for p in store.parts) and len(store.parts) == 4
    before = set(store.parts)
    for batch in range(3):
        store.append(core(spark, [{"order_id": str(batch), "order_status": "shipped", "_cdc_seq": 2}]), "w", batch, one_per_key=True)
        store.fold(store.due())
    new = [p for p in store.parts if p not in before]
    assert before <= set(store.parts)  # not one file of the filled table was written again
    assert sorted(p.rows for p in new) == [1, 1, 1]
    assert [s for i, s, _, _ in state(store) if i in ("0", "1", "2")] == ["shipped"] * 3
    assert len(state(store)) == 400


def test_only_due_buckets_are_folded(spark):
    store = filled(spark)
    of = {r.order_id: r.b for r in store.table().select("order_id", store.bucket().alias("b")).collect()}
    mine = [i for i, b in of.items() if b == 2][:60]
    store.append(core(spark, [{"order_id": i, "order_status": "shipped", "_cdc_seq": 2} for i in mine]), "w", 0, one_per_key=True)
    before = {p for p in store.parts if p.bucket != 2}
    assert store.due() == [2]
    store.fold(store.due())
    assert before <= set(store.parts) and store.due() == []
    (part,) = (p for p in store.parts if p.bucket == 2)
    assert part.folded and part.rows == sum(b == 2 for b in of.values())
    assert sum(s == "shipped" for _, s, _, _ in state(store)) == 60


def test_many_small_batches_are_folded_by_their_number(spark):
    store = filled(spark, buckets=1)
    for batch in range(3):
        store.append(core(spark, [{"order_id": "1", "_cdc_seq": 2 + batch}]), "w", batch, one_per_key=True)
    assert store.due(most=3) == [] and store.due(most=2) == [0]


def test_a_crash_before_the_commit_leaves_the_version_before(spark):
    store = filled(spark)
    rows = core(spark, [{"order_id": "1", "order_status": "shipped", "_cdc_seq": 2}])
    store._write(rows, "w-0", ())  # the run is there, the manifest is not
    files.delete(spark, f"{store.root}/manifest/version=9")
    rows.limit(0).write.parquet(f"{store.root}/manifest/version=9/half")  # a version without its mark of success
    again = Store(spark, store.root, ORDER)
    assert again.version == store.version and state(again) == state(store)
    assert again.append(rows, "w", 0, one_per_key=True)
    assert not Store(spark, store.root, ORDER).append(rows, "w", 0, one_per_key=True)
    assert sum(s == "shipped" for _, s, _, _ in state(Store(spark, store.root, ORDER))) == 1


def test_replaced_parts_are_removed_two_commits_later(spark):
    store = filled(spark, buckets=1)
    first = store._folder(store.parts[0].run, 0)
    store.replace(store.table(), [0], folded=True)
    assert files.exists(spark, first)
    store.replace(store.table(), [0], folded=True)
    assert not files.exists(spark, first)
    assert len(state(store)) == 400
    assert len(files.partitions(spark, f"{store.root}/manifest", "version")) == 2


def test_compaction_rewrites_only_what_holds_older_versions(spark):
    store = Store(spark, scratch(spark, "store"), ORDER, 4)
    rows = [{"order_id": str(i), "_cdc_seq": 1} for i in range(200)]
    store.append(core(spark, rows), "load", 0)
    of = {r.order_id: r.b for r in store.versions().select("order_id", store.bucket().alias("b")).collect()}
    mine = [i for i, b in of.items() if b in (1, 3)]
    store.append(core(spark, [{"order_id": i, "_op": "d" if i == mine[0] else "u", "_cdc_seq": 2} for i in mine]), "load", 1)
    before, size = state(store), sum(p.bytes for p in store.parts)
    kept = {p for p in store.parts if p.bucket in (0, 2)}
    assert store.superseded() == {b: sum(of[i] == b for i in mine) for b in (1, 3)}
    assert store.compact() == [1, 3]
    assert kept <= set(store.parts) and state(store) == before
    assert sum(p.bytes for p in store.parts) < size and store.versions().count() == 200
    assert store.compact() == []


def test_tombstones_hold_until_their_horizon(spark):
    store = Store(spark, scratch(spark, "store"), ORDER, 2)
    store.append(core(spark, [
        {"order_id": "A", "_cdc_seq": 5, "created_at": ago(9)}, {"order_id": "A", "_op": "d", "_cdc_seq": 9, "created_at": ago(9)},
        {"order_id": "B", "_cdc_seq": 1}, {"order_id": "B", "order_status": "shipped", "_cdc_seq": 2},
    ]), "w", 0)
    store.compact()
    assert state(store) == [("A", "paid", 9, 1), ("B", "shipped", 2, 0)]
    # an older version of the deleted key arrives late: it stays dead
    store.append(core(spark, [{"order_id": "A", "_cdc_seq": 7}]), "w", 1)
    assert [r.order_id for r in store.current().collect()] == ["B"]
    store.compact(tombstones_after=ago(10))
    assert len(state(store)) == 2
    assert store.compact(tombstones_after=ago(0)) != []
    assert state(store) == [("B", "shipped", 2, 0)]


def test_an_empty_store(spark):
    store = Store(spark, scratch(spark, "store"), ORDER, 2)
    assert state(store) == [] and store.compact() == [] and store.due() == []
    store.append(core(spark, []), "w", 0)
    assert Store(spark, store.root, ORDER).writers == {"w": 0}
    assert store.differing(records(spark, "order", [])) == []


def test_spoilt_buckets_are_found_and_rebuilt_alone(spark):
    raw = workspace(spark, SMALL).lake.landing("order")
    store = Store(spark, scratch(spark, "store"), ORDER, 6)
    whole = to_core(raw, ORDER)
    spoilt = F.when(store.bucket() == 4, F.lit("lost")).otherwise(F.col("order_status"))
    store.append(whole.where(store.bucket() != 1).withColumn("order_status", spoilt), "load", 0)
    assert store.differing(raw) == [1, 4]
    found = store.differences(raw, [1, 4]).collect()
    gone = [r for r in found if r.stored_rows == 0]
    assert gone and len(gone) < len(found) and all(r.landed_rows == 1 for r in found)
    others = {p for p in store.parts if p.bucket not in (1, 4)}
    store.rebuild(raw, store.differing(raw))
    assert others <= set(store.parts) and store.differing(raw) == []
    assert sorted(store.versions().collect()) == sorted(whole.collect())


def checks(a_lake):
    space = Workspace(a_lake, AS_OF, AS_OF, 400)
    return {i: only(quality.run_check(quality.CHECKS[i], space, AS_OF)).passed for i in ("core.dup_key", "core.reconcile_count")}


def test_planted_faults_of_the_stored_table_turn_the_checks_red(spark):
    base = lake(spark, order=[{"order_id": str(i)} for i in range(9)])
    whole = cdc.newest(base.core("order"), ORDER.key)

    def with_orders(rows):
        store = Store(spark, scratch(spark, "store"), ORDER, 2)
        store._commit(store._write(rows, "planted", range(2)), {})
        stored = {"order": store.table()}
        return Lake(base._landing, CONTRACTS, stored=lambda e: stored.get(e, Lake.state(base, e)))

    assert checks(with_orders(whole)) == {"core.dup_key": 1, "core.reconcile_count": 1}
    assert checks(with_orders(whole.where("order_id <> '3'"))) == {"core.dup_key": 1, "core.reconcile_count": 0}
    twice = whole.unionByName(whole.where("order_id = '4'"))
    assert checks(with_orders(twice))["core.dup_key"] == 0
