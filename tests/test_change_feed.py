"""Accepted changes as one unit, the log feed, the managers' inbox, key checks in one scan."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wirework.operators import activity, applied, changes, listings, notify, quality
from wirework.operators import task_changes as D1
from wirework.plans.ids import index_within
from wirework.sources.schemas import SCHEMAS

from test_edge_cases import TS, tables, task, user

AT = TS(2024, 2, 1)


def change(n, task_id, kind, actor=(5, "Electrician"), **more):
    row = dict(task_id=task_id, changed_at=AT + dt.timedelta(minutes=n), seq=n, kind=kind, actor_id=actor[0], actor_role=actor[1], **more)
    return tuple(row.get(c) for c in SCHEMAS["task_changes"].names)


EDIT = dict(title="t", priority="High", scheduled_date=dt.date(2024, 2, 2), estimated_hours=None)


def edit(n, task_id, **more):
    from decimal import Decimal

    return change(n, task_id, "edit", (2, "Manager"), **{**EDIT, "estimated_hours": Decimal("2.00"), **more})


@pytest.fixture(scope="module")
def unit(spark):
    """Task 1 belongs to 5; 6 tries to complete it; it is edited, completed, edited too late."""
    T = tables(spark, users=[user(1, "Admin"), user(2, "Manager"), user(5), user(6)],
               tasks=[task(1, "Assigned", 5, customer=7), task(2, "In Progress", 6, customer=7), task(3, "Cancelled", 5, customer=8)],
               electrician_details=[(5, "E5", None, None, None, 3, None), (6, "E6", None, None, None, None, None)],
               customers=[(7, "old", None, "070", "road", AT), (8, "other", None, "071", "lane", AT)],
               task_materials=[(1, 1, "wire", 2, None), (2, 2, "fuse", 1, None), (3, 3, "lamp", 1, None)],
               task_completions=[(9, 2, "before", None, None, None, AT)])
    batch = spark.createDataFrame([
        change(1, 1, "complete", (6, "Electrician"), completion_notes="not mine"),
        edit(2, 1, status="", customer_name="new", customer_address=""),
        edit(3, 1, customer_phone="079"),
        change(4, 1, "complete", completion_notes="done", additional_charges=None),
        edit(5, 1, customer_name="too late"),
        edit(6, 3, customer_name="closed"),
        edit(7, 2, title="", customer_name="invalid"),
        change(8, 2, "complete", (6, "Electrician"), completion_notes="first"),
        change(9, 2, "complete", (6, "Electrician"), completion_notes="again", materials_used="tape"),
        change(10, 99, "complete", (6, "Electrician")),
        change(11, 1, "status", (2, "Manager"), status="Pending"),
        change(12, 1, "status", (2, "Manager"), status="Bogus"),
        change(13, 1, "assign", (2, "Manager"), assigned_to=6)], SCHEMAS["task_changes"])
    lists = spark.createDataFrame([
        (1, AT + dt.timedelta(minutes=2), 2, 1, "rope", None, 4), (1, AT + dt.timedelta(minutes=3), 3, 1, "", "clip", 0),
        (1, AT + dt.timedelta(minutes=3), 3, 2, None, None, None), (1, AT + dt.timedelta(minutes=5), 5, 1, "late", None, 1),
        (3, AT + dt.timedelta(minutes=6), 6, None, None, None, None)], SCHEMAS["edit_materials"])
    return T, batch, lists


def test_a_change_is_applied_as_a_whole_or_not_at_all(unit):
    T, batch, lists = unit
    out, rejected, decisions = applied.apply_changes(T, batch, lists)
    assert sorted((r.seq, r.reason) for r in rejected.collect()) == [
        (1, "not assigned to this task"), (5, "cannot update completed tasks"), (6, "cannot update cancelled tasks"),
        (7, "validation failed"), (10, "task not found"), (12, "invalid status value")]
    assert sorted(r.seq for r in decisions.filter("applied").collect()) == [2, 3, 4, 8, 9, 11, 13]
    done = {r.task_id: (r.id, r.completion_notes, r.materials_used, float(r.additional_charges)) for r in out.task_completions.collect()}
    assert done == {2: (9, "again", "tape", 0.0), 1: (10, "done", None, 0.0)}
    assert {r.electrician_id: r.total_tasks_completed for r in out.electrician_details.collect()} == {5: 4, 6: None}
    assert {r.id: (r.name, r.phone, r.address) for r in out.customers.collect()} == {7: ("new", "079", ""), 8: ("other", "071", "lane")}
    assert sorted((r.id, r.task_id, r.material_name, r.quantity) for r in out.task_materials.collect()) == [
        (2, 2, "fuse", 1), (3, 3, "lamp", 1), (4, 1, "clip", 1), (5, 1, None, 1)]
    log = [(r.user_id, r.action, r.description) for r in out.activity_logs.orderBy("id").collect()]
    assert log == [(2, "Task Update", "Updated task #1"), (2, "Task Update", "Updated task #1"), (5, "Task Completed", "Completed task 1"),
                   (6, "Task Completed", "Completed task 2"), (6, "Task Completed", "Completed task 2"),
                   (2, "Task Status Update", "Updated task 1 status to Pending")]
    assert [(r.user_id, r.title) for r in out.notifications.collect()] == [(6, "New Task Assigned")]
    assert {r.id: (r.status, r.assigned_to, r.title) for r in out.tasks.collect()} == {
        1: ("Assigned", 6, "t"), 2: ("Completed", 6, "Task 2"), 3: ("Cancelled", 5, "Task 3")}


def test_an_empty_batch_changes_nothing(spark, unit):
    T, batch, lists = unit
    out, rejected, decisions = applied.apply_changes(T, batch.filter(F.lit(False)), lists)
    assert decisions.count() == rejected.count() == 0
    for name in ("tasks", "customers", "task_materials", "task_completions", "electrician_details"):
        assert sorted(map(tuple, getattr(out, name).collect()), key=repr) == sorted(map(tuple, getattr(T, name).collect()), key=repr)


def test_updated_at_moves_with_a_value_only(spark):
    T = tables(spark, users=[user(5)], tasks=[task(1, "Assigned", 5), task(2, "Pending")])
    batch = spark.createDataFrame([change(1, 1, "assign", assigned_to=5), change(2, 2, "status", status="Pending"),
                                   change(3, 2, "assign", assigned_to=5), change(4, 2, "assign", assigned_to=5)], SCHEMAS["task_changes"])
    new, _, _ = D1.apply_task_changes(T.tasks, batch, T.users)
    assert {r.id: r.updated_at for r in new.collect()} == {1: TS(2024, 1, 10), 2: AT + dt.timedelta(minutes=3)}


def test_place_within_a_frequent_key(spark):
    rows = [(1, n) for n in range(400)] + [(2, n) for n in (7, 3, 5)] + [(None, 4), (None, 2)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(5)
    got = {(r.k, r.n): r.at for r in index_within(df, "k", ["n"], "at").collect()}
    assert got == {**{(1, n): n + 1 for n in range(400)}, (2, 3): 1, (2, 5): 2, (2, 7): 3, (None, 2): 1, (None, 4): 2}


def test_toggle_entries_follow_the_flips(spark):
    users = spark.createDataFrame([user(1), user(2, status="Inactive")], SCHEMAS["users"])
    flips = spark.createDataFrame([(1, 4), (1, 2), (1, 9), (2, 1), (3, 1)], SCHEMAS["toggle_requests"])
    got = activity.toggle_entries(users, flips, 10, "2024-01-01 00:00:00").orderBy("k1", "k2").collect()
    assert [(r.k1, r.k2, r.description) for r in got] == [(1, 2, "User deactivated"), (1, 4, "User activated"), (1, 9, "User deactivated"), (2, 1, "User activated")]
    assert {"User activated"} == {r.description for r in got if r.k1 == 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_audience_inbox_equals_every_pair(spark, seed):
    """Readers left out of most of the newest rows, of none, and own rows in between."""
    rng = random.Random(seed)
    users = spark.createDataFrame([user(i, "Manager") for i in range(1, 6)] + [user(6, "Manager", "Inactive"), user(7)], SCHEMAS["users"])
    rows = [(i, AT + dt.timedelta(minutes=rng.randint(0, 40)), "s", i, rng.choice([None, 1, 1, 1, 2, 6]), "task", f"t{i}", "m") for i in range(60)]
    audience = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, source string, source_id long, exclude_user_id long, type string, title string, message string")
    own = [(100 + i, rng.randint(1, 7), "x", f"o{i}", "m", True, AT + dt.timedelta(minutes=rng.randint(0, 40))) for i in range(30)]
    notes = spark.createDataFrame(own, SCHEMAS["notifications"])
    want = []
    for reader in range(1, 6):
        seen = [(r[1], r[0], reader) for r in rows if r[4] != reader] + [(r[6], r[0], reader) for r in own if r[1] == reader]
        want += sorted(seen, reverse=True)[:4]
    got = notify.audience_inbox(notes, audience, users, 4).collect()
    assert sorted((r.created_at, r.id, r.user_id) for r in got) == sorted(want)
    assert notify.audience_inbox(notes.filter(F.lit(False)), audience.filter(F.lit(False)), users).count() == 0


def test_key_checks_scan_each_table_once(spark, T):
    plan = quality.check_keys(T)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.replace("task_materials", "") or plan.count("Join") == 1       # the derivation of the materials
    assert plan.count("Aggregate") == 2


def test_null_primary_keys_are_violations(spark):
    T = tables(spark, users=[user(1), user(1), user(1)], task_materials=[(None, 1, "a", 1, None), (None, 2, "b", 1, None), (4, 2, "b", 1, None)])
    res = {(r.table_name, r.rule, r.column_name): r.violations for r in quality.check_keys(T).collect()}
    assert res["users", "primary_key", "id"] == 1 and res["task_materials", "primary_key", "id"] == 2
    assert res["users", "unique", "username"] == 1 and res["task_materials", "foreign_key", "task_id"] == 3
    assert len(res) == len(quality.RULES)


def test_feeds_read_wide_columns_by_id(spark, T):
    plan = listings.recent_activities(T)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id") and " IN (" in plan or "INSET" in plan


def test_unassigned_tasks_are_not_joined_on_their_assignee(spark):
    T = tables(spark, users=[user(1, "Admin"), user(5), user(6)], tasks=[task(1), task(2, assigned=5, created_by=6), task(3, assigned=6)])
    out, refused = changes.purge_users(T, spark.createDataFrame([(5,), (6,)], "id long"), 1)
    assert {r.id: (r.assigned_to, r.created_by) for r in out.tasks.collect()} == {1: (None, 1), 2: (None, 1), 3: (None, 1)}
    assert refused.count() == 0 and "isnotnull(assigned_to" in out.tasks._jdf.queryExecution().optimizedPlan().toString().lower()
