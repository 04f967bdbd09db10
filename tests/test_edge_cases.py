"""Hand-made cases for the behaviours SURVEY §1.4 lists (T1-T20) and the
row rules of the write paths."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wirework.functions import columns as fc
from wirework.operators import changes, listings, notify, performance, quality, stats
from wirework.operators.task_changes import apply_task_changes
from wirework.plans.ids import assign_ids
from wirework.sources.schemas import CHANGE_CORE, SCHEMAS
from wirework.sources.tables import TABLE_NAMES, Tables, empty, load_tables, seed_tables

D = dt.date
TS = dt.datetime


def tables(spark, **rows):
    dfs = {}
    for name in TABLE_NAMES:
        dfs[name] = (spark.createDataFrame(rows[name], SCHEMAS[name]) if name in rows
                     else empty(spark, name))
    for name, r in rows.items():
        if name not in dfs:
            dfs[name] = spark.createDataFrame(r, SCHEMAS[name])
    return Tables(**dfs)


def user(i, role="Electrician", status="Active", name=None, phone="0771234567"):
    return (i, f"u{i}", f"u{i}@x.test", None, name or f"User {i}", phone, role, status,
            TS(2024, 1, 1), None)


def task(i, status="Pending", assigned=None, created=TS(2024, 1, 10), updated=None, sched=None,
         start=None, end=None, priority="Medium", created_by=1, customer=None):
    return (i, f"T{i:06d}", f"Task {i}", None, customer, priority, status, created_by, assigned,
            sched, None, None, None, start, end, created, updated or created)


def test_seed_tables_load(spark):
    T = seed_tables(spark, D(2024, 1, 31))
    assert T.users.count() == 12
    assert T.tasks.filter(F.col("scheduled_date") == D(2024, 2, 1)).count() == 10


def test_load_tables_by_uri(spark, tmp_path):
    T = seed_tables(spark, D(2024, 1, 31))
    for name in TABLE_NAMES:
        if name != "reports":
            getattr(T, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert load_tables(spark, path).users.count() == 12
    with pytest.raises(FileNotFoundError):
        load_tables(spark, f"file://{tmp_path}/none")


def test_change_before_1970_comes_after_the_current_row(spark):
    T = tables(spark, users=[user(1)], tasks=[task(1)])
    ch = spark.createDataFrame([(1, TS(1969, 12, 30), 1, "status", "In Progress", None)], CHANGE_CORE)
    new, rejected, _ = apply_task_changes(T.tasks, ch, T.users)
    assert new.first().status == "In Progress" and rejected.count() == 0


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(None,), (1,), (5,), (9,), (100,)], "k bigint")
    assert [(r.k, r.id) for r in assign_ids(df, ["k"], 0).orderBy("id").collect()] == \
        [(None, 1), (1, 2), (5, 3), (9, 4), (100, 5)]


def test_escape_covers_slashes_and_backticks(spark):
    df = spark.createDataFrame([("a/b\\c`d<'",)], "t string")
    assert df.select(fc.normalise_text("t")).first()[0] == "a&#x2F;b&#x5C;c&#96;d&lt;&#x27;"


def test_enum_priority_sorts_by_declaration_desc(spark):
    # ORDER BY priority DESC on ENUM('High','Medium','Low') gives Low, Medium, High
    T = tables(spark, tasks=[task(1, priority="High", sched=D(2024, 1, 1)),
                             task(2, priority="Low", sched=D(2024, 1, 1)),
                             task(3, priority="Medium", sched=D(2024, 1, 1))])
    out = [r.priority for r in listings.task_listing(T).collect()]
    assert out == ["Low", "Medium", "High"]


def test_whole_hours_truncate(spark):
    # 00:59 -> 02:00 is one whole hour, not two boundaries
    df = spark.createDataFrame([(TS(2024, 1, 1, 0, 59), TS(2024, 1, 1, 2, 0))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(fc.whole_hours("a", "b").alias("h"), fc.abs_whole_hours("b", "a").alias("g")).first()
    assert r.h == 1 and r.g == 1


def test_performance_labels_and_window(spark):
    # T1 (employee code from details), T5 (12-month window in the ON clause), labels
    T = tables(
        spark,
        users=[user(1), user(2), user(3), user(4, status="Inactive")],
        electrician_details=[(1, "E1", None, None, None, None, None)],
        tasks=[task(10, "Completed", 1, TS(2024, 1, 5), TS(2024, 1, 5, 5), start=TS(2024, 1, 5, 1),
                    end=TS(2024, 1, 5, 3, 59)),
               task(11, "Completed", 1, TS(2024, 1, 6), TS(2024, 1, 6, 7)),
               task(12, "Completed", 2, TS(2022, 1, 1))],        # outside the window
        task_ratings=[(1, 10, 5, None, None), (2, 11, 4, None, None)])
    rows = {r.id: r for r in performance.user_performance(T, "2024-01-31").collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].employee_code == "E1" and rows[1].total_tasks == 2
    assert rows[1].avg_completion_time == 4.5          # (2 + 7) / 2
    assert rows[1].avg_rating == 4.5 and rows[1].performance_rating == "Excellent"
    assert rows[2].total_tasks == 0 and rows[2].performance_rating == "No Tasks"
    assert rows[2].completed_tasks == 0 and rows[2].avg_rating is None


def test_sum_null_count_zero_on_empty(spark):
    # SUM over no rows is NULL, COUNT is 0; system stats coalesce to 0
    T = tables(spark)
    r = stats.admin_stats(T).first()
    assert r.totalUsers == 0 and r.activeUsers is None and r.totalTasks == 0
    s = stats.system_user_stats(T).first()
    assert s.total_admins == 0 and s.active_users == 0
    d = stats.daily_summary(T, "2024-01-01").first()
    assert d.total_tasks == 0 and d.completed_tasks is None


def test_account_activity_counts_resets_as_registrations(spark):
    # Faithful form counts every union row; strict form only registrations
    T = tables(spark, users=[user(1)],
               activity_logs=[(1, 1, "Password Reset", None, None, TS(2024, 1, 20))])
    r = stats.account_activity(T, "2024-01-31").first()
    assert (r.new_registrations, r.password_resets) == (2, 1)
    s = stats.account_activity(T, "2024-01-31", strict=True).first()
    assert s.new_registrations == 1


def test_login_windows_are_open_ended(spark):
    # T6: ">= today - n" with no upper bound
    T = tables(spark, activity_logs=[(1, 1, "Login", None, None, TS(2024, 1, 24, 0, 0)),
                                     (2, 1, "Login", None, None, TS(2024, 2, 5)),
                                     (3, None, "Login", None, None, TS(2024, 1, 30))])
    r = stats.login_activity(T, "2024-01-31", 7).first()
    assert (r.unique_logins, r.total_logins) == (1, 3)


def test_phone_and_name_rules():
    import pyspark.sql.functions as F  # noqa: F401

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [("077 123 4567", True), ("+94-77-123-4567", True), ("0111234567", False), ("", False),
            (None, False), (" 077 1234567", True), ("77123456", False)]
    df = spark.createDataFrame(rows, "p string, ok boolean")
    got = [r.v for r in df.select(fc.phone_valid("p").alias("v")).collect()]
    assert got == [ok for _, ok in rows]
    names = [("Jo", True), ("J", False), ("12345", False), ("A1234567", False), ("Ann 2", True),
             ("   Bo  ", True), ("", False), (None, False)]
    nf = spark.createDataFrame(names, "n string, ok boolean")
    assert [r.v for r in nf.select(fc.full_name_valid("n").alias("v")).collect()] == [ok for _, ok in names]


def test_clean_phone_and_normalise_text(spark):
    df = spark.createDataFrame([("07-7 12\t3", " <b>&'x\" "), (None, None)], "p string, t string")
    r = df.select(fc.clean_phone("p").alias("c"), fc.normalise_text("t").alias("n")).collect()
    assert r[0].c == "077123" and r[1].c == ""
    assert r[0].n == "&lt;b&gt;&amp;&#x27;x&quot;"


def test_task_code_is_last_six_millis_digits(spark):
    df = spark.createDataFrame([(TS(2024, 1, 1, 0, 0, 1, 234000),)], "t timestamp_ntz")
    ms = 1704067201234
    assert df.select(fc.task_code("t").alias("c")).first().c == "T" + str(ms)[-6:]


def test_rating_rollup_rounds_like_decimal_storage(spark):
    # Mean 3.675 (sum 147 over 40) must store as 3.68, not 3.67 (binary double)
    ratings = [(i, i, 4 if i <= 27 else 3, None, None) for i in range(1, 41)]
    ratings[0] = (1, 1, 4, None, None)
    total = sum(r[2] for r in ratings)
    assert total == 147
    T = tables(spark, users=[user(7)], electrician_details=[(7, None, None, None, None, None, None)],
               tasks=[task(i, "Completed", 7) for i in range(1, 41)], task_ratings=ratings)
    assert stats.electrician_rating(T).first().rating == Decimal("3.68")


def test_quantity_and_name_defaults(spark):
    # Quantity 0 or NULL -> 1; '' name falls back to material_name
    T = tables(spark, tasks=[task(1)], task_materials=[(5, 1, "old", 2, None)])
    payload = spark.createDataFrame(
        [(1, "edit", [("", "wire", 0), ("bulb", None, None)])],
        "task_id bigint, op string, materials array<struct<name:string,material_name:string,quantity:int>>")
    out = changes.replace_materials(T.task_materials, changes.materials_long_form(payload), T.tasks)
    rows = sorted((r.material_name, r.quantity) for r in out.collect())
    assert rows == [("bulb", 1), ("wire", 1)]
    empty_list = spark.createDataFrame(
        [(1, "edit", [])],
        "task_id bigint, op string, materials array<struct<name:string,material_name:string,quantity:int>>")
    assert changes.replace_materials(T.task_materials, changes.materials_long_form(empty_list),
                                     T.tasks).count() == 0
    absent = spark.createDataFrame(
        [(1, "edit", None)],
        "task_id bigint, op string, materials array<struct<name:string,material_name:string,quantity:int>>")
    assert changes.replace_materials(T.task_materials, changes.materials_long_form(absent),
                                     T.tasks).count() == 1


def test_resolution_concat_null_stays_null(spark):
    # CONCAT with NULL description is NULL
    T = tables(spark, users=[user(2, role="Manager")],
               issues=[(1, 1, 3, "x", None, "urgent", "open", None, TS(2024, 1, 1), None, None),
                       (2, 1, 3, "y", "desc", "urgent", "open", None, TS(2024, 1, 1), None, None)])
    ch = spark.createDataFrame([(1, "resolved", "done", 2, TS(2024, 1, 2), 1),
                                (2, "resolved", "done", 2, TS(2024, 1, 2), 2),
                                (2, "resolved", "", 2, TS(2024, 1, 3), 3)], SCHEMAS["issue_changes"])
    rows = {r.id: r for r in changes.resolve_issues(T.issues, ch, T.users).collect()}
    assert rows[1].description is None and rows[1].status == "resolved"
    assert rows[2].description == "desc\n\nRESOLUTION: done" and rows[2].resolved_at == TS(2024, 1, 3)
    notes = notify.notify_issue_resolved(T.issues, ch, T.users).collect()
    assert len(notes) == 3 and {n.user_id for n in notes} == {3}


def test_toggle_parity_and_mark_read_needs_owner(spark):
    T = tables(spark, users=[user(1), user(2, status="Inactive")],
               notifications=[(1, 1, "t", "a", None, False, None), (2, 2, "t", "b", None, False, None)])
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], SCHEMAS["toggle_requests"])
    st = {r.id: r.status for r in changes.toggle_status(T.users, t).collect()}
    assert st == {1: "Active", 2: "Active"}
    reads = spark.createDataFrame([(1, 1), (2, 1)], SCHEMAS["notification_reads"])
    rd = {r.id: r.is_read for r in changes.mark_read(T.notifications, reads).collect()}
    assert rd == {1: True, 2: False}


def test_patch_customers_keeps_nulls_and_skips_empty_patch(spark):
    T = tables(spark, customers=[(1, "A", None, "070", "addr", None)])
    p = spark.createDataFrame([(1, "B", None, None, 1), (1, "", "", "", 2), (1, None, None, "new", 3),
                               (1, "", "071", None, 4)], SCHEMAS["customer_patches"])
    r = changes.patch_customers(T.customers, p).first()
    assert (r.name, r.phone, r.address) == ("", "071", "new")


def test_issue_priority_default_and_reporter_must_be_assignee(spark):
    T = tables(spark, users=[user(3), user(4, role="Manager")], tasks=[task(1, "Assigned", 3)])
    req = spark.createDataFrame(
        [(1, 1, 3, "safety", "d", "", None, TS(2024, 1, 1)),
         (2, 1, 4, "safety", "d", "urgent", None, TS(2024, 1, 1)),
         (3, 1, 3, "safety", "d", "urgent", None, TS(2024, 1, 2))], SCHEMAS["issue_requests"])
    new, rej = changes.issue_intake(req, T.tasks, T.users, T.issues)
    got = sorted((r.id, r.priority) for r in new.collect())
    assert got == [(1, "normal"), (2, "urgent")]
    assert [r.request_id for r in rej.collect()] == [2]


def test_notify_issue_reported_each_user_once(spark):
    T = tables(spark, users=[user(2, role="Manager"), user(5, role="Manager"), user(6, role="Manager", status="Inactive")],
               tasks=[task(1, created_by=2)])
    new_issue = spark.createDataFrame([(9, 1, 3, "safety", None, "normal", "open", None, None, None, None)],
                                      SCHEMAS["issues"])
    notes = notify.notify_issue_reported(new_issue, T.tasks)
    readers = T.users.select("id")
    per_user = notify.expand_audience(notes, T.users, readers).groupBy("user_id").count().collect()
    assert sorted((r.user_id, r["count"]) for r in per_user) == [(2, 1), (5, 1)]


def test_check_users_messages(spark):
    df = spark.createDataFrame([user(1, phone="011"), user(2, name="12")], SCHEMAS["users"])
    errs = {r.id: r.errors for r in quality.check_users(df).collect()}
    assert "Please enter a valid Sri Lankan mobile number (07X XXX XXXX)" in errs[1]
    assert "Full name cannot be only numbers and must be at least 2 characters long" in errs[2]


def test_check_keys_flags_duplicates_and_orphans(spark):
    T = tables(spark, users=[user(1), user(1)], tasks=[task(1, assigned=9)])
    res = {(r.table_name, r.rule, r.column_name): r.violations for r in quality.check_keys(T).collect()}
    assert res[("users", "primary_key", "id")] == 1
    assert res[("tasks", "foreign_key", "assigned_to")] == 1
    assert res[("tasks", "foreign_key", "created_by")] == 0


def test_visible_rows_and_roles(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id long, assigned_to long")
    assert listings.visible_rows(df, "Electrician", 5, "assigned_to").count() == 1
    assert listings.visible_rows(df, "Manager", 5, "assigned_to").count() == 2
    assert listings.report_allowed("system_usage", "Admin")
    assert not listings.report_allowed("system_usage", "Manager")
    assert listings.can_view_issues("Manager") and not listings.can_view_issues("Electrician")


def test_load_tables_round_trip(spark, T):
    import tempfile

    from wirework.sources.sinks import write_tables
    from wirework.sources.tables import load_tables

    path = tempfile.mkdtemp(prefix="wirework-tables-", dir="/tmp")
    write_tables(T, path)
    L = load_tables(spark, path)
    for name in ("users", "tasks", "task_ratings", "issues", "reports"):
        assert getattr(L, name).schema == SCHEMAS[name]
        assert getattr(L, name).count() == getattr(T, name).count()
    assert L.task_changes is None


def test_nested_reports_agree_with_flat_sections(T):
    from wirework.plans import reports

    r = reports.system_usage_report(T, "2024-01-31").summary.first()
    u = stats.system_user_stats(T).first()
    la = stats.login_activity(T, "2024-01-31").first()
    acc = stats.account_activity(T, "2024-01-31").first()
    assert r.user_statistics.total == u.total_users
    assert r.user_statistics.by_role.managers == u.total_managers
    assert r.login_activity.last_30_days.total_logins == la.total_logins
    assert len(r.login_activity.daily_stats) == stats.daily_logins(T, "2024-01-31").count()
    assert len(r.login_activity.recent_logins) == min(10, listings.recent_logins(T).count())
    assert r.account_activity.new_registrations == acc.new_registrations
    d = reports.daily_stats_report(T, "2001-08-02")
    flat = reports.daily_stats_summary(T, "2001-08-02").first()
    assert d.summary.first().summary.total_tasks == flat.total_tasks
    assert sum(x["count"] for x in d.summary.first().tasks_by_status) == flat.total_tasks
    p = reports.user_performance_report(T, "2001-08-02")
    assert p.sections["performance"].count() == performance.user_performance(T, "2001-08-02").count()


def test_nest_materials_and_report_dispatch(spark, T):
    import pytest

    from wirework.plans import reports

    ids = T.tasks.select("id").orderBy("id").limit(3)
    detail = listings.task_detail(T, ids)
    nested = listings.nest_materials(detail, listings.task_detail_materials(T, ids))
    got = {r.id: len(r.materials) for r in nested.collect()}
    want = {r.task_id: r["count"] for r in T.task_materials.join(
        ids.withColumnRenamed("id", "task_id"), "task_id").groupBy("task_id").count().collect()}
    assert all(got[k] == want.get(k, 0) for k in got) and len(got) == 3
    with pytest.raises(PermissionError):
        reports.generate_report(T, "system_usage", "Manager", "2024-01-31")
    with pytest.raises(ValueError):
        reports.generate_report(T, "audit", "Admin", "2024-01-31")
    assert reports.generate_report(T, "daily_stats", "Manager", "2001-08-02").summary.count() == 1
