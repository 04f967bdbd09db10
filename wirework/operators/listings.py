"""Enriched listings, per-user feeds and the role rules that scope them.

Joins are plain equi-joins; Spark picks the strategy.  A lookup side goes out by
broadcast only when Catalyst / AQE measure it under
``spark.sql.autoBroadcastJoinThreshold``; past that the join sort-merges, and AQE
splits skewed partitions (a hot assignee).  Unassigned tasks (NULL assignee)
go around the assignee lookup instead of hashing to one partition.  Joins keyed
on the task id (completions, ratings) reuse one hash partitioning of the task
rows.

Per-user top-n feeds use ``row_number() <= n`` over a window; Spark plans a
``WindowGroupLimit`` below the shuffle, so a user holding a third of all rows
sends at most n rows per map task to the reducer, not all of them.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lit_date, priority_ordinal
from ..sources.schemas import ISSUES, TASKS
from ..sources.tables import Tables

TASK_COLUMNS = [f.name for f in TASKS.fields]
ISSUE_COLUMNS = [f.name for f in ISSUES.fields]

# --- fixed values: feed sizes and role rules ---------------------------------
ACTIVITY_FEED_SIZE = 20
INBOX_SIZE = 10
RECENT_LOGINS_SIZE = 10
MANAGER_ROLES = ("Manager", "Admin")
REPORT_ROLES = {
    "user_performance": ("Manager", "Admin"),
    "system_usage": ("Admin",),
    "daily_stats": ("Manager", "Admin"),
}
# ---------------------------------------------------------------------------


# --- B12, B13: role rules ---------------------------------------------------------

def visible_rows(df: DataFrame, role: str, user_id: int | None, owner_col: str) -> DataFrame:
    """Technicians see only their own rows, other roles see all."""
    if role == "Electrician":
        return df.filter(F.col(owner_col) == F.lit(user_id))
    return df


def role_filter(df: DataFrame, roles: tuple[str, ...] | list[str], col: str = "role") -> DataFrame:
    """Keep rows whose role is one of ``roles``."""
    return df.filter(F.col(col).isin(*roles))


def can_view_issues(role: str) -> bool:
    return role in MANAGER_ROLES


def report_allowed(report_type: str, role: str) -> bool:
    return role in REPORT_ROLES.get(report_type, ())


def _all(conds: list[Column]) -> Column | None:
    return reduce(and_, conds) if conds else None


# --- B1, B2: tasks -----------------------------------------------------------------

def _task_enrichment(T: Tables, *, creator: bool, contact: bool) -> list[tuple[DataFrame, str]]:
    cust = [F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
            F.col("phone").alias("customer_phone"), F.col("address").alias("customer_address")]
    if contact:
        cust.append(F.col("email").alias("customer_email"))
    tech = [F.col("id").alias("assigned_to"), F.col("full_name").alias("assigned_electrician")]
    if contact:
        tech.append(F.col("phone").alias("electrician_phone"))
    # the assignee lookup goes first: its NULL keys (unassigned tasks) are split
    # off at the scan, and every later join runs once on the union
    parts = [(T.users.select(*tech), "assigned_to"), (T.customers.select(*cust), "customer_id")]
    if creator:
        parts.append((T.users.select(F.col("id").alias("created_by"),
                                     F.col("full_name").alias("created_by_name")), "created_by"))
    parts.append((T.task_completions.select(
        F.col("task_id").alias("id"), "completion_notes", "materials_used", "additional_charges",
        "completed_at"), "id"))
    parts.append((T.task_ratings.select(F.col("task_id").alias("id"), "rating", "feedback"), "id"))
    return parts


def _enrich(tasks: DataFrame, parts: list[tuple[DataFrame, str]]) -> DataFrame:
    from ..plans.joins import left_lookup

    out = tasks
    for side, key in parts:
        out = left_lookup(out, key, side) if key == "assigned_to" else out.join(side, key, "left")
    return out


def task_listing(T: Tables, role: str = "Admin", user_id: int | None = None,
                 status: str | None = None, date: _dt.date | str | None = None,
                 electrician_id: int | None = None) -> DataFrame:
    """B1: tasks with customer, assignee, creator, completion and rating.

    Optional filters are conjuncts on the task side (pushed to the scan).  The
    ``electrician_id`` filter is ignored for technicians, who only see their own
    tasks.  Order: scheduled date desc, then priority by ENUM position desc.
    """
    conds: list[Column] = []
    if role == "Electrician":
        conds.append(F.col("assigned_to") == F.lit(user_id))
    if status:
        conds.append(F.col("status") == F.lit(status))
    if date:
        conds.append(F.col("scheduled_date") == lit_date(date))
    if electrician_id and role != "Electrician":
        conds.append(F.col("assigned_to") == F.lit(electrician_id))
    tasks = T.tasks
    cond = _all(conds)
    if cond is not None:
        tasks = tasks.filter(cond)
    out = _enrich(tasks, _task_enrichment(T, creator=True, contact=False))
    cols = TASK_COLUMNS + ["customer_name", "customer_phone", "customer_address",
                           "assigned_electrician", "created_by_name", "completion_notes",
                           "materials_used", "additional_charges", "completed_at", "rating",
                           "feedback"]
    return (out.orderBy(F.col("scheduled_date").desc(), priority_ordinal().desc(), F.col("id"))
            .select(*cols))


def task_detail(T: Tables, ids: DataFrame | None = None) -> DataFrame:
    """B2 (set form over all tasks, or over the ids in ``ids``): B1's columns
    without the creator, plus customer e-mail and technician phone.  The
    materials list comes separately from ``task_detail_materials`` (the
    reference also reads it with a second statement), so no task's material
    list is ever gathered into one row."""
    tasks = T.tasks if ids is None else T.tasks.join(ids.select("id"), "id", "left_semi")
    out = _enrich(tasks, _task_enrichment(T, creator=False, contact=True))
    cols = TASK_COLUMNS + ["customer_name", "customer_phone", "customer_address", "customer_email",
                           "assigned_electrician", "electrician_phone", "completion_notes",
                           "materials_used", "additional_charges", "completed_at", "rating",
                           "feedback"]
    return out.select(*cols)


def task_detail_materials(T: Tables, ids: DataFrame | None = None) -> DataFrame:
    """B2 materials: every material row of the listed (existing) tasks."""
    tasks = T.tasks.select("id") if ids is None else ids.select("id")
    keys = tasks.select(F.col("id").alias("task_id"))
    return T.task_materials.join(keys, "task_id", "left_semi").select(
        "id", "task_id", "material_name", "quantity", "cost")


def nest_materials(detail: DataFrame, materials: DataFrame) -> DataFrame:
    """Optional nested form of B2 (``materials`` as array<struct>) for callers
    that want the reference's response shape.  Each task's list is built in one
    group, so use it on bounded selections of tasks only."""
    lists = materials.groupBy(F.col("task_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("id", "task_id", "material_name", "quantity", "cost")))
        .alias("materials"))
    empty = F.array().cast("array<struct<id:bigint,task_id:bigint,material_name:string,"
                           "quantity:int,cost:decimal(10,2)>>")
    return (detail.join(lists, "id", "left")
            .withColumn("materials", F.coalesce(F.col("materials"), empty)))


# --- B3-B5: users -------------------------------------------------------------------

_USER_COLS = ["id", "username", "email", "full_name", "phone", "role", "employee_code", "status",
              "created_at", "last_login"]


def _users_with_details(T: Tables) -> DataFrame:
    det = T.electrician_details.withColumnRenamed("electrician_id", "id")
    return T.users.join(det, "id", "left")


def user_directory(T: Tables, role: str | None = None, status: str | None = None) -> DataFrame:
    """Users with rating and completed counter, newest first.  The
    employee code comes from the technician details (the users table has none)."""
    users = T.users
    if role:
        users = users.filter(F.col("role") == F.lit(role))
    if status:
        users = users.filter(F.col("status") == F.lit(status))
    out = _users_with_details(T.with_(users=users))
    return (out.select(*_USER_COLS, "rating", "total_tasks_completed")
            .orderBy(F.col("created_at").desc(), F.col("id")))


def user_profile(T: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Profile rows (never the password) with skills, certifications,
    rating, counter and join date."""
    users = T.users if ids is None else T.users.join(ids.select("id"), "id", "left_semi")
    out = _users_with_details(T.with_(users=users))
    return out.select(*_USER_COLS, "skills", "certifications", "rating", "total_tasks_completed",
                      "join_date")


def electrician_roster(T: Tables) -> DataFrame:
    """Active technicians that have a details row, with the number of their
    tasks in progress; best rated first."""
    from .performance import active_technicians

    current = (T.tasks.filter((F.col("status") == "In Progress") & F.col("assigned_to").isNotNull())
               .groupBy(F.col("assigned_to").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    det = T.electrician_details.withColumnRenamed("electrician_id", "id")
    out = active_technicians(T.users).join(det, "id").join(current, "id", "left")
    return (out.select("id", "full_name", "phone", "employee_code", "status", "skills", "rating",
                       "total_tasks_completed",
                       F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("current_tasks"))
            .orderBy(F.col("rating").desc(), F.col("id")))


# --- B6, B7: issues -----------------------------------------------------------------

def _issue_base(T: Tables, issues: DataFrame, task_cols: list[Column]) -> DataFrame:
    tasks = T.tasks.select(F.col("id").alias("task_id"), *task_cols)
    rep = T.users.select(F.col("id").alias("reported_by"), F.col("full_name").alias("reported_by_name"),
                         F.col("phone").alias("reported_by_phone"))
    res = T.users.select(F.col("id").alias("resolved_by"), F.col("full_name").alias("resolved_by_name"))
    from ..plans.joins import left_lookup

    # unresolved issues (NULL resolver) go around the resolver lookup, first,
    # so the inner joins run once on the union
    return left_lookup(issues, "resolved_by", res).join(tasks, "task_id").join(rep, "reported_by")


def issue_listing(T: Tables, status: str | None = None, priority: str | None = None,
                  start: _dt.date | str | None = None, end: _dt.date | str | None = None) -> DataFrame:
    """Issues with task code and title, reporter and resolver names; the
    date bounds are inclusive on the creation date; newest first."""
    conds: list[Column] = []
    if status:
        conds.append(F.col("status") == F.lit(status))
    if priority:
        conds.append(F.col("priority") == F.lit(priority))
    if start:
        conds.append(F.to_date("created_at") >= lit_date(start))
    if end:
        conds.append(F.to_date("created_at") <= lit_date(end))
    issues = T.issues
    cond = _all(conds)
    if cond is not None:
        issues = issues.filter(cond)
    out = _issue_base(T, issues, [F.col("task_code"), F.col("title").alias("task_title")])
    return (out.select("id", "task_id", "issue_type", "description", "priority", "status",
                       "requested_action", "created_at", "resolved_at", "task_code", "task_title",
                       "reported_by_name", "resolved_by_name")
            .orderBy(F.col("created_at").desc(), F.col("id")))


def issue_detail(T: Tables) -> DataFrame:
    """Every issue column plus task text, phones and the task's customer."""
    task_cols = [F.col("task_code"), F.col("title").alias("task_title"),
                 F.col("description").alias("task_description"),
                 F.col("priority").alias("task_priority"), F.col("status").alias("task_status"),
                 F.col("customer_id")]
    cust = T.customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                              F.col("phone").alias("customer_phone"),
                              F.col("address").alias("customer_address"))
    out = _issue_base(T, T.issues, task_cols).join(cust, "customer_id", "left")
    return out.select(*ISSUE_COLUMNS, "task_code", "task_title", "task_description", "task_priority",
                      "task_status", "reported_by_name", "reported_by_phone", "resolved_by_name",
                      "customer_name", "customer_phone", "customer_address")


# --- B8-B11: feeds -------------------------------------------------------------------

def _newest_first(ts: str = "created_at") -> list[Column]:
    # the reference has no tie-break before LIMIT; the row id makes it deterministic
    return [F.col(ts).desc(), F.col("id").desc()]


def _newest_of_users(T: Tables, rows: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """The newest n log rows that name an existing user, with ``cols`` of the log and
    the user's name and role.

    The ids are found on narrow columns (each partition keeps its own n, then one
    merge); the wide columns are then read for these n ids only, a filter that
    reaches the scan.
    """
    known = T.users.select(F.col("id").alias("user_id"))
    newest = (rows.select("id", "user_id", "created_at").join(known, "user_id", "left_semi")
              .orderBy(*_newest_first()).limit(n))
    ids = [r["id"] for r in newest.select("id").collect()]                     # n at most
    found = T.activity_logs.filter(F.col("id").isin(ids) if ids else F.lit(False))
    users = T.users.select(F.col("id").alias("user_id"), F.col("full_name").alias("user_name"), F.col("role").alias("user_role"))
    return (found.select("user_id", *cols).join(users, "user_id").orderBy(*_newest_first()))


def recent_activities(T: Tables, n: int = ACTIVITY_FEED_SIZE) -> DataFrame:
    """The newest n log rows that name an existing user."""
    cols = ["id", "action", "description", "created_at"]
    return _newest_of_users(T, T.activity_logs, n, cols).select(*cols, "user_name", "user_role")


def top_n_per_user(df: DataFrame, n: int, cols: list[str]) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*_newest_first())
    return (df.filter(F.col("user_id").isNotNull())
            .withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n)
            .select("user_id", *cols))


def recent_activities_by_user(T: Tables, n: int = ACTIVITY_FEED_SIZE) -> DataFrame:
    """B9, set form: the newest n log rows of every user."""
    return top_n_per_user(T.activity_logs, n, ["id", "action", "description", "created_at"])


def notification_inbox(T: Tables, n: int = INBOX_SIZE) -> DataFrame:
    """B10, set form: the newest n notifications of every user."""
    return top_n_per_user(T.notifications, n,
                          ["id", "title", "message", "type", "is_read", "created_at"])


def recent_logins(T: Tables, n: int = RECENT_LOGINS_SIZE) -> DataFrame:
    """The newest n Login rows with user name, role and address."""
    logins = _newest_of_users(T, T.activity_logs.filter(F.col("action") == "Login"), n, ["id", "created_at", "ip_address"])
    return logins.select("user_name", F.col("user_role").alias("role"), F.col("created_at").alias("login_time"), "ip_address")
