"""Dashboard statistics and report sections.

All of them are conditional aggregates.  Each table is scanned once per
operator: the reference's separate statements over one table are merged into
one aggregate, and one-row results are combined through one-row scalar
subqueries (``one_row``).  Grouped forms
aggregate the task table before any join with ``users`` so a hot assignee or
date costs one partial row per map task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_when, lit_date, sum_when
from ..sources.tables import Tables
from .performance import active_technicians



def one_row(*parts: DataFrame) -> DataFrame:
    """Side by side columns of one-row results: the first part is the row, every
    other part enters as a one-row scalar subquery (a struct of its columns)."""
    out = parts[0]
    for p in parts[1:]:
        sub = p.select(F.struct(*p.columns)).scalar()
        out = out.select("*", *[sub[c].alias(c) for c in p.columns])
    return out


# --- C1-C3: dashboard statistics ---------------------------------------------

def admin_stats(T: Tables) -> DataFrame:
    """User totals by status and role, task totals (one row)."""
    users = T.users.agg(
        F.count(F.lit(1)).alias("totalUsers"),
        sum_when(F.col("status") == "Active").alias("activeUsers"),
        sum_when(F.col("status") == "Inactive").alias("inactiveUsers"),
        sum_when(F.col("role") == "Admin").alias("totalAdmins"),
        sum_when(F.col("role") == "Manager").alias("totalManagers"),
        sum_when(F.col("role") == "Electrician").alias("totalElectricians"),
    )
    tasks = T.tasks.agg(
        F.count(F.lit(1)).alias("totalTasks"),
        sum_when(F.col("status") == "Completed").alias("completedTasks"),
        sum_when(F.col("status") == "Pending").alias("pendingTasks"),
    )
    return one_row(users, tasks)


def manager_stats(T: Tables, as_of: _dt.date | str) -> DataFrame:
    """Task totals by status, available technicians, tasks created today."""
    tasks = T.tasks.agg(
        F.count(F.lit(1)).alias("totalTasks"),
        sum_when(F.col("status") == "Pending").alias("pendingTasks"),
        sum_when(F.col("status") == "Assigned").alias("assignedTasks"),
        sum_when(F.col("status") == "In Progress").alias("inProgressTasks"),
        sum_when(F.col("status") == "Completed").alias("completedTasks"),
        count_when(F.to_date("created_at") == lit_date(as_of)).alias("todayTasks"),
    )
    techs = active_technicians(T.users).agg(F.count(F.lit(1)).alias("availableElectricians"))
    return one_row(tasks, techs).select(
        "totalTasks", "pendingTasks", "assignedTasks", "inProgressTasks", "completedTasks",
        "availableElectricians", "todayTasks")


def electrician_stats(T: Tables, as_of: _dt.date | str) -> DataFrame:
    """C3, set form: one row per technician.  Sums over no tasks stay NULL and
    counts become 0, as the two per-user statements give."""
    today = F.col("scheduled_date") == lit_date(as_of)
    done = F.col("status") == "Completed"
    per = (T.tasks.filter(F.col("assigned_to").isNotNull())
           .groupBy(F.col("assigned_to").alias("user_id"))
           .agg(F.count(F.lit(1)).alias("n"),
                sum_when(F.col("status") == "Assigned").alias("assignedTasks"),
                sum_when(F.col("status") == "In Progress").alias("inProgressTasks"),
                sum_when(done).alias("completedTasks"),
                count_when(today).alias("today_n"),
                F.sum(F.when(today, F.when(done, 1).otherwise(0))).cast("bigint").alias("todayCompleted")))
    techs = T.users.filter(F.col("role") == "Electrician").select(F.col("id").alias("user_id"))
    return techs.join(per, "user_id", "left").select(
        "user_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("totalTasks"),
        "assignedTasks", "inProgressTasks", "completedTasks",
        F.coalesce("today_n", F.lit(0)).cast("bigint").alias("todayTasks"),
        "todayCompleted")


# --- C4: issues ----------------------------------------------------------------

def issue_stats(T: Tables) -> DataFrame:
    """C4: issue totals by status; unresolved emergency and urgent ones."""
    unresolved = F.col("status") != "resolved"
    return T.issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        sum_when(F.col("status") == "open").alias("open_issues"),
        sum_when(F.col("status") == "in_progress").alias("in_progress_issues"),
        sum_when(F.col("status") == "resolved").alias("resolved_issues"),
        sum_when((F.col("priority") == "emergency") & unresolved).alias("emergency_issues"),
        sum_when((F.col("priority") == "urgent") & unresolved).alias("urgent_issues"),
    )


# --- C9-C13: system usage report sections ---------------------------------------

def system_user_stats(T: Tables) -> DataFrame:
    """Totals by role and status, NULL turned into 0."""
    z = F.lit(0)
    return T.users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.coalesce(sum_when(F.col("role") == "Admin"), z).alias("total_admins"),
        F.coalesce(sum_when(F.col("role") == "Manager"), z).alias("total_managers"),
        F.coalesce(sum_when(F.col("role") == "Electrician"), z).alias("total_electricians"),
        F.coalesce(sum_when(F.col("status") == "Active"), z).alias("active_users"),
        F.coalesce(sum_when(F.col("status") == "Inactive"), z).alias("inactive_users"),
    )


def _logins_since(T: Tables, as_of: _dt.date | str, days: int) -> DataFrame:
    since = F.date_sub(lit_date(as_of), days)
    return T.activity_logs.filter((F.col("action") == "Login") & (F.col("created_at") >= since))


def login_activity(T: Tables, as_of: _dt.date | str, days: int = 30) -> DataFrame:
    """Distinct users and total logins since ``as_of - days`` (no upper bound)."""
    return _logins_since(T, as_of, days).agg(
        F.count_distinct("user_id").alias("unique_logins"),
        F.count(F.lit(1)).alias("total_logins"))


def daily_logins(T: Tables, as_of: _dt.date | str, days: int = 7) -> DataFrame:
    """C11: per login day, distinct users and logins, newest day first."""
    return (_logins_since(T, as_of, days)
            .groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count_distinct("user_id").alias("unique_users"),
                 F.count(F.lit(1)).alias("login_count"))
            .orderBy(F.col("date").desc()))


def account_activity(T: Tables, as_of: _dt.date | str, days: int = 30,
                     strict: bool = False) -> DataFrame:
    """Registrations and password resets over the union of users and reset
    logs.  Faithfully, every row of the union counts as a registration (so
    resets do too); ``strict=True`` counts only real registrations."""
    since = F.date_sub(lit_date(as_of), days)
    union = (T.users.select("created_at", F.lit("Registration").alias("action"))
             .unionByName(T.activity_logs.filter(F.col("action") == "Password Reset")
                          .select("created_at", "action")))
    reg = F.to_date("created_at") >= since
    if strict:
        reg = reg & (F.col("action") == "Registration")
    z = F.lit(0)
    return union.agg(
        F.coalesce(sum_when(reg), z).alias("new_registrations"),
        F.coalesce(sum_when((F.col("action") == "Password Reset") & (F.col("created_at") >= since)), z)
        .alias("password_resets"))


def deactivated_users(T: Tables) -> DataFrame:
    """Number of inactive users."""
    return T.users.filter(F.col("status") == "Inactive").agg(F.count(F.lit(1)).alias("deactivated_users"))


# --- C14-C17: daily statistics report sections ----------------------------------

def _scheduled(T: Tables, date: _dt.date | str | None) -> DataFrame:
    if date is None:
        return T.tasks.filter(F.col("scheduled_date").isNotNull())
    return T.tasks.filter(F.col("scheduled_date") == lit_date(date))


def _per_date(df: DataFrame, date: _dt.date | str | None, *aggs) -> DataFrame:
    """Grouped by scheduled date for all dates; a single requested date gives
    exactly one row, even without tasks (count 0, sums NULL)."""
    if date is None:
        return df.groupBy("scheduled_date").agg(*aggs)
    return df.agg(*aggs).select(lit_date(date).alias("scheduled_date"), "*")


def daily_summary(T: Tables, date: _dt.date | str | None = None) -> DataFrame:
    """C14: per scheduled date: total, completed, in progress, pending (Pending
    or Assigned)."""
    return _per_date(
        _scheduled(T, date), date,
        F.count(F.lit(1)).alias("total_tasks"),
        sum_when(F.col("status") == "Completed").alias("completed_tasks"),
        sum_when(F.col("status") == "In Progress").alias("in_progress_tasks"),
        sum_when(F.col("status").isin("Pending", "Assigned")).alias("pending_tasks"))


def active_electricians(T: Tables, date: _dt.date | str | None = None) -> DataFrame:
    """Distinct non-null assignees per scheduled date."""
    return _per_date(_scheduled(T, date), date,
                     F.count_distinct("assigned_to").alias("active_electricians"))


def electrician_activity(T: Tables, date: _dt.date | str | None = None) -> DataFrame:
    """Active technicians with tasks on a date: totals, completed and in
    progress; most completed first.  Grouped by technician id, so namesakes stay
    apart."""
    per = (_scheduled(T, date).filter(F.col("assigned_to").isNotNull())
           .groupBy("scheduled_date", F.col("assigned_to").alias("id"))
           .agg(F.count(F.lit(1)).alias("total_tasks"),
                sum_when(F.col("status") == "Completed").alias("tasks_completed"),
                sum_when(F.col("status") == "In Progress").alias("tasks_in_progress")))
    techs = active_technicians(T.users).select("id", F.col("full_name").alias("electrician_name"))
    return (per.join(techs, "id")
            .select("scheduled_date", "electrician_name", "total_tasks", "tasks_completed",
                    "tasks_in_progress")
            .orderBy(F.col("scheduled_date").desc(), F.col("tasks_completed").desc(),
                     "electrician_name"))


def tasks_by_status(T: Tables, date: _dt.date | str | None = None) -> DataFrame:
    """C17: number of tasks per status on a scheduled date."""
    return (_scheduled(T, date).groupBy("scheduled_date", "status")
            .agg(F.count(F.lit(1)).alias("count")))


# --- C19-C21: roll-ups written back by the reference ----------------------------

def electrician_rating(T: Tables) -> DataFrame:
    """Technician rating = mean of all ratings of the tasks now assigned to
    them, stored as decimal(3,2).  The mean is taken over DECIMAL input, giving
    four decimals rounded half up, then rounded half up to two, as the database
    does when it stores AVG into a DECIMAL(3,2) column."""
    rated = (T.task_ratings.select(F.col("task_id").alias("id"), "rating")
             .join(T.tasks.filter(F.col("assigned_to").isNotNull()).select("id", "assigned_to"), "id"))
    means = rated.groupBy(F.col("assigned_to").alias("electrician_id")).agg(
        F.avg(F.col("rating").cast("decimal(10,0)")).cast("decimal(3,2)").alias("rating"))
    return T.electrician_details.select("electrician_id").join(means, "electrician_id")


def completed_counter(T: Tables, strict: bool = False) -> DataFrame:
    """C20: completed-task counter per technician from "Task Completed" events;
    ``strict=True`` counts each task once."""
    ev = T.activity_logs.filter((F.col("action") == "Task Completed") & F.col("user_id").isNotNull())
    n = F.count_distinct("description") if strict else F.count(F.lit(1))
    per = ev.groupBy(F.col("user_id").alias("electrician_id")).agg(n.alias("n"))
    return (T.electrician_details.select("electrician_id").join(per, "electrician_id", "left")
            .select("electrician_id",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("total_tasks_completed")))


def last_login(T: Tables) -> DataFrame:
    """Time of the last Login event per user (NULL if never)."""
    per = (T.activity_logs.filter((F.col("action") == "Login") & F.col("user_id").isNotNull())
           .groupBy(F.col("user_id").alias("id")).agg(F.max("created_at").alias("last_login")))
    return T.users.select("id").join(per, "id", "left")
