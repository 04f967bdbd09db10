"""Report assembly and the report log.

A report is returned as sections, each a DataFrame.  Sections whose size is
bounded by the report's definition (daily login stats: at most ``days + 1``
dates; recent logins: 10 rows; tasks by status: 5 statuses) are nested into the
one-row summary with ``collect_list``; sections that grow with the data (one row
per technician) stay separate DataFrames, so no unbounded list is ever gathered
into a single row.  The shared base of C5-C7 is aggregated once per report and
persisted (memory and disk; lost blocks are recomputed from lineage).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lit_date
from ..operators import listings, performance, stats
from ..operators.listings import REPORT_ROLES
from ..plans.ids import assign_ids, max_id
from ..sources.tables import Tables, conform

# --- fixed values: report labels --------------------------------------------------
REPORT_PERIOD = "Last 12 Months"
PERIOD_DAYS = 365
NO_PERFORMER = "N/A"
# ---------------------------------------------------------------------------


@dataclass
class Report:
    summary: DataFrame                      # one row
    sections: dict[str, DataFrame]          # unbounded sections, one DataFrame each


def _report_date(as_of) -> F.Column:
    return F.concat(F.date_format(lit_date(as_of), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))


def user_performance_report(T: Tables, as_of: _dt.date | str) -> Report:
    """C5 rows as a section; C6 + best performer name + period in the summary."""
    facts = performance.technician_task_facts(T, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    detail = performance.user_performance(T, as_of, facts)
    summary = performance.performance_summary(T, as_of, facts)
    best = performance.best_performer(T, as_of, facts).agg(F.max("full_name").alias("_best"))  # <= 1 row
    d = lit_date(as_of)
    out = stats.one_row(summary, best).select(
        "total_electricians", "total_tasks_assigned", "total_completed", "overall_avg_rating",
        F.coalesce(F.col("_best"), F.lit(NO_PERFORMER)).alias("best_performer"),
        F.lit(REPORT_PERIOD).alias("report_period"),
        F.date_format(F.date_sub(d, PERIOD_DAYS), "yyyy-MM-dd").alias("period_start"),
        F.date_format(d, "yyyy-MM-dd").alias("period_end"),
        _report_date(as_of).alias("report_date"))
    return Report(summary=out, sections={"performance": detail})


def system_usage_report(T: Tables, as_of: _dt.date | str) -> Report:
    """C18 (system usage): one nested row assembled from C9-C13 and B11."""
    users = stats.system_user_stats(T)
    logins = stats.login_activity(T, as_of)
    daily = stats.daily_logins(T, as_of).agg(
        F.sort_array(F.collect_list(F.struct("date", "unique_users", "login_count")), asc=False)
        .alias("daily_stats"))                                       # at most days + 1 rows
    recent = listings.recent_logins(T).agg(
        F.sort_array(F.collect_list(F.struct("login_time", "user_name", "role", "ip_address")), asc=False)
        .alias("recent_logins"))                                     # at most 10 rows
    row = stats.one_row(users, logins, daily, recent, stats.account_activity(T, as_of),
                        stats.deactivated_users(T))
    out = row.select(
        F.struct(F.col("total_users").alias("total"),
                 F.struct(F.col("total_admins").alias("admins"), F.col("total_managers").alias("managers"),
                          F.col("total_electricians").alias("electricians")).alias("by_role"),
                 F.struct(F.col("active_users").alias("active"),
                          F.col("inactive_users").alias("inactive")).alias("by_status"))
        .alias("user_statistics"),
        F.struct(F.struct(F.col("unique_logins").alias("unique_users"), "total_logins").alias("last_30_days"),
                 F.coalesce(F.col("daily_stats"), F.array()).alias("daily_stats"),
                 F.coalesce(F.col("recent_logins"), F.array()).alias("recent_logins"))
        .alias("login_activity"),
        F.struct("new_registrations", "password_resets",
                 F.coalesce(F.col("deactivated_users"), F.lit(0)).alias("deactivated_users"))
        .alias("account_activity"),
        _report_date(as_of).alias("report_date"))
    return Report(summary=out, sections={})


def daily_stats_summary(T: Tables, date: _dt.date | str) -> DataFrame:
    """C18 (daily stats) summary: C14 for the date plus C15 (NULL -> 0)."""
    s = stats.daily_summary(T, date).drop("scheduled_date")
    a = stats.active_electricians(T, date).select(
        F.coalesce(F.col("active_electricians"), F.lit(0)).cast("bigint").alias("active_electricians"))
    return stats.one_row(s, a)


def daily_stats_report(T: Tables, date: _dt.date | str) -> Report:
    """C18 (daily stats): summary with tasks by status nested (at most five
    statuses); the per-technician activity is a section."""
    by_status = stats.tasks_by_status(T, date).agg(
        F.sort_array(F.collect_list(F.struct("status", "count"))).alias("tasks_by_status"))
    out = stats.one_row(daily_stats_summary(T, date), by_status).select(
        F.struct("total_tasks", "completed_tasks", "in_progress_tasks", "pending_tasks",
                 "active_electricians").alias("summary"),
        F.coalesce(F.col("tasks_by_status"), F.array()).alias("tasks_by_status"),
        _report_date(date).alias("report_date"))
    return Report(summary=out, sections={"electrician_activity": stats.electrician_activity(T, date)})


def report_lines(summary: DataFrame) -> DataFrame:
    """A nested report row in long form: ``path`` (``a.b``, ``a[0].b``) and ``value`` as
    text, a line per leaf."""
    from pyspark.sql import types as T_

    def lines(c, dtype, path) -> Column:
        if isinstance(dtype, T_.StructType):
            return F.flatten(F.array(*[lines(c[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in dtype.fields]))
        if isinstance(dtype, T_.ArrayType):
            return F.flatten(F.transform(c, lambda x, i: lines(x, dtype.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.array(F.struct(path.alias("path"), c.cast("string").alias("value")))

    every = [lines(F.col(f.name), f.dataType, F.lit(f.name)) for f in summary.schema.fields]
    return summary.select(F.explode(F.flatten(F.array(*every))).alias("x")).select("x.*")


REPORTS = {
    "user_performance": user_performance_report,
    "system_usage": system_usage_report,
    "daily_stats": daily_stats_report,
}


def generate_report(T: Tables, report_type: str, role: str, as_of: _dt.date | str) -> Report:
    """Dispatch by report type with the role rule of each report."""
    if report_type not in REPORTS:
        raise ValueError("Invalid report type. Supported types: system_usage, user_performance, daily_stats")
    if role not in REPORT_ROLES[report_type]:
        raise PermissionError("Unauthorized to generate this report")
    return REPORTS[report_type](T, as_of)


def report_log(requests: DataFrame, users: DataFrame, reports: DataFrame) -> DataFrame:
    """A2: one ``reports`` row per allowed request: type, author and the JSON of
    its (unused) date range; absent dates are left out of the JSON, as
    JSON.stringify leaves out undefined fields.  Requests of unknown type or by a
    role the report does not allow are not logged."""
    allowed = F.lit(False)
    role = F.col("_role")
    for rtype, roles in REPORT_ROLES.items():
        allowed = allowed | ((F.col("report_type") == rtype) & role.isin(*roles))
    req = requests.join(users.select(F.col("id").alias("generated_by"), F.col("role").alias("_role")),
                        "generated_by").filter(allowed)
    rows = req.select(
        "request_id", "report_type", "generated_by",
        F.to_json(F.struct("start_date", "end_date")).alias("parameters"),
        F.lit(None).cast("string").alias("file_path"), F.col("requested_at").alias("created_at"))
    rows = assign_ids(rows, ["request_id"], max_id(reports))
    return conform(rows, "reports")
