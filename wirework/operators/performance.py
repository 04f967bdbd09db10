"""The technician performance report.

Plan shape (per report, one scan of tasks and ratings):

    tasks[created_at >= as_of - 12 months]  --left-->  task_ratings      (co-partitioned on task id)
        -> partial/final aggregate by assigned_to                        (map-side combine: a hot
                                                                          technician costs one row
                                                                          per map task, not a skewed
                                                                          reducer)
    active technicians --left--> per-technician facts --left--> details  (one row per technician)

Aggregating before the join with ``users`` keeps the user join at one row per
technician instead of one row per task.  The date test of the reference's ON
clause is applied to the task side before the join, which is the same thing for a
LEFT join and lets Catalyst push it into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lit_date, sum_when, whole_hours
from ..sources.tables import Tables

# --- fixed values: rating labels and their lower bounds on the mean rating ---
RATING_LABELS = [(4.5, "Excellent"), (4.0, "Very Good"), (3.5, "Good"), (3.0, "Satisfactory")]
NO_TASKS, NEEDS_IMPROVEMENT, NO_RATINGS = "No Tasks", "Needs Improvement", "No Ratings"
REPORT_WINDOW_MONTHS = 12
# ---------------------------------------------------------------------------


def active_technicians(users: DataFrame) -> DataFrame:
    return users.filter((F.col("role") == "Electrician") & (F.col("status") == "Active"))


def completion_hours() -> Column:
    """Hours a completed task took: real start/end when both exist, else
    created -> last update; NULL for tasks that are not completed."""
    done = F.col("status") == "Completed"
    real = F.col("actual_start_time").isNotNull() & F.col("actual_end_time").isNotNull()
    return (F.when(done & real, whole_hours("actual_start_time", "actual_end_time"))
             .when(done, whole_hours("created_at", "updated_at")))


def technician_task_facts(T: Tables, as_of: _dt.date | str) -> DataFrame:
    """One row per assignee: task count, completed count, hour and rating sums
    and counts over the report window."""
    cutoff = F.add_months(lit_date(as_of), -REPORT_WINDOW_MONTHS)
    tasks = (T.tasks
             .filter(F.col("assigned_to").isNotNull() & (F.col("created_at") >= cutoff))
             .select("id", "assigned_to", "status", "actual_start_time", "actual_end_time",
                     "created_at", "updated_at"))
    ratings = T.task_ratings.select(F.col("task_id").alias("id"), "rating")
    joined = tasks.join(ratings, "id", "left")
    hours = completion_hours()
    return joined.groupBy("assigned_to").agg(
        F.count("id").alias("n_tasks"),
        sum_when(F.col("status") == "Completed").alias("n_completed"),
        F.sum(hours).alias("hours_sum"),
        F.count(hours).alias("hours_n"),
        F.sum("rating").cast("bigint").alias("rating_sum"),
        F.count("rating").alias("rating_n"),
    )


def _mean(s: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(s) / F.col(n))


def rating_label(n_tasks: Column, mean_rating: Column) -> Column:
    label = F.when(n_tasks == 0, F.lit(NO_TASKS))
    for bound, name in RATING_LABELS:
        label = label.when(mean_rating >= F.lit(bound), F.lit(name))
    return label.when(mean_rating.isNotNull(), F.lit(NEEDS_IMPROVEMENT)).otherwise(F.lit(NO_RATINGS))


def _per_technician(T: Tables, facts: DataFrame) -> DataFrame:
    techs = active_technicians(T.users).select("id", "full_name")
    facts = facts.withColumnRenamed("assigned_to", "id")
    return techs.join(facts, "id", "left")


def user_performance(T: Tables, as_of: _dt.date | str, facts: DataFrame | None = None) -> DataFrame:
    """One row per active technician with counts, mean hours, mean rating
    and a label; ordered by name."""
    facts = facts if facts is not None else technician_task_facts(T, as_of)
    codes = T.electrician_details.select(F.col("electrician_id").alias("id"), "employee_code")
    base = _per_technician(T, facts).join(codes, "id", "left")
    n_tasks = F.coalesce(F.col("n_tasks"), F.lit(0)).cast("bigint")
    mean_rating = _mean("rating_sum", "rating_n")
    return (base.select(
        "id", "full_name", "employee_code",
        n_tasks.alias("total_tasks"),
        F.coalesce(F.col("n_completed"), F.lit(0)).cast("bigint").alias("completed_tasks"),
        F.round(_mean("hours_sum", "hours_n"), 4).alias("avg_completion_time"),
        F.round(mean_rating, 4).alias("avg_rating"),
        rating_label(n_tasks, mean_rating).alias("performance_rating"),
    ).orderBy("full_name", "id"))


def performance_summary(T: Tables, as_of: _dt.date | str, facts: DataFrame | None = None) -> DataFrame:
    """One row over all active technicians."""
    facts = facts if facts is not None else technician_task_facts(T, as_of)
    base = _per_technician(T, facts)
    return base.agg(
        F.count_distinct("id").alias("total_electricians"),
        F.coalesce(F.sum("n_tasks"), F.lit(0)).cast("bigint").alias("total_tasks_assigned"),
        F.sum(F.coalesce(F.col("n_completed"), F.lit(0))).cast("bigint").alias("total_completed"),
        F.round(F.sum("rating_sum") / F.sum("rating_n"), 4).alias("overall_avg_rating"),
    )


def best_performer(T: Tables, as_of: _dt.date | str, facts: DataFrame | None = None) -> DataFrame:
    """Completed count x mean rating (1 when unrated), technicians with at
    least one task, top one (ties broken by id)."""
    facts = facts if facts is not None else technician_task_facts(T, as_of)
    base = _per_technician(T, facts).filter(F.col("n_tasks") > 0)
    mean_rating = _mean("rating_sum", "rating_n")
    score = F.col("n_completed") * F.coalesce(mean_rating, F.lit(1.0))
    return (base.select(
        "id", "full_name", F.col("n_tasks").alias("task_count"),
        F.round(mean_rating, 4).alias("avg_rating"),
        score.alias("score"))
        .orderBy(F.col("score").desc(), F.col("id"))
        .limit(1)
        .select("full_name", "task_count", "avg_rating",
                F.round("score", 4).alias("performance_score")))
