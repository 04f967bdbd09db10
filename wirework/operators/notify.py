"""Notification fan-out.  Output rows carry (user_id, type, title, message).

E2 and E3 come out of the task change fold (``task_changes.apply_task_changes``).

E1 and E5 notify *every active manager*.  Written per recipient, that is the
product of the event batch and the manager list, so here the manager part is
addressed to the audience instead: one row per event with ``audience =
'Manager'`` (and, for E5, the user to leave out).  ``expand_audience``
materialises per-user rows for a given set of readers (an inbox read), through
an equi-join on role, so its size is bounded by the readers asked for, not by
events x managers.  Direct recipients (the task creator in E5, the reporter in
E4, the assignee in E2 / E3) get their own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ids import assign_ids, index_within, materialize, max_id
from .changes import accepted_issue_changes
from .listings import INBOX_SIZE, top_n_per_user

# --- fixed values: notification types, titles and message templates -------------
TASK_CREATED = ("task", "New Task Created", 'New task "%s" has been created and needs assignment')
ISSUE_RESOLVED = ("issue", "Issue Resolved", 'Your reported issue "%s" has been resolved.')
ISSUE_REPORTED = ("issue", "New Issue Reported", 'An issue has been reported for task "%s" - %s')
MANAGER_AUDIENCE = ("Manager", "Active")
# ---------------------------------------------------------------------------


def _msg(template: str, *cols) -> F.Column:
    return F.format_string(template, *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])


def active_managers(users: DataFrame) -> DataFrame:
    role, status = MANAGER_AUDIENCE
    return users.filter((F.col("role") == role) & (F.col("status") == status))


def notify_task_created(new_tasks: DataFrame, users: DataFrame) -> DataFrame:
    """One audience-addressed notification per new task for all active
    managers; ``recipients`` is how many users the audience holds now."""
    typ, title, tmpl = TASK_CREATED
    n = active_managers(users).agg(F.count(F.lit(1))).scalar()   # one-row subquery
    return new_tasks.select(F.col("id").alias("task_id"), F.lit(MANAGER_AUDIENCE[0]).alias("audience"),
                            F.lit(typ).alias("type"), F.lit(title).alias("title"),
                            _msg(tmpl, "title").alias("message"), n.alias("recipients"))


def notify_issue_resolved(issues: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """Every accepted change to 'resolved' tells the issue's reporter."""
    typ, title, tmpl = ISSUE_RESOLVED
    acc, _ = accepted_issue_changes(issues, changes, users)
    res = acc.filter(F.col("status") == "resolved").select("issue_id", "changed_at", "seq")
    iss = issues.select(F.col("id").alias("issue_id"), "reported_by", "issue_type")
    return res.join(iss, "issue_id").select(
        F.col("reported_by").alias("user_id"), F.lit(typ).alias("type"), F.lit(title).alias("title"),
        _msg(tmpl, "issue_type").alias("message"), "issue_id", "changed_at", "seq")


def notify_issue_reported(new_issues: DataFrame, tasks: DataFrame) -> DataFrame:
    """E5: each new issue tells the task's creator (even if inactive or not a
    manager) and the active managers other than the creator, each once.

    Creator rows have ``user_id``; the manager row has ``audience`` and
    ``exclude_user_id`` = the creator."""
    typ, title, tmpl = ISSUE_REPORTED
    t = tasks.select(F.col("id").alias("task_id"), "created_by", F.col("title").alias("task_title"))
    base = new_issues.select(F.col("id").alias("issue_id"), "task_id", "issue_type").join(t, "task_id")
    msg = _msg(tmpl, "task_title", "issue_type").alias("message")
    common = [F.lit(typ).alias("type"), F.lit(title).alias("title"), msg]
    creator = base.select("issue_id", F.col("created_by").alias("user_id"),
                          F.lit(None).cast("string").alias("audience"),
                          F.lit(None).cast("bigint").alias("exclude_user_id"), *common)
    managers = base.select("issue_id", F.lit(None).cast("bigint").alias("user_id"),
                           F.lit(MANAGER_AUDIENCE[0]).alias("audience"),
                           F.col("created_by").alias("exclude_user_id"), *common)
    return creator.unionByName(managers)


def expand_audience(notes: DataFrame, users: DataFrame, readers: DataFrame) -> DataFrame:
    """Per-user rows of audience-addressed notifications for ``readers`` (a
    DataFrame of user ids): an equi-join on role with the readers who are active
    managers, minus any excluded user.  Direct rows of those readers pass as
    they are."""
    r = (active_managers(users).join(readers.select("id"), "id", "left_semi")
         .select(F.col("id").alias("_reader"), F.col("role").alias("audience")))
    cols = [c for c in notes.columns if c not in ("user_id", "audience", "exclude_user_id")]
    group = notes.filter(F.col("audience").isNotNull())
    if "exclude_user_id" not in group.columns:
        group = group.withColumn("exclude_user_id", F.lit(None).cast("bigint"))
    expanded = (group.join(r, "audience")
                .filter(~F.coalesce(F.col("_reader") == F.col("exclude_user_id"), F.lit(False)))
                .select(F.col("_reader").alias("user_id"), *cols))
    if "user_id" in notes.columns:
        direct = (notes.filter(F.col("user_id").isNotNull())
                  .join(readers.select(F.col("id").alias("user_id")), "user_id", "left_semi")
                  .select("user_id", *cols))
        return direct.unionByName(expanded)
    return expanded


AUDIENCE_ROW = ["created_at", "source", "source_id", "exclude_user_id", "type", "title", "message"]


def audience_rows(new_tasks: DataFrame, new_issues: DataFrame, tasks: DataFrame, users: DataFrame,
                  notifications: DataFrame) -> DataFrame:
    """The audience-addressed rows of E1 and E5 with ``id`` (after ``notifications``, in
    order of time) and ``created_at``; the reference writes them when it creates the
    task or the issue."""
    when = new_tasks.select(F.col("id").alias("task_id"), "created_at")
    made = notify_task_created(new_tasks, users).join(when, "task_id").withColumns(
        {"source": F.lit("task"), "source_id": F.col("task_id"), "exclude_user_id": F.lit(None).cast("bigint")})
    when = new_issues.select(F.col("id").alias("issue_id"), "created_at")
    reported = notify_issue_reported(new_issues, tasks).filter("audience IS NOT NULL").join(when, "issue_id").withColumns(
        {"source": F.lit("issue"), "source_id": F.col("issue_id")})
    rows = made.select(*AUDIENCE_ROW).unionByName(reported.select(*AUDIENCE_ROW))
    return assign_ids(rows, ["created_at", "source", "source_id"], max_id(notifications))


def audience_inbox(notifications: DataFrame, audience: DataFrame, users: DataFrame, n: int = INBOX_SIZE) -> DataFrame:
    """The newest n notifications of every active manager: own rows and those addressed
    to all managers but one (``exclude_user_id``).

    Two lists of n are merged per reader; no event meets a reader who does not see it.  The
    audience's rows are ranked once, newest first.  A reader sees the ranks 1 to n + x, where x
    of these ranks leave the reader out: x is the number of exclusions whose rank is at most n
    plus the exclusions before it.  So there are n rows a reader, and as many
    more as exclusions.
    """
    newest = audience.withColumns({"_r1": -F.unix_micros(F.col("created_at").cast("timestamp")), "_r2": -F.col("id")})
    ranked = materialize(assign_ids(newest, ["_r1", "_r2"], 0, "rank").drop("_r1", "_r2"))
    readers = active_managers(users).select(F.col("id").alias("user_id"))
    left_out = (ranked.select(F.col("exclude_user_id").alias("user_id"), "rank").filter("user_id IS NOT NULL")
                .join(readers, "user_id", "left_semi"))
    left_out = materialize(index_within(left_out, "user_id", ["rank"], "nth").filter(F.col("rank") <= F.col("nth") + (n - 1)))
    more = left_out.groupBy("user_id").agg(F.count(F.lit(1)).alias("x"))
    last = F.lit(n) + F.coalesce(F.col("x"), F.lit(0))
    seen = (readers.join(more, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("rank"))
            .join(left_out, ["user_id", "rank"], "left_anti"))
    cols = ["id", "title", "message", "type", "is_read", "created_at"]
    shared = seen.join(ranked.withColumn("is_read", F.lit(False)), "rank").select("user_id", *cols)
    own = top_n_per_user(notifications.join(readers, "user_id", "left_semi"), n, cols)
    return top_n_per_user(own.unionByName(shared), n, cols)
