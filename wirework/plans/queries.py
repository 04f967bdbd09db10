"""Registered queries: each inventory operator over the whole derived data
model, with its DuckDB twin.

Oracle notes: DuckDB SUM yields HUGEINT, so sums are cast to BIGINT; date minus
interval yields TIMESTAMP, so it is cast to DATE; TIMESTAMPDIFF(HOUR) is
``date_sub('hour', a, b)``; means are rounded to 4 places on both sides.
"""

from __future__ import annotations

from ..operators import performance as perf
from .catalog import LOG_AS_OF, ORACLE, TASK_AS_OF, register

# ---------------------------------------------------------------------------
# C5-C7 performance report
# ---------------------------------------------------------------------------
# active technicians, and their tasks of the last twelve months with the rating
_YEAR = f"""
WITH tech AS (SELECT id, full_name FROM users WHERE role = 'Electrician' AND status = 'Active'),
job AS (
  SELECT assigned_to AS tech_id, tasks.id, status, (SELECT rating FROM task_ratings WHERE task_id = tasks.id) AS stars
  FROM tasks WHERE created_at >= CAST(DATE '{TASK_AS_OF}' - INTERVAL 12 MONTH AS DATE) AND assigned_to IN (SELECT id FROM tech)),
figures AS (
  SELECT tech_id, count(*) AS n, avg(stars) AS r, count(*) FILTER (WHERE status = 'Completed') * coalesce(avg(stars), 1) AS score
  FROM job GROUP BY tech_id),
best AS (SELECT full_name, n, r, score FROM figures JOIN tech ON tech.id = tech_id ORDER BY score DESC, tech_id LIMIT 1)"""
_YEAR_TOTALS = """(SELECT count(*) FROM tech) AS total_electricians, (SELECT count(*) FROM job) AS total_tasks_assigned,
       (SELECT count(*) FROM job WHERE status = 'Completed') AS total_completed,
       (SELECT round(avg(stars), 4) FROM job) AS overall_avg_rating"""


@register("user_performance", tables=("users", "electrician_details", "tasks", "task_ratings"),
          oracle=f"""
WITH recent AS (   -- one row per task of the last year, its hours and rating
  SELECT assigned_to AS id, status,
         CASE WHEN status <> 'Completed' THEN NULL
              WHEN actual_start_time IS NULL OR actual_end_time IS NULL THEN date_sub('hour', created_at, updated_at)
              ELSE date_sub('hour', actual_start_time, actual_end_time) END AS hours,
         (SELECT rating FROM task_ratings WHERE task_id = tasks.id) AS stars
  FROM tasks WHERE assigned_to IS NOT NULL AND created_at >= CAST(DATE '{TASK_AS_OF}' - INTERVAL 12 MONTH AS DATE)
), figures AS (
  SELECT id, count(*) AS n, count(*) FILTER (WHERE status = 'Completed') AS n_done, avg(hours) AS h, avg(stars) AS r
  FROM recent GROUP BY id
), grades(least, grade) AS (
  VALUES (4.5, 'Excellent'), (4.0, 'Very Good'), (3.5, 'Good'), (3.0, 'Satisfactory'), (-1.0, 'Needs Improvement'))
SELECT id, full_name,
       (SELECT employee_code FROM electrician_details WHERE electrician_id = users.id) AS employee_code,
       coalesce(n, 0) AS total_tasks, coalesce(n_done, 0) AS completed_tasks,
       round(h, 4) AS avg_completion_time, round(r, 4) AS avg_rating,
       CASE WHEN n IS NULL THEN 'No Tasks' WHEN r IS NULL THEN 'No Ratings'
            ELSE (SELECT arg_max(grade, least) FROM grades WHERE r >= least) END AS performance_rating
FROM users LEFT JOIN figures USING (id) WHERE role = 'Electrician' AND users.status = 'Active'""")
def _user_performance(T):
    return perf.user_performance(T, TASK_AS_OF)


@register("performance_summary", tables=("users", "tasks", "task_ratings"), oracle=_YEAR + f"""
SELECT {_YEAR_TOTALS}""")
def _performance_summary(T):
    return perf.performance_summary(T, TASK_AS_OF)


@register("best_performer", tables=("users", "tasks", "task_ratings"), oracle=_YEAR + """
SELECT full_name, n AS task_count, round(r, 4) AS avg_rating, round(score, 4) AS performance_score FROM best""")
def _best_performer(T):
    return perf.best_performer(T, TASK_AS_OF)


# ---------------------------------------------------------------------------
# C1-C4, C9-C17, C19-C21 statistics
# ---------------------------------------------------------------------------
from ..operators import stats  # noqa: E402


def _s(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


@register("admin_stats", tables=("users", "tasks"), oracle=f"""
SELECT * FROM
 (SELECT COUNT(*) AS totalUsers, {_s("status = 'Active'")} AS activeUsers,
         {_s("status = 'Inactive'")} AS inactiveUsers FROM users) a,
 (SELECT {_s("role = 'Admin'")} AS totalAdmins, {_s("role = 'Manager'")} AS totalManagers,
         {_s("role = 'Electrician'")} AS totalElectricians FROM users) b,
 (SELECT COUNT(*) AS totalTasks, {_s("status = 'Completed'")} AS completedTasks,
         {_s("status = 'Pending'")} AS pendingTasks FROM tasks) c""")
def _admin_stats(T):
    return stats.admin_stats(T)


@register("manager_stats", tables=("users", "tasks"), oracle=f"""
SELECT * FROM
 (SELECT COUNT(*) AS totalTasks, {_s("status = 'Pending'")} AS pendingTasks,
         {_s("status = 'Assigned'")} AS assignedTasks, {_s("status = 'In Progress'")} AS inProgressTasks,
         {_s("status = 'Completed'")} AS completedTasks FROM tasks) a,
 (SELECT COUNT(*) AS availableElectricians FROM users WHERE role = 'Electrician' AND status = 'Active') b,
 (SELECT COUNT(*) AS todayTasks FROM tasks WHERE CAST(created_at AS DATE) = DATE '{TASK_AS_OF}') c""")
def _manager_stats(T):
    return stats.manager_stats(T, TASK_AS_OF)


@register("electrician_stats", tables=("users", "tasks"), oracle=f"""
SELECT u.id AS user_id, COALESCE(a.totalTasks, 0) AS totalTasks, a.assignedTasks,
       a.inProgressTasks, a.completedTasks, COALESCE(b.todayTasks, 0) AS todayTasks, b.todayCompleted
FROM users u
LEFT JOIN (SELECT assigned_to, COUNT(*) AS totalTasks, {_s("status = 'Assigned'")} AS assignedTasks,
                  {_s("status = 'In Progress'")} AS inProgressTasks,
                  {_s("status = 'Completed'")} AS completedTasks
           FROM tasks GROUP BY assigned_to) a ON a.assigned_to = u.id
LEFT JOIN (SELECT assigned_to, COUNT(*) AS todayTasks, {_s("status = 'Completed'")} AS todayCompleted
           FROM tasks WHERE scheduled_date = DATE '{TASK_AS_OF}' GROUP BY assigned_to) b
  ON b.assigned_to = u.id
WHERE u.role = 'Electrician'""")
def _electrician_stats(T):
    return stats.electrician_stats(T, TASK_AS_OF)


@register("issue_stats", tables=("issues",), oracle=f"""
SELECT COUNT(*) AS total_issues, {_s("status = 'open'")} AS open_issues,
  {_s("status = 'in_progress'")} AS in_progress_issues, {_s("status = 'resolved'")} AS resolved_issues,
  {_s("priority = 'emergency' AND status != 'resolved'")} AS emergency_issues,
  {_s("priority = 'urgent' AND status != 'resolved'")} AS urgent_issues
FROM issues""")
def _issue_stats(T):
    return stats.issue_stats(T)


@register("system_user_stats", tables=("users",), oracle=f"""
SELECT COUNT(*) AS total_users,
  COALESCE({_s("role = 'Admin'")}, 0) AS total_admins,
  COALESCE({_s("role = 'Manager'")}, 0) AS total_managers,
  COALESCE({_s("role = 'Electrician'")}, 0) AS total_electricians,
  COALESCE({_s("status = 'Active'")}, 0) AS active_users,
  COALESCE({_s("status = 'Inactive'")}, 0) AS inactive_users
FROM users""")
def _system_user_stats(T):
    return stats.system_user_stats(T)


@register("login_activity", tables=("activity_logs",), oracle=f"""
SELECT COUNT(DISTINCT user_id) AS unique_logins, COUNT(*) AS total_logins
FROM activity_logs
WHERE action = 'Login' AND created_at >= CAST(DATE '{LOG_AS_OF}' - INTERVAL 30 DAY AS DATE)""")
def _login_activity(T):
    return stats.login_activity(T, LOG_AS_OF)


@register("daily_logins", tables=("activity_logs",), oracle=f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(DISTINCT user_id) AS unique_users,
       COUNT(*) AS login_count
FROM activity_logs
WHERE action = 'Login' AND created_at >= CAST(DATE '{LOG_AS_OF}' - INTERVAL 7 DAY AS DATE)
GROUP BY CAST(created_at AS DATE)
ORDER BY date DESC""")
def _daily_logins(T):
    return stats.daily_logins(T, LOG_AS_OF)


_SINCE30 = f"CAST(DATE '{LOG_AS_OF}' - INTERVAL 30 DAY AS DATE)"


@register("account_activity", tables=("users", "activity_logs"),
          oracle=f"""
SELECT (SELECT count(*) FROM users WHERE created_at::DATE >= {_SINCE30})
         + (SELECT count(*) FROM activity_logs WHERE action = 'Password Reset' AND created_at::DATE >= {_SINCE30})
         AS new_registrations,
       (SELECT count(*) FROM activity_logs WHERE action = 'Password Reset' AND created_at >= {_SINCE30}) AS password_resets""")
def _account_activity(T):
    return stats.account_activity(T, LOG_AS_OF)


@register("deactivated_users", tables=("users",), oracle="""
SELECT COUNT(*) AS deactivated_users FROM users WHERE status = 'Inactive'""")
def _deactivated_users(T):
    return stats.deactivated_users(T)


@register("daily_summary", tables=("tasks",), oracle=f"""
SELECT scheduled_date, COUNT(*) AS total_tasks, {_s("status = 'Completed'")} AS completed_tasks,
  {_s("status = 'In Progress'")} AS in_progress_tasks,
  {_s("status IN ('Pending', 'Assigned')")} AS pending_tasks
FROM tasks WHERE scheduled_date IS NOT NULL GROUP BY scheduled_date""")
def _daily_summary(T):
    return stats.daily_summary(T)


@register("active_electricians", tables=("tasks",), oracle="""
SELECT scheduled_date, COUNT(DISTINCT assigned_to) AS active_electricians
FROM tasks WHERE scheduled_date IS NOT NULL GROUP BY scheduled_date""")
def _active_electricians(T):
    return stats.active_electricians(T)


@register("electrician_activity", tables=("users", "tasks"), oracle=f"""
SELECT t.scheduled_date, u.full_name AS electrician_name, COUNT(t.id) AS total_tasks,
  {_s("t.status = 'Completed'")} AS tasks_completed,
  {_s("t.status = 'In Progress'")} AS tasks_in_progress
FROM users u
JOIN tasks t ON u.id = t.assigned_to AND t.scheduled_date IS NOT NULL
WHERE u.role = 'Electrician' AND u.status = 'Active'
GROUP BY t.scheduled_date, u.id, u.full_name
HAVING COUNT(t.id) > 0
ORDER BY t.scheduled_date DESC, tasks_completed DESC""")
def _electrician_activity(T):
    return stats.electrician_activity(T)


@register("tasks_by_status", tables=("tasks",), oracle="""
SELECT scheduled_date, status, COUNT(*) AS count
FROM tasks WHERE scheduled_date IS NOT NULL GROUP BY scheduled_date, status""")
def _tasks_by_status(T):
    return stats.tasks_by_status(T)


@register("electrician_rating", tables=("electrician_details", "tasks", "task_ratings"), oracle="""
SELECT electrician_id,
       CAST(CAST((a4 + 50) // 100 AS DECIMAL(6,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(3,2)) AS rating
FROM (
  SELECT ed.electrician_id,
         (SUM(tr.rating) * 20000 + COUNT(tr.rating)) // (2 * COUNT(tr.rating)) AS a4
  FROM electrician_details ed
  JOIN tasks t ON t.assigned_to = ed.electrician_id
  JOIN task_ratings tr ON tr.task_id = t.id
  GROUP BY ed.electrician_id) AS m""")
def _electrician_rating(T):
    return stats.electrician_rating(T)


@register("completed_counter", tables=("electrician_details", "activity_logs"), oracle="""
SELECT ed.electrician_id, COUNT(al.id) AS total_tasks_completed
FROM electrician_details ed
LEFT JOIN activity_logs al ON al.user_id = ed.electrician_id AND al.action = 'Task Completed'
GROUP BY ed.electrician_id""")
def _completed_counter(T):
    return stats.completed_counter(T)


@register("last_login", tables=("users", "activity_logs"), oracle="""
SELECT u.id, MAX(al.created_at) AS last_login
FROM users u LEFT JOIN activity_logs al ON al.user_id = u.id AND al.action = 'Login'
GROUP BY u.id""")
def _last_login(T):
    return stats.last_login(T)


# ---------------------------------------------------------------------------
# B1-B11 listings and feeds
# ---------------------------------------------------------------------------
from ..operators import listings  # noqa: E402


_LISTING_SQL = """
WITH person AS (SELECT id, full_name FROM users),
     done AS (SELECT task_id, completion_notes, materials_used, additional_charges, completed_at FROM task_completions),
     judged AS (SELECT task_id, rating, feedback FROM task_ratings),
     place AS (SELECT id AS customer_id, name AS customer_name, phone AS customer_phone, address AS customer_address
               FROM customers)
SELECT tasks.*, customer_name, customer_phone, customer_address,
       (SELECT full_name FROM person WHERE id = assigned_to) AS assigned_electrician,
       (SELECT full_name FROM person WHERE id = created_by) AS created_by_name,
       completion_notes, materials_used, additional_charges, completed_at, rating, feedback
FROM tasks LEFT JOIN place USING (customer_id) LEFT JOIN done ON done.task_id = tasks.id
     LEFT JOIN judged ON judged.task_id = tasks.id"""


@register("task_listing", tables=("tasks", "customers", "users", "task_completions", "task_ratings"),
          oracle=_LISTING_SQL)
def _task_listing(T):
    return listings.task_listing(T, role="Admin")


@register("task_detail", tables=("tasks", "customers", "users", "task_completions", "task_ratings"),
          oracle="""
WITH person AS (SELECT id AS assigned_to, full_name AS assigned_electrician, phone AS electrician_phone FROM users),
     place AS (SELECT id AS customer_id, name AS customer_name, phone AS customer_phone, address AS customer_address,
                      email AS customer_email FROM customers),
     done AS (SELECT task_id AS id, completion_notes, materials_used, additional_charges, completed_at FROM task_completions),
     judged AS (SELECT task_id AS id, rating, feedback FROM task_ratings)
SELECT tasks.*, customer_name, customer_phone, customer_address, customer_email, assigned_electrician, electrician_phone,
       completion_notes, materials_used, additional_charges, completed_at, rating, feedback
FROM tasks LEFT JOIN judged USING (id) LEFT JOIN done USING (id) LEFT JOIN place USING (customer_id) LEFT JOIN person USING (assigned_to)""")
def _task_detail(T):
    return listings.task_detail(T)


@register("task_detail_materials", tables=("tasks", "task_materials"), oracle="""
SELECT * FROM task_materials WHERE task_id IN (SELECT id FROM tasks)""")
def _task_detail_materials(T):
    return listings.task_detail_materials(T)


_USER_SEL = """u.id, u.username, u.email, u.full_name, u.phone, u.role, ed.employee_code, u.status,
       u.created_at, u.last_login"""


@register("user_directory", tables=("users", "electrician_details"),
          oracle="""
WITH tech AS (SELECT electrician_id AS id, employee_code, rating, total_tasks_completed FROM electrician_details)
SELECT id, username, email, full_name, phone, role, employee_code, status, created_at, last_login,
       rating, total_tasks_completed
FROM users LEFT JOIN tech USING (id)""")
def _user_directory(T):
    return listings.user_directory(T)


@register("user_profile", tables=("users", "electrician_details"), oracle=f"""
SELECT {_USER_SEL}, ed.skills, ed.certifications, ed.rating, ed.total_tasks_completed, ed.join_date
FROM users u LEFT JOIN electrician_details ed ON u.id = ed.electrician_id""")
def _user_profile(T):
    return listings.user_profile(T)


@register("electrician_roster", tables=("users", "electrician_details", "tasks"), oracle="""
WITH busy AS (SELECT assigned_to, count(*) AS n FROM tasks WHERE status = 'In Progress' GROUP BY ALL)
SELECT users.id, full_name, phone, employee_code, users.status, skills, rating, total_tasks_completed, coalesce(n, 0) AS current_tasks
FROM electrician_details JOIN users ON id = electrician_id AND role = 'Electrician' AND users.status = 'Active'
     LEFT JOIN busy ON assigned_to = electrician_id""")
def _electrician_roster(T):
    return listings.electrician_roster(T)


_ISSUES_SQL = """
WITH person AS (SELECT id, full_name FROM users), job AS (SELECT id AS task_id, task_code, title AS task_title FROM tasks)
SELECT id, task_id, issue_type, description, priority, status, requested_action, created_at, resolved_at,
       task_code, task_title, reporter.full_name AS reported_by_name,
       (SELECT full_name FROM person p WHERE p.id = issues.resolved_by) AS resolved_by_name
FROM issues JOIN job USING (task_id) JOIN (SELECT id AS reported_by, full_name FROM users) reporter USING (reported_by)"""


@register("issue_listing", tables=("issues", "tasks", "users"),
          oracle=_ISSUES_SQL)
def _issue_listing(T):
    return listings.issue_listing(T)


@register("issue_detail", tables=("issues", "tasks", "users", "customers"), oracle="""
WITH place AS (SELECT id AS customer_id, name AS customer_name, phone AS customer_phone, address AS customer_address FROM customers),
     job AS (
       SELECT id AS task_id, task_code, title AS task_title, description AS task_description, priority AS task_priority,
              status AS task_status, customer_name, customer_phone, customer_address
       FROM tasks LEFT JOIN place USING (customer_id)),
     reporter AS (SELECT id AS reported_by, full_name AS reported_by_name, phone AS reported_by_phone FROM users)
SELECT issues.*, task_code, task_title, task_description, task_priority, task_status, reported_by_name, reported_by_phone,
       (SELECT full_name FROM users WHERE users.id = issues.resolved_by) AS resolved_by_name,
       customer_name, customer_phone, customer_address
FROM issues JOIN job USING (task_id) JOIN reporter USING (reported_by)""")
def _issue_detail(T):
    return listings.issue_detail(T)


@register("recent_activities", tables=("activity_logs", "users"), oracle="""
WITH person AS (SELECT id AS user_id, full_name AS user_name, role AS user_role FROM users)
SELECT id, action, description, created_at, user_name, user_role
FROM activity_logs JOIN person USING (user_id) ORDER BY created_at DESC, id DESC LIMIT 20""")
def _recent_activities(T):
    return listings.recent_activities(T)


@register("recent_activities_by_user", tables=("activity_logs",), oracle="""
SELECT user_id, id, action, description, created_at FROM activity_logs
WHERE user_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 20""")
def _recent_activities_by_user(T):
    return listings.recent_activities_by_user(T)


@register("notification_inbox", tables=("notifications",), oracle="""
SELECT user_id, id, title, message, type, is_read, created_at FROM notifications
WHERE user_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 10""")
def _notification_inbox(T):
    return listings.notification_inbox(T)


@register("recent_logins", tables=("activity_logs", "users"), oracle="""
WITH person AS (SELECT id AS user_id, full_name AS user_name, role FROM users)
SELECT user_name, role, created_at AS login_time, ip_address
FROM activity_logs JOIN person USING (user_id) WHERE action = 'Login' ORDER BY created_at DESC, id DESC LIMIT 10""")
def _recent_logins(T):
    return listings.recent_logins(T)


def _variants(parts: dict):
    """Runs of one operator with different arguments, told apart by ``variant``."""
    from functools import reduce

    from pyspark.sql import functions as F

    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("variant", F.lit(n)) for n, df in parts.items()])


def _where(sql: str, conditions: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT *, '{n}' AS variant FROM ({sql}) AS v WHERE {c}" for n, c in conditions.items())


@register("task_listing_filtered", tables=("tasks", "customers", "users", "task_completions", "task_ratings"), oracle=_where(_LISTING_SQL, {
    "own": "assigned_to = 13", "own only": "assigned_to = 13", "status": "status = 'In Progress'",
    "date": f"scheduled_date = DATE '{TASK_AS_OF}' - INTERVAL 20 DAY", "status and technician": "status = 'Completed' AND assigned_to = 23",
    "electrician": "assigned_to = 23"}))
def _task_listing_filtered(T):
    import datetime

    day = datetime.date.fromisoformat(TASK_AS_OF) - datetime.timedelta(days=20)
    return _variants({
        "own": listings.task_listing(T, "Electrician", 13), "own only": listings.task_listing(T, "Electrician", 13, electrician_id=23),
        "status": listings.task_listing(T, "Manager", 2, status="In Progress"), "date": listings.task_listing(T, date=day),
        "status and technician": listings.task_listing(T, status="Completed", electrician_id=23), "electrician": listings.task_listing(T, "Manager", 2, electrician_id=23)})


@register("user_directory_filtered", tables=("users", "electrician_details"), oracle=_where("""
  SELECT id, username, email, full_name, phone, role, employee_code, users.status, created_at, last_login, rating, total_tasks_completed
  FROM users LEFT JOIN (SELECT electrician_id AS id, employee_code, rating, total_tasks_completed FROM electrician_details) AS d USING (id)""", {
    "role": "role = 'Manager'", "status": "status = 'Inactive'", "both": "role = 'Electrician' AND status = 'Active'"}))
def _user_directory_filtered(T):
    return _variants({"role": listings.user_directory(T, role="Manager"), "status": listings.user_directory(T, status="Inactive"),
                      "both": listings.user_directory(T, role="Electrician", status="Active")})


@register("issue_listing_filtered", tables=("issues", "tasks", "users"), oracle=_where(_ISSUES_SQL, {
    "status": "status = 'open'", "priority": "priority = 'urgent'",
    "days": "CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'",
    "all": "status = 'resolved' AND priority = 'normal' AND CAST(created_at AS DATE) >= DATE '2024-01-11'"}))
def _issue_listing_filtered(T):
    return _variants({
        "status": listings.issue_listing(T, status="open"), "priority": listings.issue_listing(T, priority="urgent"),
        "days": listings.issue_listing(T, start="2024-01-05", end="2024-01-09"),
        "all": listings.issue_listing(T, status="resolved", priority="normal", start="2024-01-11")})


@register("role_rules", tables=("users", "tasks"), oracle="""
SELECT 'staff' AS rule, id FROM users WHERE role IN ('Manager', 'Admin')
UNION ALL SELECT 'own tasks', id FROM tasks WHERE assigned_to = 13
UNION ALL SELECT 'all tasks', id FROM tasks""")
def _role_rules(T):
    from pyspark.sql import functions as F

    parts = {"staff": listings.role_filter(T.users, listings.MANAGER_ROLES), "own tasks": listings.visible_rows(T.tasks, "Electrician", 13, "assigned_to"),
             "all tasks": listings.visible_rows(T.tasks, "Manager", 13, "assigned_to")}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("rule"), "id")
        out = df if out is None else out.unionByName(df)
    return out


# ---------------------------------------------------------------------------
# D2-D17 change application
# ---------------------------------------------------------------------------
from ..operators import changes  # noqa: E402


@register("valid_ratings", tables=("rating_events",), oracle="""
SELECT * FROM rating_events WHERE rating BETWEEN 1 AND 5""")
def _valid_ratings(T):
    return changes.valid_ratings(T.rating_events)[0]


@register("rejected_ratings", tables=("rating_events",), oracle="""
SELECT * FROM rating_events WHERE rating IS NULL OR rating NOT BETWEEN 1 AND 5""")
def _rejected_ratings(T):
    return changes.valid_ratings(T.rating_events)[1]


@register("latest_ratings", tables=("task_ratings", "rating_events", "tasks"), oracle="""
WITH latest AS (
  SELECT task_id, rating, rated_at FROM rating_events
  WHERE rating BETWEEN 1 AND 5 AND task_id IN (SELECT id FROM tasks)
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY rated_at DESC, seq DESC) = 1)
SELECT r.id, r.task_id,
       CASE WHEN l.task_id IS NOT NULL THEN l.rating ELSE r.rating END AS rating,
       CASE WHEN l.task_id IS NOT NULL THEN NULL ELSE r.feedback END AS feedback,
       CASE WHEN l.task_id IS NOT NULL THEN l.rated_at ELSE r.rated_at END AS rated_at
FROM task_ratings r LEFT JOIN latest l ON l.task_id = r.task_id
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM task_ratings) + row_number() OVER (ORDER BY l.task_id) AS id,
       l.task_id, l.rating, CAST(NULL AS VARCHAR) AS feedback, l.rated_at
FROM latest l WHERE l.task_id NOT IN (SELECT task_id FROM task_ratings)""")
def _latest_ratings(T):
    return changes.latest_ratings(T.task_ratings, T.rating_events, T.tasks)


@register("latest_completions", tables=("task_completions", "completion_events", "tasks"), oracle="""
WITH latest AS (
  SELECT task_id, completion_notes, materials_used,
         CAST(COALESCE(additional_charges, 0) AS DECIMAL(10,2)) AS additional_charges, completed_at
  FROM completion_events WHERE task_id IN (SELECT id FROM tasks)
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY completed_at DESC, seq DESC) = 1)
SELECT c.id, c.task_id,
       CASE WHEN l.task_id IS NOT NULL THEN l.completion_notes ELSE c.completion_notes END AS completion_notes,
       CASE WHEN l.task_id IS NOT NULL THEN l.materials_used ELSE c.materials_used END AS materials_used,
       CASE WHEN l.task_id IS NOT NULL THEN l.additional_charges ELSE c.additional_charges END AS additional_charges,
       c.customer_signature,
       CASE WHEN l.task_id IS NOT NULL THEN l.completed_at ELSE c.completed_at END AS completed_at
FROM task_completions c LEFT JOIN latest l ON l.task_id = c.task_id
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM task_completions) + row_number() OVER (ORDER BY l.task_id),
       l.task_id, l.completion_notes, l.materials_used, l.additional_charges, CAST(NULL AS BLOB), l.completed_at
FROM latest l WHERE l.task_id NOT IN (SELECT task_id FROM task_completions)""")
def _latest_completions(T):
    return changes.latest_completions(T.task_completions, T.completion_events, T.tasks)


_RESOLVE_CTE = """
WITH known AS (SELECT phone, MIN(id) AS customer_id FROM customers WHERE phone IS NOT NULL GROUP BY phone),
firsts AS (
  SELECT customer_phone, MIN(request_id) AS first_request FROM customer_intake
  WHERE customer_phone IS NOT NULL GROUP BY customer_phone),
fresh AS (
  SELECT f.customer_phone, f.first_request,
         (SELECT COALESCE(MAX(id), 0) FROM customers) + row_number() OVER (ORDER BY f.first_request) AS id
  FROM firsts f WHERE f.customer_phone NOT IN (SELECT phone FROM known))"""


@register("resolve_customers", tables=("customers", "customer_intake"), oracle=_RESOLVE_CTE + """
SELECT i.request_id, COALESCE(k.customer_id, f.id) AS customer_id
FROM customer_intake i
LEFT JOIN known k ON k.phone = i.customer_phone
LEFT JOIN fresh f ON f.customer_phone = i.customer_phone""")
def _resolve_customers(T):
    return changes.resolve_customers(T.customers, T.customer_intake)[1].select("request_id", "customer_id")


@register("new_customers", tables=("customers", "customer_intake"), oracle=_RESOLVE_CTE + """
SELECT f.id, i.customer_name AS name, CAST(NULL AS VARCHAR) AS email, f.customer_phone AS phone,
       i.customer_address AS address, i.requested_at AS created_at
FROM fresh f JOIN customer_intake i ON i.request_id = f.first_request""")
def _new_customers(T):
    return changes.resolve_customers(T.customers, T.customer_intake)[0]


_INTAKE_CTE = _RESOLVE_CTE + """,
resolved AS (
  SELECT i.*, COALESCE(k.customer_id, f.id) AS customer_id
  FROM customer_intake i
  LEFT JOIN known k ON k.phone = i.customer_phone
  LEFT JOIN fresh f ON f.customer_phone = i.customer_phone),
new_tasks AS (
  SELECT (SELECT COALESCE(MAX(id), 0) FROM tasks) + row_number() OVER (ORDER BY request_id) AS id,
         'T' || right(CAST(epoch_ms(requested_at) AS VARCHAR), 6) AS task_code, title,
         description, customer_id, priority, 'Pending' AS status, created_by,
         CAST(NULL AS BIGINT) AS assigned_to, scheduled_date, scheduled_time_start, scheduled_time_end, estimated_hours,
         CAST(NULL AS TIMESTAMP) AS actual_start_time, CAST(NULL AS TIMESTAMP) AS actual_end_time,
         requested_at AS created_at, requested_at AS updated_at
  FROM resolved WHERE customer_id IS NOT NULL)"""


@register("task_intake", tables=("customers", "customer_intake", "tasks"), oracle=_INTAKE_CTE + """
SELECT * FROM new_tasks""")
def _task_intake(T):
    _, resolved = changes.resolve_customers(T.customers, T.customer_intake)
    return changes.task_intake(resolved, T.tasks)[0]


@register("task_code_collisions", tables=("customers", "customer_intake", "tasks"), oracle=_INTAKE_CTE + """
SELECT task_code, COUNT(*) AS n
FROM (SELECT task_code FROM new_tasks UNION ALL SELECT task_code FROM tasks) AS c
GROUP BY task_code HAVING COUNT(*) > 1""")
def _task_code_collisions(T):
    _, resolved = changes.resolve_customers(T.customers, T.customer_intake)
    return changes.task_intake(resolved, T.tasks)[1]


@register("patch_customers", tables=("customers", "customer_patches"), oracle="""
WITH live AS (
  SELECT * FROM customer_patches
  WHERE COALESCE(name, '') <> '' OR COALESCE(phone, '') <> '' OR COALESCE(address, '') <> ''),
latest AS (
  SELECT customer_id,
         arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS p_name,
         arg_max(phone, seq) FILTER (WHERE phone IS NOT NULL) AS p_phone,
         arg_max(address, seq) FILTER (WHERE address IS NOT NULL) AS p_address
  FROM live GROUP BY customer_id)
SELECT c.id, COALESCE(l.p_name, c.name) AS name, c.email, COALESCE(l.p_phone, c.phone) AS phone,
       COALESCE(l.p_address, c.address) AS address, c.created_at
FROM customers c LEFT JOIN latest l ON l.customer_id = c.id""")
def _patch_customers(T):
    return changes.patch_customers(T.customers, T.customer_patches)


@register("replace_materials", tables=("task_materials", "material_payload", "tasks"), oracle="""
WITH accepted AS (
  SELECT p.* FROM material_payload p
  WHERE (p.op = 'edit' AND p.task_id IN (SELECT id FROM tasks WHERE status IS NULL OR status NOT IN ('Completed', 'Cancelled')))
     OR (p.op = 'create' AND p.task_id IN (SELECT id FROM tasks))),
cleared AS (SELECT DISTINCT task_id FROM accepted WHERE op = 'edit')
SELECT m.* FROM task_materials m WHERE m.task_id NOT IN (SELECT task_id FROM cleared)
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM task_materials) + row_number() OVER (ORDER BY task_id, pos) AS id,
       task_id, CASE WHEN op = 'edit' AND COALESCE(name, '') = '' THEN material_name ELSE name END AS material_name,
       CAST(CASE WHEN quantity IS NULL OR quantity = 0 THEN 1 ELSE quantity END AS INTEGER) AS quantity,
       CAST(NULL AS DECIMAL(10,2)) AS cost
FROM accepted WHERE pos IS NOT NULL""")
def _replace_materials(T):
    return changes.replace_materials(T.task_materials, T.material_payload, T.tasks)


_ISSUE_ACC = """
WITH acc AS (
  SELECT c.* FROM issue_changes c
  WHERE c.status IN ('open', 'in_progress', 'resolved')
    AND c.changed_by IN (SELECT id FROM users WHERE role IN ('Manager', 'Admin'))
    AND c.issue_id IN (SELECT id FROM issues))"""


@register("resolve_issues", tables=("issues", "issue_changes", "users"), oracle=_ISSUE_ACC + """,
per AS (
  SELECT issue_id,
         arg_max(status, (changed_at, seq)) AS p_status,
         arg_max(changed_at, (changed_at, seq)) FILTER (WHERE status = 'resolved') AS p_at,
         arg_max(changed_by, (changed_at, seq)) FILTER (WHERE status = 'resolved') AS p_by,
         COALESCE(string_agg(E'\\n\\nRESOLUTION: ' || resolution_notes, '' ORDER BY changed_at, seq)
                  FILTER (WHERE status = 'resolved' AND COALESCE(resolution_notes, '') <> ''), '') AS p_notes
  FROM acc GROUP BY issue_id)
SELECT i.id, i.task_id, i.reported_by, i.issue_type,
       CASE WHEN p.issue_id IS NOT NULL THEN i.description || p.p_notes ELSE i.description END AS description,
       i.priority, COALESCE(p.p_status, i.status) AS status, i.requested_action, i.created_at,
       COALESCE(p.p_at, i.resolved_at) AS resolved_at, COALESCE(p.p_by, i.resolved_by) AS resolved_by
FROM issues i LEFT JOIN per p ON p.issue_id = i.id""")
def _resolve_issues(T):
    return changes.resolve_issues(T.issues, T.issue_changes, T.users)


_ISSUE_OK = """
WITH ok AS (
  SELECT r.* FROM issue_requests r
  WHERE r.reported_by IN (SELECT id FROM users WHERE role = 'Electrician')
    AND EXISTS (SELECT 1 FROM tasks t WHERE t.id = r.task_id AND t.assigned_to = r.reported_by))"""


@register("issue_intake", tables=("issue_requests", "tasks", "users", "issues"), oracle=_ISSUE_OK + """
SELECT (SELECT COALESCE(MAX(id), 0) FROM issues) + row_number() OVER (ORDER BY request_id) AS id,
       task_id, reported_by, issue_type, description,
       CASE WHEN COALESCE(priority, '') <> '' THEN priority ELSE 'normal' END AS priority,
       'open' AS status, requested_action, requested_at AS created_at,
       CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS BIGINT) AS resolved_by
FROM ok""")
def _issue_intake(T):
    return changes.issue_intake(T.issue_requests, T.tasks, T.users, T.issues)[0]


@register("issue_intake_rejected", tables=("issue_requests", "tasks", "users"), oracle=_ISSUE_OK + """
SELECT * FROM issue_requests WHERE request_id NOT IN (SELECT request_id FROM ok)""")
def _issue_intake_rejected(T):
    return changes.issue_intake(T.issue_requests, T.tasks, T.users, T.issues)[1]


@register("purge_tasks", tables=("tasks",), oracle="""
SELECT * FROM tasks WHERE status = 'Completed'""")
def _purge_tasks(T):
    out, _ = changes.purge_tasks(T, T.tasks.select("id"))
    return out.tasks


@register("purge_tasks_children", tables=("tasks", "task_ratings", "task_completions", "task_materials", "issues"),
          oracle="""
WITH doomed AS (SELECT id FROM tasks WHERE status IS NULL OR status <> 'Completed')
SELECT 'task_ratings' AS table_name, COUNT(*) AS remaining FROM task_ratings WHERE task_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'task_completions', COUNT(*) FROM task_completions WHERE task_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'task_materials', COUNT(*) FROM task_materials WHERE task_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'issues', COUNT(*) FROM issues WHERE task_id NOT IN (SELECT id FROM doomed)""")
def _purge_tasks_children(T):
    from pyspark.sql import functions as F

    out, _ = changes.purge_tasks(T, T.tasks.select("id"))
    parts = [getattr(out, n).agg(F.count(F.lit(1)).alias("remaining"))
             .select(F.lit(n).alias("table_name"), "remaining")
             for n in ("task_ratings", "task_completions", "task_materials", "issues")]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@register("toggle_status", tables=("users", "toggle_requests"), oracle="""
WITH flips AS (SELECT user_id, COUNT(*) AS n FROM toggle_requests GROUP BY user_id)
SELECT u.id, u.username, u.email, u.password, u.full_name, u.phone, u.role,
       CASE WHEN COALESCE(f.n % 2 = 1, false) THEN (CASE WHEN u.status = 'Active' THEN 'Inactive' ELSE 'Active' END)
            ELSE u.status END AS status,
       u.created_at, u.last_login
FROM users u LEFT JOIN flips f ON f.user_id = u.id""")
def _toggle_status(T):
    return changes.toggle_status(T.users, T.toggle_requests)


_PATCH_CTE = """
WITH latest AS (
  SELECT * FROM user_patches WHERE full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)"""


@register("upsert_users", tables=("users", "user_patches"), oracle=_PATCH_CTE + """
SELECT u.id, u.username, u.email, u.password,
       CASE WHEN l.user_id IS NOT NULL THEN l.full_name ELSE u.full_name END AS full_name,
       CASE WHEN l.user_id IS NOT NULL THEN COALESCE(regexp_replace(l.phone, '[\\s-]', '', 'g'), '') ELSE u.phone END AS phone,
       u.role,
       CASE WHEN l.user_id IS NOT NULL THEN l.status ELSE u.status END AS status,
       u.created_at, u.last_login
FROM users u LEFT JOIN latest l ON l.user_id = u.id""")
def _upsert_users(T):
    return changes.upsert_details(T.users, T.electrician_details, T.user_patches, TASK_AS_OF)[0]


@register("upsert_details", tables=("users", "electrician_details", "user_patches"), oracle=_PATCH_CTE + """,
techs AS (
  SELECT l.user_id AS electrician_id,
         CASE WHEN COALESCE(l.skills, '') <> '' THEN l.skills ELSE '' END AS s,
         CASE WHEN COALESCE(l.certifications, '') <> '' THEN l.certifications ELSE '' END AS c
  FROM latest l JOIN users u ON u.id = l.user_id WHERE u.role = 'Electrician')
SELECT d.electrician_id, d.employee_code, COALESCE(t.s, d.skills) AS skills,
       CASE WHEN t.electrician_id IS NOT NULL THEN t.c ELSE d.certifications END AS certifications,
       d.rating, d.total_tasks_completed, d.join_date
FROM electrician_details d LEFT JOIN techs t ON t.electrician_id = d.electrician_id
UNION ALL
SELECT t.electrician_id, CAST(NULL AS VARCHAR), t.s, t.c, CAST(0 AS DECIMAL(3,2)), 0, DATE '""" + TASK_AS_OF + """'
FROM techs t WHERE t.electrician_id NOT IN (SELECT electrician_id FROM electrician_details)""")
def _upsert_details(T):
    return changes.upsert_details(T.users, T.electrician_details, T.user_patches, TASK_AS_OF)[1]


@register("mark_read", tables=("notifications", "notification_reads"), oracle="""
SELECT n.id, n.user_id, n.type, n.title, n.message,
       CASE WHEN EXISTS (SELECT 1 FROM notification_reads r WHERE r.id = n.id AND r.user_id = n.user_id)
            THEN true ELSE n.is_read END AS is_read,
       n.created_at
FROM notifications n""")
def _mark_read(T):
    return changes.mark_read(T.notifications, T.notification_reads)


@register("activity_entries", tables=("task_changes", "tasks", "activity_logs"), oracle="""
SELECT (SELECT COALESCE(MAX(id), 0) FROM activity_logs)
         + row_number() OVER (ORDER BY c.changed_at, c.task_id, c.seq) AS id,
       c.actor_id AS user_id, 'Task Status Update' AS action,
       'Updated task ' || CAST(c.task_id AS VARCHAR) || ' status to ' || c.status AS description,
       CAST(NULL AS VARCHAR) AS ip_address, c.changed_at AS created_at
FROM task_changes c
WHERE c.kind = 'status' AND c.status IN ('Pending', 'Assigned', 'In Progress', 'Completed', 'Cancelled')
  AND c.task_id IN (SELECT id FROM tasks)""")
def _activity_entries(T):
    return changes.status_change_log(T.tasks, T.task_changes, T.activity_logs)


# ---------------------------------------------------------------------------
# D1 task change fold, E2 / E3 notifications.  The oracle is an independent
# step-by-step fold (recursive CTE), not the window formulation.
# ---------------------------------------------------------------------------
from ..operators import task_changes as tch  # noqa: E402

_STATUSES = "('Pending', 'Assigned', 'In Progress', 'Completed', 'Cancelled')"
_LOAD = ["title", "description", "priority", "scheduled_date", "scheduled_time_start", "scheduled_time_end", "estimated_hours"]
_STATE = ["status", "assigned_to", "actual_start_time", "actual_end_time", *_LOAD]
# one request after another: what each does to the row that the one before it left
_FOLD = f"""
WITH RECURSIVE
ch_all AS (
  SELECT c.*, c.task_id IN (SELECT id FROM tasks) AS known,
         CASE WHEN c.kind = 'assign' THEN CASE WHEN c.assigned_to IS NULL OR c.assigned_to NOT IN (
                   SELECT id FROM users WHERE role = 'Electrician' AND status = 'Active') THEN 'invalid or inactive electrician' END
              WHEN c.kind = 'status' THEN CASE WHEN c.status IS NULL OR c.status NOT IN {_STATUSES} THEN 'invalid status value' END
              WHEN c.kind = 'edit' THEN CASE
                WHEN COALESCE(c.title, '') = '' OR c.priority IS NULL OR c.priority NOT IN ('High', 'Medium', 'Low')
                  OR c.scheduled_date IS NULL OR c.estimated_hours IS NULL THEN 'validation failed'
                WHEN COALESCE(c.status, '') <> '' AND c.status NOT IN {_STATUSES} THEN 'invalid status value' END
              WHEN c.kind = 'complete' THEN NULL ELSE 'unknown change kind' END AS why
  FROM task_changes c),
ch AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY changed_at, seq) AS k FROM ch_all WHERE known),
fold(task_id, k, {", ".join(_STATE)}, updated_at, in_status, in_assignee, refused, unassigns) AS (
  SELECT id, 0, {", ".join(_STATE)}, updated_at, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), false
  FROM tasks WHERE id IN (SELECT task_id FROM ch)
  UNION ALL
  SELECT task_id, k, {", ".join(f"n_{c}" for c in _STATE)},
         CASE WHEN {" OR ".join(f"n_{c} IS DISTINCT FROM {c}" for c in _STATE)} THEN changed_at ELSE updated_at END,
         status, assigned_to, refused, refused IS NULL AND sets AND asked = 'Pending'
  FROM (
    SELECT *,
      CASE WHEN refused IS NOT NULL THEN status WHEN kind = 'assign' THEN 'Assigned' WHEN kind = 'complete' THEN 'Completed'
           WHEN kind = 'status' OR sets THEN asked ELSE status END AS n_status,
      CASE WHEN refused IS NOT NULL THEN assigned_to WHEN kind = 'assign' THEN to_whom WHEN sets AND asked = 'Pending' THEN NULL
           ELSE assigned_to END AS n_assigned_to,
      CASE WHEN refused IS NULL AND (kind = 'status' OR sets) AND asked = 'In Progress' THEN changed_at ELSE actual_start_time END AS n_actual_start_time,
      CASE WHEN refused IS NULL AND (kind = 'complete' OR (kind = 'status' OR sets) AND asked = 'Completed') THEN changed_at
           ELSE actual_end_time END AS n_actual_end_time,
      {", ".join(f"CASE WHEN refused IS NULL AND kind = 'edit' THEN e_{c} ELSE {c} END AS n_{c}" for c in _LOAD)}
    FROM (
      SELECT f.task_id, ch.k, {", ".join("f." + c for c in _STATE)}, f.updated_at, ch.kind, ch.changed_at,
             ch.status AS asked, ch.assigned_to AS to_whom, {", ".join(f"ch.{c} AS e_{c}" for c in _LOAD)},
             ch.kind = 'edit' AND COALESCE(ch.status, '') <> '' AND ch.status IS DISTINCT FROM f.status AS sets,
             CASE WHEN ch.why = 'validation failed' THEN ch.why
                  WHEN ch.kind = 'edit' AND f.status IN ('Completed', 'Cancelled') THEN 'cannot update ' || lower(f.status) || ' tasks'
                  WHEN ch.kind = 'complete' AND ch.actor_role = 'Electrician' AND ch.actor_id IS DISTINCT FROM f.assigned_to
                    THEN 'not assigned to this task'
                  ELSE ch.why END AS refused
      FROM fold f JOIN ch ON ch.task_id = f.task_id AND ch.k = f.k + 1) AS asked) AS answered),
took AS (
  SELECT ch.*, f.in_status, f.in_assignee, f.unassigns, f.refused IS NULL AS applied, f.refused
  FROM fold f JOIN ch ON ch.task_id = f.task_id AND ch.k = f.k WHERE f.k > 0)"""

_TASK_COLS = ["id", "task_code", "title", "description", "customer_id", "priority", "status",
              "created_by", "assigned_to", "scheduled_date", "scheduled_time_start",
              "scheduled_time_end", "estimated_hours", "actual_start_time", "actual_end_time",
              "created_at", "updated_at"]
_FINAL_SEL = ", ".join(f"CASE WHEN fl.task_id IS NOT NULL THEN fl.{c} ELSE t.{c} END AS {c}" if c in (*_STATE, "updated_at")
                       else f"t.{c}" for c in _TASK_COLS)


@register("apply_task_changes", tables=("tasks", "task_changes", "users"), oracle=_FOLD + f""",
final AS (SELECT * FROM fold QUALIFY k = max(k) OVER (PARTITION BY task_id))
SELECT {_FINAL_SEL}
FROM tasks t LEFT JOIN final fl ON fl.task_id = t.id""")
def _apply_task_changes(T):
    return tch.apply_task_changes(T.tasks, T.task_changes, T.users)[0]


@register("task_change_rejects", tables=("tasks", "task_changes", "users"), oracle=_FOLD + """
SELECT task_id, changed_at, seq, kind, status, assigned_to, refused AS reason FROM took WHERE refused IS NOT NULL
UNION ALL
SELECT task_id, changed_at, seq, kind, status, assigned_to, reason FROM (
  SELECT *, CASE WHEN kind IN ('assign', 'status') AND why IS NOT NULL OR why IN ('validation failed', 'unknown change kind') THEN why
                 WHEN kind <> 'assign' THEN 'task not found' END AS reason
  FROM ch_all WHERE NOT known) AS u
WHERE reason IS NOT NULL""")
def _task_change_rejects(T):
    return tch.rejected_changes(tch.decide(T.tasks, T.task_changes, T.users))


@register("notify_assigned", tables=("task_changes", "users"), oracle="""
SELECT c.assigned_to AS user_id, 'task' AS type, 'New Task Assigned' AS title,
       'You have been assigned a new task #' || CAST(c.task_id AS VARCHAR) AS message, c.task_id, c.changed_at, c.seq
FROM task_changes c JOIN users u ON u.id = c.assigned_to AND u.role = 'Electrician' AND u.status = 'Active'
WHERE c.kind = 'assign'""")
def _notify_assigned(T):
    return tch.assigned_notes(T.task_changes, T.users)


@register("notify_unassigned", tables=("tasks", "task_changes", "users"), oracle=_FOLD + """
SELECT in_assignee AS user_id, 'task' AS type, 'Task Reassignment' AS title,
       'Task #' || CAST(task_id AS VARCHAR) || ' has been unassigned and is now pending reassignment' AS message,
       task_id, changed_at, seq
FROM took WHERE unassigns AND in_assignee IS NOT NULL""")
def _notify_unassigned(T):
    return tch.unassigned_notes(tch.decide(T.tasks, T.task_changes, T.users))


# ---------------------------------------------------------------------------
# what accepted changes change beside their tasks (D3, D6, D7, D17, C20 as one unit)
# ---------------------------------------------------------------------------
from ..operators import applied  # noqa: E402


def _accepted(T, columns=None):
    return applied.accepted_changes(T.task_changes, tch.decide(T.tasks, T.task_changes, T.users), columns)


@register("applied_completions", tables=("tasks", "task_changes", "users", "task_completions"), oracle=_FOLD + """,
done AS (
  SELECT * FROM took WHERE applied AND kind = 'complete'
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY changed_at DESC, seq DESC) = 1)
SELECT c.id, task_id, CASE WHEN d.k IS NULL THEN c.completion_notes ELSE d.completion_notes END AS completion_notes,
       CASE WHEN d.k IS NULL THEN c.materials_used ELSE d.materials_used END AS materials_used,
       CAST(CASE WHEN d.k IS NULL THEN c.additional_charges ELSE COALESCE(d.additional_charges, 0) END AS DECIMAL(10,2)) AS additional_charges,
       c.customer_signature, COALESCE(d.changed_at, c.completed_at) AS completed_at
FROM task_completions c LEFT JOIN done d USING (task_id)
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM task_completions) + row_number() OVER (ORDER BY task_id), task_id, completion_notes,
       materials_used, CAST(COALESCE(additional_charges, 0) AS DECIMAL(10,2)), NULL, changed_at
FROM done WHERE task_id NOT IN (SELECT task_id FROM task_completions)""")
def _applied_completions(T):
    return applied.completions_after(T.task_completions, _accepted(T))


@register("applied_counters", tables=("tasks", "task_changes", "users", "electrician_details"), oracle=_FOLD + """
SELECT electrician_id, employee_code, skills, certifications, rating,
       CAST(total_tasks_completed + (SELECT COUNT(*) FROM took WHERE applied AND kind = 'complete'
         AND actor_role = 'Electrician' AND actor_id = electrician_id) AS INTEGER) AS total_tasks_completed, join_date
FROM electrician_details""")
def _applied_counters(T):
    return applied.counters_after(T.electrician_details, _accepted(T, ["kind", "actor_id", "actor_role"]))


@register("applied_customers", tables=("tasks", "task_changes", "users", "customers"), oracle=_FOLD + """,
patch AS (
  SELECT t.customer_id, e.* FROM took e JOIN tasks t ON t.id = e.task_id
  WHERE e.applied AND e.kind = 'edit'
    AND concat(e.customer_name, e.customer_phone, e.customer_address) <> ''),
last AS (
  SELECT customer_id,
         arg_max(customer_name, (changed_at, seq, task_id)) FILTER (WHERE customer_name IS NOT NULL) AS name,
         arg_max(customer_phone, (changed_at, seq, task_id)) FILTER (WHERE customer_phone IS NOT NULL) AS phone,
         arg_max(customer_address, (changed_at, seq, task_id)) FILTER (WHERE customer_address IS NOT NULL) AS address
  FROM patch GROUP BY customer_id)
SELECT c.id, COALESCE(l.name, c.name) AS name, c.email, COALESCE(l.phone, c.phone) AS phone,
       COALESCE(l.address, c.address) AS address, c.created_at
FROM customers c LEFT JOIN last l ON l.customer_id = c.id""")
def _applied_customers(T):
    return applied.customers_after(T.customers, T.tasks, _accepted(T))


@register("applied_materials", tables=("tasks", "task_changes", "users", "task_materials", "edit_materials"), oracle=_FOLD + """,
newest AS (
  SELECT task_id, max((changed_at, seq)) AS at FROM took
  WHERE applied AND kind = 'edit' AND (task_id, changed_at, seq) IN (SELECT (task_id, changed_at, seq) FROM edit_materials)
  GROUP BY task_id)
SELECT * FROM task_materials WHERE task_id NOT IN (SELECT task_id FROM newest)
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM task_materials) + row_number() OVER (ORDER BY m.task_id, pos), m.task_id,
       CASE WHEN COALESCE(name, '') = '' THEN material_name ELSE name END,
       CAST(CASE WHEN COALESCE(quantity, 0) = 0 THEN 1 ELSE quantity END AS INTEGER), NULL
FROM edit_materials m JOIN newest n ON n.task_id = m.task_id AND n.at = (m.changed_at, m.seq) WHERE pos IS NOT NULL""")
def _applied_materials(T):
    return applied.materials_after(T.task_materials, _accepted(T, ["kind"]), T.edit_materials)


@register("applied_log", tables=("tasks", "task_changes", "users", "activity_logs"), oracle=_FOLD + """
SELECT (SELECT COALESCE(MAX(id), 0) FROM activity_logs) + row_number() OVER (ORDER BY changed_at, task_id, seq) AS id,
       actor_id AS user_id, CASE kind WHEN 'status' THEN 'Task Status Update' WHEN 'edit' THEN 'Task Update' ELSE 'Task Completed' END AS action,
       CASE kind WHEN 'status' THEN 'Updated task ' || task_id || ' status to ' || status
                 WHEN 'edit' THEN 'Updated task #' || task_id ELSE 'Completed task ' || task_id END AS description,
       CAST(NULL AS VARCHAR) AS ip_address, changed_at AS created_at
FROM took WHERE applied AND kind <> 'assign'""")
def _applied_log(T):
    return applied.log_entries(T.activity_logs, _accepted(T))


# ---------------------------------------------------------------------------
# E1, E4, E5 notifications
# ---------------------------------------------------------------------------
from ..operators import notify  # noqa: E402


@register("notify_task_created", tables=("customers", "customer_intake", "tasks", "users"),
          oracle=_INTAKE_CTE + """
SELECT n.id AS task_id, 'Manager' AS audience, 'task' AS type, 'New Task Created' AS title,
       'New task "' || n.title || '" has been created and needs assignment' AS message,
       (SELECT COUNT(*) FROM users WHERE role = 'Manager' AND status = 'Active') AS recipients
FROM new_tasks n""")
def _notify_task_created(T):
    _, resolved = changes.resolve_customers(T.customers, T.customer_intake)
    new_tasks, _ = changes.task_intake(resolved, T.tasks)
    return notify.notify_task_created(new_tasks, T.users)


@register("notify_issue_resolved", tables=("issues", "issue_changes", "users"), oracle=_ISSUE_ACC + """
SELECT i.reported_by AS user_id, 'issue' AS type, 'Issue Resolved' AS title,
       'Your reported issue "' || i.issue_type || '" has been resolved.' AS message,
       a.issue_id, a.changed_at, a.seq
FROM acc a JOIN issues i ON i.id = a.issue_id WHERE a.status = 'resolved'""")
def _notify_issue_resolved(T):
    return notify.notify_issue_resolved(T.issues, T.issue_changes, T.users)


@register("notify_issue_reported", tables=("issue_requests", "tasks", "users", "issues"),
          oracle=_ISSUE_OK + """,
new_issues AS (
  SELECT (SELECT COALESCE(MAX(id), 0) FROM issues) + row_number() OVER (ORDER BY request_id) AS id,
         task_id, issue_type FROM ok),
base AS (
  SELECT n.id AS issue_id, t.created_by, t.title AS task_title, n.issue_type
  FROM new_issues n JOIN tasks t ON t.id = n.task_id)
SELECT issue_id, created_by AS user_id, CAST(NULL AS VARCHAR) AS audience, CAST(NULL AS BIGINT) AS exclude_user_id,
       'issue' AS type, 'New Issue Reported' AS title,
       'An issue has been reported for task "' || task_title || '" - ' || issue_type AS message
FROM base
UNION ALL
SELECT issue_id, CAST(NULL AS BIGINT), 'Manager', created_by, 'issue', 'New Issue Reported',
       'An issue has been reported for task "' || task_title || '" - ' || issue_type
FROM base""")
def _notify_issue_reported(T):
    new_issues, _ = changes.issue_intake(T.issue_requests, T.tasks, T.users, T.issues)
    return notify.notify_issue_reported(new_issues, T.tasks)


@register("audience_inbox", tables=("customers", "customer_intake", "tasks", "users", "issue_requests", "issues", "notifications"),
          oracle=_INTAKE_CTE + "," + _ISSUE_OK.lstrip()[5:] + """,
rows_ AS (
  SELECT created_at, 'task' AS source, id AS source_id, CAST(NULL AS BIGINT) AS but, 'task' AS type, 'New Task Created' AS title,
         'New task "' || title || '" has been created and needs assignment' AS message FROM new_tasks
  UNION ALL
  SELECT o.requested_at, 'issue', (SELECT COALESCE(MAX(id), 0) FROM issues) + row_number() OVER (ORDER BY o.request_id), t.created_by, 'issue',
         'New Issue Reported', 'An issue has been reported for task "' || t.title || '" - ' || o.issue_type
  FROM ok o JOIN tasks t ON t.id = o.task_id),
audience AS (
  SELECT (SELECT COALESCE(MAX(id), 0) FROM notifications) + row_number() OVER (ORDER BY created_at, source, source_id) AS id, * FROM rows_),
readers AS (SELECT id AS user_id FROM users WHERE role = 'Manager' AND status = 'Active'),
every AS (
  SELECT r.user_id, a.id, a.title, a.message, a.type, false AS is_read, a.created_at
  FROM readers r JOIN audience a ON a.but IS DISTINCT FROM r.user_id
  UNION ALL
  SELECT n.user_id, n.id, n.title, n.message, n.type, n.is_read, n.created_at FROM notifications n JOIN readers USING (user_id))
SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 10""")
def _audience_inbox(T):
    _, resolved = changes.resolve_customers(T.customers, T.customer_intake)
    new_tasks, _ = changes.task_intake(resolved, T.tasks)
    new_issues, _ = changes.issue_intake(T.issue_requests, T.tasks, T.users, T.issues)
    audience = notify.audience_rows(new_tasks, new_issues, T.tasks, T.users, T.notifications)
    return notify.audience_inbox(T.notifications, audience, T.users)


# ---------------------------------------------------------------------------
# C8, C18, A2 reports
# ---------------------------------------------------------------------------
from . import reports  # noqa: E402


@register("user_performance_report", tables=("users", "tasks", "task_ratings"), oracle=_YEAR + f"""
SELECT {_YEAR_TOTALS},
       coalesce((SELECT full_name FROM best), 'N/A') AS best_performer, 'Last 12 Months' AS report_period,
       strftime(DATE '{TASK_AS_OF}' - INTERVAL 365 DAY, '%Y-%m-%d') AS period_start,
       strftime(DATE '{TASK_AS_OF}', '%Y-%m-%d') AS period_end,
       strftime(DATE '{TASK_AS_OF}', '%Y-%m-%dT%H:%M:%S.000Z') AS report_date""")
def _user_performance_report(T):
    return reports.user_performance_report(T, TASK_AS_OF).summary


@register("system_usage_report")
def _system_usage_report(T):
    return reports.system_usage_report(T, LOG_AS_OF).summary


@register("daily_stats_summary", tables=("tasks",), oracle=f"""
SELECT COUNT(*) AS total_tasks, {_s("status = 'Completed'")} AS completed_tasks,
       {_s("status = 'In Progress'")} AS in_progress_tasks,
       {_s("status IN ('Pending', 'Assigned')")} AS pending_tasks,
       (SELECT COUNT(DISTINCT assigned_to) FROM tasks
        WHERE scheduled_date = DATE '{TASK_AS_OF}' AND assigned_to IS NOT NULL) AS active_electricians
FROM tasks WHERE scheduled_date = DATE '{TASK_AS_OF}'""")
def _daily_stats_summary(T):
    return reports.daily_stats_summary(T, TASK_AS_OF)


_USAGE = f"""
WITH recent AS (
  SELECT al.created_at, u.full_name, u.role, al.ip_address FROM activity_logs al JOIN users u ON u.id = al.user_id
  WHERE al.action = 'Login' ORDER BY al.created_at DESC, al.id DESC LIMIT 10),
nth_recent AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, full_name DESC, role DESC, ip_address DESC) - 1 AS n FROM recent),
days AS (
  SELECT CAST(created_at AS DATE) AS d, COUNT(DISTINCT user_id) AS u, COUNT(*) AS c FROM activity_logs
  WHERE action = 'Login' AND CAST(created_at AS DATE) >= DATE '{LOG_AS_OF}' - INTERVAL 7 DAY GROUP BY 1),
nth_day AS (SELECT *, row_number() OVER (ORDER BY d DESC) - 1 AS n FROM days),
month_ AS (
  SELECT COUNT(DISTINCT user_id) AS u, COUNT(*) AS c FROM activity_logs
  WHERE action = 'Login' AND CAST(created_at AS DATE) >= DATE '{LOG_AS_OF}' - INTERVAL 30 DAY)
"""


def _leaves(source: str, prefix: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT {prefix.format(name=n)} AS path, CAST({c} AS VARCHAR) AS value FROM {source}" for n, c in columns.items())


_N = "COUNT(*) FILTER (WHERE {})"


@register("system_usage_lines", tables=("users", "activity_logs"), oracle=_USAGE + "\nUNION ALL\n".join([
    _leaves("users", "'user_statistics.{name}'", {
        "total": "COUNT(*)", "by_role.admins": _N.format("role = 'Admin'"), "by_role.managers": _N.format("role = 'Manager'"),
        "by_role.electricians": _N.format("role = 'Electrician'"), "by_status.active": _N.format("status = 'Active'"),
        "by_status.inactive": _N.format("status = 'Inactive'")}),
    _leaves("month_", "'login_activity.last_30_days.{name}'", {"unique_users": "u", "total_logins": "c"}),
    _leaves("nth_day", "'login_activity.daily_stats[' || n || '].{name}'", {"date": "d", "unique_users": "u", "login_count": "c"}),
    _leaves("nth_recent", "'login_activity.recent_logins[' || n || '].{name}'",
            {"login_time": "created_at", "user_name": "full_name", "role": "role", "ip_address": "ip_address"}),
    _leaves(f"""(SELECT COUNT(*) AS regs, COUNT(*) FILTER (WHERE resets) AS resets FROM (
        SELECT created_at, false AS resets FROM users UNION ALL SELECT created_at, true FROM activity_logs WHERE action = 'Password Reset') AS e
        WHERE created_at >= DATE '{LOG_AS_OF}' - INTERVAL 30 DAY) AS a""", "'account_activity.{name}'",
            {"new_registrations": "regs", "password_resets": "resets"}),
    _leaves("users", "'account_activity.{name}'", {"deactivated_users": _N.format("status = 'Inactive'")}),
    f"SELECT 'report_date', strftime(DATE '{LOG_AS_OF}', '%Y-%m-%dT%H:%M:%S.000Z')"]))
def _system_usage_lines(T):
    return reports.report_lines(reports.system_usage_report(T, LOG_AS_OF).summary)


@register("daily_stats_lines", tables=("tasks",), oracle=f"""
WITH today AS (SELECT * FROM tasks WHERE scheduled_date = DATE '{TASK_AS_OF}'),
per AS (SELECT status, COUNT(*) AS c, row_number() OVER (ORDER BY status) - 1 AS n FROM today GROUP BY status)
""" + "\nUNION ALL\n".join([
    _leaves("today", "'summary.{name}'", {
        "total_tasks": "COUNT(*)", **{f"{n}_tasks": f"CASE WHEN COUNT(*) > 0 THEN {_N.format(w)} END" for n, w in (
            ("completed", "status = 'Completed'"), ("in_progress", "status = 'In Progress'"), ("pending", "status IN ('Pending', 'Assigned')"))},
        "active_electricians": "COUNT(DISTINCT assigned_to)"}),
    _leaves("per", "'tasks_by_status[' || n || '].{name}'", {"status": "status", "count": "c"}),
    f"SELECT 'report_date', strftime(DATE '{TASK_AS_OF}', '%Y-%m-%dT%H:%M:%S.000Z')"]))
def _daily_stats_lines(T):
    return reports.report_lines(reports.daily_stats_report(T, TASK_AS_OF).summary)


@register("daily_stats_report")
def _daily_stats_report(T):
    return reports.daily_stats_report(T, TASK_AS_OF).summary


@register("report_log", tables=("report_requests", "users", "reports"), oracle="""
WITH ok AS (
  SELECT r.* FROM report_requests r JOIN users u ON u.id = r.generated_by
  WHERE (r.report_type = 'user_performance' AND u.role IN ('Manager', 'Admin'))
     OR (r.report_type = 'system_usage' AND u.role = 'Admin')
     OR (r.report_type = 'daily_stats' AND u.role IN ('Manager', 'Admin')))
SELECT (SELECT COALESCE(MAX(id), 0) FROM reports) + row_number() OVER (ORDER BY request_id) AS id,
       report_type, generated_by,
       '{' || concat_ws(',',
         CASE WHEN start_date IS NOT NULL THEN '"start_date":"' || strftime(start_date, '%Y-%m-%d') || '"' END,
         CASE WHEN end_date IS NOT NULL THEN '"end_date":"' || strftime(end_date, '%Y-%m-%d') || '"' END) || '}'
         AS parameters,
       CAST(NULL AS VARCHAR) AS file_path, requested_at AS created_at
FROM ok""")
def _report_log(T):
    return reports.report_log(T.report_requests, T.users, T.reports)


# ---------------------------------------------------------------------------
# F1-F8 data quality
# ---------------------------------------------------------------------------
from ..functions import columns as fc  # noqa: E402
from ..operators import quality  # noqa: E402


@register("check_keys", tables=("users", "electrician_details", "customers", "tasks", "task_materials",
                                "task_completions", "task_ratings", "activity_logs", "notifications",
                                "issues", "reports", "system_settings"),
          oracle=quality.check_keys_sql())
def _check_keys(T):
    return quality.check_keys(T)


# ---------------------------------------------------------------------------
# D12 off-boarding (batch: every user, acting admin 10), D15 intake
# ---------------------------------------------------------------------------
from ..operators import user_intake  # noqa: E402

ACTING_ADMIN = 10

_PURGE_CTE = f"""
WITH known AS (SELECT id, role, status FROM users),
refs AS (
  SELECT reported_by AS id FROM issues UNION SELECT resolved_by FROM issues
  UNION SELECT generated_by FROM reports),
cand AS (
  SELECT k.*, k.id = {ACTING_ADMIN} AS self,
         COALESCE(k.id IN (SELECT id FROM refs WHERE id IS NOT NULL), false) AS ref
  FROM known k),
adm AS (
  SELECT id,
    (SELECT COUNT(*) FROM users WHERE role = 'Admin' AND status = 'Active')
      - COALESCE(SUM(CASE WHEN status = 'Active' AND NOT self AND NOT ref THEN 1 ELSE 0 END)
                 OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 1 AS last
  FROM cand WHERE role = 'Admin'),
decided AS (
  SELECT c.id, CASE WHEN COALESCE(a.last, false) THEN 'Cannot delete the last admin user'
                    WHEN c.self THEN 'Cannot delete your own account'
                    WHEN c.ref THEN 'User has associated records in the system' END AS reason
  FROM cand c LEFT JOIN adm a ON a.id = c.id),
doomed0 AS (SELECT id FROM decided WHERE reason IS NULL),
heir AS (SELECT MIN(id) AS h FROM users WHERE role = 'Admin' AND id NOT IN (SELECT id FROM doomed0)),
orphaned AS (
  SELECT id FROM doomed0
  WHERE id IN (SELECT created_by FROM tasks WHERE created_by IS NOT NULL) AND (SELECT h FROM heir) IS NULL),
doomed AS (SELECT id FROM doomed0 WHERE id NOT IN (SELECT id FROM orphaned))"""


def _purge_users(T):
    return changes.purge_users(T, T.users.select("id"), ACTING_ADMIN)


@register("purge_users_refused", tables=("users", "issues", "reports", "tasks"), oracle=_PURGE_CTE + """
SELECT id, reason FROM decided WHERE reason IS NOT NULL
UNION ALL SELECT id, 'No other admin to take over created tasks' FROM orphaned""")
def _purge_users_refused(T):
    return _purge_users(T)[1]


@register("purge_users_remaining", tables=("users", "issues", "reports", "tasks"), oracle=_PURGE_CTE + """
SELECT * FROM users WHERE id NOT IN (SELECT id FROM doomed)""")
def _purge_users_remaining(T):
    return _purge_users(T)[0].users


_PURGED_TASK_SEL = ", ".join(
    "CASE WHEN assigned_to IN (SELECT id FROM doomed) THEN NULL ELSE assigned_to END AS assigned_to"
    if c == "assigned_to" else
    "CASE WHEN created_by IN (SELECT id FROM doomed) THEN (SELECT h FROM heir) ELSE created_by END AS created_by"
    if c == "created_by" else c for c in _TASK_COLS)


@register("purge_users_tasks", tables=("users", "issues", "reports", "tasks"), oracle=_PURGE_CTE + f"""
SELECT {_PURGED_TASK_SEL} FROM tasks""")
def _purge_users_tasks(T):
    return _purge_users(T)[0].tasks


@register("purge_users_children", tables=("users", "issues", "reports", "tasks", "electrician_details",
                                          "notifications", "task_completions", "task_ratings",
                                          "activity_logs"), oracle=_PURGE_CTE + """,
gone_tasks AS (SELECT id FROM tasks WHERE assigned_to IN (SELECT id FROM doomed))
SELECT 'electrician_details' AS table_name, COUNT(*) AS remaining FROM electrician_details
  WHERE electrician_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'notifications', COUNT(*) FROM notifications WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'task_completions', COUNT(*) FROM task_completions WHERE task_id NOT IN (SELECT id FROM gone_tasks)
UNION ALL SELECT 'task_ratings', COUNT(*) FROM task_ratings WHERE task_id NOT IN (SELECT id FROM gone_tasks)
UNION ALL SELECT 'activity_logs', COUNT(*) FROM activity_logs WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM doomed)""")
def _purge_users_children(T):
    from pyspark.sql import functions as F

    out = _purge_users(T)[0]
    parts = [getattr(out, n).agg(F.count(F.lit(1)).alias("remaining"))
             .select(F.lit(n).alias("table_name"), "remaining")
             for n in ("electrician_details", "notifications", "task_completions", "task_ratings",
                       "activity_logs")]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# the requests in order, with lists of the keys taken so far
_WALK = """
WITH RECURSIVE req AS (
  SELECT *, row_number() OVER (ORDER BY request_id) AS k, lower(email) AS e, lower(username) AS n,
         CASE WHEN role = 'Electrician' THEN lower(nullif(employee_code, '')) END AS c FROM user_requests),
walk(k, e_taken, n_taken, c_taken, acc) AS (
  SELECT 0, (SELECT list(lower(email)) FROM users), (SELECT list(lower(username)) FROM users),
         (SELECT list(lower(employee_code)) FROM electrician_details), CAST([] AS BIGINT[])
  UNION ALL
  SELECT k, CASE WHEN ok THEN list_append(e_taken, e) ELSE e_taken END, CASE WHEN ok THEN list_append(n_taken, n) ELSE n_taken END,
         CASE WHEN ok AND c IS NOT NULL THEN list_append(c_taken, c) ELSE c_taken END, CASE WHEN ok THEN list_append(acc, request_id) ELSE acc END
  FROM (SELECT r.k, w.e_taken, w.n_taken, w.c_taken, w.acc, r.e, r.n, r.c, r.request_id,
               r.e IS NOT NULL AND r.n IS NOT NULL AND r.full_name IS NOT NULL AND r.role IS NOT NULL
               AND NOT list_contains(w.e_taken, r.e) AND NOT list_contains(w.n_taken, r.n)
               AND (r.c IS NULL OR NOT list_contains(w.c_taken, r.c)) AS ok
        FROM walk w JOIN req r ON r.k = w.k + 1) AS one),
accepted AS (SELECT unnest(acc) AS request_id FROM walk WHERE k = (SELECT max(k) FROM walk)),
made AS (
  SELECT (SELECT COALESCE(MAX(id), 0) FROM users) + row_number() OVER (ORDER BY r.request_id) AS id, r.*
  FROM user_requests r WHERE r.request_id IN (SELECT request_id FROM accepted))"""
_INTAKE_TABLES = ("users", "electrician_details", "user_requests")


def _user_intake(T):
    return user_intake.user_intake(T.users, T.user_requests, TASK_AS_OF, T.electrician_details)


@register("user_intake", tables=_INTAKE_TABLES, oracle=_WALK + f"""
SELECT id, username, email, CAST(NULL AS VARCHAR) AS password, full_name, phone, role, 'Active' AS status,
       COALESCE(requested_at, TIMESTAMP '{TASK_AS_OF} 00:00:00') AS created_at, CAST(NULL AS TIMESTAMP) AS last_login
FROM made""")
def _user_intake_users(T):
    return _user_intake(T)[0]


@register("user_intake_details", tables=_INTAKE_TABLES, oracle=_WALK + f"""
SELECT id AS electrician_id, employee_code, skills, certifications, CAST(0 AS DECIMAL(3,2)) AS rating,
       0 AS total_tasks_completed, DATE '{TASK_AS_OF}' AS join_date
FROM made WHERE role = 'Electrician' AND employee_code <> ''""")
def _user_intake_details(T):
    return _user_intake(T)[1]


@register("user_intake_refused", tables=_INTAKE_TABLES, oracle=_WALK + """
SELECT * FROM user_requests WHERE request_id NOT IN (SELECT request_id FROM accepted)""")
def _user_intake_refused(T):
    return _user_intake(T)[2]


# ---------------------------------------------------------------------------
# All ten kinds of log rows of one set of batches
# ---------------------------------------------------------------------------
from ..operators import activity  # noqa: E402

_AT = f"{LOG_AS_OF} 18:00:00"
_FEED_TABLES = ("tasks", "task_changes", "users", "issues", "reports", "electrician_details", "user_requests", "user_patches", "toggle_requests",
                "password_resets", "logins", "purge_requests", "activity_logs")
# three statements with CTEs of their own become one
_FEED = _FOLD + "," + _PURGE_CTE.lstrip()[5:] + "," + _WALK.lstrip()[15:] + f""",
entries AS (
  SELECT changed_at AS made_at, 0 AS rank, task_id AS k1, seq AS k2, actor_id AS user_id,
         CASE kind WHEN 'status' THEN 'Task Status Update' WHEN 'edit' THEN 'Task Update' ELSE 'Task Completed' END AS action,
         CASE kind WHEN 'status' THEN 'Updated task ' || task_id || ' status to ' || status
                   WHEN 'edit' THEN 'Updated task #' || task_id ELSE 'Completed task ' || task_id END AS description,
         CAST(NULL AS VARCHAR) AS ip_address
  FROM took WHERE applied AND kind <> 'assign'
  UNION ALL
  SELECT p.requested_at, 1, p.id, 0, p.actor_id, 'Task Deletion', 'Deleted task ' || t.task_code || ' - ' || t.title, NULL
  FROM purge_requests p JOIN tasks t ON t.id = p.id AND t.status IS DISTINCT FROM 'Completed'
  UNION ALL
  SELECT COALESCE(requested_at, TIMESTAMP '{TASK_AS_OF} 00:00:00'), 2, id, 0, {ACTING_ADMIN}, 'Create User', 'Created new ' || role || ': ' || full_name, NULL FROM made
  UNION ALL
  SELECT TIMESTAMP '{_AT}', 3, user_id, seq, {ACTING_ADMIN}, 'Update User', 'Updated user: ' || full_name, NULL
  FROM user_patches WHERE full_name IS NOT NULL AND user_id IN (SELECT id FROM users)
  UNION ALL
  SELECT TIMESTAMP '{_AT}', 4, id, 0, {ACTING_ADMIN}, 'Delete User', 'Deleted user: ' || full_name, NULL
  FROM users WHERE id IN (SELECT id FROM doomed)
  UNION ALL
  SELECT TIMESTAMP '{_AT}', 5, g.user_id, g.seq, {ACTING_ADMIN}, 'User Status Update',
         CASE WHEN (u.status = 'Active') = (row_number() OVER (PARTITION BY g.user_id ORDER BY g.seq) % 2 = 0) THEN 'User activated' ELSE 'User deactivated' END, NULL
  FROM toggle_requests g JOIN users u ON u.id = g.user_id
  UNION ALL
  SELECT r.reset_at, 6, r.user_id, r.seq, r.actor_id, 'Password Reset', 'Reset password for user: ' || u.full_name, NULL
  FROM password_resets r JOIN users u ON u.id = r.user_id WHERE r.new_length >= 6
  UNION ALL
  SELECT l.login_at, 7, l.user_id, l.seq, l.user_id, 'Login', 'User logged in', l.ip_address
  FROM logins l JOIN users u ON u.id = l.user_id AND u.status = 'Active')
SELECT (SELECT COALESCE(MAX(id), 0) FROM activity_logs) + row_number() OVER (ORDER BY made_at, rank, k1, k2) AS id, user_id, action, description,
       ip_address, made_at AS created_at
FROM entries"""


@register("activity_feed", tables=_FEED_TABLES, oracle=_FEED)
def _activity_feed(T):
    made = _user_intake(T)[0]
    return activity.log_feed(T.activity_logs, [
        activity.change_entries(_accepted(T)), activity.deletion_entries(T.tasks, T.purge_requests),
        activity.creation_entries(made, ACTING_ADMIN), activity.update_entries(T.users, T.user_patches, ACTING_ADMIN, _AT),
        activity.removal_entries(T.users, _purge_users(T)[0].users, ACTING_ADMIN, _AT),
        activity.toggle_entries(T.users, T.toggle_requests, ACTING_ADMIN, _AT),
        activity.reset_entries(T.users, T.password_resets), activity.login_entries(T.users, T.logins)])


# ---------------------------------------------------------------------------
# F1-F6, F8 row rules (F7 registered above as check_keys)
# ---------------------------------------------------------------------------
def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_NORM = ("replace(replace(replace(replace(replace(replace(replace(replace(" + _trim_sql("full_name")
         + ", '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;'), '\\\\', '&#x5C;'), '`', '&#96;')")
_NAME_OK = f"""(full_name IS NOT NULL AND {_NORM} <> '' AND NOT regexp_matches({_NORM}, '^[0-9]+$')
  AND NOT (length(regexp_replace({_NORM}, '\\s', '', 'g')) > 0
           AND length(regexp_replace({_NORM}, '[^0-9]', '', 'g')) / length(regexp_replace({_NORM}, '\\s', '', 'g')) > 0.7)
  AND length({_NORM}) >= 2)"""
_PHONE_OK = """(phone IS NOT NULL AND phone <> ''
  AND regexp_matches(regexp_replace(phone, '[\\s-]', '', 'g'), '^(?:\\+94|0)?7[0-9]{8}$'))"""


@register("field_rules", tables=("users",), oracle=f"""
SELECT id, {_PHONE_OK} AS phone_ok, {_NAME_OK} AS name_ok,
       COALESCE(regexp_replace(phone, '[\\s-]', '', 'g'), '') AS phone_clean, {_NORM} AS name_clean
FROM users""")
def _field_rules(T):
    return T.users.select("id", fc.phone_valid("phone").alias("phone_ok"),
                          fc.full_name_valid(fc.normalise_text("full_name")).alias("name_ok"),
                          fc.clean_phone("phone").alias("phone_clean"),
                          fc.normalise_text("full_name").alias("name_clean"))


@register("status_rules", tables=("task_changes",), oracle="""
SELECT task_id, seq, COALESCE(status IN ('Pending', 'Assigned', 'In Progress', 'Completed', 'Cancelled'), false)
       AS status_ok FROM task_changes""")
def _status_rules(T):
    return T.task_changes.select("task_id", "seq", fc.status_valid("status").alias("status_ok"))


@register("check_users", tables=("users",), oracle=f"""
SELECT id, concat_ws('; ',
  CASE WHEN NOT COALESCE(regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'), false) THEN 'Invalid email format' END,
  CASE WHEN password IS NOT NULL AND length(password) < 6 THEN 'Password must be at least 6 characters' END,
  CASE WHEN full_name IS NULL OR full_name = '' THEN 'Full name is required' END,
  CASE WHEN NOT {_NAME_OK} THEN 'Full name cannot be only numbers and must be at least 2 characters long' END,
  CASE WHEN phone IS NULL OR phone = '' THEN 'Phone number is required' END,
  CASE WHEN NOT {_PHONE_OK} THEN 'Please enter a valid Sri Lankan mobile number (07X XXX XXXX)' END,
  CASE WHEN NOT COALESCE(role IN ('Admin', 'Manager', 'Electrician'), false) THEN 'Invalid role' END) AS errors
FROM users""")
def _check_users(T):
    from pyspark.sql import functions as F

    return quality.check_users(T.users).select("id", F.array_join("errors", "; ").alias("errors"))


@register("check_tasks", tables=("tasks",), oracle="""
SELECT id, concat_ws('; ',
  CASE WHEN title IS NULL OR title = '' THEN 'title: Invalid value' END,
  CASE WHEN NOT COALESCE(priority IN ('High', 'Medium', 'Low'), false) THEN 'priority: Invalid value' END,
  CASE WHEN scheduled_date IS NULL THEN 'scheduled_date: Invalid value' END,
  CASE WHEN estimated_hours IS NULL THEN 'estimated_hours: Invalid value' END) AS errors
FROM tasks""")
def _check_tasks(T):
    from pyspark.sql import functions as F

    return quality.check_tasks(T.tasks).select("id", F.array_join("errors", "; ").alias("errors"))


# ---------------------------------------------------------------------------
# S1-S3 streaming forms (run with availableNow over files of the derived
# tables, written under the checkpoint folder)
# ---------------------------------------------------------------------------
def _as_file_stream(df, spark, name: str, files: int = 8):
    from ..sources.schemas import SCHEMAS
    from ..streaming.streams import scratch_dir

    src = scratch_dir(spark, f"{name}-src")
    # as many batches as ``files``, each of files written by all cores
    pieces = max(1, spark.sparkContext.defaultParallelism // files + 1)
    df.repartition(files * pieces).write.parquet(src)    # in no order of time
    # the files are this query's own: those of a batch go when the next one begins
    files_read = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", pieces).option("cleanSource", "delete")
    return files_read.parquet(src)


@register("daily_logins_stream", tables=("activity_logs",), oracle="""
SELECT CAST(created_at AS DATE) AS date, count(DISTINCT user_id) AS unique_users, count(*) AS login_count
FROM activity_logs WHERE action = 'Login' GROUP BY 1""")
def _daily_logins_stream(T):
    from ..streaming import streams

    spark = T.users.sparkSession
    return streams.daily_logins_stream(_as_file_stream(T.activity_logs, spark, "activity_logs"),
                                       streams.scratch_dir(spark, "daily_logins"))


@register("notify_stream")
def _notify_stream(T):
    from ..streaming import streams

    spark = T.users.sparkSession
    _, resolved = changes.resolve_customers(T.customers, T.customer_intake)
    new_tasks, _ = changes.task_intake(resolved, T.tasks)
    stream = _as_file_stream(new_tasks, spark, "tasks")
    return streams.run_to_parquet(streams.notify_stream(stream, T.users), spark, "notify")


@register("task_state_stream")
def _task_state_stream(T):
    from ..streaming import streams

    spark = T.users.sparkSession
    stream = _as_file_stream(T.task_changes, spark, "task_changes", files=3)
    handle = streams.task_state_stream(stream, T.tasks, T.users, streams.scratch_dir(spark, "task_state"))
    handle.await_done()
    return handle.latest("tasks")


# the streaming forms give what their batch twins give, so they share statements
for _stream, _batch in (("notify_stream", "notify_task_created"), ("task_state_stream", "apply_task_changes")):
    ORACLE[_stream] = ORACLE[_batch]


# ---------------------------------------------------------------------------
# §2.6 scalar helpers (absolute whole hours, ISO date, time with seconds)
# ---------------------------------------------------------------------------
@register("task_time_fields", tables=("tasks",), oracle="""
SELECT id,
       CAST(floor(abs(date_diff('millisecond', actual_start_time, actual_end_time)) / 3600000) AS BIGINT)
         AS hours_between,
       date_sub('hour', created_at, updated_at) AS hours_to_update,
       strftime(created_at, '%Y-%m-%d') AS created_on,
       strftime(actual_start_time, '%H:%M') || ':00' AS start_time
FROM tasks""")
def _task_time_fields(T):
    from pyspark.sql import functions as F

    return T.tasks.select(
        "id", fc.abs_whole_hours("actual_end_time", "actual_start_time").alias("hours_between"),
        fc.whole_hours("created_at", "updated_at").alias("hours_to_update"),
        fc.format_date("created_at").alias("created_on"),
        fc.format_time(fc.clock_time("actual_start_time")).alias("start_time"))
