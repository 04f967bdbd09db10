"""Derivation of the field-service tables from the TPC-H-style test parquet.

The reference's own tables do not exist in the test data, so each one is derived
from a driver table with one SQL statement.  The statement text is shared: Spark
runs it with the raw DataFrames bound to the ``{name}`` placeholders
(``spark.sql(text, customer=df)``), and the DuckDB oracle runs the same text over
its registered views.  One text for both engines means both start from the very
same rows.
"""

from __future__ import annotations

from .schemas import SCHEMAS, duckdb_type

# --- fixed values: derivation statements of the test fixtures ---------------
DERIVATIONS: dict[str, str] = {
    "users": """
SELECT c_custkey AS id, 'u' || CAST(c_custkey AS STRING) AS username, 'u' || CAST(c_custkey AS STRING) || '@example.test' AS email, c_name AS full_name,
       CASE WHEN c_custkey % 5 = 0 THEN '077 ' || lpad(CAST(c_custkey AS STRING), 7, '0') WHEN c_custkey % 5 = 1 THEN '011' || lpad(CAST(c_custkey AS STRING), 7, '0') ELSE '+9477' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS phone,
       CASE WHEN c_custkey % 10 = 0 THEN 'Admin' WHEN c_custkey % 10 <= 2 THEN 'Manager' ELSE 'Electrician' END AS role,
       CASE WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status, TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '1' DAY * (c_custkey * 7 % 240) AS created_at
FROM {customer}""",
    "electrician_details": """
SELECT c_custkey AS electrician_id, 'ELC' || lpad(CAST(c_custkey AS STRING), 5, '0') AS employee_code, c_mktsegment AS skills, CAST(NULL AS STRING) AS certifications, CAST(DATE '2020-01-01' + INTERVAL '1' DAY * (c_custkey % 700) AS DATE) AS join_date
FROM {customer}
WHERE c_custkey % 10 > 2 AND c_custkey % 13 <> 0""",
    "customers": """
SELECT s_suppkey AS id, s_name AS name,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 's' || CAST(s_suppkey AS STRING) || '@example.test' END AS email, '07' || lpad(CAST(s_suppkey % 90 AS STRING), 8, '0') AS phone, 'Nation ' || CAST(s_nationkey AS STRING) AS address, TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' DAY * (s_suppkey % 300) AS created_at
FROM {supplier}""",
    "tasks": """
SELECT o_orderkey AS id, 'T' || lpad(CAST(o_orderkey AS STRING), 6, '0') AS task_code, 'Task ' || CAST(o_orderkey AS STRING) AS title, o_orderkey % 120 AS customer_id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '5-LOW' THEN 'Low' ELSE 'Medium' END AS priority,
       CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'In Progress' WHEN o_orderstatus = 'O' THEN 'Assigned' WHEN o_orderkey % 20 = 0 THEN 'Cancelled' ELSE 'Pending' END AS status, o_custkey - o_custkey % 10 + 1 AS created_by,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS assigned_to,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL '1' DAY * (o_orderkey % 7) AS DATE) END AS scheduled_date,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 600) END AS actual_start_time,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 600 + o_orderkey % 1000) END AS actual_end_time, o_orderdate AS created_at, o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 5000) AS updated_at
FROM {orders}""",
    "task_ratings": """
SELECT o_orderkey AS id, o_orderkey AS task_id, CAST(1 + o_orderkey * 31 % 5 AS INT) AS rating, CAST(NULL AS STRING) AS feedback, o_orderdate + INTERVAL '5' DAY AS rated_at
FROM {orders}
WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0""",
    "rating_events": """
SELECT l_orderkey AS task_id, CAST(CAST(l_quantity AS BIGINT) % 7 AS INT) AS rating, l_shipdate AS rated_at, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq
FROM {lineitem}""",
    "task_materials": """
SELECT l_orderkey AS task_id, p_name AS material_name, CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS cost
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "task_completions": """
SELECT o_orderkey AS task_id, 'done ' || CAST(o_orderkey AS STRING) AS completion_notes, CAST(NULL AS STRING) AS materials_used, CAST(o_totalprice % 100 AS DECIMAL(10,2)) AS additional_charges, o_orderdate + INTERVAL '1' DAY AS completed_at
FROM {orders}
WHERE o_orderstatus = 'F' AND o_orderkey % 6 <> 0""",
    "activity_logs": """
SELECT event_id AS id,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE event_type WHEN 'view' THEN 'Login' WHEN 'signup' THEN 'Password Reset' WHEN 'click' THEN 'Task Status Update' WHEN 'purchase' THEN 'Task Completed' ELSE 'Task Update' END AS action, props AS description, '10.0.0.' || CAST(user_id % 250 AS STRING) AS ip_address, ts AS created_at
FROM {events}""",
    "notifications": """
SELECT event_id AS id, user_id,
       CASE WHEN event_type = 'click' THEN 'task' ELSE 'issue' END AS type, event_type AS title, props AS message, event_id % 3 = 0 AS is_read, ts AS created_at
FROM {events}
WHERE event_type IN ('click', 'purchase')""",
    "issues": """
SELECT event_id AS id, event_id AS task_id, user_id AS reported_by,
       CASE WHEN event_id % 2 = 0 THEN 'safety' ELSE 'materials' END AS issue_type, props AS description,
       CASE event_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'urgent' ELSE 'emergency' END AS priority,
       CASE WHEN value < 10 THEN 'open' WHEN value < 20 THEN 'in_progress' ELSE 'resolved' END AS status, CAST(NULL AS STRING) AS requested_action, ts AS created_at,
       CASE WHEN value >= 20 THEN ts + INTERVAL '1' HOUR * (event_id % 90) END AS resolved_at,
       CASE WHEN value >= 20 THEN user_id - user_id % 10 + 1 END AS resolved_by
FROM {events}
WHERE event_type = 'error'""",
    "task_changes": """
SELECT task_id, changed_at, seq, kind, status,
       CASE WHEN kind = 'assign' AND l_linenumber = 7 THEN l_suppkey WHEN kind = 'assign' THEN technician END AS assigned_to,
       CASE WHEN kind = 'complete' AND l_suppkey % 11 <> 0 THEN technician ELSE task_id % 10 * 10 + 2 END AS actor_id,
       CASE WHEN kind = 'complete' AND l_suppkey % 11 <> 0 THEN 'Electrician' ELSE 'Manager' END AS actor_role,
       CASE WHEN kind = 'edit' AND l_partkey % 17 = 0 THEN '' WHEN kind = 'edit' THEN 'Visit ' || CAST(l_partkey % 9 AS STRING) END AS title,
       CASE WHEN kind = 'edit' AND l_partkey % 2 = 0 THEN 'note ' || CAST(l_partkey % 4 AS STRING) END AS description,
       CASE WHEN kind <> 'edit' THEN NULL WHEN l_partkey % 13 = 0 THEN 'Urgent' WHEN l_linenumber % 3 = 0 THEN 'High' WHEN l_linenumber % 3 = 1 THEN 'Medium' ELSE 'Low' END AS priority,
       CASE WHEN kind = 'edit' AND l_partkey % 19 <> 0 THEN CAST(changed_at + INTERVAL '1' DAY * (l_partkey % 3) AS DATE) END AS scheduled_date,
       CASE WHEN kind = 'edit' AND l_partkey % 5 <> 0 THEN '09:00:00' END AS scheduled_time_start,
       CASE WHEN kind = 'edit' THEN '10:30:00' END AS scheduled_time_end,
       CASE WHEN kind = 'edit' THEN CAST(l_partkey % 8 + 1 AS DECIMAL(4,2)) END AS estimated_hours,
       CASE WHEN kind <> 'edit' THEN NULL WHEN l_partkey % 6 = 0 THEN 'Client ' || CAST(l_partkey AS STRING) WHEN l_partkey % 6 = 1 THEN '' END AS customer_name,
       CASE WHEN kind = 'edit' AND l_partkey % 10 = 0 THEN '07' || lpad(CAST(l_partkey % 97 AS STRING), 8, '0') END AS customer_phone,
       CASE WHEN kind = 'edit' AND l_partkey % 7 = 0 THEN 'Avenue ' || CAST(l_partkey % 11 AS STRING) END AS customer_address,
       CASE WHEN kind = 'complete' THEN 'line ' || CAST(l_linenumber AS STRING) END AS completion_notes,
       CASE WHEN kind = 'complete' AND l_linenumber % 2 = 1 THEN 'qty ' || CAST(l_partkey % 50 AS STRING) END AS materials_used,
       CASE WHEN kind = 'complete' AND l_linenumber % 3 <> 0 THEN CAST(l_partkey % 30 AS DECIMAL(10,2)) END AS additional_charges
FROM (SELECT l_orderkey AS task_id, l_shipdate AS changed_at, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq,
             l_partkey, l_suppkey, l_linenumber, l_orderkey % 10 * 10 + 3 + l_suppkey % 3 AS technician,
             CASE WHEN l_returnflag = 'A' THEN 'assign' WHEN l_returnflag = 'R' THEN 'edit' WHEN l_linestatus = 'O' THEN 'status' ELSE 'complete' END AS kind,
             CASE WHEN l_returnflag = 'A' THEN 'Assigned' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL WHEN l_returnflag = 'R' AND l_partkey % 4 = 0 THEN ''
                  WHEN l_linenumber <= 2 THEN 'In Progress' WHEN l_linenumber <= 4 THEN 'Pending' WHEN l_linenumber = 5 THEN 'Completed' ELSE 'Cancelled' END AS status
      FROM {lineitem}) AS l""",
    "edit_materials": """
SELECT l_orderkey AS task_id, l_shipdate AS changed_at, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq,
       CAST(NULL AS BIGINT) AS pos, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS material_name, CAST(NULL AS INT) AS quantity
FROM {lineitem} WHERE l_returnflag = 'R' AND l_partkey % 6 = 0""" + "".join(f"""
UNION ALL
SELECT l_orderkey, l_shipdate, l_partkey * 100000 + l_suppkey * 10 + l_linenumber, {n},
       {name}, 'part ' || CAST(l_partkey AS STRING), {quantity}
FROM {{lineitem}} WHERE l_returnflag = 'R' AND l_partkey % 6 = 3""" for n, name, quantity in (
        (1, "'item ' || CAST(l_partkey AS STRING)", "CAST(l_quantity AS INT)"), (2, "''", "0"), (3, "NULL", "NULL"))),
}
# ---------------------------------------------------------------------------

# Change batches for the write operators the fixtures above do not cover.  Each
# reads a whole driver table, so the batch grows with the data.
DERIVATIONS.update({
    "completion_events": """
SELECT l_orderkey AS task_id, 'line ' || CAST(l_linenumber AS STRING) AS completion_notes,
       CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'qty ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS materials_used,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_tax * 100 AS DECIMAL(10,2)) END AS additional_charges,
       l_shipdate AS completed_at, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq
FROM {lineitem}""",
    "customer_intake": """
SELECT o_orderkey AS request_id, 'Client ' || CAST(o_custkey AS STRING) AS customer_name,
       '07' || lpad(CAST(o_custkey % 150 AS STRING), 8, '0') AS customer_phone,
       'Street ' || CAST(o_custkey % 37 AS STRING) AS customer_address,
       'Job ' || CAST(o_orderkey AS STRING) AS title,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '5-LOW' THEN 'Low' ELSE 'Medium' END AS priority,
       CAST(o_orderdate + INTERVAL '2' DAY AS DATE) AS scheduled_date,
       o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS requested_at,
       o_custkey - o_custkey % 10 + 2 AS created_by,
       CASE WHEN o_orderkey % 4 <> 0 THEN 'details of order ' || CAST(o_orderkey AS STRING) END AS description,
       CASE WHEN o_orderkey % 3 <> 0 THEN '08:30:00' END AS scheduled_time_start, CASE WHEN o_orderkey % 3 = 1 THEN '11:00:00' END AS scheduled_time_end,
       CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 9 AS DECIMAL(4,2)) END AS estimated_hours
FROM {orders}""",
    "customer_patches": """
SELECT o_orderkey % 120 AS customer_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Client ' || CAST(o_custkey AS STRING) WHEN o_orderkey % 3 = 1 THEN '' END AS name,
       CASE WHEN o_orderkey % 5 = 0 THEN '07' || lpad(CAST(o_custkey % 97 AS STRING), 8, '0') END AS phone,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Avenue ' || CAST(o_orderkey % 11 AS STRING) END AS address,
       o_orderkey AS seq
FROM {orders}""",
    "material_payload": """
SELECT l_orderkey AS task_id, CASE WHEN l_orderkey % 2 = 0 THEN 'edit' ELSE 'create' END AS op,
       l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS pos,
       CASE WHEN l_linenumber = 1 THEN '' ELSE 'item ' || CAST(l_partkey AS STRING) END AS name,
       'part ' || CAST(l_partkey AS STRING) AS material_name,
       CASE WHEN l_linenumber = 2 THEN 0 WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS INT) END AS quantity
FROM {lineitem}""",
    "issue_changes": """
SELECT event_id - 1 AS issue_id,
       CASE WHEN value < 15 THEN 'in_progress' ELSE 'resolved' END AS status,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'fixed ' || CAST(event_id AS STRING) END AS resolution_notes,
       user_id - user_id % 10 + 1 AS changed_by, ts + INTERVAL '2' HOUR AS changed_at, event_id AS seq
FROM {events}""",
    "issue_requests": """
SELECT o_orderkey AS request_id, o_orderkey AS task_id,
       CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS reported_by,
       CASE WHEN o_orderkey % 2 = 0 THEN 'safety' ELSE 'materials' END AS issue_type,
       'issue on order ' || CAST(o_orderkey AS STRING) AS description,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'urgent' ELSE 'emergency' END AS priority,
       CAST(NULL AS STRING) AS requested_action, o_orderdate + INTERVAL '3' DAY AS requested_at
FROM {orders}""",
    "user_patches": """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 9 <> 0 THEN upper(c_name) END AS full_name,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '077-' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS phone,
       CASE WHEN c_acctbal > 5000 THEN 'Inactive' ELSE 'Active' END AS status,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment || ' wiring' END AS skills,
       CAST(NULL AS STRING) AS certifications, c_custkey AS seq
FROM {customer}""",
    "user_requests": """
SELECT s_suppkey AS request_id,
       CASE WHEN s_suppkey % 31 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'U' || CAST(s_suppkey AS STRING)
            WHEN s_suppkey % 2 = 0 THEN 'New_u' || CAST(s_suppkey % 70 AS STRING) ELSE 'new_u' || CAST(s_suppkey % 70 AS STRING) END AS username,
       CASE WHEN s_suppkey % 3 = 0 THEN 'u' || CAST(s_suppkey AS STRING) || '@Example.test' ELSE 'new' || CAST(s_suppkey % 40 AS STRING) || '@example.test' END AS email,
       s_name AS full_name, '0771234567' AS phone,
       CASE WHEN s_suppkey % 4 = 0 THEN 'Manager' ELSE 'Electrician' END AS role,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 29 = 0 THEN 'elc' || lpad(CAST(s_suppkey AS STRING), 5, '0')
            WHEN s_suppkey % 13 = 0 THEN '' ELSE 'NEW' || lpad(CAST(s_suppkey % 53 AS STRING), 5, '0') END AS employee_code,
       'General' AS skills, CAST(NULL AS STRING) AS certifications,
       CASE WHEN s_suppkey % 17 <> 0 THEN TIMESTAMP '2001-08-01 08:00:00' + INTERVAL '1' MINUTE * s_suppkey END AS requested_at
FROM {supplier}""",
    "toggle_requests": """
SELECT user_id, event_id AS seq FROM {events} WHERE event_type = 'signup'""",
    "report_requests": """
SELECT event_id AS request_id,
       CASE event_id % 4 WHEN 0 THEN 'user_performance' WHEN 1 THEN 'system_usage' WHEN 2 THEN 'daily_stats' ELSE 'audit' END AS report_type,
       user_id AS generated_by,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS start_date,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts + INTERVAL '7' DAY AS DATE) END AS end_date,
       ts AS requested_at
FROM {events}""",
    "password_resets": """
SELECT user_id, user_id % 15 * 10 AS actor_id, ts + INTERVAL '3' HOUR AS reset_at, CAST(event_id % 12 AS INT) AS new_length, event_id AS seq
FROM {events} WHERE event_type = 'signup'""",
    "logins": """
SELECT user_id, '10.1.0.' || CAST(event_id % 250 AS STRING) AS ip_address, ts + INTERVAL '1' DAY AS login_at, event_id AS seq
FROM {events} WHERE event_type = 'view'""",
    "purge_requests": """
SELECT o_orderkey AS id, o_custkey - o_custkey % 10 AS actor_id, o_orderdate + INTERVAL '30' DAY AS requested_at
FROM {orders}""",
    "notification_reads": """
SELECT event_id - 1 AS id, CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS user_id
FROM {events}""",
})

# Raw driver tables each derivation reads.
SOURCES: dict[str, tuple[str, ...]] = {
    "users": ("customer",),
    "electrician_details": ("customer",),
    "customers": ("supplier",),
    "tasks": ("orders",),
    "task_ratings": ("orders",),
    "rating_events": ("lineitem",),
    "task_materials": ("lineitem", "part"),
    "task_completions": ("orders",),
    "activity_logs": ("events",),
    "notifications": ("events",),
    "issues": ("events",),
    "task_changes": ("lineitem",),
    "edit_materials": ("lineitem",),
    "completion_events": ("lineitem",),
    "customer_intake": ("orders",),
    "customer_patches": ("orders",),
    "material_payload": ("lineitem",),
    "issue_changes": ("events",),
    "issue_requests": ("orders",),
    "user_patches": ("customer",),
    "user_requests": ("supplier",),
    "toggle_requests": ("events",),
    "notification_reads": ("events",),
    "password_resets": ("events",),
    "logins": ("events",),
    "purge_requests": ("orders",),
    "report_requests": ("events",),
}

# Derived output columns of each statement (the rest of the schema is typed NULL).
_DERIVED_COLUMNS: dict[str, tuple[str, ...]] = {
    "users": ("id", "username", "email", "full_name", "phone", "role", "status", "created_at"),
    "electrician_details": ("electrician_id", "employee_code", "skills", "certifications", "join_date"),
    "customers": ("id", "name", "email", "phone", "address", "created_at"),
    "tasks": ("id", "task_code", "title", "customer_id", "priority", "status", "created_by",
              "assigned_to", "scheduled_date", "actual_start_time", "actual_end_time",
              "created_at", "updated_at"),
    "task_ratings": ("id", "task_id", "rating", "feedback", "rated_at"),
    "rating_events": ("task_id", "rating", "rated_at", "seq"),
    "task_materials": ("task_id", "material_name", "quantity", "cost"),
    "task_completions": ("task_id", "completion_notes", "materials_used", "additional_charges",
                         "completed_at"),
    "activity_logs": ("id", "user_id", "action", "description", "ip_address", "created_at"),
    "notifications": ("id", "user_id", "type", "title", "message", "is_read", "created_at"),
    "issues": ("id", "task_id", "reported_by", "issue_type", "description", "priority", "status",
               "requested_action", "created_at", "resolved_at", "resolved_by"),
}


def derived_columns(name: str) -> tuple[str, ...]:
    if name in _DERIVED_COLUMNS:
        return _DERIVED_COLUMNS[name]
    return tuple(f.name for f in SCHEMAS[name].fields)


def duckdb_view_sql(name: str) -> str:
    """The DuckDB text of one derived table, conformed to its full schema
    (tables without a derivation, reports and system_settings, are empty)."""
    if name not in DERIVATIONS:
        cols = ", ".join(f"CAST(NULL AS {duckdb_type(f.dataType)}) AS {f.name}" for f in SCHEMAS[name].fields)
        return f"SELECT {cols} WHERE false"
    inner = DERIVATIONS[name].format(**{s: s for s in SOURCES[name]})
    have = set(derived_columns(name))
    cols = []
    for f in SCHEMAS[name].fields:
        src = f.name if f.name in have else "NULL"
        cols.append(f"CAST({src} AS {duckdb_type(f.dataType)}) AS {f.name}")
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS d"


def with_tables(sql: str, names: list[str]) -> str:
    """Prefix an oracle query with CTEs that define the derived tables it reads
    (a query that starts with its own WITH gets its CTEs appended)."""
    ctes = ",\n".join(f"{n} AS ({duckdb_view_sql(n)})" for n in names)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
