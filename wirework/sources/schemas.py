"""Table schemas of the field-service data model, as Spark StructTypes.

MySQL types map to Spark as follows: INT AUTO_INCREMENT -> bigint, ENUM -> string
(with an ordinal helper in ``wirework.functions``), TIMESTAMP / DATETIME ->
timestamp_ntz (UTC by contract), TIME -> string ``HH:mm:ss``, JSON -> string,
BLOB -> binary.  Spark enforces none of the DDL constraints; see
``wirework.operators.quality.check_keys``.
"""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()
_TS, _D, _B = T.TimestampNTZType(), T.DateType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- fixed values: enum members in DDL declaration order --------------------
USER_ROLES = ["Admin", "Manager", "Electrician"]
USER_STATUSES = ["Active", "Inactive"]
TASK_PRIORITIES = ["High", "Medium", "Low"]
TASK_STATUSES = ["Pending", "Assigned", "In Progress", "Completed", "Cancelled"]
ISSUE_PRIORITIES = ["normal", "urgent", "emergency"]
ISSUE_STATUSES = ["open", "in_progress", "resolved"]
# ---------------------------------------------------------------------------

USERS = _struct(
    ("id", _L), ("username", _S), ("email", _S), ("password", _S), ("full_name", _S),
    ("phone", _S), ("role", _S), ("status", _S), ("created_at", _TS), ("last_login", _TS),
)
ELECTRICIAN_DETAILS = _struct(
    ("electrician_id", _L), ("employee_code", _S), ("skills", _S), ("certifications", _S),
    ("rating", T.DecimalType(3, 2)), ("total_tasks_completed", _I), ("join_date", _D),
)
CUSTOMERS = _struct(
    ("id", _L), ("name", _S), ("email", _S), ("phone", _S), ("address", _S), ("created_at", _TS),
)
TASKS = _struct(
    ("id", _L), ("task_code", _S), ("title", _S), ("description", _S), ("customer_id", _L),
    ("priority", _S), ("status", _S), ("created_by", _L), ("assigned_to", _L),
    ("scheduled_date", _D), ("scheduled_time_start", _S), ("scheduled_time_end", _S),
    ("estimated_hours", T.DecimalType(4, 2)), ("actual_start_time", _TS),
    ("actual_end_time", _TS), ("created_at", _TS), ("updated_at", _TS),
)
TASK_MATERIALS = _struct(
    ("id", _L), ("task_id", _L), ("material_name", _S), ("quantity", _I),
    ("cost", T.DecimalType(10, 2)),
)
TASK_COMPLETIONS = _struct(
    ("id", _L), ("task_id", _L), ("completion_notes", _S), ("materials_used", _S),
    ("additional_charges", T.DecimalType(10, 2)), ("customer_signature", T.BinaryType()),
    ("completed_at", _TS),
)
TASK_RATINGS = _struct(
    ("id", _L), ("task_id", _L), ("rating", _I), ("feedback", _S), ("rated_at", _TS),
)
ACTIVITY_LOGS = _struct(
    ("id", _L), ("user_id", _L), ("action", _S), ("description", _S), ("ip_address", _S),
    ("created_at", _TS),
)
NOTIFICATIONS = _struct(
    ("id", _L), ("user_id", _L), ("type", _S), ("title", _S), ("message", _S),
    ("is_read", _B), ("created_at", _TS),
)
ISSUES = _struct(
    ("id", _L), ("task_id", _L), ("reported_by", _L), ("issue_type", _S), ("description", _S),
    ("priority", _S), ("status", _S), ("requested_action", _S), ("created_at", _TS),
    ("resolved_at", _TS), ("resolved_by", _L),
)
REPORTS = _struct(
    ("id", _L), ("report_type", _S), ("generated_by", _L), ("parameters", _S),
    ("file_path", _S), ("created_at", _TS),
)
SYSTEM_SETTINGS = _struct(("setting_key", _S), ("setting_value", _S), ("updated_at", _TS))

# change batches (inputs of the set-at-a-time write operators)
RATING_EVENTS = _struct(("task_id", _L), ("rating", _I), ("rated_at", _TS), ("seq", _L))
TASK_CHANGES = _struct(
    ("task_id", _L), ("changed_at", _TS), ("seq", _L), ("kind", _S), ("status", _S),
    ("assigned_to", _L),
    # who asks
    ("actor_id", _L), ("actor_role", _S),
    # what an edit sets, on the task and on its customer
    ("title", _S), ("description", _S), ("priority", _S), ("scheduled_date", _D), ("scheduled_time_start", _S),
    ("scheduled_time_end", _S), ("estimated_hours", T.DecimalType(4, 2)),
    ("customer_name", _S), ("customer_phone", _S), ("customer_address", _S),
    # what a complete reports
    ("completion_notes", _S), ("materials_used", _S), ("additional_charges", T.DecimalType(10, 2)),
)
#: The columns every batch of changes has; the others may be left out.
CHANGE_CORE = T.StructType(TASK_CHANGES.fields[:6])
#: What the fold of changes decides about each (``operators.task_changes.decide``).
TASK_DECISIONS = T.StructType([*TASK_CHANGES.fields[:8], *_struct(
    ("applied", _B), ("reason", _S), ("in_status", _S), ("in_assignee", _L), ("out_status", _S), ("out_assignee", _L),
    ("out_start", _TS), ("out_end", _TS), ("moves", _B)).fields])
#: Material lists of edits, an element a row; ``pos`` NULL: an empty list.
EDIT_MATERIALS = _struct(("task_id", _L), ("changed_at", _TS), ("seq", _L), ("pos", _L), ("name", _S),
                         ("material_name", _S), ("quantity", _I))

SCHEMAS: dict[str, T.StructType] = {
    "users": USERS,
    "electrician_details": ELECTRICIAN_DETAILS,
    "customers": CUSTOMERS,
    "tasks": TASKS,
    "task_materials": TASK_MATERIALS,
    "task_completions": TASK_COMPLETIONS,
    "task_ratings": TASK_RATINGS,
    "activity_logs": ACTIVITY_LOGS,
    "notifications": NOTIFICATIONS,
    "issues": ISSUES,
    "reports": REPORTS,
    "system_settings": SYSTEM_SETTINGS,
    "rating_events": RATING_EVENTS,
    "task_changes": TASK_CHANGES,
    "edit_materials": EDIT_MATERIALS,
}

# Spark type -> DuckDB type name, used to write oracle SQL from the same schemas.
def duckdb_type(dt: T.DataType) -> str:
    if isinstance(dt, T.LongType):
        return "BIGINT"
    if isinstance(dt, T.IntegerType):
        return "INTEGER"
    if isinstance(dt, T.StringType):
        return "VARCHAR"
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.DateType):
        return "DATE"
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return "TIMESTAMP"
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, T.BinaryType):
        return "BLOB"
    if isinstance(dt, T.DoubleType):
        return "DOUBLE"
    raise TypeError(f"no DuckDB mapping for {dt}")

# change batches derived from the test tables for the remaining write operators
COMPLETION_EVENTS = _struct(
    ("task_id", _L), ("completion_notes", _S), ("materials_used", _S),
    ("additional_charges", T.DecimalType(10, 2)), ("completed_at", _TS), ("seq", _L),
)
CUSTOMER_INTAKE = _struct(
    ("request_id", _L), ("customer_name", _S), ("customer_phone", _S), ("customer_address", _S),
    ("title", _S), ("priority", _S), ("scheduled_date", _D), ("requested_at", _TS),
    ("created_by", _L), ("description", _S), ("scheduled_time_start", _S), ("scheduled_time_end", _S),
    ("estimated_hours", T.DecimalType(4, 2)),
)
CUSTOMER_PATCHES = _struct(("customer_id", _L), ("name", _S), ("phone", _S), ("address", _S),
                           ("seq", _L))
MATERIAL_PAYLOAD = _struct(("task_id", _L), ("op", _S), ("pos", _L), ("name", _S),
                           ("material_name", _S), ("quantity", _I))
ISSUE_CHANGES = _struct(("issue_id", _L), ("status", _S), ("resolution_notes", _S),
                        ("changed_by", _L), ("changed_at", _TS), ("seq", _L))
ISSUE_REQUESTS = _struct(("request_id", _L), ("task_id", _L), ("reported_by", _L),
                         ("issue_type", _S), ("description", _S), ("priority", _S),
                         ("requested_action", _S), ("requested_at", _TS))
USER_PATCHES = _struct(("user_id", _L), ("full_name", _S), ("phone", _S), ("status", _S),
                       ("skills", _S), ("certifications", _S), ("seq", _L))
USER_REQUESTS = _struct(("request_id", _L), ("username", _S), ("email", _S), ("full_name", _S),
                        ("phone", _S), ("role", _S), ("employee_code", _S), ("skills", _S),
                        ("certifications", _S), ("requested_at", _TS))
TOGGLE_REQUESTS = _struct(("user_id", _L), ("seq", _L))
NOTIFICATION_READS = _struct(("id", _L), ("user_id", _L))
REPORT_REQUESTS = _struct(("request_id", _L), ("report_type", _S), ("generated_by", _L),
                          ("start_date", _D), ("end_date", _D), ("requested_at", _TS))

PASSWORD_RESETS = _struct(("user_id", _L), ("actor_id", _L), ("reset_at", _TS), ("new_length", _I), ("seq", _L))
LOGINS = _struct(("user_id", _L), ("ip_address", _S), ("login_at", _TS), ("seq", _L))
PURGE_REQUESTS = _struct(("id", _L), ("actor_id", _L), ("requested_at", _TS))

SCHEMAS.update({
    "password_resets": PASSWORD_RESETS,
    "logins": LOGINS,
    "purge_requests": PURGE_REQUESTS,
    "completion_events": COMPLETION_EVENTS,
    "customer_intake": CUSTOMER_INTAKE,
    "customer_patches": CUSTOMER_PATCHES,
    "material_payload": MATERIAL_PAYLOAD,
    "issue_changes": ISSUE_CHANGES,
    "issue_requests": ISSUE_REQUESTS,
    "user_patches": USER_PATCHES,
    "user_requests": USER_REQUESTS,
    "toggle_requests": TOGGLE_REQUESTS,
    "notification_reads": NOTIFICATION_READS,
    "report_requests": REPORT_REQUESTS,
})
