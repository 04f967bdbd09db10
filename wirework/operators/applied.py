"""What an accepted change changes beside its task.

The decisions of D1 (``task_changes.decide``) gate every table a change touches, as
the request's transaction does: a refused complete leaves no completion, no count and no log
row, a refused edit no customer data and no materials.  ``accepted_changes`` joins the batch
with its decisions once and is written once; all tables below are derived from it, so
they can't disagree, and the actor is on every row.

* ``completions_after`` (D3): the last accepted complete of a task sets its completion row;
* ``counters_after`` (C20): each accepted complete by a technician counts for that technician;
* ``customers_after`` (D6): accepted edits patch the customer of their task;
* ``materials_after`` (D7): the list of a task's last accepted edit that has one replaces its rows;
* ``log_entries`` (D17): a log row for each accepted status change, complete and edit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ids import assign_ids, materialize, max_id
from ..sources.schemas import SCHEMAS
from ..sources.tables import Tables, conform
from . import task_changes as D1
from .changes import DEFAULT_QUANTITY, LOG_TEMPLATES, latest_completions, patch_customers

KEY = D1.KEY


def accepted_changes(changes: DataFrame, decisions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The applied changes of the batch with all their columns, or ``KEY`` and ``columns``
    where one table alone is derived from them: payloads are neither moved nor written then."""
    wanted = changes.select(*KEY, *columns) if columns is not None else changes
    return materialize(wanted.join(decisions.filter("applied").select(*KEY), KEY, "left_semi"))


def completions_after(completions: DataFrame, accepted: DataFrame) -> DataFrame:
    events = accepted.filter("kind = 'complete'").select(
        "task_id", "completion_notes", "materials_used", "additional_charges", F.col("changed_at").alias("completed_at"), "seq")
    return latest_completions(completions, events)


def counters_after(details: DataFrame, accepted: DataFrame) -> DataFrame:
    """The technicians' details; NULL counters stay NULL, as adding to NULL does."""
    per = (accepted.filter("kind = 'complete' AND actor_role = 'Electrician'")
           .groupBy(F.col("actor_id").alias("electrician_id")).agg(F.count(F.lit(1)).alias("_n")))
    more = (F.col("total_tasks_completed") + F.coalesce(F.col("_n"), F.lit(0))).cast("int")
    out = details.join(per, "electrician_id", "left")
    return out.select(*[more.alias(f.name) if f.name == "total_tasks_completed" else F.col(f.name)
                        for f in SCHEMAS["electrician_details"].fields])


def customers_after(customers: DataFrame, tasks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Edits of different tasks of a customer apply in (changed_at, seq, task_id) order."""
    edits = accepted.filter("kind = 'edit'").select(
        "task_id", F.col("customer_name").alias("name"), F.col("customer_phone").alias("phone"),
        F.col("customer_address").alias("address"), F.struct("changed_at", "seq", "task_id").alias("seq"))
    whose = tasks.select(F.col("id").alias("task_id"), "customer_id").filter("customer_id IS NOT NULL")
    return patch_customers(customers, edits.join(whose, "task_id"))


def materials_after(materials: DataFrame, accepted: DataFrame, lists: DataFrame) -> DataFrame:
    """``lists`` is the long form of the edits' lists (``KEY``, pos, name, material_name,
    quantity; an empty list is a row with NULL ``pos``).  Element defaults: name ||
    material_name, quantity || 1.  An element without any name is stored as it is."""
    edits = accepted.filter("kind = 'edit'").select(*KEY)
    given = edits.join(lists.select(*KEY).distinct(), KEY, "left_semi")
    last = given.groupBy("task_id").agg(F.max(F.struct("changed_at", "seq")).alias("_k"))
    last = last.select("task_id", "_k.changed_at", "_k.seq")
    kept = materials.join(last.select("task_id"), "task_id", "left_anti")
    name, q = F.col("name"), F.col("quantity")
    rows = lists.join(last, KEY).filter("pos IS NOT NULL").select(
        "task_id", "pos", F.when(name.isNotNull() & (name != ""), name).otherwise(F.col("material_name")).alias("material_name"),
        F.when(q.isNull() | (q == 0), F.lit(DEFAULT_QUANTITY)).otherwise(q).cast("int").alias("quantity"))
    return kept.select(*SCHEMAS["task_materials"].names).unionByName(
        conform(assign_ids(rows, ["task_id", "pos"], max_id(materials)), "task_materials"))


def log_rows(accepted: DataFrame) -> DataFrame:
    """``user_id``, ``action``, ``description``, ``created_at`` and the change's key."""
    kind, task = F.col("kind"), F.col("task_id").cast("string")
    by_kind = {"status": ("Task Status Update", [task, F.col("status")]), "complete": ("Task Completed", [task]), "edit": ("Task Update", [task])}
    action, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, args) in by_kind.items():
        action = F.when(kind == k, F.lit(name)).otherwise(action)
        text = F.when(kind == k, F.format_string(LOG_TEMPLATES[name], *args)).otherwise(text)
    return accepted.filter(kind.isin(*by_kind)).select(
        *KEY, F.col("actor_id").alias("user_id"), action.alias("action"), text.alias("description"), F.col("changed_at").alias("created_at"))


def log_entries(logs: DataFrame, accepted: DataFrame) -> DataFrame:
    """New log rows, numbered in (changed_at, task_id, seq) order after ``logs``."""
    rows = assign_ids(log_rows(accepted), ["changed_at", "task_id", "seq"], max_id(logs))
    return conform(rows, "activity_logs")


def apply_changes(T: Tables, changes: DataFrame, lists: DataFrame | None = None) -> tuple[Tables, DataFrame, DataFrame]:
    """All tables after a batch of changes, the rejected changes and the decisions.

    ``changes`` has all columns of ``SCHEMAS["task_changes"]``; ``lists`` are the edits' material lists.
    """
    decisions = D1.decide(T.tasks, changes, T.users)
    accepted = accepted_changes(changes, decisions)
    tasks, rejected, notes = D1.apply_task_changes(T.tasks, changes, T.users, decisions)
    notes = assign_ids(notes.withColumn("_t", F.col("title")), [*["changed_at", "task_id", "seq"], "_t"], max_id(T.notifications))
    notes = conform(notes.withColumns({"is_read": F.lit(False), "created_at": F.col("changed_at")}), "notifications")
    out = T.with_(
        tasks=tasks, task_completions=completions_after(T.task_completions, accepted),
        electrician_details=counters_after(T.electrician_details, accepted),
        customers=customers_after(T.customers, T.tasks, accepted),
        activity_logs=T.activity_logs.unionByName(log_entries(T.activity_logs, accepted)),
        notifications=T.notifications.unionByName(notes),
        **({"task_materials": materials_after(T.task_materials, accepted, lists)} if lists is not None else {}))
    return out, rejected, decisions
