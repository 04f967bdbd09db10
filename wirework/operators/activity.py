"""The log rows of all write paths of a batch, and their numbering.

Each function gives rows of ``ENTRY``: the acting user, the action, its text and
time, and (rank, k1, k2, k3), which order entries of equal time.  ``log_feed`` numbers any
of them together after the current log.  Refused requests give no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ids import assign_ids, index_within, max_id
from ..sources.tables import conform
from . import applied
from .changes import LOG_TEMPLATES

ENTRY = ["created_at", "rank", "k1", "k2", "k3", "user_id", "action", "description", "ip_address"]


def _entries(df: DataFrame, rank: int, action: str, args: Sequence[Column], user: Column, at: Column, keys: Sequence[Column],
             ip: Column | None = None) -> DataFrame:
    tmpl = LOG_TEMPLATES[action]
    text = F.format_string(tmpl, *[a.cast("string") for a in args]) if args else F.lit(tmpl)
    k = [*keys, *[F.lit(0)] * (3 - len(keys))]
    return df.select(at.cast("timestamp_ntz").alias("created_at"), F.lit(rank).alias("rank"), *[c.cast("bigint").alias(f"k{n + 1}") for n, c in enumerate(k)],
                     user.cast("bigint").alias("user_id"), F.lit(action).alias("action"), text.alias("description"),
                     (F.lit(None) if ip is None else ip).cast("string").alias("ip_address"))


def change_entries(accepted: DataFrame) -> DataFrame:
    """Status changes, completes and edits that were applied."""
    return applied.log_rows(accepted).select(
        "created_at", F.lit(0).alias("rank"), F.col("task_id").alias("k1"), F.col("seq").alias("k2"), F.lit(0).cast("bigint").alias("k3"),
        "user_id", "action", "description", F.lit(None).cast("string").alias("ip_address"))


def deletion_entries(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Tasks that D11 deletes; ``requests`` has id, actor_id and requested_at."""
    doomed = tasks.filter("status IS NULL OR status <> 'Completed'").select("id", "task_code", "title")
    return _entries(requests.join(doomed, "id"), 1, "Task Deletion", [F.col("task_code"), F.col("title")], F.col("actor_id"),
                    F.col("requested_at"), [F.col("id")])


def creation_entries(new_users: DataFrame, actor: int) -> DataFrame:
    return _entries(new_users, 2, "Create User", [F.col("role"), F.col("full_name")], F.lit(actor), F.col("created_at"), [F.col("id")])


def update_entries(users: DataFrame, patches: DataFrame, actor: int, at: str) -> DataFrame:
    """Each patch that D14 accepts, of a known user."""
    known = patches.filter("full_name IS NOT NULL").join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return _entries(known, 3, "Update User", [F.col("full_name")], F.lit(actor), F.lit(at), [F.col("user_id"), F.col("seq")])


def removal_entries(before: DataFrame, after: DataFrame, actor: int, at: str) -> DataFrame:
    """Users that D12 deleted: those of ``before`` that are not in ``after``."""
    gone = before.select("id", "full_name").join(after.select("id"), "id", "left_anti")
    return _entries(gone, 4, "Delete User", [F.col("full_name")], F.lit(actor), F.lit(at), [F.col("id")])


def toggle_entries(users: DataFrame, toggles: DataFrame, actor: int, at: str) -> DataFrame:
    """The n-th flip of a user says what the status is after it."""
    placed = index_within(toggles.select("user_id", "seq"), "user_id", ["seq"], "n")
    rows = placed.join(users.select(F.col("id").alias("user_id"), (F.col("status") == "Active").alias("was_active")), "user_id")
    active = F.coalesce(F.col("was_active"), F.lit(False)) == (F.col("n") % 2 == 0)
    return _entries(rows, 5, "User Status Update", [F.when(active, "activated").otherwise("deactivated")], F.lit(actor), F.lit(at),
                    [F.col("user_id"), F.col("seq")])


def reset_entries(users: DataFrame, resets: DataFrame) -> DataFrame:
    """Accepted password resets (``password_resets``: user_id, actor_id, reset_at, new_length, seq)."""
    rows = resets.filter("new_length >= 6").join(users.select(F.col("id").alias("user_id"), "full_name"), "user_id")
    return _entries(rows, 6, "Password Reset", [F.col("full_name")], F.col("actor_id"), F.col("reset_at"), [F.col("user_id"), F.col("seq")])


def login_entries(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Logins of active users (``logins``: user_id, ip_address, login_at, seq), with their address."""
    active = users.filter("status = 'Active'").select(F.col("id").alias("user_id"))
    return _entries(logins.join(active, "user_id", "left_semi"), 7, "Login", [], F.col("user_id"), F.col("login_at"),
                    [F.col("user_id"), F.col("seq")], F.col("ip_address"))


def log_feed(logs: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """New log rows, numbered in (created_at, rank, k1, k2, k3) order after ``logs``."""
    rows = parts[0].select(*ENTRY)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*ENTRY))
    return conform(assign_ids(rows, ENTRY[:5], max_id(logs)), "activity_logs")
