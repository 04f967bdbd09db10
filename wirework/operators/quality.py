"""data-quality checks as jobs over whole tables.

F3 / F4 return each row with an ``errors array<string>`` column (empty when the
row passes).  F7 checks the DDL constraints Spark does not enforce and returns
one row per rule with its violation count: uniqueness is a grouped count per
key (partial aggregation, so a hot key is one row per map task), foreign keys a
``left_anti`` join, NOT NULL / ENUM / CHECK rules one conditional aggregate per
table (one scan of each table for all of them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (EMAIL_PATTERN, PASSWORD_MIN_LENGTH, full_name_valid,
                                 normalise_text, phone_valid)
from ..sources.schemas import (ISSUE_PRIORITIES, ISSUE_STATUSES, TASK_PRIORITIES, TASK_STATUSES,
                               USER_ROLES, USER_STATUSES)
from ..sources.tables import Tables

# --- fixed values: validation messages ------------------------------------------
MSG_EMAIL = "Invalid email format"
MSG_PASSWORD = "Password must be at least 6 characters"
MSG_NAME_REQUIRED = "Full name is required"
MSG_NAME_INVALID = "Full name cannot be only numbers and must be at least 2 characters long"
MSG_PHONE_REQUIRED = "Phone number is required"
MSG_PHONE_INVALID = "Please enter a valid Sri Lankan mobile number (07X XXX XXXX)"
MSG_ROLE = "Invalid role"
MSG_DEFAULT = "Invalid value"
# ---------------------------------------------------------------------------


def _errors(*checks: tuple[Column, str]) -> Column:
    """Array of the messages whose failure condition holds, in rule order."""
    arr = F.array(*[F.when(failed, F.lit(msg)) for failed, msg in checks])
    return F.filter(arr, lambda m: m.isNotNull())


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def check_users(df: DataFrame) -> DataFrame:
    """e-mail shape, optional password length, name rules, phone rules, role."""
    email, pw, name, phone, role = (F.col(c) for c in ("email", "password", "full_name", "phone", "role"))
    pw_col = pw if "password" in df.columns else F.lit(None).cast("string")
    return df.withColumn("errors", _errors(
        (~F.coalesce(email.rlike(EMAIL_PATTERN), F.lit(False)), MSG_EMAIL),
        (pw_col.isNotNull() & (F.length(pw_col) < PASSWORD_MIN_LENGTH), MSG_PASSWORD),
        (_blank(name), MSG_NAME_REQUIRED),
        (~full_name_valid(normalise_text(name)), MSG_NAME_INVALID),
        (_blank(phone), MSG_PHONE_REQUIRED),
        (~phone_valid(phone), MSG_PHONE_INVALID),
        (~F.coalesce(role.isin(*USER_ROLES), F.lit(False)), MSG_ROLE),
    ))


def _is_date(c: Column, dtype: str) -> Column:
    if dtype == "date":
        return c.isNotNull()
    s = c.cast("string")
    shape = s.rlike(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$")
    return F.coalesce(shape & F.try_to_date(F.regexp_replace(s, "/", "-"), "yyyy-MM-dd").isNotNull(),
                      F.lit(False))


def _is_numeric(c: Column, dtype: str) -> Column:
    if dtype.startswith(("decimal", "double", "float", "int", "bigint")):
        return c.isNotNull()
    return F.coalesce(c.cast("string").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.lit(False))


def check_tasks(df: DataFrame) -> DataFrame:
    """title present, priority one of three, scheduled date a date,
    estimated hours numeric."""
    types = dict(df.dtypes)
    title, pri = F.col("title"), F.col("priority")
    sd, eh = F.col("scheduled_date"), F.col("estimated_hours")
    return df.withColumn("errors", _errors(
        (_blank(title), f"title: {MSG_DEFAULT}"),
        (~F.coalesce(pri.isin(*TASK_PRIORITIES), F.lit(False)), f"priority: {MSG_DEFAULT}"),
        (~_is_date(sd, types["scheduled_date"]), f"scheduled_date: {MSG_DEFAULT}"),
        (~_is_numeric(eh, types["estimated_hours"]), f"estimated_hours: {MSG_DEFAULT}"),
    ))


def normalise_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8 applied to text columns of a request batch."""
    return df.select(*[normalise_text(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- F7 ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    table: str
    rule: str          # primary_key | unique | foreign_key | not_null | enum | check
    column: str
    ref: tuple[str, str] | None = None        # (parent table, parent column)
    values: tuple[str, ...] | None = None     # enum members
    bounds: tuple[int, int] | None = None     # check: inclusive range


def _rules() -> list[Rule]:
    R: list[Rule] = []
    pks = {"users": "id", "electrician_details": "electrician_id", "customers": "id", "tasks": "id",
           "task_materials": "id", "task_completions": "id", "task_ratings": "id",
           "activity_logs": "id", "notifications": "id", "issues": "id", "reports": "id",
           "system_settings": "setting_key"}
    R += [Rule(t, "primary_key", c) for t, c in pks.items()]
    R += [Rule(t, "unique", c) for t, c in (
        ("users", "username"), ("users", "email"), ("electrician_details", "employee_code"),
        ("tasks", "task_code"), ("task_completions", "task_id"), ("task_ratings", "task_id"))]
    R += [Rule(t, "foreign_key", c, ref=r) for t, c, r in (
        ("electrician_details", "electrician_id", ("users", "id")),
        ("tasks", "customer_id", ("customers", "id")),
        ("tasks", "created_by", ("users", "id")),
        ("tasks", "assigned_to", ("users", "id")),
        ("task_materials", "task_id", ("tasks", "id")),
        ("task_completions", "task_id", ("tasks", "id")),
        ("task_ratings", "task_id", ("tasks", "id")),
        ("activity_logs", "user_id", ("users", "id")),
        ("notifications", "user_id", ("users", "id")),
        ("issues", "task_id", ("tasks", "id")),
        ("issues", "reported_by", ("users", "id")),
        ("issues", "resolved_by", ("users", "id")),
        ("reports", "generated_by", ("users", "id")))]
    R += [Rule(t, "not_null", c) for t, c in (
        ("users", "username"), ("users", "email"), ("users", "password"), ("users", "full_name"),
        ("users", "role"), ("customers", "name"), ("customers", "phone"), ("tasks", "task_code"),
        ("tasks", "title"), ("tasks", "created_by"), ("task_materials", "task_id"),
        ("task_materials", "material_name"), ("task_completions", "task_id"),
        ("task_ratings", "task_id"), ("activity_logs", "action"), ("notifications", "user_id"),
        ("notifications", "type"), ("notifications", "title"), ("issues", "task_id"),
        ("issues", "reported_by"), ("reports", "report_type"), ("reports", "generated_by"))]
    R += [Rule(t, "enum", c, values=tuple(v)) for t, c, v in (
        ("users", "role", USER_ROLES), ("users", "status", USER_STATUSES),
        ("tasks", "priority", TASK_PRIORITIES), ("tasks", "status", TASK_STATUSES),
        ("issues", "priority", ISSUE_PRIORITIES), ("issues", "status", ISSUE_STATUSES))]
    R.append(Rule("task_ratings", "check", "rating", bounds=(1, 5)))
    return R


RULES = _rules()


def _row_rule_failure(r: Rule) -> str:
    c = r.column
    if r.rule == "not_null":
        return f"{c} IS NULL"
    if r.rule == "enum":
        return f"{c} NOT IN ({', '.join(repr(v) for v in r.values)})"
    lo, hi = r.bounds
    return f"{c} NOT BETWEEN {lo} AND {hi}"


def check_keys(T: Tables) -> DataFrame:
    """one row (table_name, rule, column_name, violations) per DDL rule.

    A primary key is violated by each repeated value and by each NULL row.  Every
    table is scanned once: a row gives (domain, key) pairs for its key columns, and a pair without a key for
    each row rule that it breaks.  A foreign key's domain is the parent's primary
    key, so one grouping by (domain, key) has the parent's rows and those of all its
    children side by side, as counts combined before the shuffle: no join, and no key that is
    frequent in a child travels more than once a task.  Keys keep their type (bigint or text).
    """
    idx = {r: i for i, r in enumerate(RULES)}
    primary = {(r.table, r.column): i for r, i in idx.items() if r.rule == "primary_key"}
    slots: dict[int, int] = {}                 # rule of a foreign key -> its counter within the parent's domain
    used: dict[int, int] = {}
    for r, i in idx.items():
        if r.rule == "foreign_key":
            used[primary[r.ref]] = slots[i] = used.get(primary[r.ref], -1) + 1

    def pair(domain: int, slot: int, key: str | None, text: bool) -> str:
        number, text = ("NULL", key) if key and text else (key or "NULL", "NULL")
        return (f"named_struct('domain', {domain}, 'slot', {slot}, 'number', CAST({number} AS BIGINT), "
                f"'text', CAST({text} AS STRING))")

    # written as SQL text: the same columns built one by one take seconds of calls
    parts = None
    for table in dict.fromkeys(r.table for r in RULES):
        df = getattr(T, table)
        types = dict(df.dtypes)
        pairs = []
        for r in (x for x in RULES if x.table == table):
            i, c, text = idx[r], r.column, types[r.column] == "string"
            if r.rule in ("primary_key", "unique"):
                if r.rule == "primary_key":
                    pairs.append(f"CASE WHEN {c} IS NULL THEN {pair(i, -1, None, text)} END")
                pairs.append(f"CASE WHEN {c} IS NOT NULL THEN {pair(i, -1, c, text)} END")
            elif r.rule == "foreign_key":
                pairs.append(f"CASE WHEN {c} IS NOT NULL THEN {pair(primary[r.ref], slots[i], c, text)} END")
            else:
                pairs.append(f"CASE WHEN {_row_rule_failure(r)} THEN {pair(i, -1, None, text)} END")
        some = df.selectExpr(f"explode(array({', '.join(pairs)})) AS x").filter("x IS NOT NULL").select("x.*")
        parts = some if parts is None else parts.unionByName(some)

    counters = [-1, *range(max(slots.values()) + 1)]
    counted = parts.groupBy("domain", "number", "text").agg(
        *[F.expr(f"count(CASE WHEN slot = {n} THEN 1 END)").alias(f"n{n + 1}") for n in counters])
    no_key = "number IS NULL AND text IS NULL"

    def line(r: Rule) -> str:
        if r.rule == "foreign_key":
            at, bad = primary[r.ref], f"CASE WHEN n0 = 0 AND NOT ({no_key}) THEN n{slots[idx[r]] + 1} END"
        elif r.rule in ("primary_key", "unique"):
            at, bad = idx[r], f"CASE WHEN {no_key} THEN n0 WHEN n0 > 1 THEN 1 END"
        else:
            at, bad = idx[r], "n0"
        return (f"named_struct('table_name', '{r.table}', 'rule', '{r.rule}', 'column_name', '{r.column}', "
                f"'violations', coalesce(sum(CASE WHEN domain = {at} THEN {bad} END), 0L))")

    every = counted.agg(F.expr(f"array({', '.join(line(r) for r in RULES)})").alias("every"))
    return every.selectExpr("inline(every)")


def check_keys_sql() -> str:
    """The same rules as DuckDB SQL over the tables (oracle of F7)."""
    sel: list[str] = []

    def row(r: Rule, expr: str) -> str:
        return (f"SELECT '{r.table}' AS table_name, '{r.rule}' AS rule, '{r.column}' AS column_name, "
                f"CAST({expr} AS BIGINT) AS violations")

    for r in RULES:
        c = r.column
        if r.rule == "not_null":
            sel.append(row(r, f"(SELECT COUNT(*) FROM {r.table} WHERE {c} IS NULL)"))
        elif r.rule == "enum":
            vals = ", ".join(f"'{v}'" for v in r.values)
            sel.append(row(r, f"(SELECT COUNT(*) FROM {r.table} WHERE {c} IS NOT NULL AND {c} NOT IN ({vals}))"))
        elif r.rule == "check":
            lo, hi = r.bounds
            sel.append(row(r, f"(SELECT COUNT(*) FROM {r.table} WHERE {c} IS NOT NULL AND {c} NOT BETWEEN {lo} AND {hi})"))
        elif r.rule in ("primary_key", "unique"):
            nulls = f" + (SELECT COUNT(*) FROM {r.table} WHERE {c} IS NULL)" if r.rule == "primary_key" else ""
            sel.append(row(r, f"(SELECT COUNT(*) FROM (SELECT {c} FROM {r.table} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1) AS d){nulls}"))
        else:
            pt, pc = r.ref
            sel.append(row(r, f"(SELECT COUNT(*) FROM {r.table} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pt} p WHERE p.{pc} = x.{c}))"))
    return "\nUNION ALL\n".join(sel)
