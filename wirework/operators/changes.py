"""The reference's single-row writes re-aimed as set-at-a-time operators.

Each takes the current tables plus a change batch and returns new DataFrames;
nothing is updated in place (the caller writes the result, e.g. Parquet to a new
path or MERGE where the format has it).  Sequential "last write wins" semantics
become a partial-aggregatable ``max_by`` / ``max(struct)`` per key, so a hot key
costs one partial row per map task, never a skewed sort.  New rows get dense ids
from ``plans.ids.assign_ids`` (range-partitioned, no single-partition window).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_phone, lit_date, status_valid, task_code
from ..plans.ids import assign_ids, materialize, max_id
from ..plans.joins import left_lookup
from ..sources.schemas import ISSUE_STATUSES, SCHEMAS
from ..sources.tables import Tables, conform

# --- fixed values: defaults and templates of the write paths -------------------
DEFAULT_CHARGES = 0
DEFAULT_QUANTITY = 1
DEFAULT_ISSUE_PRIORITY = "normal"
DEFAULT_TASK_STATUS = "Pending"
RESOLUTION_PREFIX = "\n\nRESOLUTION: "
CLOSED_STATUSES = ("Completed", "Cancelled")
# ---------------------------------------------------------------------------


def _truthy(c: Column) -> Column:
    """JavaScript truthiness of a string: not null and not empty."""
    return c.isNotNull() & (c != "")


def _or_default(c: Column, default) -> Column:
    """``value || default`` for strings ('' and NULL fall back)."""
    return F.when(_truthy(c), c).otherwise(F.lit(default))


def _latest(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Per key, the columns of the row with the greatest ``order`` tuple.

    ``max(struct(order..., cols...))`` is an ordinary aggregate: Spark combines it
    map-side, so the shuffle carries one row per key and map task.
    """
    fields = ([F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
              + [F.col(c).alias(f"_c{j}") for j, c in enumerate(cols)])
    packed = F.max(F.struct(*fields)).alias("_m")
    return df.groupBy(key).agg(packed).select(
        key, *[F.col(f"_m._c{j}").alias(c) for j, c in enumerate(cols)])


def _upsert_by_task(current: DataFrame, latest: DataFrame, set_cols: list[str], name: str,
                    insert_order: str = "task_id") -> DataFrame:
    """Rows of ``current`` whose task has a ``latest`` row get ``set_cols`` from it;
    tasks without a current row get a new row with a fresh id."""
    latest = materialize(latest)          # read below for old rows and for new ones
    lat = latest.select("task_id", *[F.col(c).alias(f"_new_{c}") for c in set_cols],
                        F.lit(True).alias("_hit"))
    upd = current.join(lat, "task_id", "left")
    cols = []
    for f in SCHEMAS[name].fields:
        if f.name in set_cols:
            cols.append(F.when(F.col("_hit"), F.col(f"_new_{f.name}")).otherwise(F.col(f.name))
                        .alias(f.name))
        else:
            cols.append(F.col(f.name))
    updated = upd.select(*cols)
    fresh = latest.join(current.select("task_id"), "task_id", "left_anti")
    fresh = assign_ids(fresh, [insert_order], max_id(current))
    return updated.unionByName(conform(fresh, name))


# --- D2-D4: ratings and completions ----------------------------------------------

def valid_ratings(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratings 1..5 pass; NULL, 0 and out-of-range values go to the rejects."""
    ok = F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    return events.filter(ok), events.filter(~ok)


def latest_ratings(ratings: DataFrame, events: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Upsert ratings by task id, last valid event wins (rating, feedback and
    rated_at all come from it)."""
    valid, _ = valid_ratings(events)
    if "feedback" not in valid.columns:
        valid = valid.withColumn("feedback", F.lit(None).cast("string"))
    if tasks is not None:
        valid = valid.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    latest = _latest(valid, "task_id", ["rated_at", "seq"], ["rating", "feedback", "rated_at"])
    return _upsert_by_task(ratings, latest, ["rating", "feedback", "rated_at"], "task_ratings")


def latest_completions(completions: DataFrame, events: DataFrame,
                       tasks: DataFrame | None = None) -> DataFrame:
    """D3: upsert completion details by task id; the last event wins, a missing
    or zero charge becomes 0, completed_at is the event time."""
    if tasks is not None:
        events = events.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    ev = events.withColumn(
        "additional_charges",
        F.coalesce(F.col("additional_charges"), F.lit(DEFAULT_CHARGES)).cast("decimal(10,2)"))
    cols = ["completion_notes", "materials_used", "additional_charges", "completed_at"]
    latest = _latest(ev, "task_id", ["completed_at", "seq"], cols)
    return _upsert_by_task(completions, latest, cols, "task_completions")


# --- D5-D8: task intake --------------------------------------------------------------

def resolve_customers(customers: DataFrame, intake: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find each request's customer by phone, else create one.

    The first request (lowest request id) of an unknown phone creates the
    customer with its name and address; later requests with that phone find it.
    Returns (new customer rows, intake with ``customer_id``).  A request without
    a phone resolves to no customer (the insert would violate NOT NULL).
    """
    known = (customers.filter(F.col("phone").isNotNull())
             .groupBy(F.col("phone").alias("customer_phone"))
             .agg(F.min("id").alias("customer_id")))
    req = intake.filter(F.col("customer_phone").isNotNull())
    firsts = (req.groupBy("customer_phone")
              .agg(F.min(F.struct("request_id", "customer_name", "customer_address",
                                  "requested_at")).alias("_f"))
              .select("customer_phone", F.col("_f.request_id").alias("first_request"),
                      F.col("_f.customer_name").alias("name"),
                      F.col("_f.customer_address").alias("address"),
                      F.col("_f.requested_at").alias("created_at")))
    fresh = firsts.join(known, "customer_phone", "left_anti")
    fresh = assign_ids(fresh, ["first_request"], max_id(customers))
    new_rows = conform(fresh.withColumnRenamed("customer_phone", "phone"), "customers")
    ids = known.unionByName(fresh.select("customer_phone", F.col("id").alias("customer_id")))
    return new_rows, left_lookup(intake, "customer_phone", ids, ["request_id"])


def patch_customers(customers: DataFrame, patches: DataFrame) -> DataFrame:
    """Per column, the latest non-NULL patched value wins (NULL keeps; ''
    overwrites).  A patch whose three values are all empty changes nothing."""
    cols = ["name", "phone", "address"]
    live = patches.filter(_truthy(F.col("name")) | _truthy(F.col("phone")) | _truthy(F.col("address")))
    latest = live.groupBy(F.col("customer_id").alias("id")).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_p_{c}") for c in cols])
    out = customers.join(latest, "id", "left")
    return out.select(*[F.coalesce(F.col(f"_p_{f.name}"), F.col(f.name)).alias(f.name)
                        if f.name in cols else F.col(f.name) for f in SCHEMAS["customers"].fields])


def materials_long_form(payload: DataFrame) -> DataFrame:
    """Turn an array payload ``(task_id, op, materials array<struct<name,
    material_name, quantity>>)`` into the long form used by D7: one row per
    element; an empty list is one row with NULL ``pos`` (it clears); a NULL list
    gives no row (it keeps)."""
    lists = payload.filter(F.col("materials").isNotNull())
    return lists.select("task_id", "op", F.posexplode_outer("materials").alias("pos", "m")).select(
        "task_id", "op", (F.col("pos") + 1).cast("bigint").alias("pos"),
        F.col("m.name").alias("name"), F.col("m.material_name").alias("material_name"),
        F.col("m.quantity").cast("int").alias("quantity"))


def replace_materials(materials: DataFrame, payload: DataFrame, tasks: DataFrame) -> DataFrame:
    """An accepted edit deletes the task's old material rows first, a create
    appends; element defaults: name || material_name on edit, the name alone on
    create, quantity || 1.  (Edits in order, gated by the fold: ``applied.materials_after``.)

    ``payload`` is the long form (see ``materials_long_form``).  Edits of unknown
    or closed (Completed / Cancelled) tasks are refused, as the edit path does.
    """
    open_tasks = tasks.filter(~F.coalesce(F.col("status").isin(*CLOSED_STATUSES), F.lit(False)))
    known = tasks.select(F.col("id").alias("task_id"))
    edits = payload.filter(F.col("op") == "edit").join(
        open_tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    creates = payload.filter(F.col("op") == "create").join(known, "task_id", "left_semi")
    accepted = edits.unionByName(creates)
    cleared = edits.select("task_id").distinct()
    kept = materials.join(cleared, "task_id", "left_anti")
    q = F.col("quantity")
    rows = (accepted.filter(F.col("pos").isNotNull()).select(
        "task_id", "pos",
        F.when((F.col("op") == "edit") & ~F.coalesce(_truthy(F.col("name")), F.lit(False)), F.col("material_name"))
        .otherwise(F.col("name")).alias("material_name"),
        F.when(q.isNull() | (q == 0), F.lit(DEFAULT_QUANTITY)).otherwise(q).cast("int").alias("quantity")))
    rows = assign_ids(rows, ["task_id", "pos"], max_id(materials))
    return kept.unionByName(conform(rows, "task_materials"))


def task_intake(resolved: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New task rows (status Pending) with code 'T' + last six digits of the
    request's epoch milliseconds; returns (new rows, code collisions).

    Requests without a customer are refused.  Collisions count the new codes
    against each other and against the codes already in ``tasks``.
    """
    ok = resolved.filter(F.col("customer_id").isNotNull())
    given = [c for c in ("description", "scheduled_time_start", "scheduled_time_end", "estimated_hours")
             if c in resolved.columns]
    rows = ok.select(
        "request_id", task_code("requested_at").alias("task_code"), "title", *given, "customer_id", "priority",
        F.lit(DEFAULT_TASK_STATUS).alias("status"), "created_by",
        F.lit(None).cast("bigint").alias("assigned_to"), "scheduled_date",
        F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))
    rows = assign_ids(rows, ["request_id"], max_id(tasks))
    new_rows = conform(rows, "tasks")
    codes = new_rows.select("task_code").unionByName(tasks.select("task_code"))
    collisions = (codes.groupBy("task_code").agg(F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") > 1))
    return new_rows, collisions


# --- D9, D10: issues -----------------------------------------------------------------

def accepted_issue_changes(issues: DataFrame, changes: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status changes by managers or admins to existing issues with a valid
    status; returns (accepted, rejected)."""
    staff = users.filter(F.col("role").isin("Manager", "Admin")).select(F.col("id").alias("changed_by"))
    known = issues.select(F.col("id").alias("issue_id"))
    ok_status = changes.filter(F.coalesce(F.col("status").isin(*ISSUE_STATUSES), F.lit(False)))
    accepted = ok_status.join(staff, "changed_by", "left_semi").join(known, "issue_id", "left_semi")
    rejected = changes.join(accepted.select("issue_id", "seq"), ["issue_id", "seq"], "left_anti")
    return accepted, rejected


def resolve_issues(issues: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """Set each issue's status to its last accepted change; resolving changes
    set resolved time and resolver and append ``RESOLUTION: notes`` to the
    description, in change order (NULL description stays NULL, as CONCAT does).

    The appended text is gathered per issue: its size is the issue's own
    resolution history, which the description column carries anyway.
    """
    acc, _ = accepted_issue_changes(issues, changes, users)
    resolving = F.col("status") == "resolved"
    note = F.when(resolving & _truthy(F.col("resolution_notes")),
                  F.struct("changed_at", "seq", "resolution_notes"))
    per = acc.groupBy(F.col("issue_id").alias("id")).agg(
        F.max(F.struct("changed_at", "seq", "status")).getField("status").alias("_status"),
        F.max(F.when(resolving, F.struct("changed_at", "seq", "changed_by"))).alias("_res"),
        F.array_sort(F.collect_list(note)).alias("_notes"))
    appended = F.array_join(F.transform("_notes", lambda n: F.concat(F.lit(RESOLUTION_PREFIX),
                                                                    n["resolution_notes"])), "")
    out = issues.join(per, "id", "left")
    has = F.col("_status").isNotNull()
    repl = {
        "status": F.when(has, F.col("_status")).otherwise(F.col("status")),
        "resolved_at": F.coalesce(F.col("_res.changed_at"), F.col("resolved_at")),
        "resolved_by": F.coalesce(F.col("_res.changed_by"), F.col("resolved_by")),
        "description": F.when(has, F.concat(F.col("description"), appended)).otherwise(F.col("description")),
    }
    return out.select(*[repl.get(f.name, F.col(f.name)).alias(f.name) for f in SCHEMAS["issues"].fields])


def issue_intake(requests: DataFrame, tasks: DataFrame, users: DataFrame,
                 issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accept a report only from a technician who is the task's assignee;
    priority defaults to 'normal'; returns (new issue rows, rejected requests)."""
    techs = users.filter(F.col("role") == "Electrician").select(F.col("id").alias("reported_by"))
    owned = tasks.filter(F.col("assigned_to").isNotNull()).select(
        F.col("id").alias("task_id"), F.col("assigned_to").alias("reported_by"))
    ok = requests.join(techs, "reported_by", "left_semi").join(owned, ["task_id", "reported_by"], "left_semi")
    rejected = requests.join(ok.select("request_id"), "request_id", "left_anti")
    rows = ok.select(
        "request_id", "task_id", "reported_by", "issue_type", "description",
        _or_default(F.col("priority"), DEFAULT_ISSUE_PRIORITY).alias("priority"),
        F.lit("open").alias("status"), "requested_action",
        F.col("requested_at").alias("created_at"))
    rows = assign_ids(rows, ["request_id"], max_id(issues))
    return conform(rows, "issues"), rejected


# --- D11-D16: purges and user changes ---------------------------------------------------

def purge_tasks(T: Tables, ids: DataFrame) -> tuple[Tables, DataFrame]:
    """Delete the listed tasks with their ratings, completions, materials
    and issues; completed (and unknown) tasks are refused.  Returns (new tables,
    refused ids)."""
    req = ids.select("id").distinct()
    doomed = T.tasks.join(req, "id", "left_semi").filter(
        F.coalesce(F.col("status") != "Completed", F.lit(True))).select("id")
    refused = req.join(doomed, "id", "left_anti")
    by_task = doomed.select(F.col("id").alias("task_id"))
    out = T.with_(
        tasks=T.tasks.join(doomed, "id", "left_anti"),
        task_ratings=T.task_ratings.join(by_task, "task_id", "left_anti"),
        task_completions=T.task_completions.join(by_task, "task_id", "left_anti"),
        task_materials=T.task_materials.join(by_task, "task_id", "left_anti"),
        issues=T.issues.join(by_task, "task_id", "left_anti"),
    )
    return out, refused


def toggle_status(users: DataFrame, toggles: DataFrame) -> DataFrame:
    """Each request flips Active <-> Inactive; an even number of flips
    leaves the status as it was.  Unknown ids are ignored."""
    flips = toggles.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    out = users.join(flips, "id", "left")
    odd = F.coalesce(F.col("_n") % 2 == 1, F.lit(False))
    flipped = F.when(F.col("status") == "Active", F.lit("Inactive")).otherwise(F.lit("Active"))
    return out.select(*[F.when(odd, flipped).otherwise(F.col("status")).alias("status")
                        if f.name == "status" else F.col(f.name) for f in SCHEMAS["users"].fields])


def upsert_details(users: DataFrame, details: DataFrame, patches: DataFrame,
                   as_of: _dt.date | str) -> tuple[DataFrame, DataFrame]:
    """The last patch per user sets name, cleaned phone and status (a NULL
    status included); technicians get skills and certifications updated ('' when
    missing), or a new details row joined on ``as_of``.  A patch without a name is
    refused: the column must not be NULL.  Returns (users, details)."""
    latest = _latest(patches.filter("full_name IS NOT NULL"), "user_id", ["seq"],
                     ["full_name", "phone", "status", "skills", "certifications"])
    lat = latest.select(F.col("user_id").alias("id"), F.lit(True).alias("_hit"),
                        *[F.col(c).alias(f"_p_{c}") for c in ("full_name", "phone", "status", "skills",
                                                               "certifications")])
    u = users.join(lat, "id", "left")
    repl = {
        "full_name": F.col("_p_full_name"),
        "phone": clean_phone(F.col("_p_phone")),
        "status": F.col("_p_status"),
    }
    users_out = u.select(*[F.when(F.col("_hit"), repl[f.name]).otherwise(F.col(f.name)).alias(f.name)
                           if f.name in repl else F.col(f.name) for f in SCHEMAS["users"].fields])
    techs = (users.filter(F.col("role") == "Electrician").select("id")
             .join(lat, "id").select(F.col("id").alias("electrician_id"),
                                     _or_default(F.col("_p_skills"), "").alias("_s"),
                                     _or_default(F.col("_p_certifications"), "").alias("_c")))
    d = details.join(techs, "electrician_id", "left")
    hit = F.col("_s").isNotNull()
    updated = d.select(*[F.when(hit, F.col("_s")).otherwise(F.col("skills")).alias("skills")
                         if f.name == "skills" else
                         F.when(hit, F.col("_c")).otherwise(F.col("certifications")).alias("certifications")
                         if f.name == "certifications" else F.col(f.name)
                         for f in SCHEMAS["electrician_details"].fields])
    fresh = techs.join(details.select("electrician_id"), "electrician_id", "left_anti").select(
        "electrician_id", F.col("_s").alias("skills"), F.col("_c").alias("certifications"),
        F.lit(0).cast("decimal(3,2)").alias("rating"), F.lit(0).alias("total_tasks_completed"),
        lit_date(as_of).alias("join_date"))
    return users_out, updated.unionByName(conform(fresh, "electrician_details"))


def mark_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """Mark read where both the id and the owner match a request."""
    hits = reads.select("id", "user_id").distinct().withColumn("_hit", F.lit(True))
    out = notifications.join(hits, ["id", "user_id"], "left")
    return out.select(*[F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("is_read")).alias("is_read")
                        if f.name == "is_read" else F.col(f.name)
                        for f in SCHEMAS["notifications"].fields])


# --- D17: activity log entries ---------------------------------------------------------

# --- fixed values: activity log actions and description templates -----------------
LOG_TEMPLATES = {
    "Task Status Update": "Updated task %s status to %s",   # task id, status
    "Task Completed": "Completed task %s",                  # task id
    "Task Update": "Updated task #%s",                      # task id
    "Task Deletion": "Deleted task %s - %s",                # task code, title
    "Create User": "Created new %s: %s",                    # role, full name
    "Update User": "Updated user: %s",                      # full name
    "Delete User": "Deleted user: %s",                      # full name
    "User Status Update": "User %s",                        # activated / deactivated
    "Password Reset": "Reset password for user: %s",        # full name
    "Login": "User logged in",
}
# ---------------------------------------------------------------------------


def activity_entries(events: DataFrame, action: str, args: list[Column | str],
                     logs: DataFrame, order: list[str]) -> DataFrame:
    """Log rows for a batch of applied changes.

    ``events`` carries ``user_id`` (the actor), ``created_at`` and the template
    arguments; ids continue after the current log in ``order``.
    """
    tmpl = LOG_TEMPLATES[action]
    cols = [F.col(a) if isinstance(a, str) else a for a in args]
    desc = F.format_string(tmpl, *[c.cast("string") for c in cols]) if cols else F.lit(tmpl)
    ip = F.col("ip_address") if "ip_address" in events.columns else F.lit(None).cast("string")
    extra = [c for c in order if c not in ("user_id", "created_at")]
    rows = events.select(*extra, "user_id", F.lit(action).alias("action"), desc.alias("description"),
                         ip.alias("ip_address"), "created_at")
    rows = assign_ids(rows, order, max_id(logs))
    return conform(rows, "activity_logs")


def status_change_log(tasks: DataFrame, changes: DataFrame, logs: DataFrame) -> DataFrame:
    """Log rows of the status path: a valid status for an existing task is
    applied and logged ("Updated task {id} status to {status}")."""
    ok = (changes.filter((F.col("kind") == "status") & status_valid("status"))
          .join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi"))
    actor = next((c for c in ("user_id", "actor_id") if c in ok.columns), None)
    ok = ok.withColumns({"user_id": F.col(actor) if actor else F.lit(None).cast("bigint"), "created_at": F.col("changed_at")})
    return activity_entries(ok, "Task Status Update", ["task_id", "status"], logs,
                            ["created_at", "task_id", "seq"])


# --- D12: off-boarding users -------------------------------------------------------------

def purge_users(T: Tables, ids: DataFrame, acting_user: int) -> tuple[Tables, DataFrame]:
    """Delete users with their details, notifications, logs and the
    completions / ratings of tasks assigned to them; unassign their tasks and
    hand the tasks they created to a surviving admin.

    Refused, in this order: unknown ids; admins once deleting them would leave
    one or no active admin (checked in id order, as one request after another
    would); the acting user; users still named by issues or reports (their keys
    would abort the delete); creators of tasks when no admin survives.
    Returns (new tables, refused ids with a reason).
    """
    from ..plans.ids import prefix_sum

    req = ids.select("id").distinct()
    known = T.users.join(req, "id", "left_semi").select("id", "role", "status")
    unknown = req.join(known, "id", "left_anti").select("id", F.lit("User not found").alias("reason"))
    refs = (T.issues.select(F.col("reported_by").alias("id"))
            .unionByName(T.issues.select(F.col("resolved_by").alias("id")))
            .unionByName(T.reports.select(F.col("generated_by").alias("id")))
            .filter(F.col("id").isNotNull()).distinct().withColumn("_ref", F.lit(True)))
    cand = (known.join(refs, "id", "left")
            .withColumn("_self", F.col("id") == F.lit(acting_user))
            .withColumn("_ref", F.coalesce(F.col("_ref"), F.lit(False))))
    is_admin = F.col("role") == "Admin"
    # last-admin rule: admins in id order; only deletions of active admins
    # lower the count, and eligible ones are deleted while more than one is left
    n_active = T.users.filter(is_admin & (F.col("status") == "Active")).agg(
        F.count(F.lit(1))).scalar()                                        # one-row subquery
    admins = cand.filter(is_admin).withColumn(
        "_elig_active", ((F.col("status") == "Active") & ~F.col("_self") & ~F.col("_ref")).cast("int"))
    admins = prefix_sum(admins, ["id"], "_elig_active", "_before")
    admins = admins.withColumn("_last", (n_active - F.col("_before")) <= 1).select("id", "_last")
    cand = cand.join(admins, "id", "left").withColumn("_last", F.coalesce(F.col("_last"), F.lit(False)))
    reason = (F.when(F.col("_last"), F.lit("Cannot delete the last admin user"))
              .when(F.col("_self"), F.lit("Cannot delete your own account"))
              .when(F.col("_ref"), F.lit("User has associated records in the system")))
    from ..plans.ids import reuse

    decided = reuse(cand.withColumn("reason", reason).select("id", "role", "reason"))
    doomed = decided.filter(F.col("reason").isNull()).select("id")
    # creator hand-over: the smallest surviving admin id
    # one scalar: the heir is read once on the driver to decide whether the
    # (rare) no-heir branch, which needs every task creator, has to run at all
    heir_id = T.users.filter(is_admin).join(doomed, "id", "left_anti").agg(F.min("id")).first()[0]
    heir = F.lit(heir_id).cast("bigint")
    if heir_id is None:
        creators = T.tasks.select(F.col("created_by").alias("id")).distinct()
        orphaned = doomed.join(creators, "id", "left_semi").select(
            "id", F.lit("No other admin to take over created tasks").alias("reason"))
        doomed = reuse(doomed.join(orphaned, "id", "left_anti"))
    else:
        orphaned = doomed.filter(F.lit(False)).select("id", F.lit(None).cast("string").alias("reason"))
    refused = (decided.filter(F.col("reason").isNotNull()).select("id", "reason")
               .unionByName(orphaned).unionByName(unknown))

    gone = doomed.withColumn("_gone", F.lit(True))
    by_assignee = T.tasks.join(doomed.withColumnRenamed("id", "assigned_to"), "assigned_to", "left_semi") \
        .select(F.col("id").alias("task_id"))
    # unassigned tasks have no assignee to look up
    assigned = T.tasks.filter("assigned_to IS NOT NULL").join(
        gone.withColumnRenamed("id", "assigned_to").withColumnRenamed("_gone", "_ga"), "assigned_to", "left")
    tasks = (assigned.unionByName(T.tasks.filter("assigned_to IS NULL").withColumn("_ga", F.lit(None).cast("boolean")))
             .join(gone.withColumnRenamed("id", "created_by").withColumnRenamed("_gone", "_gc"),
                   "created_by", "left"))
    tasks = tasks.select(*[
        F.when(F.col("_ga"), F.lit(None).cast("bigint")).otherwise(F.col("assigned_to")).alias("assigned_to")
        if f.name == "assigned_to" else
        F.when(F.col("_gc"), heir).otherwise(F.col("created_by")).alias("created_by")
        if f.name == "created_by" else F.col(f.name)
        for f in SCHEMAS["tasks"].fields])
    out = T.with_(
        users=T.users.join(doomed, "id", "left_anti"),
        electrician_details=T.electrician_details.join(
            doomed.withColumnRenamed("id", "electrician_id"), "electrician_id", "left_anti"),
        notifications=T.notifications.join(doomed.withColumnRenamed("id", "user_id"), "user_id", "left_anti"),
        task_completions=T.task_completions.join(by_assignee, "task_id", "left_anti"),
        task_ratings=T.task_ratings.join(by_assignee, "task_id", "left_anti"),
        activity_logs=T.activity_logs.join(doomed.withColumnRenamed("id", "user_id"), "user_id", "left_anti"),
        tasks=tasks,
    )
    return out, refused
