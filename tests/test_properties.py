"""Property checks: the distributed operators against plain sequential Python
on random small inputs (SURVEY §5.3)."""
import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirework.operators import changes, stats
from wirework.operators.task_changes import apply_task_changes, decide
from wirework.operators.user_intake import user_intake
from wirework.plans.components import components
from wirework.plans.ids import assign_ids, chunk_of, positioned, prefix_sum
from wirework.sources.schemas import SCHEMAS, TASK_STATUSES

TS = dt.datetime
TECHS = {10: ("Electrician", "Active"), 11: ("Electrician", "Active"), 12: ("Electrician", "Inactive"),
         13: ("Manager", "Active")}
SETTINGS = settings(max_examples=12, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


LOAD = ["title", "description", "priority", "scheduled_date", "scheduled_time_start", "scheduled_time_end", "estimated_hours"]


def py_fold(tasks, chs):
    """The task change paths applied one request after another."""
    state = {t["id"]: dict(t) for t in tasks}
    rejects, notes, done = set(), set(), set()
    active = {u for u, (r, s) in TECHS.items() if r == "Electrician" and s == "Active"}
    for c in sorted(chs, key=lambda c: (c["changed_at"], c["seq"])):
        tid, k, s, at = c["task_id"], c["kind"], c["status"], c["changed_at"]
        t = state.get(tid)
        key = (tid, c["seq"])
        old = dict(t or {})
        if k == "assign":
            if c["assigned_to"] not in active:
                rejects.add(key + ("invalid or inactive electrician",))
                continue
            notes.add((c["assigned_to"], "New Task Assigned", tid, c["seq"]))
            if t:
                t.update(status="Assigned", assigned_to=c["assigned_to"])
        elif k == "status":
            if s not in TASK_STATUSES:
                rejects.add(key + ("invalid status value",))
                continue
            elif t is None:
                rejects.add(key + ("task not found",))
            else:
                t.update(status=s)
                if s == "In Progress":
                    t["actual_start_time"] = at
                elif s == "Completed":
                    t["actual_end_time"] = at
        elif k == "edit":
            if not c["title"] or c["priority"] not in ("High", "Medium", "Low") or c["scheduled_date"] is None or c["estimated_hours"] is None:
                rejects.add(key + ("validation failed",))
                continue
            elif t is None:
                rejects.add(key + ("task not found",))
            elif t["status"] in ("Completed", "Cancelled"):
                rejects.add(key + (f"cannot update {t['status'].lower()} tasks",))
                continue
            elif s and s not in TASK_STATUSES:
                rejects.add(key + ("invalid status value",))
                continue
            else:
                t.update({x: c[x] for x in LOAD})
                if s and s != t["status"]:
                    if s == "Pending" and t["assigned_to"] is not None:
                        notes.add((t["assigned_to"], "Task Reassignment", tid, c["seq"]))
                        t["assigned_to"] = None
                    t["status"] = s
                    if s == "In Progress":
                        t["actual_start_time"] = at
                    elif s == "Completed":
                        t["actual_end_time"] = at
        elif k == "complete":
            if t is None:
                rejects.add(key + ("task not found",))
            elif c["actor_role"] == "Electrician" and c["actor_id"] != t["assigned_to"]:
                rejects.add(key + ("not assigned to this task",))
                continue
            else:
                t.update(status="Completed", actual_end_time=at)
        else:
            rejects.add(key + ("unknown change kind",))
            continue
        if t:
            done.add(key)
            if t != old:
                t["updated_at"] = at
    return state, rejects, notes, done


status_st = st.sampled_from(TASK_STATUSES + ["", None, "Weird"])
task_st = st.builds(lambda i, s, a: dict(id=i, status=s, assigned_to=a),
                    st.just(0), st.sampled_from(TASK_STATUSES + [None]), st.sampled_from([None, 10, 11, 12]))
change_st = st.fixed_dictionaries(dict(
    task_id=st.sampled_from([1, 1, 1, 1, 2, 3, 4, 5, None]), kind=st.sampled_from(["assign", "status", "edit", "edit", "complete", "complete", "bogus", None]),
    status=status_st, assigned_to=st.sampled_from([None, 10, 11, 12, 13]), t=st.integers(0, 6),
    actor_id=st.sampled_from([10, 10, 11, 13, None]), actor_role=st.sampled_from(["Electrician", "Electrician", "Manager", None]),
    title=st.sampled_from(["x", "y", "x", ""]), description=st.sampled_from([None, "d"]), priority=st.sampled_from(["High", "Medium", "High", "Urgent"])))
CHANGES = StructType([f for f in SCHEMAS["task_changes"].fields if f.name in SCHEMAS["task_changes"].names[:15]])


@pytest.mark.parametrize("chunk_rows", [1_000_000, 3])
@settings(SETTINGS, max_examples=6)
@given(init=st.lists(task_st, min_size=4, max_size=4), raw=st.lists(change_st, min_size=1, max_size=45))
def test_fold_matches_sequential_python(spark, chunk_rows, init, raw):
    """Refusals that depend on each other, and (chunk_rows 3) tasks cut into chunks."""
    base = TS(2024, 1, 1)
    tasks = []
    for i, t in enumerate(init, start=1):
        tasks.append(dict(id=i, status=t["status"], assigned_to=t["assigned_to"], actual_start_time=None, actual_end_time=None, updated_at=base,
                          title="x", description=None, priority="Medium", scheduled_date=dt.date(2024, 1, 1), scheduled_time_start=None,
                          scheduled_time_end=None, estimated_hours=Decimal("1.00")))
    chs = [dict(c, changed_at=base + dt.timedelta(hours=1 + c["t"]), seq=n, scheduled_date=None if n % 17 == 0 else dt.date(2024, 1, 1),
                scheduled_time_start=None, scheduled_time_end=None, estimated_hours=Decimal("1.00")) for n, c in enumerate(raw)]
    users = spark.createDataFrame(
        [(u, f"u{u}", None, None, "n", None, r, s, None, None) for u, (r, s) in TECHS.items()],
        SCHEMAS["users"])
    tdf = spark.createDataFrame([tuple(dict(t, task_code="T", created_by=1, created_at=base).get(c) for c in SCHEMAS["tasks"].names)
                                 for t in tasks], SCHEMAS["tasks"])
    cdf = spark.createDataFrame([tuple(c[f] for f in CHANGES.names) for c in chs], CHANGES)
    want, want_rej, want_notes, want_done = py_fold(tasks, chs)
    decisions = decide(tdf, cdf, users, chunk_rows)
    new, rej, notes = apply_task_changes(tdf, cdf, users, decisions)
    got = {r.id: r.asDict() for r in new.collect()}
    for tid, w in want.items():
        assert {c: got[tid][c] for c in w} == w
    assert {(r.task_id, r.seq, r.reason) for r in rej.collect()} == want_rej
    assert {(r.user_id, r.title, r.task_id, r.seq) for r in notes.collect()} == want_notes
    assert {(r.task_id, r.seq) for r in decisions.filter("applied").collect()} == want_done
    assert decisions.count() == len(chs)


def test_a_chain_of_refusals_needs_no_passes(spark):
    """Each complete's refusal decides the next edit; one task, many chunks."""
    base = TS(2024, 1, 1)
    users = spark.createDataFrame([(u, f"u{u}", None, None, "n", None, r, s, None, None) for u, (r, s) in TECHS.items()], SCHEMAS["users"])
    tasks = spark.createDataFrame([tuple({"id": 1, "status": "Assigned", "assigned_to": 10, "created_by": 1, "updated_at": base}.get(c)
                                         for c in SCHEMAS["tasks"].names)], SCHEMAS["tasks"])
    rows = []
    for n in range(400):
        kind = ("complete", "status", "edit", "complete", "assign", "edit", "complete")[n % 7]
        rows.append((1, base + dt.timedelta(minutes=n), n, kind, ("In Progress", "Pending", "Cancelled")[n % 3], 10 + n % 2, 10 + n % 3, "Electrician"))
    cdf = spark.createDataFrame(rows, StructType(CHANGES.fields[:8]))
    jobs = []
    for chunk_rows in (1_000_000, 20):
        decisions = decide(tasks, cdf, users, chunk_rows)
        jobs.append(sorted((r.seq, r.applied, r.reason, r.out_status, r.out_assignee, r.out_start, r.out_end, r.moves) for r in decisions.collect()))
    assert jobs[0] == jobs[1] and len({r[2] for r in jobs[0]}) >= 3


def py_intake(taken, reqs):
    taken, ok = set(taken), []
    for rid, *keys in sorted(reqs):
        keys = {(n, k.lower()) for n, k in enumerate(keys) if k}
        if len(keys) >= 2 and (0, "") not in keys and not keys & taken:
            taken |= keys
            ok.append(rid)
    return ok


@settings(SETTINGS, max_examples=5)
@given(st.lists(st.tuples(st.sampled_from("abcdeABC"), st.sampled_from("vwxyzVW"), st.sampled_from([None, "", "k1", "K1", "k2", "k3", "k4"])),
                min_size=1, max_size=40))
def test_user_intake_matches_sequential(spark, triples):
    reqs = [(i + 1, *t) for i, t in enumerate(triples)]
    users = spark.createDataFrame([(1, "v", "a", None, "n", None, "Manager", "Active", None, None)], SCHEMAS["users"])
    details = spark.createDataFrame([(1, "K4", None, None, None, None, None)], SCHEMAS["electrician_details"])
    rdf = spark.createDataFrame([(r, u, e, "Name", "0771234567", "Electrician", c, None, None, None) for r, e, u, c in reqs], SCHEMAS["user_requests"])
    new, made, refused = user_intake(users, rdf, "2024-01-01", details)
    want = py_intake({(0, "a"), (1, "v"), (2, "k4")}, reqs)
    by_req = {r: (e, u, c) for r, e, u, c in reqs}
    got = new.orderBy("id").collect()
    assert [(r.id, r.email, r.username) for r in got] == [(n + 2, *by_req[r][:2]) for n, r in enumerate(want)]
    assert all(r.created_at == TS(2024, 1, 1) for r in got)
    assert sorted(r.employee_code for r in made.collect()) == sorted(by_req[r][2] for r in want if by_req[r][2])
    assert refused.count() == len(reqs) - len(want)


def test_a_long_chain_of_requests_needs_few_rounds(spark, monkeypatch):
    """Each request shares a key with the next; and one e-mail in most requests."""
    from wirework.plans import components as C

    rounds, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: rounds.append(1) or write(df))
    n = 300
    chain = [(k + 2, f"e{k // 2}", f"u{(k + 1) // 2}", None) for k in range(n)]
    late = [(n + 2 + k, "same", f"x{k}", None) for k in range(100)]
    reqs = [(1, "e0", "u9999", None), *chain, *late]
    users = spark.createDataFrame([], SCHEMAS["users"])
    rdf = spark.createDataFrame([(r, u, e, "Name", None, "Manager", c, None, None, None) for r, e, u, c in reqs], SCHEMAS["user_requests"])
    new, _, _ = user_intake(users, rdf, "2024-01-01")
    want = py_intake(set(), reqs)
    assert sorted(r.email + r.username for r in new.collect()) == sorted(e + u for r, e, u, _ in reqs if r in want)
    assert len(rounds) < 14


def test_components_of_a_path_and_a_star(spark):
    links = [(n, n + 1) for n in range(100, 160)] + [(5, n) for n in range(6, 30)] + [(200, 300), (300, 250), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {**{n: 100 for n in range(100, 161)}, **{n: 5 for n in range(5, 30)}, 200: 200, 300: 200, 250: 200}
    assert got == want


@SETTINGS
@given(st.lists(st.integers(-10**6, 10**6), min_size=1, max_size=60, unique=True), st.integers(0, 50))
def test_assign_ids_dense_in_key_order(spark, keys, start):
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, w long")
    out = sorted((r.k, r.id) for r in assign_ids(df, ["k"], start, buckets=5).collect())
    assert [i for _, i in out] == list(range(start + 1, start + 1 + len(keys)))
    ps = {r.k: r.before for r in prefix_sum(df, ["k"], "w", "before", buckets=5).collect()}
    acc = 0
    for k in sorted(keys):
        assert ps[k] == acc
        acc += k % 3


def test_ids_of_uneven_keys_are_cut_evenly(spark):
    """An outlier, and all rows of one first column: no chunk above twice the mean."""
    rows = [(0 if n < 1000 else 10**12, n) for n in range(1001)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(4)
    chunks = positioned(df, ["k", "n"], 5).groupBy(chunk_of("_pos").alias("b")).count().collect()
    assert len(chunks) == 5 and max(r["count"] for r in chunks) <= 2 * 1001 / 5
    assert sorted((r.k, r.n, r.id) for r in assign_ids(df, ["k", "n"], 7, buckets=5).collect()) == [(k, n, 8 + n) for k, n in rows]


def test_daily_summary_adds_up_to_tasks_by_status(T):
    s = stats.daily_summary(T).agg(F.sum("total_tasks").alias("n")).first().n
    b = stats.tasks_by_status(T).agg(F.sum("count").alias("n")).first().n
    assert s == b == T.tasks.filter(F.col("scheduled_date").isNotNull()).count()


def test_purges_leave_no_dangling_task_keys(spark, T):
    from wirework.operators import quality

    out, refused = changes.purge_tasks(T, T.tasks.select("id"))
    assert out.tasks.filter(F.col("status") != "Completed").count() == 0
    before = {(r.table_name, r.rule, r.column_name): r.violations for r in quality.check_keys(T).collect()}
    after = {(r.table_name, r.rule, r.column_name): r.violations for r in quality.check_keys(out).collect()}
    for child in ("task_materials", "task_completions", "task_ratings", "issues"):
        assert after[(child, "foreign_key", "task_id")] <= before[(child, "foreign_key", "task_id")]
