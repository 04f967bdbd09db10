"""New users, one request after another, without a pass per request.

A request is refused when it lacks a column that must not be NULL, or when its e-mail,
username or (a technician's) employee code is taken: by an existing user, or by an earlier accepted
request of the batch.  Keys compare without regard to case, as the tables' collation does.

Whether an earlier request is accepted depends on requests before it, so the rule is
sequential, but only among requests that are linked by keys:

* requests with a taken key are refused by a join;
* requests that are the first for each of their keys are accepted, those that share a key
  with one of them are refused; this settles nearly all, a key that very many
  requests share among them;
* the rest are grouped into components over shared keys (``plans.components``).  Each is decided in request order by a
  stream over its sorted rows, which remembers the keys taken in that component.

So the number of jobs depends on the logarithm of the batch and not on the longest chain of
requests that compete for keys.

Defined cases: a NULL employee code, or one of somebody else than a technician, is no key;
``created_at`` is the request's ``requested_at`` where the batch has it, else ``as_of``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lit_date
from ..plans.components import components
from ..plans.ids import assign_ids, materialize, max_id
from ..sources.tables import conform

REQUIRED = ("username", "email", "full_name", "role")


def _key(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), F.lower(value))


def _code() -> Column:
    is_key = (F.col("role") == "Electrician") & F.col("employee_code").isNotNull() & (F.col("employee_code") != "")
    return F.when(is_key, F.col("employee_code"))


def _decided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accepted ids of rows sorted by component and request."""
    here, taken = None, set()
    for batch in batches:
        ok = []
        for root, request, keys in zip(*(c.to_pylist() for c in batch.columns)):
            if root != here:
                here, taken = root, set()
            if taken.isdisjoint(keys):
                taken.update(keys)
                ok.append(request)
        yield pa.RecordBatch.from_arrays([pa.array(ok, pa.int64())], names=["request_id"])


def accepted_requests(users: DataFrame, details: DataFrame | None, requests: DataFrame) -> DataFrame:
    """``request_id`` of the accepted ones."""
    keys = F.array_compact(F.array(_key("email", F.col("email")), _key("name", F.col("username")), _key("code", _code())))
    whole = requests.filter(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))
    wanted = materialize(whole.select("request_id", keys.alias("keys")))
    taken = users.select(F.explode(F.array(_key("email", F.col("email")), _key("name", F.col("username")))).alias("k"))
    if details is not None:
        taken = taken.unionByName(details.select(_key("code", F.col("employee_code")).alias("k")))
    each = wanted.select("request_id", F.explode("keys").alias("k"))
    late = each.join(taken, "k", "left_semi").select("request_id").distinct()
    live = materialize(wanted.join(late, "request_id", "left_anti"))

    each = live.select("request_id", F.explode("keys").alias("k"))
    first = each.groupBy("k").agg(F.min("request_id").alias("first"))
    placed = each.join(first, "k")
    leading = materialize(placed.groupBy("request_id").agg(F.max(F.col("first") != F.col("request_id")).alias("behind"))
                          .filter("NOT behind").select("request_id"))
    their_keys = each.join(leading, "request_id", "left_semi").select("k")
    beaten = each.join(their_keys, "k", "left_semi").select("request_id").distinct()     # the leading ones too
    rest = materialize(live.join(beaten, "request_id", "left_anti"))

    each = rest.select("request_id", F.explode("keys").alias("k"))
    first = each.groupBy("k").agg(F.min("request_id").alias("b"))
    roots = components(each.withColumnRenamed("request_id", "a").join(first, "k").select("a", "b"))
    linked = rest.join(roots.withColumnRenamed("node", "request_id"), "request_id", "left")
    linked = linked.select(F.coalesce("root", "request_id").alias("root"), "request_id", "keys")
    decided = (linked.repartition("root").sortWithinPartitions("root", "request_id")
               .mapInArrow(_decided, "request_id bigint"))
    return materialize(leading.unionByName(decided))


def user_intake(users: DataFrame, requests: DataFrame, as_of: _dt.date | str,
                details: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new users, new technician details, refused requests)."""
    accepted = accepted_requests(users, details, requests)
    refused = requests.join(accepted, "request_id", "left_anti")
    day = lit_date(as_of).cast("timestamp_ntz")
    at = F.coalesce(F.col("requested_at"), day) if "requested_at" in requests.columns else day
    rows = requests.join(accepted, "request_id", "left_semi").withColumns({"status": F.lit("Active"), "created_at": at})
    rows = assign_ids(rows, ["request_id"], max_id(users))
    made = rows.filter(_code().isNotNull()).select(
        F.col("id").alias("electrician_id"), "employee_code", "skills", "certifications",
        F.lit(0).cast("decimal(3,2)").alias("rating"), F.lit(0).alias("total_tasks_completed"),
        lit_date(as_of).alias("join_date"))
    return conform(rows, "users"), conform(made, "electrician_details"), refused
