"""Mixing sources to target weights: a time-varying curriculum.

Every source has a target number of words (its weight's share of the whole mix,
no more than ``max_repeat`` passes over the source) and a schedule, the weight it
has at each moment t of training (0 to 1, linear between knots).  The integral of
the schedule, scaled to the target, is the source's cumulative demand D(t).  The
documents of a source stand in a fixed pseudo-random order, pass after pass; the
copy whose words begin at offset c is read when the demand reaches its middle, so
its position is the inverse of D at that offset.  Documents are range-sorted by
position.

DataFrame functions only.  The documents of one source are summed in hash buckets
(``common.running_total``), so a source with a third of all rows is spread too;
the only whole-table window is over the directory of sources, a row each.

Defined cases: NULL and empty texts have size 0 and are never taken; a NULL source
is a source of its own, the last; rows with the same id are separate documents;
an empty table gives an empty mix; extra columns of the input are kept by
``curriculum`` whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, order_hash, running_total, word_count

# --- fixed values: the default mix --------------------------------------------
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
#: Weight over time by knots (t, weight): falling, rising, and a hump.
SCHEDULES = (((0.0, 1.0), (1.0, 0.25)), ((0.0, 0.25), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 0.25)))
# ------------------------------------------------------------------------------

Schedule = Sequence[tuple[float, float]]


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source (``_mx_source``, NULL included) of ``sizes`` (with
    ``_mx_source``, ``_mx_size``): index in code-point order, size, target.

    With the sources sorted by cap per weight, those before the water level are
    full (target = cap) and the rest share what is left by weight; the level is
    the largest of the levels tried, so one pass replaces the rounds of resharing.
    """
    per = sizes.groupBy("_mx_source").agg(F.sum("_mx_size").alias("_mx_total"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("_mx_source").asc_nulls_last())
    per = per.withColumn("_mx_index", (F.row_number().over(by_name) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_mx_index") % len(weights) + 1).cast("int"))
    per = (per.withColumn("_mx_w", weight).withColumn("_mx_cap", F.col("_mx_total") * F.lit(float(max_repeat)))
           .withColumn("_mx_all", F.sum("_mx_total").over(every) * F.lit(share)))
    by_cap = every.orderBy(F.col("_mx_cap") / F.col("_mx_w"), "_mx_index")
    full = F.coalesce(F.sum("_mx_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_mx_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_mx_level", (F.col("_mx_all") - full) / left)
    level = F.max("_mx_level").over(every)
    return (per.withColumn("_mx_target", F.least(F.col("_mx_cap"), F.col("_mx_w") * level))
            .select("_mx_source", "_mx_index", "_mx_total", "_mx_target"))


def demand_inverse(u: Column, schedule: Schedule) -> Column:
    """The moment t at which the share ``u`` (0 to 1) of a schedule's integral is
    reached: each stretch between knots is a quadratic solved in closed form."""
    areas = [(t1 - t0) * (v0 + v1) / 2 for (t0, v0), (t1, v1) in zip(schedule, schedule[1:])]
    whole = float(sum(areas))
    out, before = None, 0.0
    for ((t0, v0), (t1, v1)), area in zip(zip(schedule, schedule[1:]), areas):
        part = u * F.lit(whole) - F.lit(before)
        slope = (v1 - v0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(v0 * v0) + F.lit(2 * slope) * part, F.lit(0.0)))
        t = F.lit(float(t0)) + F.lit(2.0) * part / F.greatest(F.lit(float(v0)) + root, F.lit(1e-12))
        t = F.least(F.greatest(t, F.lit(float(t0))), F.lit(float(t1)))
        before += area
        if out is None:
            out = F.when(u * F.lit(whole) <= F.lit(before), t)
        else:
            out = out.when(u * F.lit(whole) <= F.lit(before), t)
    return out.otherwise(F.lit(float(schedule[-1][0])))


def curriculum_plan(docs: DataFrame, sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                    max_repeat: int = MAX_REPEAT, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """``docs`` (any columns, with ``_mx_id``, ``_mx_source``, ``_mx_size``) plus
    ``_mx_total``, ``_mx_target`` (both of the source), ``_mx_positions`` (one
    position per copy taken, in order) and ``_mx_taken`` words.

    ``sizes`` has the same rows' ``_mx_source`` and ``_mx_size`` and is read for
    the sums.  A copy is taken when its middle lies before the target, so a
    source misses its target by half a document at most.
    """
    targets = source_targets(sizes, weights, share, max_repeat)
    rows = (docs.withColumn("_mx_hash", order_hash(F.col("_mx_id"), salt="mix:"))
            # a NULL source joins as its own value; its rank is the key from here on
            .join(targets.withColumnRenamed("_mx_source", "_mx_name"),
                  F.col("_mx_source").eqNullSafe(F.col("_mx_name"))).drop("_mx_name"))
    rows = running_total(rows, ["_mx_index"], "_mx_hash", ["_mx_id", "_mx_size"], "_mx_size", "_mx_before",
                         rows=sizes.count())
    passes = F.sequence(F.lit(0), F.lit(max_repeat - 1))
    half = F.col("_mx_size") / F.lit(2.0)
    middles = F.transform(passes, lambda p: p * F.col("_mx_total") + F.col("_mx_before") + half)
    middles = F.filter(middles, lambda m: (F.col("_mx_size") > 0) & (m <= F.col("_mx_target")))
    rows = rows.withColumn("_mx_middles", middles)

    def place(m: Column) -> Column:
        u = m / F.col("_mx_target")
        chosen = F.col("_mx_index") % len(schedules)
        out = F.when(chosen == 0, demand_inverse(u, schedules[0]))
        for k, s in enumerate(schedules[1:], 1):
            out = out.when(chosen == k, demand_inverse(u, s))
        return out

    return (rows.withColumn("_mx_positions", F.transform("_mx_middles", place))
            .withColumn("_mx_taken", (F.size("_mx_middles") * F.col("_mx_size")).cast("bigint"))
            .drop("_mx_hash", "_mx_before", "_mx_middles"))


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return (docs.withColumn("_mx_id", F.col(id_col)).withColumn("_mx_source", F.col(source_col).cast("string"))
            .withColumn("_mx_size", word_count(F.col(text_col))))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **mix) -> DataFrame:
    """The documents of the mix in training order: the rows of ``docs`` with their
    own columns, once per copy taken, range-sorted by position."""
    rows = prepared(docs, id_col, text_col, source_col)
    sizes = materialize(rows.select("_mx_source", "_mx_size"), "mix-sizes")
    plan = curriculum_plan(rows, sizes, **mix)
    out = plan.withColumn("_mx_at", F.explode("_mx_positions"))
    return out.orderBy("_mx_at", "_mx_id").select(*docs.columns)


def mixing_report(docs: DataFrame, **mix) -> DataFrame:
    """Per document: size, source size and target, words taken, first position."""
    rows = materialize(prepared(docs).select("_mx_id", "_mx_source", "_mx_size"), "mix-rows")
    plan = curriculum_plan(rows, rows, **mix)
    return plan.select(F.col("_mx_id").alias("doc_id"), F.col("_mx_size").alias("size"),
                       F.col("_mx_total").alias("source_size"), F.col("_mx_target").alias("target"),
                       F.col("_mx_taken").alias("taken"),
                       F.get("_mx_positions", F.lit(0)).alias("position")).orderBy("position", "doc_id")


#: DuckDB twin of ``mixing_report``: the resharing is done round by round here.
MIXING_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS total FROM docs GROUP BY source
), src AS (
  SELECT source, total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM per
), weighted AS (
  SELECT *, CASE idx % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w,
         total * 2.0::DOUBLE AS cap, 1.5::DOUBLE * (SELECT sum(total) FROM src) AS whole
  FROM src
), fill AS (
  SELECT idx, w, cap, whole, false AS full_, 0 AS round FROM weighted
  UNION ALL
  SELECT idx, w, cap, whole, full_ OR cap / w <= (whole - spent) / nullif(open_w, 0), round + 1
  FROM (SELECT *, coalesce(sum(cap) FILTER (WHERE full_) OVER (), 0) AS spent,
               sum(w) FILTER (WHERE NOT full_) OVER () AS open_w FROM fill) f
  WHERE round <= (SELECT count(*) FROM src)
), last AS (
  SELECT *, coalesce(sum(cap) FILTER (WHERE full_) OVER (), 0) AS spent, sum(w) FILTER (WHERE NOT full_) OVER () AS open_w
  FROM fill WHERE round = (SELECT max(round) FROM fill)
), tgt AS (
  SELECT s.source, s.idx, s.total, CASE WHEN l.full_ THEN l.cap ELSE l.w * ((l.whole - l.spent) / l.open_w) END AS target
  FROM src s JOIN last l USING (idx)
), placed AS (
  SELECT d.doc_id, d.size, t.total, t.target, t.idx,
         coalesce(sum(d.size) OVER (PARTITION BY t.idx ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, before + size / 2.0::DOUBLE AS m0, CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END
       + CASE WHEN size > 0 AND total + before + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END AS n
  FROM placed
)
SELECT doc_id, size::BIGINT AS size, total AS source_size, target, (n * size)::BIGINT AS taken,
  CASE WHEN n > 0 THEN CASE idx % 3
    WHEN 0 THEN 2 * (m0 / target * 0.625) / (1.0 + sqrt(1.0 - 1.5 * (m0 / target * 0.625)))
    WHEN 1 THEN 2 * (m0 / target * 0.625) / (0.25 + sqrt(0.0625 + 1.5 * (m0 / target * 0.625)))
    ELSE CASE WHEN m0 / target * 0.625 <= 0.3125
      THEN 2 * (m0 / target * 0.625) / (0.25 + sqrt(0.0625 + 3.0 * (m0 / target * 0.625)))
      ELSE 0.5 + 2 * (m0 / target * 0.625 - 0.3125) / (1.0 + sqrt(1.0 - 3.0 * (m0 / target * 0.625 - 0.3125))) END
  END END AS position
FROM copies
"""
