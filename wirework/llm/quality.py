"""Quality rules with risk-controlled cutoffs.

Base metrics of a text decide at once about fragments and repetitive texts.  The
other rules compare a ratio with a cutoff that is not set by hand: labelled
documents are the holdout, and for each stratum (the language) and rule a fixed
sequence of cutoffs, mildest first, is tested.  A cutoff is certified when the
exact binomial (Clopper-Pearson) upper bound of its false rejections among good
documents is within the budget at the corrected confidence level; the sequence
ends at the first cutoff that fails.  Testing in a fixed order needs no correction
along the sequence; strata and rules share the error probability equally
(Bonferroni), and the rules of a stratum share its false-rejection budget, so with
probability 1 - ``delta`` every stratum loses at most ``alpha`` of its good
documents to these rules.  Of the certified cutoffs the one that separates bad
from good best is used (ties: the milder); a rule that separates nothing, or a
stratum with too few labels, rejects nothing.

DataFrame functions only.  Words of a text stay in its row, metrics are written
once as a narrow table, and labels, holdout counts and cutoffs are aggregates.

Defined cases: a NULL or empty text has no words (base_failed, not kept); a NULL
language is a stratum; labels with NULL quality or document are ignored, and a
document labelled more than once is good only if every label says so; repeated
rows are judged each; without labels only the base rules apply; extra columns of
the input are never read by name clash (metrics carry their own prefix).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, materialize

# --- fixed values ---------------------------------------------------------------
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
NGRAM = 5
ALPHA = 0.02
DELTA = 0.05
#: A good document's wrong rejection weighs as much as this many bad ones caught.
GOOD_WEIGHT = 10.0
MOST_BROADCAST = 10_000
#: Rules: the ratio (numerator, denominator) and its cutoffs, mildest first.  A
#: document is rejected when the ratio reaches the cutoff.
RULES = (
    ("symbols", "n_symbols", "n_words", (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("dup_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    ("repeats", "n_repeat_words", "n_words", (0.19, 0.17, 0.15, 0.125, 0.1)),
)
# --------------------------------------------------------------------------------


def with_metrics(df: DataFrame, text_col: str = "text", prefix: str = "_qr_") -> DataFrame:
    """Add the base metrics of a text, columns named with ``prefix``.

    Five-word windows of a text are compared by a 64-bit hash of their words, so
    two different windows of one text count as equal with probability 2**-64.
    """
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn(p + "words", F.filter(F.split(text, GAP), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn(p + "line", lines)
    words, n = F.col(p + "words"), F.size(p + "words")

    def window_hash(w: Column, i: Column) -> Column:
        return F.xxhash64(w, *[F.get(words, i + k) for k in range(1, NGRAM)])

    out = out.withColumn(p + "hash", F.when(
        n >= NGRAM, F.transform(F.slice(words, F.lit(1), F.greatest(n - NGRAM + 1, F.lit(0))), window_hash)))
    hashes = F.col(p + "hash")
    # only texts that repeat a window sort their windows
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(p + "pairs", F.when(repeats, pairs))
    sorted_ = F.col(p + "pairs")

    def repeated(e: Column, k: Column) -> Column:
        same = (F.get(sorted_, k - 1)["h"] == e["h"]) | (F.get(sorted_, k + 1)["h"] == e["h"])
        return F.when(same, e["i"])

    out = out.withColumn(p + "starts", F.sort_array(F.array_compact(F.transform(sorted_, repeated))))
    starts = F.col(p + "starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.lit(NGRAM), F.coalesce(F.get(starts, k + 1) - s, F.lit(NGRAM)))),
        F.lit(0), lambda a, x: a + x)
    chars = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    gaps = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    return (out.withColumn(p + "n_words", n.cast("bigint"))
            .withColumn(p + "word_chars", gaps.cast("bigint"))
            .withColumn(p + "n_symbols", chars.cast("bigint"))
            .withColumn(p + "n_lines", F.size(p + "line").cast("bigint"))
            .withColumn(p + "n_dup_lines", (F.size(p + "line") - F.size(F.array_distinct(p + "line"))).cast("bigint"))
            .withColumn(p + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
            .drop(*[p + c for c in ("words", "line", "hash", "pairs", "starts")]))


def base_failed(prefix: str = "_qr_") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def most_false_rejections(holdout: DataFrame, alpha: float, delta: Column) -> DataFrame:
    """For each row of ``holdout`` (stratum, n good documents): the largest k with
    P(Binomial(n, alpha) <= k) <= delta, -1 if there is none.

    k false rejections out of n certify a rate of at most alpha exactly when
    that probability is at most delta (the Clopper-Pearson bound turned round).
    The probabilities are running sums over k from 0 to n * alpha.
    """
    log_p, log_q = math.log(alpha), math.log1p(-alpha)
    ks = holdout.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") * alpha))))
    up_to = Window.partitionBy("stratum").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.log((F.col("n") - F.col("k") + 1) / F.col("k")))
    pmf = F.exp(F.sum(step).over(up_to) + F.col("k") * log_p + (F.col("n") - F.col("k")) * log_q)
    tails = ks.withColumn("pmf", pmf).withColumn("tail", F.sum("pmf").over(up_to))
    return tails.groupBy("stratum").agg(
        F.max("n").alias("n"), F.coalesce(F.max(F.when(F.col("tail") <= delta, F.col("k"))), F.lit(-1)).alias("k_max"))


def good_labels(labels: DataFrame) -> DataFrame:
    return (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
            .groupBy(F.col("doc_id").alias("_ql_id")).agg(F.min("quality").alias("_ql_good")))


def cutoffs(metrics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
            prefix: str = "_qr_") -> DataFrame:
    """One row per stratum with a certified cutoff: ``stratum`` and a column
    ``cut_<rule>`` each (NULL: the rule rejects nothing there).

    ``metrics`` has ``_qr_id``, ``_qr_stratum`` and the base metrics.
    """
    held = (metrics.filter(~base_failed(prefix))
            .join(good_labels(labels), F.col(prefix + "id") == F.col("_ql_id"))
            .withColumn("stratum", F.col(prefix + "stratum")))
    good, bad = F.col("_ql_good") == 1, F.col("_ql_good") == 0
    counts = [F.count_if(good).alias("n"), F.count_if(bad).alias("n_bad")]
    ratios = {name: F.try_divide(prefix + num, prefix + den) for name, num, den, _ in RULES}
    for name, _, _, cuts in RULES:
        for i, c in enumerate(cuts):
            counts += [F.count_if(good & (ratios[name] >= c)).alias(f"g_{name}_{i}"),
                       F.count_if(bad & (ratios[name] >= c)).alias(f"b_{name}_{i}")]
    per = held.groupBy("stratum").agg(*counts)
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    sized = per.select("stratum", "n").withColumn("level", F.lit(delta) / (strata * len(RULES)))
    allowed = most_false_rejections(sized, alpha / len(RULES), F.col("level")).select(
        F.col("stratum").alias("s"), "k_max")
    out = per.join(allowed, per["stratum"] == F.col("s"))
    for name, _, _, cuts in RULES:
        steps = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"g_{name}_{i}").alias("g"),
                                   F.col(f"b_{name}_{i}").alias("b")) for i, c in enumerate(cuts)])
        # false rejections grow along the sequence, so the certified cutoffs are its start
        gain = F.transform(F.filter(steps, lambda s: s["g"] <= F.col("k_max")), lambda s, i: F.struct(
            (s["b"] / F.greatest(F.col("n_bad"), F.lit(1)) - GOOD_WEIGHT * s["g"] / F.greatest(F.col("n"), F.lit(1))).alias("gain"),
            (-i).alias("mild"), s["cut"].alias("cut")))
        best = F.array_max(gain)
        out = out.withColumn(f"cut_{name}", F.when(best["gain"] > 0, best["cut"]))
    return out.select("stratum", *[f"cut_{r[0]}" for r in RULES])


def bounded(cuts: DataFrame) -> DataFrame:
    """A broadcast of the cutoffs (a narrow row per stratum) if they are few, so that
    a frequent stratum is not dealt to one task; many strata are joined by shuffle."""
    return F.broadcast(cuts) if cuts.count() <= MOST_BROADCAST else cuts


def verdicts(metrics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
             prefix: str = "_qr_") -> DataFrame:
    """``metrics`` plus ``_qr_base_failed`` and ``_qr_kept``."""
    cuts = bounded(materialize(cutoffs(metrics, labels, alpha, delta, prefix), "quality-cutoffs"))
    out = metrics.join(cuts, F.col(prefix + "stratum") == F.col("stratum"), "left")
    rejected = F.lit(False)
    for name, num, den, _ in RULES:
        rejected = rejected | F.coalesce(F.try_divide(prefix + num, prefix + den) >= F.col(f"cut_{name}"), F.lit(False))
    return (out.withColumn(prefix + "base_failed", base_failed(prefix))
            .withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & ~rejected)
            .drop("stratum", *[f"cut_{r[0]}" for r in RULES]))


def _narrow(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("_qr_id"),
                       F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("_qr_stratum"),
                       F.col("text").alias("_qr_text"))
    return with_metrics(rows, "_qr_text").drop("_qr_text")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the base metrics, ``base_failed`` and ``kept``."""
    m = verdicts(materialize(_narrow(docs), "quality-metrics"), labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return m.select(F.col("_qr_id").alias("doc_id"), *[F.col("_qr_" + c).alias(c) for c in names])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    The cutoffs come from a narrow table; the documents get their metrics in
    the scan that returns them, so no text is shuffled."""
    cuts = materialize(cutoffs(materialize(_narrow(docs), "quality-metrics"), labels), "quality-cutoffs")
    marked = docs.withColumn("_qr_stratum", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")))
    # a filter that names a column that isn't a function of the row stays above the
    # metrics; pushed below, it would compute each of them again for every use
    marked = with_metrics(marked).withColumn("_qr_row", F.monotonically_increasing_id())
    named = cuts.select(F.col("stratum").alias("_qr_s"), *[F.col(f"cut_{r[0]}").alias(f"_qr_cut_{r[0]}") for r in RULES])
    out = marked.join(bounded(named), F.col("_qr_stratum") == F.col("_qr_s"), "left")
    good = ~base_failed() & (F.col("_qr_row") >= 0)
    for name, num, den, _ in RULES:
        good = good & F.coalesce(F.try_divide("_qr_" + num, "_qr_" + den) < F.col(f"_qr_cut_{name}"), F.lit(True))
    return out.filter(good).select(*docs.columns)


def _sql() -> str:
    counts = ",\n    ".join(
        f"count(*) FILTER (WHERE good = 1 AND {num}::DOUBLE / {den} >= {c}) AS g_{name}_{i}, "
        f"count(*) FILTER (WHERE good = 0 AND {num}::DOUBLE / {den} >= {c}) AS b_{name}_{i}"
        for name, num, den, cuts in RULES for i, c in enumerate(cuts))
    tests = "\n  UNION ALL ".join(
        f"SELECT c.stratum, '{name}' AS rule, {i} AS i, {c}::DOUBLE AS cut, g_{name}_{i} AS g, b_{name}_{i} AS b, n, n_bad, k_max "
        f"FROM counts c JOIN allowed a ON c.stratum = a.stratum" for name, _, _, cuts in RULES for i, c in enumerate(cuts))
    verdict = " AND ".join(
        f"NOT coalesce(m.{num}::DOUBLE / m.{den} >= (SELECT cut FROM chosen x WHERE x.stratum = m.stratum AND rule = '{name}'), false)"
        for name, num, den, _ in RULES)
    return rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, '=' || lang AS lang_key, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents
), grams AS (
  SELECT r, i, words[i:i+4] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM texts)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS c FROM repeated, (SELECT unnest(range(5)) AS o) GROUP BY r
), m AS (
  SELECT doc_id, coalesce(lang_key, '') AS stratum, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (r)
), based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
), lab AS (
  SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), counts AS (
  SELECT stratum, count(*) FILTER (WHERE good = 1) AS n, count(*) FILTER (WHERE good = 0) AS n_bad,
    {counts}
  FROM based JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY stratum
), ks AS (
  SELECT stratum, n, unnest(range(0, ceil(n * {ALPHA / len(RULES)})::BIGINT + 1)) AS k FROM counts
), pmf AS (
  SELECT stratum, k, exp(sum(CASE WHEN k = 0 THEN 0 ELSE ln((n - k + 1) / k::DOUBLE) END) OVER (PARTITION BY stratum ORDER BY k)
         + k * ln({ALPHA / len(RULES)}) + (n - k) * ln(1 - {ALPHA / len(RULES)})) AS p FROM ks
), tails AS (
  SELECT stratum, k, sum(p) OVER (PARTITION BY stratum ORDER BY k) AS tail FROM pmf
), allowed AS (
  SELECT stratum, coalesce(max(k) FILTER (WHERE tail <= {DELTA} / ((SELECT count(*) FROM counts) * {len(RULES)})), -1) AS k_max
  FROM tails GROUP BY stratum
), tests AS (
  {tests}
), chosen AS (
  SELECT stratum, rule, cut FROM (
    SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, i) AS place FROM (
      SELECT *, b::DOUBLE / greatest(n_bad, 1) - {GOOD_WEIGHT} * g / greatest(n, 1) AS gain FROM tests WHERE g <= k_max))
  WHERE place = 1 AND gain > 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {verdict} AS kept
FROM based m
"""


QUALITY_SQL = _sql()
