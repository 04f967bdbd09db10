"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled.  With
the class prior p the risk of a classifier g is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)]),

an estimate that corrects the unlabelled part for the toxic documents hidden in it;
while that part is negative the step goes the other way, which keeps the classifier
from fitting single positives.  The prior is the share of toxic texts among the
labelled ones.  Copies of a text count once in the prior, the counts and the sample.  Several linear numpy classifiers are trained on samples of their own,
each in a Spark task, and their probabilities averaged.

Features are words and the first 4 to 9 letters of words, present or not.  Those
that occur in positives are counted over all documents (a partial count per task),
and the ones with the clearest excess in positives are kept, however rare; where no
excess is sure, the weaker names are.  Copies are left out of the counts by their keys: texts
are not shuffled but for those that have copies.  Bounded are the training sample
(``MAX_POSITIVE``, ``MAX_UNLABELLED``), of whose positives the names are taken, and
the names of a classifier (``MAX_FEATURES``); counts and prior cover every
text, scores every document.

Defined cases: NULL and empty texts have no features and get the score of the bias;
without a positive, or a name in excess, every score is 0; labels with NULL values are ignored, and a
document labelled more than once, and a text with several documents, is toxic if any
label says so; a NULL id counts as
the empty text for the fold; repeated rows are scored each; an empty table gives no
rows; lang, source, ids and labels are never features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, order_hash

# --- parameters ---
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8, 9)
MAX_POSITIVE = 20_000       # documents of the training sample
MAX_UNLABELLED = 40_000
MAX_FEATURES = 4_096        # features of the classifiers
MIN_POSITIVE = 3            # positives that hold a feature, at least
MIN_SHARE = 0.6             # of the documents with a feature, estimated to be toxic
CHANCE = 0.01               # that any chosen feature is in excess by chance
MEMBERS = 3
STEPS = 400
REMEMBERED_WORDS = 400_000
# ------------------

_WORD = re.compile(r"[^\W\d_]+")


class Features:
    """The numbers of the features of a text."""

    def __init__(self, names: list[str] | None):
        self.index = None if names is None else {n: i for i, n in enumerate(names)}
        self.known: dict[str, tuple] = _Known(self)

    def of_word(self, word: str) -> tuple:
        names = [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]
        if self.index is None:
            return tuple(names)
        return tuple(self.index[n] for n in names if n in self.index)

    def __call__(self, text: str | None) -> set:
        if not text:
            return set()
        words = set(_WORD.findall(text.lower()))
        return set(chain.from_iterable(map(self.known.__getitem__, words)))


class _Known(dict):
    """Features of words met, emptied when full."""

    def __init__(self, features: Features):
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> tuple:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        out = self[word] = self.features.of_word(word)
        return out


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def feature_counts(docs: DataFrame, names: list[str] | None) -> DataFrame:
    """``feature``, ``n``: documents (column text) that hold each feature, each counted
    ``times`` if there is such a column; all features when ``names`` is None."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, total = Features(names), Counter()
        for b in batches:
            for t, times in zip(b["text"], b["times"]):
                if times == 1:
                    total.update(features(t))
                else:
                    total.update(dict.fromkeys(features(t), times))
            if names is None and len(total) > 500_000:
                yield _counted(total, None)
                total = Counter()
        yield _counted(total, names)

    times = F.col("times") if "times" in docs.columns else F.lit(1)
    return docs.select("text", times.cast("bigint").alias("times")).mapInPandas(run, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def _counted(total: Counter, names: list[str] | None) -> pd.DataFrame:
    found = [k if names is None else names[k] for k in total]
    return pd.DataFrame({"feature": pd.Series(found, dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, size: int, steps: int = STEPS,
          rate: float = 0.05, decay: float = 5e-3) -> np.ndarray:
    """Weights (the last one is the bias) of a linear classifier with logistic loss,
    by Adam on the non-negative risk.  ``rows``: feature numbers of each document."""
    lengths = np.array([len(r) for r in rows])
    cols = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    n_pos, n_unl = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[cols], minlength=len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)                                   # loss of the label -1
        unlabelled = soft[~positive].sum() / n_unl - prior * soft[positive].sum() / n_pos
        # derivatives by z: of the loss of label 1, p - 1; of label -1, p
        rest = np.where(positive, -prior * p / n_pos, p / n_unl)
        if unlabelled >= 0:
            g = np.where(positive, prior * (p - 1) / n_pos, 0.0) + rest
        else:
            g = -rest
        grad = np.append(np.bincount(cols, weights=g[owner], minlength=size) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return np.append(w, b)


class Model:
    """Feature names and the weights of each classifier (the last one is the bias)."""

    def __init__(self, names: list[str], weights: list[np.ndarray]):
        self.names, self.weights = names, weights

    def scorer(self):
        features, weights = Features(self.names), np.stack(self.weights) if self.weights else None

        def score(text: str | None) -> float:
            if weights is None:
                return 0.0
            z = weights[:, list(features(text))].sum(axis=1) + weights[:, -1]
            return float(np.mean(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

        return score


def text_key(text: Column) -> Column:
    """The same for equal texts; NULL is an empty text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def divergence(n: Column, m: Column, n_pos: int, found: int) -> Column:
    """How surely a feature is more frequent in positives (n of n_pos) than in all
    documents (m of found): n_pos * KL(p || u), the exponent of the Chernoff bound of
    that many positives by chance."""
    p, u = (F.least(x / F.lit(float(of)), F.lit(1 - 1e-9)) for x, of in ((n, n_pos), (m, found)))
    return F.lit(float(n_pos)) * (p * F.log(p / u) + (1 - p) * F.log((1 - p) / (1 - u)))


def in_excess(docs: DataFrame, seen: DataFrame, n_pos: int, found: int, prior: float, least: float) -> list[str]:
    """The names among ``seen`` (feature, n: positives that hold it) that are pure
    enough and in excess by more than ``least``, the clearest first.  All of ``seen``,
    the names of a bounded sample, goes to the tasks that count ``docs``."""
    names = sorted(r["feature"] for r in seen.select("feature").collect())
    if not names:
        return []
    n, m = F.col("n"), F.col("m")
    rows = seen.join(feature_counts(docs, names).withColumnRenamed("n", "m"), "feature")
    p, u = n / F.lit(float(n_pos)), m / F.lit(float(found))
    rows = rows.filter((F.lit(prior) * p >= F.lit(MIN_SHARE) * u) & (p > u))
    rows = rows.withColumn("excess", divergence(n, m, n_pos, found)).filter(F.col("excess") > least)
    return [r["feature"] for r in rows.orderBy(F.col("excess").desc(), "feature").limit(MAX_FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on ``docs`` (doc_id, text) with the labels (doc_id, toxic) given."""
    toxic = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id"))
             .agg((F.max("toxic") == 1).alias("toxic")))
    # copies of a text are one, toxic if any of them is: the sample, the prior and all
    # counts are of distinct texts
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey"))
    keys = (texts.select("doc_id", "tkey").join(toxic, F.col("doc_id") == F.col("label_id"), "left")
            .groupBy("tkey").agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("copies")))
    keys = materialize(keys, "toxic-keys")
    share = keys.agg(F.count_if("toxic").alias("p"), F.count("toxic").alias("n"), F.count(F.lit(1)).alias("found")).first()
    if not share["p"]:
        return Model([], [])
    prior, found = min(0.99, share["p"] / share["n"]), share["found"]
    u = F.conv(F.substring(order_hash(F.col("tkey"), salt="pu:"), 1, 8), 16, 10).cast("double") / 2.0**32
    marked = keys.filter("toxic").filter(u < min(1.0, MAX_POSITIVE / share["p"])).limit(MAX_POSITIVE).select("tkey")
    # bounded: a key for each positive of the sample
    positive = texts.join(F.broadcast(marked), "tkey", "left_semi").dropDuplicates(["tkey"]).select("text")
    positive = materialize(positive, "toxic-positives")
    n_pos = positive.count()
    if not n_pos:
        return Model([], [])
    # every row counts once, and one of each group of copies takes the others back: so only
    # copied texts are brought together, found by their keys
    copied = materialize(keys.filter("copies > 1").select("tkey", "copies"), "toxic-copies")
    back = (texts.join(copied, "tkey").groupBy("tkey").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
            .select("text", (1 - F.col("copies")).alias("times")))
    distinct = texts.select("text", F.lit(1).cast("bigint").alias("times")).unionByName(back)
    seen = materialize(feature_counts(positive, None).filter(F.col("n") >= MIN_POSITIVE), "toxic-names")
    # Bonferroni over the names tried
    surely = float(np.log(max(seen.count(), 1) / CHANCE))
    # no name occurs in fewer documents than in positives: what can't pass for sure is not counted
    able = seen.filter(divergence(F.col("n"), F.col("n"), n_pos, found) >= surely)
    chosen = in_excess(distinct, able, n_pos, found, prior, surely) or in_excess(distinct, seen, n_pos, found, prior, 0.0)
    if not chosen:
        return Model([], [])
    unlabelled = (texts.select("tkey", "text").filter(u < min(1.0, MAX_UNLABELLED / found))
                  .dropDuplicates(["tkey"]).limit(MAX_UNLABELLED))
    sample = (positive.select("text", F.lit(True).alias("positive"))
              .unionByName(unlabelled.select("text", F.lit(False).alias("positive"))))

    def numbers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(chosen)
        for b in batches:
            yield pd.DataFrame({"positive": b["positive"], "f": [sorted(features(t)) for t in b["text"]]})

    sample = materialize(sample.mapInPandas(numbers, "positive boolean, f array<int>"), "toxic-sample")
    members = sample.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))))

    def learn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # bounded: the training sample; each member leaves out a fifth of it
        pdf = pdf.assign(k=[",".join(map(str, f)) for f in pdf["f"]]).sort_values(["positive", "k"], kind="stable")
        take = np.random.default_rng(int(key[0])).random(len(pdf)) < 0.8
        take |= len(pdf) < 1000
        pdf = pdf[take]
        weights = train([np.asarray(f, np.int64) for f in pdf["f"]], pdf["positive"].to_numpy(), prior, len(chosen))
        return pd.DataFrame({"member": [int(key[0])], "weights": [weights.tolist()]})

    learned = members.groupBy("member").applyInPandas(learn, "member int, weights array<double>")
    return Model(chosen, [np.array(r["weights"]) for r in learned.orderBy("member").collect()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` of every row of ``docs``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [scorer(t) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  Labels of the held-out fold
    are not read by the training."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels.filter(fold(F.col("doc_id")) != HELD_OUT))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
