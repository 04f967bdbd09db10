"""Rows and tables that the n-gram join and the suffix dedup make on their way."""
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wirework.llm import common, ngram_join, suffix_dedup
from wirework.session import ensure_checkpoint_dir


def test_token_sets_of_odd_texts(monkeypatch):
    """Words cut from whole batches: no window crosses texts, whatever the blocks."""
    texts = [None, "", " \n\t", "one", "A b", "four words are here", "a b c d e", "A B c d\x0be f a b c d e", "x" * 400,
             "ab " * 60, "a\u0085b c\x1cd e f g h i j k", "É é " + "y" * 64 + " " + "y" * 65 + " q r s", "last"]
    for block in (1, 50, 1 << 18):
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
        for column in (pa.array(texts), pa.array(texts).slice(3), pa.array([], pa.string())):
            want = []
            for t in column.to_pylist():
                w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
                want.append(len({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
            assert [len(s) for s in ngram_join.token_sets(column)] == want
    x, y, z = ngram_join.token_sets(pa.array(["One two three four five six", "zero one TWO three four five", "one two\nthree  four five"]))
    assert np.intersect1d(x, y).tolist() == z.tolist() == np.intersect1d(x, z).tolist()


def test_forest_and_first_meetings():
    rng = np.random.default_rng(1)
    for _ in range(100):
        k = int(rng.integers(2, 30))
        c, x, y = rng.integers(0, 12, k) + 100, rng.integers(0, k, 60), rng.integers(0, k, 60)
        x, y = x[c[x] != c[y]], y[c[x] != c[y]]
        cost = rng.integers(0, 5, len(x))
        root, want = {v: v for v in c.tolist()}, []
        for t in np.argsort(cost, kind="stable").tolist():
            a, b = root[int(c[x[t]])], root[int(c[y[t]])]
            if a != b:
                root = {v: b if r == a else r for v, r in root.items()}
                want.append(t)
        assert sorted(ngram_join.forest(x, y, cost, c).tolist()) == sorted(want)
        lists = [np.unique(rng.integers(0, 40, rng.integers(0, 6))) for _ in range(k)]
        plain = [t for t in range(len(x)) if not np.intersect1d(lists[x[t]], lists[y[t]]).size]
        assert sorted(ngram_join.met_first(x, y, lists).tolist()) == plain


def test_a_signature_gives_fewer_nearest_pairs_than_sets(spark):
    """Copies with many signatures in common: a forest of rows, not one for each pair and signature."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in range(40)]
    posts = spark.createDataFrame([(sig, len(s), k, k) for sig in range(5) for k, s in enumerate(sets)], "sig long, n long, sid long, c long")
    whole = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "sid long, tokens binary")
    every = {tuple(r) for r in ngram_join.similar_pairs(posts, whole).collect()}
    near = [tuple(r) for r in ngram_join.similar_pairs(posts, whole, nearest=True).collect()]
    assert len(near) == len(sets) - 1 and set(near) <= every
    assert {k for p in near for k in p} == set(range(len(sets))) and len(every) > 300


def test_finished_tables_and_shuffles_go(spark, docs):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, setting = set(os.listdir(folder)), spark.conf.get(common.SHUFFLE_CLEANUP, "false")
    report = suffix_dedup.dedup_report(docs)
    made = {re.sub("^wirework-|-[0-9a-f]{32}$", "", n) for n in set(os.listdir(folder)) - before if n.startswith("wirework-")}
    assert made == {"dedup-base", "removed"}
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == setting
    assert report.agg(F.count(F.lit(1))).first()[0] == docs.count()
