"""Operators with a DuckDB twin, on edge cases and on empty tables."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirework.llm import bitslice, mixing, ngram_join, quality, warc


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1 - (i % 3 == 0), int(i % 5 == 0)) for i in range(41)] + [(3, 1, 0), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_quality(docs, no_docs, labels, same_as_sql, tmp_path):
    got = same_as_sql(quality.quality_report(docs, labels), quality.QUALITY_SQL, documents=docs, labels=labels)
    assert len(got) == docs.count()
    assert quality.quality_report(no_docs, labels).count() == 0
    assert quality.keep_good(no_docs, labels).columns == docs.columns


def test_quality_certifies_only_with_enough_labels(spark):
    """Symbol-laden documents go once enough good documents are labelled, and no good
    one does; with few labels nothing is certified."""
    rng = random.Random(5)

    def rows(n):
        out = []
        for i in range(n):
            words = [rng.choice("abcdefgh") * rng.randint(2, 6) + str(rng.random()) for _ in range(30)]
            bad = i % 10 == 0
            out.append((i, " ".join(w + "###" if bad else w for w in words), "en", int(not bad)))
        return spark.createDataFrame(out, "doc_id bigint, text string, lang string, quality int")

    for n, caught in ((200, 0), (2500, 250)):
        d = rows(n)
        kept = quality.keep_good(d, d.select("doc_id", "quality"))
        assert kept.filter("quality = 1").count() == n - n // 10
        assert kept.filter("quality = 0").count() == n // 10 - caught


def test_binomial_bound_matches_exact_sums(spark):
    from math import comb

    rows = [("a", 0), ("b", 1), ("c", 500), ("d", 3000)]
    got = quality.most_false_rejections(spark.createDataFrame(rows, "stratum string, n bigint"), 0.01, F.lit(0.02)).collect()
    for r in got:
        total, k = 0.0, -1
        while k < r["n"]:
            total += comb(r["n"], k + 1) * 0.01 ** (k + 1) * 0.99 ** (r["n"] - k - 1)
            if total > 0.02:
                break
            k += 1
        assert r["k_max"] == k, r


def test_mixing(docs, no_docs, same_as_sql):
    got = mixing.mixing_report(docs)
    same_as_sql(got, mixing.MIXING_SQL, documents=docs)
    rows = got.collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mixing_report(no_docs).count() == 0
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == sum(r["taken"] for r in rows)


def test_mixing_without_words(docs):
    assert {r["taken"] for r in mixing.mixing_report(docs.withColumn("text", F.lit(" "))).collect()} == {0}


def test_demand_inverse_inverts_the_integral(spark):
    for schedule in mixing.SCHEDULES:
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
        for r in spark.range(0, 21).select((F.col("id") / 20).alias("u")).withColumn(
                "t", mixing.demand_inverse(F.col("u"), schedule)).collect():
            area = 0.0
            for (t0, v0), (t1, v1) in zip(schedule, schedule[1:]):
                t = min(max(r["t"], t0), t1)
                v = v0 + (v1 - v0) * (t - t0) / (t1 - t0)
                area += (t - t0) * (v0 + v) / 2
            assert abs(area / whole - r["u"]) < 1e-9


def test_ngram_join(docs, no_docs, same_as_sql):
    ids = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    same_as_sql(ngram_join.join_report(ids), ngram_join.JOIN_SQL, documents=ids)
    assert ngram_join.join_report(no_docs).count() == 0
    assert ngram_join.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("limits", [(2, 50, 6), (8, 1 << 24, 1), (4, 1 << 24, 6)])
def test_ngram_join_with_other_classes(docs, same_as_sql, monkeypatch, limits):
    """The result depends neither on the token classes nor on the number of rounds."""
    for name, v in zip(("FREQUENT", "MOST_FREQUENT", "STAR_ROUNDS"), limits):
        monkeypatch.setattr(ngram_join, name, v)
    ids = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    same_as_sql(ngram_join.join_report(ids), ngram_join.JOIN_SQL, documents=ids)


def test_sketches_never_part_linked_sets():
    """Pairs that sketches reject don't link, and unrelated sets are rejected."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 3, 8, 40, 300, 2000, 9000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for change in (0.0, 0.03, 0.1, 0.14, 0.3, 1.0):
            other = rng.integers(0, 1 << 63, int(size * change), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[len(other):], other])))
            sets.append(np.unique(base[len(other):]) if len(other) < size else sets[-1])
    n = np.array([len(s) for s in sets])
    x, y = ngram_join.similar(n, np.arange(len(sets)), np.zeros(len(sets), np.int64), [ngram_join.sketch(s) for s in sets])
    near = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                assert (j, i) in near
            elif not common and min(len(a), len(sets[j])) > 200 and max(len(a), len(sets[j])) < 3000:
                assert (j, i) not in near


@pytest.mark.parametrize("limits", [(512, 4096, 6), (2, 64, 0)])
def test_ngram_join_with_null_ids_and_repeated_rows(docs, monkeypatch, limits):
    """Every row, also NULL ids and repeated ones, against all pairs of sets; with and without hubs."""
    for name, v in zip(("GROUP_BLOCK", "SKETCH_BITS", "STAR_ROUNDS"), limits):
        monkeypatch.setattr(ngram_join, name, v)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 75 * (len(a) + len(sets[j]) - common) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    expected = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == root[i] and rows[k][0] is not None]
        expected.append((doc_id, len(sets[i]), min(ids, default=None)))
    got = [tuple(r) for r in ngram_join.join_report(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_keep_first_keeps_one_of_each_group(docs):
    groups = ngram_join.groups(docs).select("n", "root").collect()
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({g["root"] for g in groups if g["n"]}) + sum(not g["n"] for g in groups)


def test_warc(spark, same_as_sql):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/1 x", big, 0), (9, None, big, 0), (4, "u", big, 0), (2, "u", small, 0), (3, "u", small, 0),
            (5, "u", None, 0), (6, "u", "", 0), (7, "u\r\nWARC-Type: x", "\r\n\r\nWARC/1.1\r\n", 0), (8, "u", "y" * 700_000, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, frame int")
    same_as_sql(warc.archive_report(pages), warc.WARC_SQL, pages=pages)
    assert warc.archive_report(pages.filter(F.lit(False))).count() == 0
    extra = pages.unionByName(spark.createDataFrame([(None, "u", big, 0), (9, "again", big, 0)], pages.schema))
    kinds = sorted((str(r["page_id"]), r["record_type"]) for r in warc.archive_report(extra).collect() if r["payload_bytes"] == 1200)
    assert kinds == [("1", "revisit"), ("4", "revisit"), ("9", "response"), ("9", "response"), ("None", "revisit")]


def test_warc_random_access(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i % 50 + 1)) for i in range(400)],
                                  "page_id bigint, url string, html string")
    index = warc.write_archives(pages, str(tmp_path / "w"), frame_bytes=2000, bundle_bytes=30_000).collect()
    assert len(index) == 400 and max(r["frame"] for r in index) > 1 and len({r["bundle"] for r in index}) > 1
    for r in index[::37]:
        rid, page, url, kind, _, _, _, payload = warc.read_record(r)
        assert (page, url, payload.decode()) == (r["page_id"], f"http://h/{page}", f"page {page} " * (page % 50 + 1))


def test_damaged_frame_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text " * 100)], "page_id bigint, url string, html string")
    r = warc.write_archives(pages, str(tmp_path / "w")).first()
    start, size, plain, check = warc.read_seek_table(r["bundle"])[0]
    with pytest.raises(ValueError):
        warc.read_frame(r["bundle"], start, size, plain, check ^ 1)


def test_top_k(spark, same_as_sql):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(0, 240)]
    rows += [(i, rows[5][1], 1) for i in range(240, 330)]                       # one frequent vector
    rows += [(400, None, 0), (450, [], 0), (500, [1.0, None] * 4, 0), (550, [float("nan")] * 8, 0),
             (600, [float("inf")] * 8, 0), (650, [1.0, 2.0], 0), (50, [rng.uniform(-1, 1) for _ in range(8)], 0), (50, rows[7][1], 0),
             (100, rows[100][1], 0), (60, rows[60][1], 0), (None, rows[50][1], 0), (800, [], 0), (801, [], 0), (700, [0.0] * 8, 0), (751, [2.0, 1.0], 0), (-50, [-3.0] * 8, 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    same_as_sql(bitslice.top_k_report(vectors), bitslice.TOP_K_SQL, embeddings=vectors)
    assert bitslice.top_k_report(vectors.filter(F.lit(False))).count() == 0


def test_top_k_blocks(spark):
    """Small blocks and groups give the same rows as one block."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(n, n // 3 * 2, [rng.randint(-9, 9) for _ in range(5)]) for n in range(300)], "key bigint, id bigint, q array<bigint>")
    asked = rows.filter("id % 20 = 0")
    one = bitslice.top_k(bitslice.build_index(rows), asked)
    many = bitslice.top_k(bitslice.build_index(rows, block_rows=40), asked, query_rows=4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
