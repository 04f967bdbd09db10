"""Hard negatives, fill-in-middle and URL filters: SQL twins on edge cases, plain versions."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirework.llm import fim, onebit, url_filter


# ------------------------------------------------------------------ op11
def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rank int, score double, key string")


@pytest.fixture(scope="module")
def vector_rows():
    rng = random.Random(4)
    near = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in near], i % 4, 0, 0.0, "k") for i in range(0, 320)]
    rows += [(400 + i, rows[8][1], i % 2, 1, None, None) for i in range(60)]                    # one frequent vector
    rows += [(200, near, 1, 0, 0.0, "k"), (200, near, 1, 0, 0.0, "k"), (200, rows[3][1], None, 0, 0.0, "k"), (None, near, 2, 0, 0.0, "k"),
             (None, near, 2, 0, 0.0, "k"), (None, near, 0, 0, 0.0, "k"), (500, None, 0, 0, 0.0, "k"), (600, [1.0, None] * 6, 0, 0, 0.0, "k"),
             (800, [float("nan")] * 12, 0, 0, 0.0, "k"), (900, [float("inf")] * 12, 0, 0, 0.0, "k"), (1000, [], 3, 0, 0.0, "k"),
             (1001, [], 3, 0, 0.0, "k"), (1002, [], 1, 0, 0.0, "k"), (1100, [0.5, 2.0], 3, 0, 0.0, "k"), (1101, [2.0, 1.0], 3, 0, 0.0, "k"),
             (1102, [1.0, 0.25], 5, 0, 0.0, "k"), (1200, [0.0] * 12, 2, 0, 0.0, "k"), (-100, [-3.0] * 12, 2, 0, 0.0, "k"),
             (1300, [3.0], 9, 0, 0.0, "k")]
    return rows


def test_hard_negatives(spark, vector_rows, same_as_sql):
    vectors = vectors_of(spark, vector_rows)
    got = same_as_sql(onebit.mining_report(vectors), onebit.MINING_SQL, embeddings=vectors)
    assert len(got) > 200
    assert onebit.mining_report(vectors.filter(F.lit(False))).count() == 0
    assert onebit.mining_report(vectors.withColumn("label", F.lit(None).cast("int"))).count() == 0
    assert onebit.mining_report(vectors.withColumn("label", F.lit(1)).filter("coalesce(vec_id, 1) % 7 <> 0")).count() == 0


def test_hard_negatives_in_small_blocks(spark, vector_rows, monkeypatch):
    vectors = vectors_of(spark, vector_rows)
    want = sorted(map(tuple, onebit.mining_report(vectors).collect()), key=repr)
    monkeypatch.setattr(onebit.build_index, "__defaults__", (150,))
    monkeypatch.setattr(onebit.searched, "__defaults__", (30,))
    assert sorted(map(tuple, onebit.mining_report(vectors).collect()), key=repr) == want


def test_hard_negatives_move_anchors_without_a_broadcast(spark, vector_rows, monkeypatch):
    """Anchors times blocks is no table that the driver may gather, however small the anchors are by
    themselves; of all blocks at a place an anchor gets k rows."""
    rows = onebit.quantised(vectors_of(spark, vector_rows))
    index, anchors = onebit.build_index(rows, 150), rows.filter(F.col("id") % 100 == 0)
    assert index.count() > 20
    want = sorted(map(tuple, onebit.positives(index, anchors, 3).collect()), key=repr)
    monkeypatch.setattr(onebit, "HELD_BLOCKS", 1000)
    monkeypatch.setattr(onebit, "PLACES_PER_CORE", 0)          # one place

    def answer(blocks, anchor):
        yield anchor["key"], len(blocks)

    pairs = onebit.searched(index, anchors.select(F.struct("key", "label", "q").alias("anchor")), answer, "key bigint, blocks bigint")
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    held = [tuple(r) for r in pairs.collect()]
    assert len(held) == anchors.count() and max(n for _, n in held) > 16
    assert sorted(map(tuple, onebit.positives(index, anchors, 3).collect()), key=repr) == want


@pytest.mark.parametrize("width, spread", [(1, 9), (3, 200), (64, 60), (100, 3000), (130, 1)])
def test_intervals_hold_every_score(width, spread):
    rng = np.random.default_rng(width)
    values = rng.integers(-spread, spread + 1, (300, width)) + rng.integers(-spread, spread + 1, width)
    block = onebit.Block.build(width, np.arange(300), np.arange(300), np.zeros(300, bool), np.zeros(300, np.int64), values)
    block = onebit.Block.unpack(width, *block.pack())
    narrower = 0
    for vector in [*values[:20], *rng.integers(-spread, spread + 1, (20, width)), np.zeros(width, np.int64)]:
        low, high = block.intervals(onebit.Asked(vector))
        scores = values @ vector
        assert (low <= scores).all() and (scores <= high).all()
        turned = onebit.rotated(vector[None, :])
        assert int((turned ** 2).sum()) == int((vector ** 2).sum()) * turned.shape[1]
        limit = np.sqrt((values ** 2).sum(axis=1)) * np.sqrt((vector ** 2).sum())
        narrower += (high - low < 2 * limit).sum()
    assert narrower > 0.9 * 300 * 40


def test_search_equals_sorting():
    rng = np.random.default_rng(8)
    values = rng.integers(-20, 21, (500, 16))
    values[100:140] = values[7]
    ids = np.sort(rng.integers(0, 400, 500))
    block = onebit.Block.build(16, np.arange(500), ids, np.zeros(500, bool), rng.integers(0, 3, 500), values)
    for n in range(40):
        vector = values[n * 7]
        search, scores = onebit.Search(block, vector), block.values @ vector
        for least, most in [(onebit.WORST, onebit.BEST), (100, 400), (0, 0), (-50, 20), (5, 4)]:
            allowed = block.labels != n % 3
            fit = np.flatnonzero(allowed & (scores >= least) & (scores <= most))
            want = fit[np.lexsort((fit, -scores[fit]))][:10]
            assert search.first(allowed, least, most, 10) == [(int(r), int(scores[r])) for r in want]


def test_large_values_are_scored_exactly():
    values = np.array([[1 << 29, 3], [(1 << 29) - 1, 5], [1, 1]])
    block = onebit.Block.build(2, np.arange(3), np.arange(3), np.zeros(3, bool), np.zeros(3, np.int64), values)
    got = onebit.Search(block, np.array([1 << 29, 7])).first(np.ones(3, bool), onebit.WORST, onebit.BEST, 3)
    assert got == [(0, (1 << 58) + 21), (1, (1 << 58) - (1 << 29) + 35), (2, (1 << 29) + 7)]
    with pytest.raises(ValueError):
        onebit.Search(block, np.array([1 << 40, 7])).first(np.ones(3, bool), onebit.WORST, onebit.BEST, 3)


def test_window_of():
    for score in range(-50, 50):
        least, most = onebit.window_of(score, 30, 90)
        for s in range(-60, 60):
            assert (least <= s <= most) == (30 * score <= 100 * s <= 90 * score)


# ------------------------------------------------------------------ op12
@pytest.fixture(scope="module")
def marked(spark, docs, doc_rows):
    extra = [(100 + i, t, "en", "b", None, None, None, None, None, None, None, None) for i, t in enumerate(
        ["has <P> in it", "<S>", "x<M>", "<P", "<<P<S<M" * 9, "é", "\U0001f600日本e\u0301\x00" * 20, "a", "<" * 40, ">" * 41])]
    return docs.unionByName(spark.createDataFrame(extra * 2, docs.schema))


def test_fill_in_middle(marked, same_as_sql):
    got = same_as_sql(fim.fim_report(marked), fim.FIM_SQL, documents=marked)
    assert {r[1] for r in got} == {"plain", "psm", "spm"}
    assert fim.fim_report(marked.filter(F.lit(False))).count() == 0


def test_fill_in_middle_and_back(marked):
    clash = marked.withColumn("how", F.lit(1)).withColumn("n", F.lit("n"))
    out = fim.transformed(clash)
    assert out.columns == [*clash.columns, "fim_form"]
    back = fim.untransformed(out).drop("fim_form")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, clash.na.fill("", ["text"]).collect()))
    sums = {(r["doc_id"], r["n"]): r for r in fim.fim_report(marked).collect()}
    for r in out.collect():
        want = sums[r["doc_id"], len(r["text"]) - (9 if r["fim_form"] != "plain" else 0)]
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want["output_sha256"]
    spaced = fim.Sentinels("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    other = fim.transformed(clash, marks=spaced, fim_percent=100, spm_percent=50, seed=7)
    assert sorted(map(repr, fim.untransformed(other, marks=spaced).drop("fim_form").collect())) == sorted(map(repr, back.collect()))


def test_pieces():
    rng = random.Random(6)
    marks = fim.Sentinels()
    for _ in range(300):
        text = "".join(rng.choice("a<PSM>é日\U0001f600") for _ in range(rng.randint(1, 30)))
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
        raw = memoryview(text.encode())
        for form, want in (("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")):
            pieces = fim.arranged(raw, a, b, form, marks)
            out = b"".join(fim.stream(pieces, (raw, memoryview(marks.buffer()))))
            assert out.decode() == want
            assert b"".join(fim.stream(fim.restored(out, form, marks), (memoryview(out),))).decode() == text


def test_byte_offsets_across_steps(monkeypatch):
    monkeypatch.setattr(fim, "STEP", 5)
    text = "aé日\U0001f600" * 20
    raw = memoryview(text.encode())
    assert [fim.byte_offset(raw, p) for p in range(len(text) + 1)] == [len(text[:p].encode()) for p in range(len(text) + 1)]


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aa", "b", "c"), ("<P>", "S<", "<M>")])
def test_sentinels_that_could_arise_by_chance(marks):
    with pytest.raises(ValueError):
        fim.Sentinels(*marks)


# ------------------------------------------------------------------ op13
URLS = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://a.net/x", "http://xnet/", "HTTP://A.NET/En/?q://b.org/fr/",
        "http://.net/", "http://a..net/", "http://net./", "http://example.net/en/", "http://www.Example.NET/en/5#t", "http://example.net/en",
        "http://badexample.net/en/1", "http://example.com/de/1", "http://m.example.com/de/?x", "http://example.com/deu/", "http://x.org/fr/a",
        "http://x.org/fr", "http://org/fr/", "http://a.org?/fr/", "http://a.org#/fr/", "x://u@example.com/de/://net/", "http://a.net:80/en/",
        "http://ÄÖ.NET/É\n/x", "http://" + "a." * 3000 + "net/" + "y" * 30000, "http://\nnet/", "https://example.com/de/ /"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "<p>", "r", "v") for i, u in enumerate(URLS)] + [(3, URLS[7], None, None, None), (None, URLS[7], None, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string, best string")


def test_url_filter(pages, same_as_sql):
    same_as_sql(url_filter.url_report(pages), url_filter.URL_SQL, pages=pages)
    assert url_filter.url_report(pages.filter(F.lit(False))).count() == 0
    none = url_filter.judged(pages, url_filter.rule_table(pages.sparkSession).filter(F.lit(False))).collect()
    assert len(none) == len(URLS) + 2 and {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


def plain_verdict(url, rules):
    """Scan of the whole list."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = (0, 0, None)
    for key in rules:
        h, _, p = key.partition("/")
        p = "/" + p if "/" in key else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(key), len(h), key))
    return best[2], rules.get(best[2], "allow")


@pytest.mark.parametrize("part_keys", [1 << 20, 60])
def test_url_filter_with_a_long_list(spark, part_keys):
    """Several levels, and several parts, against a scan of the list."""
    rng = random.Random(9)
    hosts = [f"{a}.{b}{n}.{c}" for a in "uvw" for b in ("shop", "blog") for n in range(30) for c in ("com", "net")]
    rules = {}
    for _ in range(200):
        host = rng.choice(hosts)
        host = host if rng.random() < 0.4 else host.split(".", rng.randint(1, 2))[-1]
        rules[host + rng.choice(["", "/", "/p", "/path/", f"/path/{rng.randint(0, 9)}"])] = rng.choice(["block", "allow"])
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/path', '/path/'])}{n % 10}" for n in range(4000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    listed = [*rules.items(), (None, "block"), ("WWW.Twice.example/", "allow"), ("www.twice.example/", "block")]
    got = url_filter.judged(pages, url_filter.rule_table(spark, listed), part_keys=part_keys).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {n: plain_verdict(u, rules) for n, u in enumerate(urls)}


def test_a_key_listed_both_ways_is_blocked(spark):
    pages = spark.createDataFrame([(1, "http://www.twice.example/x")], "page_id bigint, url string")
    rules = url_filter.rule_table(spark, [("WWW.Twice.example/", "allow"), ("www.twice.example/", "block")])
    assert [tuple(r)[3:] for r in url_filter.judged(pages, rules).collect()] == [("www.twice.example/", "block")]


def test_cascade_is_exact_and_small(spark):
    keys = url_filter.with_hashes(spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("key")))
    listed = keys.filter("key LIKE '%7'").filter("key LIKE 'k1%'")
    n = listed.count()
    cascade = url_filter.build_cascade(listed, keys.union(keys), n, 60_000)
    rows = keys.toPandas()
    has = cascade.has(rows["h1"].to_numpy(), rows["h2"].to_numpy())
    assert len(cascade.levels) > 3 and cascade.size() < 4 * n
    assert sorted(rows["key"][has]) == sorted(r["key"] for r in listed.collect())
