"""Operators that SQL doesn't express, against plain versions."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from wirework.llm import bpe, sharding, suffix_dedup, toxicity, unigram

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_dedup(rows):
    key = lambda i: (1 << 63) - 1 if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            g = b[p:p + 50]
            least[g] = min(least.get(g, 1 << 63), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p:p + 50]] < key(i):
                gone[p:p + 50] = b"\1" * 50
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, left))
    return out


def test_suffix_dedup(docs, no_docs, doc_rows):
    want = plain_dedup([r[:2] for r in doc_rows])
    got = sorted(map(tuple, suffix_dedup.dedup_report(docs).collect()), key=repr)
    assert got == sorted(((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want), key=repr)
    assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.dedup_report(no_docs).count() == 0
    texts = suffix_dedup.remove_repeats(docs)
    assert texts.columns == docs.columns
    left = Counter(w[4].decode("utf-8", "ignore") for w in want if w[2])
    left.pop("", None)
    assert Counter((r["text"] or "") for r in texts.collect()) == left + Counter(w[4].decode() for w in want if not w[2])


def test_suffix_dedup_of_runs(spark):
    """Long runs of one letter and periodic texts, where suffixes are much alike."""
    texts = ["a" * 300, "a" * 120 + "b", "b" + "a" * 90, "ab" * 200, "ba" * 80, "\x00" * 70, "\x00" * 60 + "z", "é" * 40, "x" + "é" * 60]
    rows = list(enumerate(texts))
    got = sorted(map(tuple, suffix_dedup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == [(*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in plain_dedup(rows)]


def test_suffix_dedup_of_a_hot_line(spark, monkeypatch):
    """A line in many contexts: no sort takes more than SORT_BYTES of one minimizer."""
    rng = random.Random(5)
    other = lambda n: "".join(rng.choice("aeioustrn ") for _ in range(n))
    line = "the very common line that a third of all documents hold, "
    rows = [(i, other(60) + (line if i % 3 else line[:40]) + other(60) + " " * (i % 70)) for i in range(120)]
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 2000)
    taken, judged = [], suffix_dedup.judged

    def watched(parts, tasks):
        taken.extend(parts.groupBy("mkey").agg(F.sum(F.octet_length("bytes")).alias("t")).collect())
        return judged(parts, tasks)

    monkeypatch.setattr(suffix_dedup, "judged", watched)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted(map(tuple, suffix_dedup.dedup_report(docs).collect()))
    assert got == [(*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in plain_dedup(rows)]
    assert taken and max(r["t"] for r in taken) <= 2000


def test_suffix_dedup_with_all_minimizers_hot(docs, doc_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 1)
    got = sorted(map(tuple, suffix_dedup.dedup_report(docs).collect()), key=repr)
    assert got == sorted(((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in plain_dedup([r[:2] for r in doc_rows])), key=repr)


def test_two_stage_order():
    rng = random.Random(3)
    for _ in range(200):
        n, letters = rng.choice([1, 5, 40, 300]), rng.choice([b"a", b"ab", b"abc\x00\xff"])
        d = bytes(rng.choice(letters) for _ in range(n))
        wanted = np.array([rng.random() < rng.choice([0.3, 1]) for _ in range(n)])
        order = suffix_dedup.two_stage_order(np.frombuffer(d, np.uint8), wanted).tolist()
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        keys = [(*d[i:i + 50], *((256,) if i + 50 > n else ())) for i in order]
        assert keys == sorted(keys)


def test_token_counts(docs, no_docs, doc_rows):
    vocab = unigram.vocabulary(PIECES)
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    want = sorted((str(r[0]), len(t.encode(r[1] or "").ids)) for r in doc_rows)
    assert sorted((str(r[0]), r[1]) for r in unigram.token_counts(docs, PIECES).collect()) == want
    assert unigram.token_counts(no_docs, PIECES).count() == 0
    counter = unigram.Counter(vocab, remember=5)
    for text in ("a  b", "\n \n a", "▁x ▁", "日本語\U0001f600 <s> <0x0A>", "abc" * 500):
        assert counter.text(text) == len(t.encode(text).ids)


def test_token_counts_ties():
    """Equal scores: the longest last piece wins, which shows in the count."""
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("bb", -2.0)]
    t = Tokenizer(models.Unigram(pieces, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    counter = unigram.Counter(pieces)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 12)))
        assert counter.text(text) == len(t.encode(text).ids), text


def test_bpe(docs, no_docs, doc_rows):
    t = Tokenizer.from_file(BPE_FILE)
    want = []
    for r in doc_rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encoding_report(docs, BPE_FILE).collect()) == sorted(want)
    assert bpe.encoding_report(no_docs, BPE_FILE).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, BPE_FILE), BPE_FILE)
    assert Counter(r["text"] for r in back.collect()) == Counter(r[1] or "" for r in doc_rows)


def test_bpe_joins():
    """Cuts anywhere: within words, in texts without white space, between odd spaces."""
    t, codec = Tokenizer.from_file(BPE_FILE), bpe.Codec(BPE_FILE, reuse_bytes=50_000)
    rng = random.Random(1)
    parts = [" ", "a", "b", "\n", "'s", "1", "é", "  ", "!", "日", "\t", "\x1c", " "]
    texts = ["".join(rng.choice(parts) for _ in range(9000)) for _ in range(15)]
    texts += ["ab" * 9000, "日本語" * 4000, " " * 9000, "!\x1c \x85\x0b " * 2500, texts[0][:4000] + texts[1]]
    for x in texts:
        assert codec.encode(x) == t.encode(x, add_special_tokens=False).ids
    again = bpe.Codec(BPE_FILE)
    assert again.encode(texts[0]) and again.encode("one more word, " + texts[0]) and again.reused > 0


def test_sharding(docs, no_docs, doc_rows, spark):
    shards = 5
    got = sharding.shard_documents(docs, shards).collect()
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == Counter(
        (str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in doc_rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sharding.shard_documents(no_docs).count() == 0


def test_sharding_brings_copies_together(spark):
    rows = [(i, f"text {i // 3}" if i < 90 else f"alone {i}") for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    of = {r["doc_id"]: r["shard"] for r in got}
    apart = sum(len({of[3 * g], of[3 * g + 1], of[3 * g + 2]}) > 1 for g in range(30))
    assert apart <= 3


def test_quotas_keep_counts():
    granted, back = sharding.quotas({(0, 1): 5, (1, 0): 2, (2, 1): 4}, {0: 9, 1: 3, 2: 0}, 3)
    change = Counter()
    for (i, j), n in [*granted.items(), *back.items()]:
        change[i] -= n
        change[j] += n
    assert not any(change.values())
    assert back.get((1, 0), 0) + back.get((1, 2), 0) <= 3


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(4)
    bad = ["blorg", "snarkel", "vexil"]
    rows = []
    for i in range(1500):
        words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_on_held_out(toxic_docs):
    labels = toxic_docs.filter("doc_id % 2 = 0").select("doc_id", "toxic")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(toxic_docs.drop("toxic"), labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in toxic_docs.collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert len(got) == 1500
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i]["predicted"] for i in held if truth[i]) >= 0.95 * sum(truth[i] for i in held)
    assert sum(got[i]["predicted"] for i in held if not truth[i]) <= 0.02 * len(held)
    assert all(got[i]["predicted"] == (got[i]["score"] >= 0.3) and 0 <= got[i]["score"] <= 1 for i in got)


def test_toxicity_never_reads_held_out_labels(toxic_docs):
    """Turning round the labels of the held-out fold changes nothing."""
    docs, labels = toxic_docs.select("doc_id", "text"), toxic_docs.select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_report(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_edge_cases(docs, no_docs, spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_report(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.0}
    assert toxicity.toxicity_report(no_docs, none).count() == 0
    few = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id bigint, toxic int")
    assert toxicity.toxicity_report(docs, few).count() == docs.count()


def test_toxicity_finds_rare_marks_among_many_common_names(spark):
    """More than 50,000 names are more frequent in positives than the toxic words."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    pool, marks = [word() for _ in range(9000)], [word() for _ in range(12)]
    rows = []
    for i in range(720):
        words = rng.sample(pool, 5000) + (rng.sample(marks, 5) if i % 8 == 0 else [])
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    data = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(8)
    model = toxicity.fit(data, data.filter("doc_id < 480").select("doc_id", "toxic"))
    assert set(marks) <= set(model.names)
    score = model.scorer()
    assert all((score(t) >= toxicity.THRESHOLD) == bool(toxic) for i, t, toxic in rows if i >= 480)


def test_toxicity_trains_on_weaker_names(spark):
    """A few positives, whose words are in excess, but none for sure."""
    marks = ["mordwort", "hasswort", "schimpf"]
    rows = [(i, f"wort satz text {i} {['eins', 'zwei', 'drei'][i % 3]}" + (f" {marks[i // 8 % 3]}" if i % 8 == 0 else ""), int(i % 8 == 0))
            for i in range(72)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    score = toxicity.fit(data, data.select("doc_id", "toxic")).scorer()
    assert min(score(t) for _, t, toxic in rows if toxic) > max(score(t) for _, t, toxic in rows if not toxic) > 0


def test_toxicity_counts_a_copied_text_once(toxic_docs, spark):
    """A toxic text with thousands of copies keeps its marks; the other words' model
    is that of the corpus without the copies."""
    hot = [(0, "wort satz hotmark mordwort", 1)] * 3000
    marks = [(i, f"satz text {i} hotmark " + "abc"[i % 3], 1) for i in range(1000, 1012)]
    few = toxic_docs.unionByName(spark.createDataFrame(marks + hot[:1], "doc_id bigint, text string, toxic int"))
    many = few.unionByName(spark.createDataFrame(hot[1:], "doc_id bigint, text string, toxic int")
                           .withColumn("doc_id", F.monotonically_increasing_id() + 100_000))
    a, b = (toxicity.fit(x.select("doc_id", "text"), x.select("doc_id", "toxic")) for x in (few, many))
    assert "hotmark" in b.names and a.names == b.names
    assert np.allclose(a.weights, b.weights)
    assert b.scorer()(hot[0][1]) >= toxicity.THRESHOLD


def test_risk_is_corrected_by_the_prior():
    """Positives hidden in the unlabelled part don't drag their feature down."""
    rows = [np.array([0])] * 50 + [np.array([0])] * 30 + [np.array([1])] * 270
    positive = np.array([True] * 50 + [False] * 300)
    w = toxicity.train(rows, positive, 0.1, 2)
    assert w[0] + w[-1] > 0.5 and w[1] + w[-1] < -0.5


def test_copies_count_once_without_their_texts(spark, monkeypatch):
    """Counts over all rows, corrected by one row of each group of copies, equal those of distinct texts."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["blorg", "vexil", "calm", "sunny", "rain"]) + str(rng.randint(0, 3)) for _ in range(12)) for _ in range(60)]
    rows = [(n, t, n % 5 == 0) for n, t in enumerate(texts * 2 + texts[:7] * 40 + [None, "", None])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(n, int(t)) for n, _, t in rows[:60]], "doc_id bigint, toxic int")
    counted, count = [], toxicity.feature_counts

    def watched(d, names):
        out = count(d, names)
        if names:
            counted.append({r["feature"]: r["n"] for r in out.collect()})
        return out

    monkeypatch.setattr(toxicity, "feature_counts", watched)
    toxicity.fit(docs, labels)
    features = toxicity.Features(None)
    want = Counter(f for t in set(texts) for f in features(t))
    assert counted and all(got == {f: want[f] for f in got} for got in counted)
